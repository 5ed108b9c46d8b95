"""Mixing sources to target weights, with DataFrame operations only.

A budget of tokens flows down a tree (domain, language, source): at each node it is shared among the children by
weight, no child gets more than its documents can give in ``most_epochs`` passes, and what a child cannot use goes to
its siblings by weight; since a node never gets more than its subtree holds, only what a whole family cannot use
reaches the ancestors. A leaf reads its documents in seeded epochs, whole ones first, and the last one up to its
budget, as a prefix in the order of a seeded hash. Shares are whole tokens, rounded down: a node's children together
get less than it does by fewer tokens than it has children.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import discard, place, staged

WORD = "[^\\x20\\x09-\\x0D]+"
BUCKET_ROWS = 2048


def _big(c: Column) -> Column:
    return c.cast("decimal(38,0)")


def share(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Adds ``budget`` to children (columns: parent keys, name, weight, capacity, above = the parent's budget).

    Children in order of capacity for their weight get all they can use until the rest can be shared by weight; whole
    tokens, rounded down.
    """
    family = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    order = family.orderBy(F.col("capacity") / F.col("weight"), name)
    past = order.rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum("capacity").over(past), F.lit(0))
    left = F.sum("weight").over(family) - F.coalesce(F.sum("weight").over(past), F.lit(0))
    table = children.withColumn("used", used).withColumn("left", left)
    full = _big(F.col("capacity")) * _big(F.col("left")) <= (_big(F.col("above")) - _big(F.col("used"))) * _big(F.col("weight"))
    table = table.withColumn("full", full)
    # all children after the first one that is not full share at that one's level
    first = F.min(F.when(~F.col("full"), F.struct(F.col("capacity") / F.col("weight"), name, "used", "left"))).over(family)
    table = table.withColumn("first", first)
    level = F.expr("div((cast(above as decimal(38,0)) - first.used) * weight, cast(first.left as decimal(38,0)))").cast("long")
    return table.withColumn("budget", F.when(F.col("full"), F.col("capacity")).otherwise(level)).drop("used", "left", "full", "first")


def leaf_budgets(leaves: DataFrame, levels: list[str], weights: DataFrame, total: Column, most_epochs: int) -> DataFrame:
    """leaves: levels, tokens, rows. weights: path (levels joined by /), weight (a positive whole number); nodes that
    are not listed weigh 1. Returns leaves with budget."""
    table = leaves.withColumn("capacity", F.col("tokens") * most_epochs)
    above = table.agg(F.least(F.sum("capacity"), total).alias("above"))
    nodes = None
    for depth in range(1, len(levels) + 1):
        keys, parent = levels[:depth], levels[: depth - 1]
        children = table.groupBy(*keys).agg(F.sum("capacity").alias("capacity"))
        path = F.concat_ws("/", *keys)
        children = children.join(weights.select(F.col("path").alias("known_path"), "weight"), path == F.col("known_path"), "left").withColumn("weight", F.coalesce("weight", F.lit(1)).cast("long"))
        children = children.join(nodes, parent) if parent else children.join(F.broadcast(above))  # above: one row
        nodes = share(children, parent, keys[-1]).select(*keys, F.col("budget").alias("above"))
    return leaves.join(nodes.withColumnRenamed("above", "budget"), levels)


class _Columns(dict):
    """The columns of a table by name, exact case first; a missing one reads as null."""

    def __init__(self, names: list[str]) -> None:
        self.names = names

    def __missing__(self, name: str) -> Column:
        at = place(self.names, name)
        return F.lit(None).cast("string") if at is None else F.col(f"c{at}")


def mixed(docs: DataFrame, levels: dict[str, Column], weights: DataFrame, *, fraction: float = 0.5, most_epochs: int = 2, seed: int = 17) -> DataFrame:
    """docs' columns as c0, c1, ... in their order, then epoch and tokens: one row for each time that a document is
    read.

    levels: name -> expression, from the root down; null is a level of its own, written ''. fraction: budget as a
    share of all tokens (words). A document without words costs nothing and is read in whole epochs only, unless its
    hash lies in the prefix. Repeated rows (equal doc_id) stand or fall together, null ids too. No rows: no rows.
    """
    names = list(levels)
    spark, own = docs.sparkSession, docs.columns
    at = _Columns(own)
    plain = docs.toDF(*[f"c{i}" for i in range(len(own))])
    slim_names = [f"l{i}" for i in range(len(names))]
    rows = plain.select("*", *[F.coalesce(e(at).cast("string"), F.lit("")).alias(s) for e, s in zip(levels.values(), slim_names, strict=True)])
    rows = rows.withColumn("key", F.coalesce(at["doc_id"].cast("string"), F.lit("")))
    rows = rows.withColumn("tokens", F.coalesce(F.regexp_count(at["text"], F.lit(WORD)), F.lit(0)).cast("long"))
    slim, slim_path = staged(rows.select(*slim_names, "key", "tokens"), "mixing-rows")

    leaves, leaves_path = staged(slim.groupBy(*slim_names).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("rows")), "mixing-leaves")
    total = F.floor(F.sum("tokens") * F.lit(fraction)).cast("long")
    plan = leaf_budgets(leaves, slim_names, weights, total, most_epochs)
    whole = F.expr("if(tokens = 0, 0, budget div tokens)")
    plan = plan.select(*slim_names, whole.alias("whole"), F.expr("if(tokens = 0, 0, budget % tokens)").alias("rest"), F.ceil(F.col("rows") / BUCKET_ROWS).alias("buckets"))
    plan, plan_path = staged(plan, "mixing-plan")

    # the prefix: find the bucket of the hash order in which it ends, then the last hash inside that bucket
    def ordered(table: DataFrame) -> DataFrame:
        table = table.withColumn("order", F.md5(F.concat_ws(":", F.lit(str(seed)), (F.col("whole") + 1).cast("string"), F.col("key")).cast("binary")))
        place = F.conv(F.substring("order", 1, 8), 16, 10).cast("long")
        return table.withColumn("bucket", F.shiftright(place * F.col("buckets"), 32))

    part = ordered(slim.join(plan, slim_names)).where("rest > 0")
    sums = part.groupBy(*slim_names, "bucket").agg(F.sum("tokens").alias("sum"))
    through = F.sum("sum").over(Window.partitionBy(*slim_names).orderBy("bucket"))
    sums = sums.withColumn("through", through).join(plan.select(*slim_names, "rest"), slim_names)
    edge = sums.where("through > rest and through - sum <= rest").select(*slim_names, "bucket", (F.col("rest") - (F.col("through") - F.col("sum"))).alias("room"))
    edge = edge.withColumn("nth", F.row_number().over(Window.partitionBy(*slim_names).orderBy("bucket"))).where("nth = 1").drop("nth")
    inside = part.select(*slim_names, "bucket", "order", "tokens").join(edge, [*slim_names, "bucket"])
    upto = F.sum("tokens").over(Window.partitionBy(*slim_names, "bucket").orderBy("order").rangeBetween(Window.unboundedPreceding, 0))
    last = inside.withColumn("upto", upto).where("upto <= room").groupBy(*slim_names).agg(F.max("order").alias("last"))
    cuts, _ = staged(plan.join(edge.drop("room"), slim_names, "left").join(last, slim_names, "left").select(*slim_names, "whole", "rest", "buckets", F.col("bucket").alias("edge"), F.col("last")), "mixing-cuts")
    for done in (slim_path, leaves_path, plan_path):
        discard(spark, done)

    chosen = ordered(rows.join(cuts, slim_names))
    takes = (F.col("bucket") < F.col("edge")) | ((F.col("bucket") == F.col("edge")) & F.coalesce(F.col("order") <= F.col("last"), F.lit(False)))
    copies = F.col("whole") + F.when((F.col("rest") > 0) & takes, 1).otherwise(0)
    chosen = chosen.withColumn("copies", copies).where("copies > 0")
    chosen = chosen.withColumn("epoch", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies").cast("long"))))
    return chosen.select(*[F.col(f"c{i}") for i in range(len(own))], "epoch", "tokens")


def mix(docs: DataFrame, levels: dict[str, Column], weights: DataFrame, **options) -> DataFrame:
    """docs' own columns, one row for each time that a document is read (see ``mixed``)."""
    return mixed(docs, levels, weights, **options).drop("epoch", "tokens").toDF(*docs.columns)
