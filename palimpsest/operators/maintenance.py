"""Keeping derived state fresh: upserts, affected regions, deltas, admission of concurrent intents."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import staged


def upsert(base: DataFrame, changes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """base with the newest change of each key in place of its rows."""
    rest = [c for c in changes.columns if c not in keys]
    newest = changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("n")).select(*keys, "n.*")
    return base.join(newest.select(*keys), keys, "left_anti").unionByName(newest)


def delete(base: DataFrame, tombstones: DataFrame, keys: list[str]) -> DataFrame:
    return base.join(tombstones.select(*keys).distinct(), keys, "left_anti")


def touched_only(rows: DataFrame, touched: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose key is among those touched."""
    return rows.join(touched.select(*keys).distinct(), keys, "left_semi")


ASSERTIONS_A_PLACE = 100_000  #: with up to five edges each, some hundred MB in a hash table


def dependency_edges(assertions: DataFrame, bridge: DataFrame) -> DataFrame:
    """source_node, derived_node: evidence and assertions to profiles and states, states to supports, supports to
    contexts."""
    key = F.concat_ws(":", "subject_id", "predicate")
    own = assertions.select(F.col("id").alias("assertion_id"), "subject_id", key.alias("key"))
    met = own.join(bridge, "assertion_id")

    def edge(table: DataFrame, source: Column, derived: Column) -> DataFrame:
        return table.select(source.alias("source_node"), derived.alias("derived_node"))

    def node(kind: str, column: str) -> Column:
        return F.concat(F.lit(kind + ":"), column)

    keys = own.select("key").distinct()
    edges = [
        edge(own, node("assertion", "assertion_id"), node("state", "key")),
        edge(own, node("assertion", "assertion_id"), node("profile", "subject_id")),
        edge(met, node("evidence", "evidence_id"), node("profile", "subject_id")),
        edge(met, node("evidence", "evidence_id"), node("support", "key")),
        edge(keys, node("state", "key"), node("support", "key")),
        edge(keys, node("support", "key"), node("context", "key")),
    ]
    out = edges[0]
    for more in edges[1:]:
        out = out.unionByName(more)
    # nearly all edges are distinct: they are hashed in the place of their source only, and places grow in number with
    # the table, since strings of a few letters that repeat take up twenty times their bytes on the way
    places = max(int(assertions.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 + assertions.count() // ASSERTIONS_A_PLACE)
    return out.repartition(places, "source_node").distinct()


def reachable(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """node, depth of everything downstream of seeds (column node), seeds not included unless a path leads to them.

    Breadth first: each round joins the frontier with the edges and drops what was met before; the frontier is written
    to the shared folder. Cycles end when nothing new is met.
    """
    edges = staged(edges.select("source_node", "derived_node").distinct(), "edges")
    met = None
    frontier, depth = seeds.select("node").distinct(), 0
    while True:
        depth += 1
        new = edges.join(frontier, edges.source_node == frontier.node).select(F.col("derived_node").alias("node")).distinct()
        if met is not None:
            new = new.join(met.select("node"), "node", "left_anti")
        new = staged(new.withColumn("depth", F.lit(depth)), "frontier")
        if new.isEmpty():
            return met if met is not None else new
        met = new if met is None else met.unionByName(new)
        frontier = new.select("node")


def difference(old: DataFrame, new: DataFrame) -> DataFrame:
    """The rows that a refresh removes and adds (change: removed or added); none if the two agree."""
    gone = old.exceptAll(new).withColumn("change", F.lit("removed"))
    return gone.unionByName(new.exceptAll(old).withColumn("change", F.lit("added")))


def admitted(intents: DataFrame) -> DataFrame:
    """intents (write_key, seq, base_version) with accepted: first come, first served in each write_key, accepted if
    the base version is the number of those accepted before. One pass over sorted partitions in constant memory."""

    def run(batches):
        last, version = None, 0
        for batch in batches:
            keys, base = batch.column("write_key").to_pylist(), batch.column("base_version").to_pylist()
            out = np.zeros(len(keys), bool)
            for k, key in enumerate(keys):
                if key != last:
                    last, version = key, 0
                if base[k] == version:
                    out[k], version = True, version + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*batch.schema.names, "accepted"])

    rows = intents.select("write_key", "seq", "base_version")
    ordered = rows.repartition("write_key").sortWithinPartitions("write_key", "seq")
    return ordered.mapInArrow(run, "write_key string, seq bigint, base_version bigint, accepted boolean")


def allocate(queue: DataFrame, keys: list[str], order: str, need: str, budget: int) -> DataFrame:
    """A first-in, first-out budget for each queue: how much of each entry's need is served."""
    before = F.sum(need).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    served = F.greatest(F.lit(0), F.least(F.col(need), F.lit(budget) - F.coalesce(before, F.lit(0))))
    return queue.withColumn("served", served)


def newest_visible(copies: DataFrame, keys: list[str], committed: Column) -> DataFrame:
    """Of each page's copies the newest one that the committed epoch covers."""
    rest = [c for c in copies.columns if c not in keys]
    kept = copies.where(F.col("epoch") <= committed)
    return kept.groupBy(*keys).agg(F.max_by(F.struct(*rest), "epoch").alias("p")).select(*keys, "p.*")


def two_tier(keys: DataFrame, primary: DataFrame, overflow: DataFrame) -> DataFrame:
    """key, tier, value: primary if it has the key, else overflow, else miss; an overflow row is read for misses only."""
    hit = keys.join(primary, "key").withColumn("tier", F.lit("primary"))
    missed = keys.join(primary.select("key"), "key", "left_anti")
    rest = missed.join(overflow.withColumn("found", F.lit(True)), "key", "left").withColumn("tier", F.when(F.col("found"), "overflow").otherwise("miss"))
    return hit.unionByName(rest.drop("found")).select("key", "tier", "value")
