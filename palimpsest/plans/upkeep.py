"""Queries over maintenance, visibility and accounting."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import maintenance as m
from ..operators import temporal as t
from ..sources import tables
from ..streaming import heads

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


_EDGES = """,
own AS (SELECT id AS assertion_id, subject_id, subject_id || ':' || predicate AS key FROM assertions),
met AS (SELECT * FROM own JOIN bridge USING (assertion_id)),
edges AS (
  SELECT 'assertion:' || assertion_id AS s, 'state:' || key AS d FROM own
  UNION SELECT 'assertion:' || assertion_id, 'profile:' || subject_id FROM own
  UNION SELECT 'evidence:' || evidence_id, 'profile:' || subject_id FROM met
  UNION SELECT 'evidence:' || evidence_id, 'support:' || key FROM met
  UNION SELECT 'state:' || key, 'support:' || key FROM own
  UNION SELECT 'support:' || key, 'context:' || key FROM own)
"""


def _edges(spark, sf_dir):
    return m.dependency_edges(tables.assertions(spark, sf_dir), tables.bridge(spark, sf_dir))


@query(f"WITH {tables.SQL}{_EDGES} SELECT s AS source_node, d AS derived_node FROM edges")
def dependency_edges(spark, sf_dir):
    """M4, M8, K2: what is derived from what."""
    return _edges(spark, sf_dir)


@query(f"""WITH RECURSIVE {tables.SQL}{_EDGES},
reach(node) AS (
  SELECT d FROM edges WHERE s IN (SELECT 'evidence:' || id FROM evidence WHERE recorded_seq > (SELECT max(event_id) // 2 FROM events))
  UNION SELECT d FROM reach JOIN edges ON s = node)
SELECT split_part(node, ':', 1) AS kind, node FROM reach""")
def affected_nodes(spark, sf_dir):
    """Everything that the evidence of the log's second half makes stale."""
    changed = tables.evidence(spark, sf_dir).where(F.col("recorded_seq") > _half(spark, sf_dir))
    seeds = changed.select(F.concat(F.lit("evidence:"), "id").alias("node"))
    return m.reachable(_edges(spark, sf_dir), seeds).select(F.split_part("node", F.lit(":"), F.lit(1)).alias("kind"), "node")


@query(f"""WITH {tables.SQL} SELECT evidence_id, count(*) AS refcount, count(DISTINCT subject_id) AS n_subjects, min(subject_id) AS first_subject
FROM bridge JOIN assertions ON id = assertion_id GROUP BY evidence_id""")
def evidence_fanout(spark, sf_dir):
    """The subjects that each piece of evidence reaches, with reference counts."""
    a = tables.assertions(spark, sf_dir).select(F.col("id").alias("assertion_id"), "subject_id")
    met = tables.bridge(spark, sf_dir).join(a, "assertion_id")
    return met.groupBy("evidence_id").agg(F.count("*").alias("refcount"), F.countDistinct("subject_id").alias("n_subjects"), F.min("subject_id").alias("first_subject"))


def _half(spark, sf_dir):
    return F.lit(tables.table(spark, sf_dir, "events").agg(F.expr("max(event_id) div 2")).first()[0])


@query(f"WITH {tables.SQL} SELECT subject_id, predicate, arg_max(id, recorded_seq) AS id, max(recorded_seq) AS recorded_seq FROM assertions GROUP BY ALL")
def upserted_heads(spark, sf_dir):
    """Heads of the log's first half with the second half merged in."""
    a, half = tables.assertions(spark, sf_dir).select(*t.KEY, "id", "recorded_seq"), _half(spark, sf_dir)
    base = t.current_heads(a.where(F.col("recorded_seq") <= half))
    return m.upsert(base, a.where(F.col("recorded_seq") > half), t.KEY, ["recorded_seq", "id"])


@query(f"WITH {tables.SQL} SELECT id, subject_id FROM assertions WHERE recorded_seq % 7 <> 0")
def deleted_assertions(spark, sf_dir):
    """The log without tombstoned assertions."""
    a = tables.assertions(spark, sf_dir)
    return m.delete(a.select("id", "subject_id"), a.where("recorded_seq % 7 = 0"), ["id"])


@query(f"""WITH {tables.SQL}, h AS (SELECT max(event_id) // 2 AS half FROM events),
old AS (SELECT subject_id, predicate, arg_max(id, recorded_seq) AS id FROM assertions, h WHERE recorded_seq <= half GROUP BY ALL),
new AS (SELECT subject_id, predicate, arg_max(id, recorded_seq) AS id FROM assertions GROUP BY ALL)
SELECT *, 'removed' AS change FROM (SELECT * FROM old EXCEPT ALL SELECT * FROM new)
UNION ALL SELECT *, 'added' FROM (SELECT * FROM new EXCEPT ALL SELECT * FROM old)""")
def head_delta(spark, sf_dir):
    """What the second half of the log changes in the heads."""
    a = tables.assertions(spark, sf_dir).select(*t.KEY, "id", "recorded_seq")
    old = t.current_heads(a.where(F.col("recorded_seq") <= _half(spark, sf_dir)))
    return m.difference(old.select(*t.KEY, "id"), t.current_heads(a).select(*t.KEY, "id"))


@query(f"""WITH {tables.SQL}, h AS (SELECT max(event_id) // 32 AS half FROM events),
new AS (SELECT DISTINCT subject_id || ':' || predicate AS key FROM assertions),
old AS (SELECT DISTINCT subject_id || ':' || predicate AS key FROM assertions, h WHERE recorded_seq <= half),
need AS (SELECT unnest(['state:' || key, 'support:' || key, 'context:' || key]) AS node FROM new),
have AS (SELECT unnest(['state:' || key, 'support:' || key, 'context:' || key]) AS node FROM old)
SELECT node FROM need WHERE node NOT IN (SELECT node FROM have)""")
def growth_obligations(spark, sf_dir):
    """Derived nodes that the keys need and that don't exist after the log's first thirty-second part."""
    first = F.lit(tables.table(spark, sf_dir, "events").agg(F.expr("max(event_id) div 32")).first()[0])
    key = F.concat_ws(":", "subject_id", "predicate")
    a = tables.assertions(spark, sf_dir)

    def nodes(rows):
        return rows.select(key.alias("key")).distinct().select(F.explode(F.array(*[F.concat(F.lit(k), "key") for k in ("state:", "support:", "context:")])).alias("node"))

    return nodes(a).join(nodes(a.where(F.col("recorded_seq") <= first)), "node", "left_anti")


@query("""WITH i AS (SELECT 'u' || user_id || '|' || event_type AS write_key, event_id AS seq, event_id % 5 AS base_version FROM events)
SELECT write_key, count(*) AS n, list_reduce([CAST(0 AS BIGINT)] || list(base_version ORDER BY seq), lambda a, x: CASE WHEN a = x THEN a + 1 ELSE a END) AS accepted
FROM i GROUP BY write_key""")
def admission(spark, sf_dir):
    """How many concurrent intents each write key accepts."""
    e = tables.table(spark, sf_dir, "events")
    key = F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("|"), "event_type")
    out = m.admitted(e.select(key.alias("write_key"), F.col("event_id").alias("seq"), (F.col("event_id") % 5).alias("base_version")))
    return out.groupBy("write_key").agg(F.count("*").alias("n"), F.count_if("accepted").alias("accepted"))


@query(f"""WITH {tables.SQL}, h AS (SELECT max(event_id) // 2 AS half FROM events)
SELECT subject_id, count(*) FILTER (before = 0) AS appeared, count(*) FILTER (after = 0) AS silent, count(*) AS n_predicates FROM (
  SELECT subject_id, predicate, count(*) FILTER (recorded_seq <= half) AS before, count(*) FILTER (recorded_seq > half) AS after FROM assertions, h GROUP BY ALL)
GROUP BY subject_id""")
def facet_manifest(spark, sf_dir):
    """H2: predicates that appear in, or stay out of, the second half of a subject's log."""
    half = _half(spark, sf_dir)
    a = tables.assertions(spark, sf_dir).groupBy(*t.KEY).agg(F.count_if(F.col("recorded_seq") <= half).alias("before"), F.count_if(F.col("recorded_seq") > half).alias("after"))
    return a.groupBy("subject_id").agg(F.count_if(F.col("before") == 0).alias("appeared"), F.count_if(F.col("after") == 0).alias("silent"), F.count("*").alias("n_predicates"))


@query(f"""WITH {tables.SQL}, heads AS (SELECT subject_id, predicate, arg_max(id, recorded_seq) AS id FROM assertions GROUP BY ALL)
SELECT h.subject_id, string_agg(DISTINCT e.payload, '; ' ORDER BY e.payload) AS payloads, count(DISTINCT e.id) AS n_evidence
FROM heads h JOIN bridge b ON b.assertion_id = h.id JOIN evidence e ON e.id = b.evidence_id WHERE h.predicate IN ('deadline', 'lives_in') GROUP BY h.subject_id""")
def membership_profile(spark, sf_dir):
    """A subject's profile composed of two chosen facets."""
    chosen = t.current_heads(tables.assertions(spark, sf_dir)).where(F.col("predicate").isin("deadline", "lives_in"))
    met = chosen.select("subject_id", F.col("id").alias("assertion_id")).join(tables.bridge(spark, sf_dir), "assertion_id")
    said = met.join(tables.evidence(spark, sf_dir).select(F.col("id").alias("evidence_id"), "payload"), "evidence_id")
    return said.groupBy("subject_id").agg(F.array_join(F.array_sort(F.collect_set("payload")), "; ").alias("payloads"), F.countDistinct("evidence_id").alias("n_evidence"))


@query(f"WITH {tables.SQL} SELECT predicate, count(*) AS n_rows, CAST(sum(octet_length(encode(subject_id))) AS BIGINT) AS bytes FROM (SELECT DISTINCT subject_id, predicate FROM assertions) GROUP BY predicate")
def membership_stats(spark, sf_dir):
    """Size of the membership rows."""
    rows = tables.assertions(spark, sf_dir).select(*t.KEY).distinct()
    return rows.groupBy("predicate").agg(F.count("*").alias("n_rows"), F.sum(F.octet_length("subject_id")).alias("bytes"))


_COPIES = """WITH c AS (SELECT user_id AS page_id, event_id % 2 AS copy_slot, event_id AS epoch, event_id % 7 AS incarnation, props AS keys FROM events),
k AS (SELECT max(epoch) * 3 // 4 AS committed FROM c),
newest AS (SELECT page_id, arg_max(copy_slot, epoch) AS copy_slot, arg_max(incarnation, epoch) AS incarnation, arg_max(keys, epoch) AS keys, max(epoch) AS epoch
  FROM c, k WHERE epoch <= committed GROUP BY page_id)
"""


def _newest(spark, sf_dir):
    e = tables.table(spark, sf_dir, "events")
    copies = e.select(F.col("user_id").alias("page_id"), (F.col("event_id") % 2).alias("copy_slot"), F.col("event_id").alias("epoch"), (F.col("event_id") % 7).alias("incarnation"), F.col("props").alias("keys"))
    return m.newest_visible(copies, ["page_id"], F.lit(e.agg(F.expr("max(event_id) * 3 div 4")).first()[0]))


@query(_COPIES + "SELECT page_id, copy_slot, epoch, keys FROM newest")
def visible_pages(spark, sf_dir):
    """Newest committed copy of each page."""
    return _newest(spark, sf_dir).select("page_id", "copy_slot", "epoch", "keys")


@query(_COPIES + "SELECT page_id, epoch FROM newest WHERE incarnation = 3")
def visible_descriptors(spark, sf_dir):
    """The newest copy is chosen first, and its identity checked after."""
    return _newest(spark, sf_dir).where("incarnation = 3").select("page_id", "epoch")


@query("""WITH p AS (SELECT o_orderkey AS key, o_orderstatus AS value FROM orders WHERE o_orderkey % 3 <> 0), v AS (SELECT o_orderkey AS key, o_orderstatus AS value FROM orders WHERE o_orderkey % 6 = 0),
k AS (SELECT DISTINCT l_orderkey AS key FROM lineitem)
SELECT k.key, CASE WHEN p.key IS NOT NULL THEN 'primary' WHEN v.key IS NOT NULL THEN 'overflow' ELSE 'miss' END AS tier, coalesce(p.value, v.value) AS value
FROM k LEFT JOIN p USING (key) LEFT JOIN v ON v.key = k.key""")
def two_tier_lookup(spark, sf_dir):
    """Keys looked up in the primary and, only if missing, in the overflow."""
    o = tables.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("value"))
    keys = tables.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key")).distinct()
    return m.two_tier(keys, o.where("key % 3 <> 0"), o.where("key % 6 = 0"))


@query("""SELECT key, count(*) AS copies FROM (SELECT o_orderkey AS key FROM orders UNION ALL SELECT l_orderkey FROM lineitem WHERE l_linenumber = 1) GROUP BY key HAVING count(*) <> 2""")
def placement_audit(spark, sf_dir):
    """Keys that the two stores don't hold once each."""
    a = tables.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"))
    b = tables.table(spark, sf_dir, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("key"))
    return a.unionAll(b).groupBy("key").agg(F.count("*").alias("copies")).where("copies <> 2")


@query("""SELECT o_orderkey, CAST(greatest(0, least(need, 900 - (upto - need))) AS BIGINT) AS served FROM (
  SELECT o_orderkey, need, sum(need) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS upto
  FROM (SELECT o_orderkey, o_custkey, CAST(floor(o_totalprice / 1000) AS BIGINT) AS need FROM orders))""")
def fifo_budget(spark, sf_dir):
    """A bounded budget spent in order within each queue."""
    rows = tables.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.floor(F.col("o_totalprice") / 1000).cast("long").alias("need"))
    return m.allocate(rows, ["o_custkey"], "o_orderkey", "need", 900).select("o_orderkey", F.col("served").cast("long").alias("served"))


@query(f"""WITH {tables.SQL}, r AS (
  SELECT subject_id, predicate, recorded_seq, valid_from, max(coalesce(valid_to, 1000000)) OVER (PARTITION BY subject_id, predicate ORDER BY valid_from, recorded_seq) AS upto FROM assertions),
o AS (SELECT *, lag(upto) OVER (PARTITION BY subject_id, predicate ORDER BY valid_from, recorded_seq) AS reach FROM r)
SELECT subject_id, predicate, count(*) AS n, count(*) FILTER (valid_from <= reach) AS n_overlapping FROM o GROUP BY ALL""")
def interval_overlap(spark, sf_dir):
    """Intervals of a key that begin before an earlier one ends."""
    order = Window.partitionBy(*t.KEY).orderBy("valid_from", "recorded_seq").rowsBetween(Window.unboundedPreceding, -1)
    a = tables.assertions(spark, sf_dir).withColumn("reach", F.max(F.coalesce("valid_to", F.lit(1000000))).over(order))
    return a.groupBy(*t.KEY).agg(F.count("*").alias("n"), F.count_if(F.col("valid_from") <= F.col("reach")).alias("n_overlapping"))


@query("""SELECT level, count(DISTINCT o_orderkey >> CAST(8 * level AS INTEGER)) AS n_nodes, 2 + 2 * 8 + 2 AS lookup_reads FROM orders, range(8) r(level) GROUP BY level""")
def radix_nodes(spark, sf_dir):
    """Nodes that order keys need at each level of an 8 x 8-bit radix map, and the reads of a lookup."""
    o = tables.table(spark, sf_dir, "orders").select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long"))).alias("level"), F.col("o_orderkey").alias("k"))
    nodes = o.select("level", F.expr("shiftright(k, cast(8 * level as int))").alias("node")).distinct()
    return nodes.groupBy("level").agg(F.count("*").alias("n_nodes")).withColumn("lookup_reads", F.lit(2 + 2 * 8 + 2))


@query("""SELECT CAST(('0x' || substr(sha256(CAST(o_orderkey AS VARCHAR)), 15, 2)) AS BIGINT) % 64 AS shard, count(*) AS n FROM orders GROUP BY shard""")
def shard_counts(spark, sf_dir):
    """Orders in each of 64 shards by a SHA-256 of the key."""
    low = F.conv(F.substring(F.sha2(F.col("o_orderkey").cast("string").cast("binary"), 256), 15, 2), 16, 10).cast("long")
    return tables.table(spark, sf_dir, "orders").groupBy((low % 64).alias("shard")).agg(F.count("*").alias("n"))


@query("""WITH o AS (SELECT l_returnflag, l_quantity, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) AS rn, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem)
SELECT l_returnflag, max(l_quantity) FILTER (rn = ceil(0.95 * n)) AS nearest_rank, max(l_quantity) FILTER (rn = 1 + round((n - 1) * 0.95)) AS by_index FROM o GROUP BY l_returnflag""")
def two_percentiles(spark, sf_dir):
    """The 95th percentile by nearest rank and by rounded index, from counts of each value."""
    counts = tables.table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_quantity").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy("l_returnflag").orderBy("l_quantity"))
    table = counts.withColumn("upto", upto).withColumn("n", F.sum("c").over(Window.partitionBy("l_returnflag")))
    rank, index = F.ceil(F.lit(0.95) * F.col("n")), 1 + F.round((F.col("n") - 1) * F.lit(0.95))
    return table.groupBy("l_returnflag").agg(F.min(F.when(F.col("upto") >= rank, F.col("l_quantity"))).alias("nearest_rank"), F.min(F.when(F.col("upto") >= index, F.col("l_quantity"))).alias("by_index"))


@query(f"""WITH {tables.SQL} SELECT subject_id, predicate, n AS history, CAST(floor(2.0 * (3 * n - 2) / (2 * n - 2)) + 1 AS BIGINT) AS break_even
FROM (SELECT subject_id, predicate, count(*) AS n FROM assertions GROUP BY ALL) WHERE n > 1""")
def break_even(spark, sf_dir):
    """How many reads pay for keeping a state (maintenance 3n - 2 at weight 2, reads 2n - 1 against 1)."""
    n = F.col("history")
    rows = tables.assertions(spark, sf_dir).groupBy(*t.KEY).agg(F.count("*").alias("history")).where("history > 1")
    return rows.select(*t.KEY, "history", (F.floor(F.lit(2.0) * (3 * n - 2) / (2 * n - 2)) + 1).cast("long").alias("break_even"))


@query(f"""WITH {tables.SQL} SELECT predicate, count(*) AS n, CAST(sum(CAST('0x' || substr(sha256(subject_id || '|' || id || '|' || object_value), 1, 8) AS BIGINT)) AS BIGINT) AS digest
FROM assertions GROUP BY predicate""")
def table_digest(spark, sf_dir):
    """An order-free digest of a table's rows."""
    row = F.sha2(F.concat_ws("|", "subject_id", "id", "object_value").cast("binary"), 256)
    return tables.assertions(spark, sf_dir).groupBy("predicate").agg(F.count("*").alias("n"), F.sum(F.conv(F.substring(row, 1, 8), 16, 10).cast("long")).alias("digest"))


@query("""WITH RECURSIVE e AS (
  SELECT 'r' || n_regionkey AS s, 'n' || n_nationkey AS d FROM nation UNION SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier),
reach(node, depth) AS (SELECT d, 1 FROM e WHERE s IN (SELECT 'r' || r_regionkey FROM region) UNION SELECT d, depth + 1 FROM reach JOIN e ON s = node)
SELECT node, depth FROM reach""")
def region_reach(spark, sf_dir):
    """M6: what depends on the regions, with its distance."""
    def edge(name, source, derived, a, b):
        return tables.table(spark, sf_dir, name).select(F.concat(F.lit(a), F.col(source).cast("string")).alias("source_node"), F.concat(F.lit(b), F.col(derived).cast("string")).alias("derived_node"))

    edges = edge("nation", "n_regionkey", "n_nationkey", "r", "n").unionByName(edge("customer", "c_nationkey", "c_custkey", "n", "c")).unionByName(edge("supplier", "s_nationkey", "s_suppkey", "n", "s"))
    seeds = tables.table(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("node"))
    return m.reachable(edges, seeds)


@query("""SELECT 'u' || user_id AS subject_id, event_type AS predicate, 'a' || max(event_id) AS id, max(event_id) AS recorded_seq FROM events GROUP BY user_id, event_type""")
def streamed_heads(spark, sf_dir):
    """Heads kept from the event log read as a stream, batch by batch."""
    return heads.heads_of_events(spark, f"{sf_dir}/events.parquet")
