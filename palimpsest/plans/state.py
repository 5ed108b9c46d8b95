"""Queries over the state of keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import temporal as t
from ..sources import tables

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def with_tables(rest: str) -> str:
    return f"WITH {tables.SQL}{rest}"


def _state_sql(condition: str = "true") -> str:
    return f""",
vis AS (SELECT * FROM assertions WHERE {condition}),
hit AS (
  SELECT DISTINCT r.target_assertion_id AS id FROM relations r
  JOIN vis s ON s.id = r.source_assertion_id
  JOIN vis g ON g.id = r.target_assertion_id AND g.subject_id = s.subject_id AND g.predicate = s.predicate
  WHERE r.relation IN ('corrects', 'supersedes')),
judged AS (SELECT vis.*, hit.id IS NOT NULL AS is_defeated FROM vis LEFT JOIN hit ON hit.id = vis.id),
val AS (
  SELECT subject_id, predicate, object_value, min(CASE WHEN NOT is_defeated THEN recorded_seq END) AS seen,
         count(*) FILTER (NOT is_defeated) AS live, count(*) FILTER (is_defeated) AS past
  FROM judged GROUP BY ALL),
cell AS (
  SELECT subject_id, predicate, coalesce(string_agg(object_value, ',' ORDER BY seen) FILTER (live > 0), '') AS vals,
         count(*) FILTER (live > 0) AS n_values, CAST(sum(live) AS BIGINT) AS n_candidates, CAST(sum(past) AS BIGINT) AS n_historical
  FROM val GROUP BY ALL),
state AS (
  SELECT subject_id, predicate,
         CASE WHEN cardinality IS NULL THEN 'unregistered' WHEN n_candidates = 0 THEN 'unknown' WHEN cardinality = 'multi' OR n_values = 1 THEN 'resolved' ELSE 'contested' END AS status,
         CASE WHEN n_candidates > 0 AND (cardinality = 'multi' OR n_values = 1) THEN vals ELSE '' END AS operative,
         n_candidates, n_historical
  FROM cell LEFT JOIN registry USING (predicate))
"""


_ACTIVE = "(valid_from IS NULL OR valid_from <= 10) AND (valid_to IS NULL OR 10 <= valid_to)"
_KNOWN = "recorded_seq <= (SELECT max(event_id) // 4 FROM events)"
_ALL = "SELECT subject_id, predicate, status, operative, n_candidates, n_historical FROM state"


def _known_by(spark, sf_dir):
    """A quarter of the highest sequence: one number from the data."""
    return F.lit(tables.table(spark, sf_dir, "events").agg(F.expr("max(event_id) div 4")).first()[0])


def _state(spark, sf_dir, valid_time=None, recorded_seq=None):
    rows = t.visible(tables.assertions(spark, sf_dir), valid_time, recorded_seq)
    return t.reconcile(rows, tables.relations(spark, sf_dir), tables.registry(spark))


@query(with_tables(_state_sql() + _ALL))
def state_current(spark, sf_dir):
    """State of every key without any as-of."""
    return t.flat(_state(spark, sf_dir))


@query(with_tables(_state_sql(_ACTIVE) + _ALL))
def state_as_of_valid(spark, sf_dir):
    """State at valid time 10."""
    return t.flat(_state(spark, sf_dir, F.lit(10)))


@query(with_tables(_state_sql(_KNOWN) + _ALL))
def state_as_of_known(spark, sf_dir):
    """State as known at a quarter of the log."""
    return t.flat(_state(spark, sf_dir, None, _known_by(spark, sf_dir)))


@query(with_tables(_state_sql(f"{_ACTIVE} AND {_KNOWN}") + _ALL))
def bitemporal_as_of(spark, sf_dir):
    """Both at once."""
    return t.flat(_state(spark, sf_dir, F.lit(10), _known_by(spark, sf_dir)))


@query(with_tables(_state_sql() + "SELECT subject_id, predicate, id FROM judged WHERE is_defeated"))
def defeated_set(spark, sf_dir):
    """Defeated assertions."""
    return t.defeated(tables.assertions(spark, sf_dir), tables.relations(spark, sf_dir))


@query(with_tables(_state_sql() + "SELECT subject_id, predicate, id, object_value FROM judged WHERE NOT is_defeated"))
def candidate_set(spark, sf_dir):
    """What is left."""
    rows = t.judged(tables.assertions(spark, sf_dir), tables.relations(spark, sf_dir))
    return rows.where("not is_defeated").select(*t.KEY, "id", "object_value")


_ROLE = "CASE WHEN is_defeated THEN 'historical' WHEN status = 'contested' THEN 'competing' ELSE 'supporting' END"


@query(with_tables(_state_sql() + f"SELECT subject_id, predicate, id, recorded_seq, {_ROLE} AS role FROM judged JOIN state USING (subject_id, predicate)"))
def state_support(spark, sf_dir):
    """Each assertion's part in its key's state."""
    return t.support(tables.assertions(spark, sf_dir), tables.relations(spark, sf_dir), tables.registry(spark))


_LABEL = """,
ranked AS (
  SELECT subject_id, predicate, id, lead(id) OVER o AS older, row_number() OVER o AS place FROM assertions
  WINDOW o AS (PARTITION BY subject_id, predicate ORDER BY recorded_seq DESC, id DESC)),
named AS (
  SELECT source_assertion_id, target_assertion_id, arg_min(relation, rel_seq) AS relation FROM relations
  WHERE relation IN ('corrects', 'supersedes') GROUP BY ALL),
label AS (
  SELECT subject_id, predicate, id AS newer, older,
         CASE relation WHEN 'corrects' THEN 'correction' WHEN 'supersedes' THEN 'transition' END AS label
  FROM ranked LEFT JOIN named ON source_assertion_id = id AND target_assertion_id = older WHERE place = 1)
"""


@query(with_tables(_LABEL + "SELECT * FROM label"))
def relation_label(spark, sf_dir):
    """How the newest assertion relates to the one before."""
    return t.relation_label(tables.assertions(spark, sf_dir), tables.relations(spark, sf_dir))


@query(with_tables(_state_sql() + _LABEL + """
SELECT subject_id, predicate, status, nullif(operative, '') AS value, label AS relation FROM state LEFT JOIN label USING (subject_id, predicate)"""))
def answers(spark, sf_dir):
    """Status, value and relation."""
    labels = t.relation_label(tables.assertions(spark, sf_dir), tables.relations(spark, sf_dir))
    return t.answers(_state(spark, sf_dir), labels)


@query(with_tables(_state_sql() + """
SELECT DISTINCT subject_id, predicate, evidence_id FROM judged JOIN bridge ON assertion_id = id WHERE NOT is_defeated"""))
def provenance(spark, sf_dir):
    """Evidence behind each state."""
    parts = t.support(tables.assertions(spark, sf_dir), tables.relations(spark, sf_dir), tables.registry(spark))
    return t.provenance(parts, tables.bridge(spark, sf_dir))


@query(with_tables(""" SELECT subject_id, predicate, arg_max(id, recorded_seq) AS id, arg_max(object_value, recorded_seq) AS object_value, max(recorded_seq) AS recorded_seq
FROM assertions GROUP BY ALL"""))
def current_heads(spark, sf_dir):
    """Newest assertion of each key, whatever the relations say."""
    return t.current_heads(tables.assertions(spark, sf_dir)).select(*t.KEY, "id", "object_value", "recorded_seq")


@query(with_tables(f""" SELECT subject_id, predicate, 'resolved' AS status, arg_max(object_value, recorded_seq) AS value, arg_max(id, recorded_seq) AS assertion_id
FROM assertions WHERE {_ACTIVE} GROUP BY ALL"""))
def recency_control(spark, sf_dir):
    """Newest valid assertion, always resolved."""
    return t.recency_answer(t.visible(tables.assertions(spark, sf_dir), F.lit(10)))


@query("""SELECT 'c' || o_custkey AS subject_id, arg_max(o_orderstatus, o_orderkey) AS object_value, max(o_orderkey) AS recorded_seq
FROM orders GROUP BY o_custkey""")
def order_status_heads(spark, sf_dir):
    """Newest order status of each customer."""
    o = tables.table(spark, sf_dir, "orders")
    rows = o.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("subject_id"), F.col("o_orderstatus").alias("object_value"), F.col("o_orderkey").alias("recorded_seq"), F.col("o_orderkey").alias("id"))
    return t.current_heads(rows, ["subject_id"]).select("subject_id", "object_value", "recorded_seq")


@query(with_tables(""" SELECT subject_id, count(*) AS n_predicates, string_agg(predicate, ',' ORDER BY predicate) AS predicates
FROM (SELECT DISTINCT subject_id, predicate FROM assertions) GROUP BY subject_id"""))
def subject_heads(spark, sf_dir):
    """The predicates that each subject has a head for."""
    heads = t.current_heads(tables.assertions(spark, sf_dir))
    return heads.groupBy("subject_id").agg(F.count("*").alias("n_predicates"), F.array_join(F.array_sort(F.collect_set("predicate")), ",").alias("predicates"))


@query(with_tables(_state_sql() + """
SELECT subject_id, predicate, 'ENTITY: ' || subject_id || chr(10) || 'PROPERTY: ' || predicate || chr(10) || 'CURRENT STATUS: ' || status ||
  CASE WHEN operative <> '' THEN chr(10) || 'CURRENT VALUE: ' || replace(operative, ',', ', ') ELSE '' END || chr(10) ||
  'CANDIDATES: ' || n_candidates || ' HISTORICAL: ' || n_historical AS context FROM state"""))
def inspection_context(spark, sf_dir):
    """Context text of each key."""
    return t.inspection(_state(spark, sf_dir))


_QUESTIONS = """,
q AS (
  SELECT o_orderkey AS query_id, 'u' || (o_custkey % (SELECT max(user_id) + 1 FROM events)) AS subject_id,
         ['lives_in','works_at','depends_on','deadline','project_status'][1 + o_orderkey % 5] AS predicate,
         CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey % (SELECT max(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE))) + 1 FROM events) END AS valid_time,
         CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE (SELECT max(event_id) FROM events) * (o_orderkey % 7 + 1) // 8 END AS known_by
  FROM orders)
"""


def _questions(spark, sf_dir):
    """One question an order: a key, a valid time and a knowledge time."""
    most = tables.table(spark, sf_dir, "events").agg(F.max("user_id"), F.max("event_id"), F.max(F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")))).first()
    o = tables.table(spark, sf_dir, "orders")
    names = F.array(*[F.lit(x) for x in ("lives_in", "works_at", "depends_on", "deadline", "project_status")])
    k = F.col("o_orderkey")
    return o.select(
        k.alias("query_id"),
        F.concat(F.lit("u"), (F.col("o_custkey") % F.lit(most[0] + 1)).cast("string")).alias("subject_id"),
        F.get(names, k % 5).alias("predicate"),
        F.when(k % 3 != 0, k % F.lit(most[2] + 1)).alias("valid_time"),
        F.when(k % 4 != 0, F.expr(f"{most[1]}L * (o_orderkey % 7 + 1) div 8")).alias("known_by"),
    )


@query(with_tables(_QUESTIONS + """
SELECT q.query_id, arg_max(a.id, a.recorded_seq) AS id, arg_max(a.object_value, a.recorded_seq) AS object_value, count(*) AS n_visible
FROM q JOIN assertions a USING (subject_id, predicate)
WHERE (valid_time IS NULL OR (valid_from <= valid_time AND (valid_to IS NULL OR valid_time <= valid_to))) AND (known_by IS NULL OR recorded_seq <= known_by)
GROUP BY q.query_id"""))
def batched_as_of(spark, sf_dir):
    """The newest visible assertion for each of many bitemporal questions."""
    met = t.as_of(_questions(spark, sf_dir), tables.assertions(spark, sf_dir))
    best = F.max_by(F.struct("id", "object_value"), F.struct("recorded_seq", "id"))
    return met.groupBy("query_id").agg(best.alias("b"), F.count("*").alias("n_visible")).select("query_id", "b.id", "b.object_value", "n_visible")


@query(with_tables(_state_sql() + """
SELECT predicate, count(*) AS n_keys, count(*) FILTER (status = 'resolved') AS n_resolved, count(*) FILTER (status = 'contested') AS n_contested,
       CAST(sum(2 * (n_candidates + n_historical) - 1) AS BIGINT) AS on_demand_reads, count(*) AS persistent_reads
FROM state GROUP BY predicate"""))
def read_costs(spark, sf_dir):
    """Logical reads on demand (2n - 1 for a linear history) against one read of a kept state."""
    n = F.col("n_candidates") + F.col("n_historical")
    return _state(spark, sf_dir).groupBy("predicate").agg(
        F.count("*").alias("n_keys"),
        F.count_if(F.col("status") == "resolved").alias("n_resolved"),
        F.count_if(F.col("status") == "contested").alias("n_contested"),
        F.sum(2 * n - 1).alias("on_demand_reads"),
        F.count("*").alias("persistent_reads"),
    )


@query(with_tables(_state_sql() + """,
control AS (SELECT subject_id, predicate, arg_max(object_value, recorded_seq) AS value FROM assertions GROUP BY ALL)
SELECT predicate, count(*) AS n, count(*) FILTER (status = 'resolved' AND operative = value) AS exact,
       count(*) FILTER (status <> 'resolved') AS overclaimed
FROM state JOIN control USING (subject_id, predicate) GROUP BY predicate"""))
def recency_score(spark, sf_dir):
    """How often the control is exact, and how often it claims too much."""
    state, control = t.flat(_state(spark, sf_dir)), t.recency_answer(tables.assertions(spark, sf_dir)).select(*t.KEY, "value")
    return state.join(control, t.KEY).groupBy("predicate").agg(
        F.count("*").alias("n"),
        F.count_if((F.col("status") == "resolved") & (F.col("operative") == F.col("value"))).alias("exact"),
        F.count_if(F.col("status") != "resolved").alias("overclaimed"),
    )
