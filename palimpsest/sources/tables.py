"""The evidence and assertion tables, derived from the driver's event log; Spark and SQL share every rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: event type -> predicate, cardinality
PREDICATES = {
    "signup": ("lives_in", "single"),
    "view": ("works_at", "multi"),
    "click": ("depends_on", "multi"),
    "purchase": ("deadline", "single"),
    "error": ("project_status", "single"),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def registry(spark: SparkSession) -> DataFrame:
    """predicate, cardinality: a handful of rows."""
    return spark.createDataFrame(sorted(PREDICATES.values()), "predicate string, cardinality string")


def _predicate(c):
    out = F
    for event, (name, _) in PREDICATES.items():
        out = out.when(c == event, name)
    return out


def assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, subject_id, predicate, object_value, recorded_seq, valid_from, valid_to; one row an event.

    Null bounds are open. The value is canonical JSON text.
    """
    e = table(spark, sf_dir, "events")
    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).cast("long")
    k = F.get_json_object("props", "$.k").cast("long")
    return e.select(
        F.concat(F.lit("a"), F.col("event_id").cast("string")).alias("id"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("subject_id"),
        _predicate(F.col("event_type")).alias("predicate"),
        (k % 3).cast("string").alias("object_value"),
        F.col("event_id").alias("recorded_seq"),
        day.alias("valid_from"),
        F.when(F.col("event_id") % 3 != 0, day + F.col("event_id") % 11).alias("valid_to"),
    )


#: what the evidence says, by the event's number k: words with synonyms, names and words of questions
SAYINGS = ("launch delayed", "deadline moved", "vendor reports certified", "target-17 slipped", "revised amount", "person_x says late")


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, payload, source_id, recorded_seq, source_event_time."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k")
    said = F.get(F.array(*[F.lit(x) for x in SAYINGS]), (k.cast("long") % len(SAYINGS)).cast("int"))
    return e.select(
        F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("id"),
        F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit(" "), "event_type", F.lit(" "), said, F.lit(" k"), k).alias("payload"),
        F.col("event_type").alias("source_id"),
        F.col("event_id").alias("recorded_seq"),
        F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).cast("long").alias("source_event_time"),
    )


def bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """assertion_id, evidence_id: an assertion's own evidence, except for one in fifty (that evidence has no assertion,
    that assertion no evidence), and the evidence before it for every tenth."""
    e = table(spark, sf_dir, "events").select("event_id")
    a = F.concat(F.lit("a"), F.col("event_id").cast("string")).alias("assertion_id")
    own = e.where("event_id % 50 <> 7").select(a, F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("evidence_id"))
    more = e.where("event_id % 10 = 0 and event_id > 0").select(a, F.concat(F.lit("e"), (F.col("event_id") - 1).cast("string")).alias("evidence_id"))
    return own.unionByName(more)


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_assertion_id, relation, target_assertion_id, rel_seq: towards the assertion before, of the same key."""
    from pyspark.sql import Window

    a = assertions(spark, sf_dir)
    before = F.lag("id").over(Window.partitionBy("subject_id", "predicate").orderBy("recorded_seq"))
    kind = F.col("recorded_seq") % 20
    name = F.when(kind <= 12, "supersedes").when(kind <= 17, "corrects").when(kind == 18, "contradicts").otherwise("refines")
    rows = a.select(F.col("id").alias("source_assertion_id"), name.alias("relation"), before.alias("target_assertion_id"), F.col("recorded_seq").alias("rel_seq"))
    return rows.where("target_assertion_id is not null")


#: the same tables as DuckDB expressions, for WITH clauses
SQL = """
assertions AS (
  SELECT 'a' || event_id AS id, 'u' || user_id AS subject_id,
         CASE event_type WHEN 'signup' THEN 'lives_in' WHEN 'view' THEN 'works_at' WHEN 'click' THEN 'depends_on'
                         WHEN 'purchase' THEN 'deadline' WHEN 'error' THEN 'project_status' END AS predicate,
         CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) % 3 AS VARCHAR) AS object_value,
         event_id AS recorded_seq, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS valid_from,
         CASE WHEN event_id % 3 <> 0 THEN CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) + event_id % 11 END AS valid_to
  FROM events),
registry AS (
  SELECT * FROM (VALUES ('lives_in','single'),('works_at','multi'),('depends_on','multi'),('deadline','single'),('project_status','single')) r(predicate, cardinality)),
evidence AS (
  SELECT 'e' || event_id AS id, 'u' || user_id || ' ' || event_type || ' ' ||
         ['launch delayed', 'deadline moved', 'vendor reports certified', 'target-17 slipped', 'revised amount', 'person_x says late'][1 + CAST(json_extract_string(props, '$.k') AS BIGINT) % 6] ||
         ' k' || json_extract_string(props, '$.k') AS payload,
         event_type AS source_id, event_id AS recorded_seq,
         CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS source_event_time
  FROM events),
bridge AS (
  SELECT 'a' || event_id AS assertion_id, 'e' || event_id AS evidence_id FROM events WHERE event_id % 50 <> 7
  UNION ALL SELECT 'a' || event_id, 'e' || (event_id - 1) FROM events WHERE event_id % 10 = 0 AND event_id > 0),
relations AS (
  SELECT * FROM (
    SELECT id AS source_assertion_id,
           CASE WHEN recorded_seq % 20 <= 12 THEN 'supersedes' WHEN recorded_seq % 20 <= 17 THEN 'corrects'
                WHEN recorded_seq % 20 = 18 THEN 'contradicts' ELSE 'refines' END AS relation,
           lag(id) OVER (PARTITION BY subject_id, predicate ORDER BY recorded_seq) AS target_assertion_id, recorded_seq AS rel_seq
    FROM assertions) WHERE target_assertion_id IS NOT NULL)
"""
