"""The registered queries of this subpackage: each applies one operator to a whole table."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, licenses, mixing, ngram_join, packing, quality, secrets_crf, token_codec, toxicity
from .frames import place


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted for every document. Null doc_id: not held out, never learnt from."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    machine = toxicity.learn(docs, labels, lambda doc_id: ~_held_out(doc_id))
    scored = toxicity.score_toxicity(docs, machine)
    return scored.select("doc_id", _held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id of every document: three-word shingles, similarity of 0.9 or more."""
    return ngram_join.jaccard_components(_table(spark, sf_dir, "documents"), width=3, per_cent=90)


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score: the 20 nearest rows of every row whose vec_id is divisible by 20."""
    return ann.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every document."""
    docs = _table(spark, sf_dir, "documents")
    return secrets_crf.scan_secrets(docs, secrets_crf.learn(docs))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_licenses and licenses (name:start:end:coverage, comma-joined) of every document."""
    found = licenses.scan_licenses(_table(spark, sf_dir, "documents"))
    text = F.transform("licenses", lambda x: F.concat_ws(":", x["license"], x["start"].cast("string"), x["end"].cast("string"), F.format_number(x["coverage"], 4)))
    return found.select("doc_id", F.size("licenses").cast("long").alias("n_licenses"), F.array_join(text, ",").alias("licenses"))


#: domain of a document: three groups of sources
SOURCE_WEIGHTS = [("web", 3), ("books", 2), ("code", 1), ("web/en", 4), ("web/en/src0", 2), ("books/en", 3)]


def source_weights(spark: SparkSession) -> DataFrame:
    """SOURCE_WEIGHTS as a local relation: rows given as a Python list would start a Python daemon and workers of
    their own on every executor."""
    path, weight = zip(*SOURCE_WEIGHTS, strict=True)
    return spark.createDataFrame(pa.table({"path": pa.array(path, pa.string()), "weight": pa.array(weight, pa.int64())}))


def mixing_levels():
    def domain(c):
        number = F.regexp_extract(F.coalesce(c["source"], F.lit("")), "([0-9]+)$", 1)
        return F.when(number == "", "other").when(number.cast("long") % 3 == 0, "web").when(number.cast("long") % 3 == 1, "books").otherwise("code")

    return {"domain": domain, "lang": lambda c: c["lang"], "source": lambda c: c["source"]}


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, epoch: one row for each time that a document is read."""
    weights = source_weights(spark)
    docs = _table(spark, sf_dir, "documents")
    mixed = mixing.mixed(docs, mixing_levels(), weights, fraction=0.5, most_epochs=2, seed=17)
    own = [F.col(f"c{place(docs.columns, x)}").alias(x) for x in ("doc_id", "lang", "source")]
    return mixed.select(*own, F.col("tokens").alias("n_tokens"), "epoch")


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, n_turns, n_logged, chat of every maximal conversation."""
    return chat.render_chat(_table(spark, sf_dir, "conversations"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the base statistics, base_failed, kept (and the other statistics) for every document."""
    docs = _table(spark, sf_dir, "documents")
    return quality.quality_report(docs, quality.learn_decision_list(docs, _table(spark, sf_dir, "labels")))


def op2_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read back from the token file."""
    return token_codec.round_trip(_table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every document in sequences of at most 2048 ids."""
    return packing.pack_along_curve(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_token_ids, op3_secrets, op4_ngram_join, op5_nearest, op6_mixing, op7_chat, op8_quality_rules, op9_packing, op10_licenses)}


def _share_sql(depth: int) -> str:
    """One level of the budget tree: children l0..l<depth> of the nodes of the level above."""
    keys = ", ".join(f"l{i}" for i in range(depth + 1))
    parent = ", ".join(f"l{i}" for i in range(depth)) or "1"
    joined = " AND ".join(f"n{depth - 1}.l{i} = c.l{i}" for i in range(depth)) if depth else "true"
    return f"""
c{depth} AS (
  SELECT c.*, coalesce(w.weight, 1) AS weight, {f'n{depth - 1}.budget' if depth else 'top.budget'} AS above
  FROM (SELECT {keys}, sum(tokens) * 2 AS capacity FROM leaves GROUP BY {keys}) c
  JOIN {f'n{depth - 1}' if depth else 'top'} ON {joined}
  LEFT JOIN w ON w.path = concat_ws('/', {', '.join(f'c.l{i}' for i in range(depth + 1))})),
u{depth} AS (
  SELECT *, row_number() OVER o AS rn, coalesce(sum(capacity) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
         sum(weight) OVER (PARTITION BY {parent}) - coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest_weight
  FROM c{depth} WINDOW o AS (PARTITION BY {parent} ORDER BY CAST(capacity AS DOUBLE) / weight, l{depth})),
f{depth} AS (
  SELECT *, CAST(capacity AS HUGEINT) * rest_weight <= (CAST(above AS HUGEINT) - used) * weight AS is_full FROM u{depth}),
g{depth} AS (SELECT *, min(CASE WHEN NOT is_full THEN rn END) OVER (PARTITION BY {parent}) AS first_rn FROM f{depth}),
h{depth} AS (
  SELECT *, max(CASE WHEN rn = first_rn THEN used END) OVER (PARTITION BY {parent}) AS first_used,
         max(CASE WHEN rn = first_rn THEN rest_weight END) OVER (PARTITION BY {parent}) AS first_left FROM g{depth}),
n{depth} AS (
  SELECT {keys}, CASE WHEN is_full THEN capacity ELSE CAST((CAST(above AS HUGEINT) - first_used) * weight // first_left AS BIGINT) END AS budget
  FROM h{depth})"""


ORACLE_SQL: dict[str, str] = {
    "op6_mixing": f"""
WITH r AS (
  SELECT doc_id, lang, source, coalesce(cast(doc_id AS VARCHAR), '') AS key,
         CASE WHEN regexp_extract(coalesce(source, ''), '([0-9]+)$', 1) = '' THEN 'other'
              WHEN CAST(regexp_extract(source, '([0-9]+)$', 1) AS BIGINT) % 3 = 0 THEN 'web'
              WHEN CAST(regexp_extract(source, '([0-9]+)$', 1) AS BIGINT) % 3 = 1 THEN 'books' ELSE 'code' END AS l0,
         coalesce(lang, '') AS l1, coalesce(source, '') AS l2,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS tokens
  FROM documents),
leaves AS (SELECT l0, l1, l2, CAST(sum(tokens) AS BIGINT) AS tokens FROM r GROUP BY l0, l1, l2),
w AS (SELECT * FROM (VALUES {', '.join(f"('{p}', {n})" for p, n in SOURCE_WEIGHTS)}) v(path, weight)),
top AS (SELECT least(sum(tokens) * 2, CAST(floor(sum(tokens) * 0.5) AS BIGINT)) AS budget FROM leaves),
{",".join(_share_sql(d) for d in range(3))},
plan AS (
  SELECT leaves.*, CASE WHEN tokens = 0 THEN 0 ELSE budget // tokens END AS whole, CASE WHEN tokens = 0 THEN 0 ELSE budget % tokens END AS rest
  FROM leaves JOIN n2 USING (l0, l1, l2)),
o AS (
  SELECT r.doc_id, r.lang, r.source, r.tokens, p.whole, p.rest,
         sum(r.tokens) OVER (PARTITION BY r.l0, r.l1, r.l2 ORDER BY md5('17:' || CAST(p.whole + 1 AS BIGINT) || ':' || r.key) RANGE UNBOUNDED PRECEDING) AS upto
  FROM r JOIN plan p ON r.l0 = p.l0 AND r.l1 = p.l1 AND r.l2 = p.l2),
k AS (SELECT *, CAST(whole + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END AS BIGINT) AS copies FROM o)
SELECT doc_id, lang, source, tokens AS n_tokens, unnest(range(1, copies + 1)) AS epoch FROM k
""",
    "op7_chat": """
WITH t AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
         md5(coalesce(role, '') || chr(31) || coalesce(text, '')) AS tie
  FROM conversations WHERE conv_id IS NOT NULL),
p AS (
  SELECT conv_id, role, text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, tie) AS pos,
         count(*) OVER (PARTITION BY conv_id) AS n,
         string_agg(tie, ',') OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, tie ROWS UNBOUNDED PRECEDING) AS so_far
  FROM t),
w AS (
  SELECT n, so_far, min(conv_id) AS conv_id, count(*) AS n_logged FROM p WHERE pos = n GROUP BY n, so_far),
k AS (
  SELECT conv_id, n, n_logged FROM w
  WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.pos < p.n AND p.pos = w.n AND p.so_far = w.so_far))
SELECT k.conv_id, k.n AS n_turns, k.n_logged,
       string_agg('<|' || p.role || '|>' || chr(10) || p.text || chr(10), '' ORDER BY p.pos) AS chat
FROM k JOIN p ON p.conv_id = k.conv_id GROUP BY k.conv_id, k.n, k.n_logged
""",
}
