"""A corpus pipeline of five operators: quality rules, near duplicates, secrets, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; ``run`` writes each stage's
result to the shared folder and reads it back. All but the last return the columns of ``documents``.

All stages share the executors' JVMs and Python workers, which keep much of what they once took: stages that send texts
to Python bound the Arrow batches first, and the packing stage has a smaller memo of segments than the single query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm import mixing, ngram_join, packing, quality, queries, secrets_crf
from palimpsest.llm.frames import bound_batches, staged


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the base rules or the learnt decision list reject."""
    bound_batches(spark)
    rules = quality.learn_decision_list(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_good(docs, rules)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest doc_id) of each group linked by five-word shingles at a similarity of 0.8."""
    bound_batches(spark)
    return ngram_join.keep_one(docs, width=5, per_cent=80)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts."""
    bound_batches(spark)
    return secrets_crf.redact(docs, secrets_crf.learn(docs))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Brings domains, languages and sources to their weights, with four fifths of the tokens and two epochs at most;
    a document that is read twice stands twice."""
    return mixing.mix(docs, queries.mixing_levels(), queries.source_weights(spark), fraction=0.8, most_epochs=2)


def curve_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 ids, neighbours on the curve together."""
    bound_batches(spark)
    return packing.pack_along_curve(docs, memo_bits=20)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("secrets", secrets),
    ("source_mixing", source_mixing),
    ("curve_packing", curve_packing),
]

#: learnt rules and tagging aren't expressible in SQL; tests hold the stages against plain versions
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs, _ = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
