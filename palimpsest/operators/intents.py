"""Concurrent changes: what they write and read, gates for readers, moves, and a log of phases that can be resumed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import SnapshotTable
from .temporal import KEY

IN_FLIGHT = ("canonical_applied", "invalidated", "rebuilding")


def read_keys(intents: DataFrame, assertions: DataFrame, bridge: DataFrame) -> DataFrame:
    """seq, read_key (``subject|predicate``) that an intent may change. intents: seq, target (evidence or assertion),
    id, subject_id, predicate (null, or where the assertion is to lie).

    Evidence touches the keys of all assertions that it supports, an assertion its present key and its new one.
    """
    key = F.concat_ws("|", *KEY)
    now = assertions.select(F.col("id").alias("assertion_id"), key.alias("read_key"))
    by_evidence = intents.where("target = 'evidence'").select("seq", F.col("id").alias("evidence_id")).join(bridge, "evidence_id").join(now, "assertion_id")
    present = intents.where("target = 'assertion'").select("seq", F.col("id").alias("assertion_id")).join(now, "assertion_id")
    wanted = intents.where("target = 'assertion' and subject_id is not null and predicate is not null").select("seq", key.alias("read_key"))
    return by_evidence.select("seq", "read_key").unionByName(present.select("seq", "read_key")).unionByName(wanted).distinct()


def gate(reads: DataFrame, keys: DataFrame, phases: DataFrame) -> DataFrame:
    """reads (query_id, read_key) with blocked: the key is among the read keys of an intent that is in flight."""
    protected = keys.join(phases.where(F.col("phase").isin(*IN_FLIGHT)), "seq").select("read_key", F.lit(True).alias("blocked")).distinct()
    return reads.join(protected, "read_key", "left").select("query_id", "read_key", F.coalesce("blocked", F.lit(False)).alias("blocked"))


def moved(assertions: DataFrame, moves: DataFrame) -> DataFrame:
    """assertions with the newest move of each (id, seq, subject_id and/or predicate; null leaves it as it is) applied."""
    newest = moves.groupBy("id").agg(F.max_by(F.struct("subject_id", "predicate"), "seq").alias("m"))
    table = assertions.join(newest, "id", "left")
    return table.select(*[F.coalesce(F.col("m")[c], F.col(c)).alias(c) if c in KEY else F.col(c) for c in assertions.columns])


def revalidated(admitted: DataFrame, promoted: DataFrame) -> DataFrame:
    """seq, n_admitted, n_promoted, changed: read keys at admission against those at promotion."""
    table = admitted.withColumn("a", F.lit(1)).join(promoted.withColumn("p", F.lit(1)), ["seq", "read_key"], "full_outer")
    return table.groupBy("seq").agg(F.count("a").alias("n_admitted"), F.count("p").alias("n_promoted"), F.bool_or(F.col("a").isNull() | F.col("p").isNull()).alias("changed"))


def synced(membership: DataFrame, touched: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to insert, rows to delete) so that the touched keys of membership hold what rows does; the others are
    not looked at."""
    have, want = (x.select(*KEY).distinct().join(touched, KEY, "left_semi") for x in (membership, rows))
    return want.join(have, KEY, "left_anti"), have.join(want, KEY, "left_anti")


PHASES = ("prepared", "canonical_applied", "invalidated", "rebuilt", "finalized")


class RedoLog:
    """One change at a time, phase by phase, each phase a committed version of the log: (seq, phase).

    ``run`` takes up where a lost writer left off: phases that are committed are not done again, and the step of the
    next one must be repeatable, as it may have been done in part.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.table = spark, SnapshotTable(spark, path)

    def phase(self) -> tuple[int, str] | None:
        """The newest change and its phase."""
        log = self.table.read()
        return tuple(log.first()) if log is not None else None

    def in_flight(self) -> bool:
        now = self.phase()
        return now is not None and now[1] != PHASES[-1]

    def _commit(self, seq: int, phase: str) -> None:
        self.table.replace(self.spark.createDataFrame([(seq, phase)], "seq long, phase string").coalesce(1))

    def prepare(self, seq: int) -> None:
        if self.in_flight():
            raise RuntimeError("another change is in flight")
        self._commit(seq, PHASES[0])

    def run(self, steps: dict[str, object]) -> None:
        """steps: phase -> callable that does it, for the phases after prepared; missing ones do nothing."""
        now = self.phase()
        if now is None:
            return
        seq, at = now
        for name in PHASES[PHASES.index(at) + 1 :]:
            if name in steps:
                steps[name]()
            self._commit(seq, name)
