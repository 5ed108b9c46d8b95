"""Small helpers shared by the operators: column picking and the shared work folder."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import shared_root

BATCH_BYTES = 8 << 20
FILTER_BITS = 1 << 25  # 4 MB: the proven bound on what a membership filter sends around


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns only, exact case first, whatever other columns the table has.

    Extra columns, also ones whose names differ in case alone or repeat, never make a name ambiguous.
    A column that is missing reads as null.
    """
    have = df.columns
    plain = df.toDF(*[f"c{i}" for i in range(len(have))])

    def one(name: str):
        at = place(have, name)
        return (F.lit(None) if at is None else F.col(f"c{at}")).alias(name)

    return plain.select(*[one(x) for x in names])


def place(names: list[str], name: str) -> int | None:
    """Where a column stands: exact case first, then any case; None if there is none."""
    lower = [x.lower() for x in names]
    return names.index(name) if name in names else lower.index(name.lower()) if name.lower() in lower else None


def staged(df: DataFrame, name: str, **options: str) -> tuple[DataFrame, str]:
    """Writes df as Parquet in the shared folder and reads it back: lineage ends there, and lost executors cost
    no recomputation of what is written. Returns the table and its path."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**{"compression": "zstd", **options}).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Removes a staged table that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def bound_batches(spark: SparkSession) -> None:
    """Lets no Arrow batch between the JVM and Python hold more than about BATCH_BYTES (or one row), from here on and
    for the whole session, since what is returned unevaluated is planned later. A lower bound that is set stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)))
    if now <= 0 or now > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def membership(keys: DataFrame, key: str):
    """A column function: long -> whether the value may be among keys (never a wrong no). The filter is a bitmap of
    FILTER_BITS, whatever the number of keys: with too many of them it lets more through, and nothing is lost."""
    slot = F.pmod(F.col(key), F.lit(FILTER_BITS))
    words = keys.select(F.shiftright(slot, 6).alias("w"), F.expr(f"shiftleft(1L, int(pmod({key}, 64)))").alias("b"))
    found = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()  # FILTER_BITS / 64 rows at most
    table = np.zeros(FILTER_BITS // 64, np.int64)
    table[found.column("w").to_numpy()] = found.column("b").to_numpy()

    @F.arrow_udf(T.BooleanType())
    def held(value: pa.Array) -> pa.Array:
        at = np.mod(value.fill_null(0).to_numpy(zero_copy_only=False), FILTER_BITS)
        return pa.array((table[at >> 6] >> (at & 63)) & 1 == 1)

    return held
