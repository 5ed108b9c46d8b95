"""Current heads kept fresh from a stream of assertions.

Each micro-batch merges the newest assertion of its keys into a versioned table; order within and across batches does
not matter, since a head is the greatest (recorded_seq, id) whenever it arrives. A batch's version is its number, so a
batch that runs again after a failure writes the same version again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.temporal import KEY, current_heads
from ..sources.shared import SnapshotTable, new_folder


def keep_heads(stream: DataFrame, path: str, checkpoint: str) -> SnapshotTable:
    """Runs over all that the stream's source holds now, then returns the table of heads."""
    spark = stream.sparkSession
    table = SnapshotTable(spark, path)

    def merge(batch: DataFrame, number: int) -> None:
        version = number + 1
        before = table.read(version - 1)
        rows = batch if before is None else before.select(*batch.columns).unionByName(batch)
        table.write(current_heads(rows).select(*batch.columns), version)
        table.commit(version)
        table.forget(version - 2)

    stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return table


def stream_events(spark: SparkSession, path: str) -> DataFrame:
    """An unbounded table over an event log's folder."""
    schema = spark.read.parquet(path).schema
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder = where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory()
    only = path if folder else f"{path[:-1]}[{path[-1]}]"  # a stream reads a folder, or what a pattern matches: this file alone
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(only)


def heads_of_events(spark: SparkSession, path: str) -> DataFrame:
    """Heads of (user, event type) from an event log read as a stream."""
    events = stream_events(spark, path)
    rows = events.select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("subject_id"),
        F.col("event_type").alias("predicate"),
        F.concat(F.lit("a"), F.col("event_id").cast("string")).alias("id"),
        F.col("event_id").alias("recorded_seq"),
    )
    table = keep_heads(rows, new_folder(spark, "heads"), new_folder(spark, "heads-progress"))
    return table.read().select(*KEY, "id", "recorded_seq")
