"""The work folder that all executors share, and versioned tables in it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where unset, a new temporary folder, in local mode only: on a cluster no folder of one
    machine is seen by the others, so that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="palimpsest-"))
        root = spark.sparkContext.getCheckpointDir()
    return root


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written in the shared folder and read back, so that lineage ends there."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class SnapshotTable:
    """Immutable versions of a table; a version counts once its marker file exists.

    The data of a version is written first and its marker second, so that a writer lost in between leaves the version
    before in force. Readers pin the version that they start with.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def _fs(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def version(self) -> int:
        """The newest committed version; 0 if there is none."""
        fs, where = self._fs(f"{self.path}/committed")
        if not fs.exists(where):
            return 0
        return max([int(s.getPath().getName()) for s in fs.listStatus(where)], default=0)

    def read(self, version: int | None = None) -> DataFrame | None:
        version = self.version() if version is None else version
        return self.spark.read.parquet(f"{self.path}/v{version}") if version else None

    def write(self, df: DataFrame, version: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/v{version}")

    def commit(self, version: int) -> None:
        fs, where = self._fs(f"{self.path}/committed/{version}")
        fs.create(where, True).close()

    def forget(self, version: int) -> None:
        """Removes an old version; its marker stays. Readers that still pin it must be done."""
        if version > 0:
            fs, where = self._fs(f"{self.path}/v{version}")
            fs.delete(where, True)

    def replace(self, df: DataFrame) -> int:
        version = self.version() + 1
        self.write(df, version)
        self.commit(version)
        return version
