"""Tables that a job writes for itself, in the folder that the cluster names in spark.checkpoint.dir. Lineage ends at files that outlive
any executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; in local mode without one, a folder of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return f"file://{_LOCAL[0]}"


class Scratch:
    """The tables of one job, in one folder, which ``drop`` deletes."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder = spark, f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Writes ``df`` and reads it back."""
        path = f"{self.folder}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """One table, written and read back."""
    return Scratch(df.sparkSession, name).keep(df, name)
