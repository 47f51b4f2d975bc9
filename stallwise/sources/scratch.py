"""Written intermediate tables: they end a lineage, so that any executor can be lost, in a folder that all machines share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names; a temporary folder only where Spark runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        found = spark.conf.get("stallwise.scratch.dir", None) or "file://" + tempfile.mkdtemp(prefix="stallwise-")
        spark.conf.set("stallwise.scratch.dir", found)
    return found.rstrip("/")


class Scratch:
    """Tables of one run. close() deletes them all; a lazy result that reads one must be written or collected first."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{folder(spark)}/{name}-{uuid.uuid4().hex}", 0

    def write(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def close(self) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
