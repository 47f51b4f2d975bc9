"""A keyed table that several writers change at once without losing each other's rows.

Every version is a folder of Parquet files and a manifest of its number that names the folder. A writer reads a version, writes what it makes of it, and publishes the next
number; of two that publish the same number one fails, for a manifest is never written over, and starts again from the version that won. Readers see whole versions only.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from random import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .tables import delete, upsert


class Conflict(RuntimeError):
    """Another writer was first, more often than the given number of tries."""


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str, schema: StructType, key: str = "cache_key", status: str = "status", allowed: dict[str, set[str]] | None = None):
        """allowed: for each status those that may follow it; none: any may follow any."""
        self.spark, self.path, self.schema, self.key, self.status, self.allowed = spark, path.rstrip("/"), schema, key, status, allowed
        self.hadoop = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.hadoop(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The last version's number; 0 before the first."""
        folder = self.hadoop(f"{self.path}/versions")
        names = [s.getPath().getName() for s in self.fs.listStatus(folder)] if self.fs.exists(folder) else []
        return max((int(n) for n in names if n.isdigit()), default=0)

    def read(self, version: int | None = None) -> DataFrame:
        n = self.version() if version is None else version
        if not n:
            return self.spark.createDataFrame([], self.schema)
        name = self.spark.read.text(f"{self.path}/versions/{n}").first()[0]
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/data/{name}")

    def _publish(self, n: int, name: str) -> bool:
        """Whether version n is ours now. A rename on a shared file system, and a hard link on a local one, fail where the name is taken."""
        part, target = self.hadoop(f"{self.path}/versions/.{name}"), self.hadoop(f"{self.path}/versions/{n}")
        out = self.fs.create(part, True)
        out.write(bytearray(name.encode()))
        out.close()
        try:
            if self.fs.getScheme() != "file":
                return bool(self.fs.rename(part, target))
            paths = self.spark._jvm.java.nio.file
            at = lambda p: self.spark._jvm.java.io.File(p.toUri().getPath()).toPath()
            try:
                paths.Files.createLink(at(target), at(part))
            except Exception as e:
                if "FileAlreadyExistsException" not in str(e):
                    raise
                return False
            return True
        finally:
            self.fs.delete(part, False)

    def commit(self, change: Callable[[DataFrame], DataFrame], tries: int = 30) -> int:
        """Publishes change(last version) and returns its number; change may be called again when another writer was first."""
        for k in range(tries):
            n, name = self.version(), uuid.uuid4().hex
            change(self.read(n)).select(*self.schema.names).write.parquet(f"{self.path}/data/{name}")
            if self._publish(n + 1, name):
                return n + 1
            self.fs.delete(self.hadoop(f"{self.path}/data/{name}"), True)
            time.sleep(min(2.0, 0.05 * 2**k) * random())
        raise Conflict(f"{tries} tries")

    def add(self, rows: DataFrame) -> int:
        """Adds rows whose key isn't there yet; of rows with one key any one."""
        fresh = rows.dropDuplicates([self.key])
        return self.commit(lambda t: t.unionByName(fresh.join(t.select(self.key), self.key, "left_anti"), allowMissingColumns=True))

    def update(self, changes: DataFrame) -> int:
        """Filled values of changes replace those of rows with their keys; unknown keys and columns are left out."""
        known = changes.select(*[c for c in changes.columns if c in self.schema.names])
        return self.commit(lambda t: upsert(t, known.join(t.select(self.key), self.key, "left_semi"), self.key))

    def transition(self, keys: DataFrame, status: str) -> int:
        """Moves the rows of keys (key, and more columns that are set as well) to a status, where it may follow theirs; other rows stay as they are."""
        before = [s for s, then in (self.allowed or {}).items() if status in then]

        def change(t: DataFrame) -> DataFrame:
            may = t if self.allowed is None else t.filter(F.col(self.status).isin(*before) if before else F.lit(False))
            moved = keys.join(may.select(self.key), self.key, "left_semi").withColumn(self.status, F.lit(status))
            return upsert(t, moved, self.key)

        return self.commit(change)

    def remove(self, keys: DataFrame) -> int:
        return self.commit(lambda t: delete(t, keys, self.key))

    def vacuum(self, keep: int = 10) -> None:
        """Deletes all but the last versions; readers of older ones must be done."""
        for n in range(self.version() - keep, 0, -1):
            manifest = self.hadoop(f"{self.path}/versions/{n}")
            if not self.fs.exists(manifest):
                break
            name = self.spark.read.text(manifest.toString()).first()[0]
            self.fs.delete(manifest, False)
            self.fs.delete(self.hadoop(f"{self.path}/data/{name}"), True)
