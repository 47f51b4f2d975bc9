"""Streaming forms of the stateful operators. Each has a batch form of the same meaning in operators/."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ..operators.outcomes import HORIZONS


def source(spark: SparkSession, path: str, schema: StructType, kind: str = "parquet", files: int = 64) -> DataFrame:
    """New files of a folder; where the stream stands is in its checkpoint."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).format(kind).load(path)


def first_seen(stream: DataFrame, keys: list[str], ts: str, horizon: str | None = None) -> DataFrame:
    """Each key's first row, once. Without a horizon keys are never forgotten, and the state grows with them; with one they are when the watermark has passed them by it."""
    if horizon is None:
        return stream.dropDuplicates(keys)
    return stream.withWatermark(ts, horizon).dropDuplicatesWithinWatermark(keys)


def sold_by_hour(stream: DataFrame, ts: str, key: str, hit: Column, late: str = "1 hour") -> DataFrame:
    return stream.withWatermark(ts, late).groupBy(F.window(ts, "1 hour").alias("w"), key).agg(F.count_if(hit).alias("sold")).select(F.col("w.start").alias("hour"), key, "sold")


def outcome_fold(stream: DataFrame, key: str, at: str, status: str, grace: float = 0.25, horizons=HORIZONS) -> DataFrame:
    """key, hours, sold, evaluated_at: each horizon's first decision, as checks come in; a key's first row is its start.

    A sale that is first seen beyond a horizon and its grace evaluates it as unknown (a row with a null); a later unsold check may still decide it.

    The state of a key is its start and the horizons decided; late checks inside a batch are taken in the order of time.
    """

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("at", kind="stable")
        start, decided = state.get if state.exists else (rows["at"].iloc[0].value // 1000, 0)
        out = []
        for at_, st in zip(rows["at"], rows["status"], strict=True):
            age = (at_.value // 1000 - start) / 3.6e9
            is_sold = str(st).strip().lower() == "sold"
            for i, h in enumerate(horizons):
                if decided >> i & 1:
                    continue
                verdict = True if is_sold and age <= h + grace else False if age >= h and not is_sold else None
                if verdict is not None:
                    decided |= 1 << i
                if verdict is not None or age >= h:
                    out.append((k[0], h, verdict, at_))
        state.update((start, decided))
        yield pd.DataFrame(out, columns=["key", "hours", "sold", "evaluated_at"]).astype({"sold": object})

    kind = stream.schema[key].dataType.simpleString()
    rows = stream.select(F.col(key).alias("key"), F.col(at).alias("at"), F.col(status).alias("status"))
    return rows.groupBy("key").applyInPandasWithState(run, f"key {kind}, hours int, sold boolean, evaluated_at timestamp", "start long, decided long", "append", GroupStateTimeout.NoTimeout)


def latest_rows(stream: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """The latest row of each key so far (complete or update mode)."""
    rest = [c for c in stream.columns if c not in keys]
    return stream.groupBy(*keys).agg(F.max_by(F.struct(*rest), ts).alias("row")).select(*keys, "row.*")


def upserting(path: str, keys: list[str], ts: str, buckets: int = 64):
    """A foreachBatch function that keeps a Parquet table of the latest row of each key, in buckets of the keys' hash (column __bucket).

    A batch reads and rewrites only the buckets that it has keys of; each is replaced as a whole when the batch commits. A batch that
    runs again gives the same table.
    """

    def run(batch: DataFrame, number: int) -> None:
        from ..operators.identity import latest
        from ..sources.tables import exists, write_table

        spark, fresh = batch.sparkSession, batch.withColumn("__bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        touched = [r[0] for r in fresh.select("__bucket").distinct().collect()]  # buckets at most
        if not touched:
            return
        rows = fresh
        if exists(spark, f"{path}/__bucket=*"):
            rows = spark.read.parquet(path).filter(F.col("__bucket").isin(touched)).unionByName(fresh, allowMissingColumns=True)
        write_table(latest(rows, keys, ts).repartition("__bucket"), path, "__bucket")

    return run


def identity_changes(df: DataFrame, group: str, ts: str, value: str) -> DataFrame:
    """Adds changed: whether value differs from the one before it in its group, in the order of ts."""
    from pyspark.sql import Window

    before = F.lag(value).over(Window.partitionBy(group).orderBy(ts))
    return df.withColumn("changed", before.isNotNull() & (before != F.col(value)))
