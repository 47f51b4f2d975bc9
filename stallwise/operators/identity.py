"""Identity: deduplication, latest-wins and audits. Every order is total: ties end at the columns the caller names.

Where pandas puts missing sort keys last in rising order, "first" here orders them last and "last" takes them as the
latest, as pandas' drop_duplicates(keep=...) after a sort does.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dedupe(df: DataFrame, keys: list, order: list[str], keep: str = "first", blank: str = "drop") -> DataFrame:
    """One row for each key. blank: what becomes of rows with a null or blank key, "drop", "keep" (all of them) or "group"."""
    key_columns = [F.col(k) if isinstance(k, str) else k for k in keys]
    missing = reduce(lambda a, b: a | b, [k.isNull() | (F.trim(k.cast("string")) == "") for k in key_columns])
    by = [F.col(c).asc_nulls_last() if keep == "first" else F.col(c).desc_nulls_first() for c in order]
    ranked = lambda x: x.withColumn("__n", F.row_number().over(Window.partitionBy(*key_columns).orderBy(*by))).filter("__n = 1").drop("__n")
    if blank == "group":
        return ranked(df)
    kept = ranked(df.filter(~missing))
    return kept if blank == "drop" else kept.unionByName(df.filter(missing))


def dedupe_id_or_link(df: DataFrame, item: str, link: str, order: list[str], keep: str = "first") -> DataFrame:
    """Rows with a numeric id by id, the others by link, together."""
    has = F.col(item).try_cast("double").isNotNull()
    return dedupe(df.filter(has), [F.col(item).try_cast("double")], order, keep, "group").unionByName(dedupe(df.filter(~F.coalesce(has, F.lit(False))), [link], order, keep, "group"))


def with_first_seen(df: DataFrame, keys: list[str], ts: str, name: str = "first_seen") -> DataFrame:
    return df.withColumn(name, F.min(ts).over(Window.partitionBy(*keys)))


def latest(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The latest row for each key by a map-side partial aggregate (max_by): no sort, and a hot key is combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__row"))
    return best.select(*keys, "__row.*").select(*df.columns)


def best_per_key(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")


def duplicate_audit(df: DataFrame, key: Column) -> DataFrame:
    """One row: rows, identity_rows, unique_keys, duplicate_groups, extra_rows, max_group."""
    counts = df.select(key.alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    there = F.col("k").isNotNull()
    return counts.agg(
        F.sum("n").alias("rows"),
        F.sum(F.when(there, F.col("n")).otherwise(0)).alias("identity_rows"),
        F.count_if(there).alias("unique_keys"),
        F.count_if(there & (F.col("n") > 1)).alias("duplicate_groups"),
        F.sum(F.when(there, F.col("n") - 1).otherwise(0)).alias("extra_rows"),
        F.max(F.when(there, F.col("n")).otherwise(0)).alias("max_group"),
    )


def top_duplicates(df: DataFrame, key: Column, n: int) -> DataFrame:
    return df.select(key.alias("key")).filter("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").orderBy(F.desc("n"), "key").limit(n)
