"""Splits and samples, all deterministic: by time, or in the order of a hash of the key and a seed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordered import ranked

#: Shares of training and validation; the rest is test. Fixed values.
TRAIN, VALIDATION = 0.6, 0.2


def time_ranked(df: DataFrame, ts: str, tie: str) -> DataFrame:
    """df with __r, the rank of each row in (ts, tie), rows without a time last, and __n, the number of rows; ranked by pieces of that order, of any type."""
    return ranked(df, [], [ts, tie])


def by_time(df: DataFrame, ts: str, tie: str, train: float = TRAIN, validation: float = VALIDATION) -> DataFrame:
    """Adds split: the first share of rows in time is train, the next validation, the rest test; ties by the tie column."""
    r, n = F.col("__r"), F.col("__n")
    split = F.when(r <= F.floor(n * train), "train").when(r <= F.floor(n * (train + validation)), "validation").otherwise("test")
    return time_ranked(df, ts, tie).select(*df.columns, split.alias("split"))


#: Pieces of a group that are ranked apart, by the first bits of the hash that orders it.
PIECES = 1 << 10


def hash_ranked(df: DataFrame, groups: list[str], key: str, seed: int) -> DataFrame:
    """df with __r, the rank of each row in its group in the order of (hash of key and seed, key), and __n, the group's rows.

    The hash is the first 60 bits of md5(key|seed), which any other engine can give as well.

    A group's rows are counted by pieces of the hash's range, the pieces' offsets are summed in a small window, and rows are ranked
    within pieces only: no task holds a whole group.
    """
    h = F.conv(F.substring(F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(seed).cast("string"))), 1, 15), 16, 10).cast("long")
    rows = df.withColumn("__h", h).withColumn("__b", F.shiftright("__h", 60 - PIECES.bit_length() + 1))
    counts = rows.groupBy(*groups, "__b").agg(F.count(F.lit(1)).alias("__c"))
    of_group = Window.partitionBy(*(groups or [F.lit(1)]))
    before = F.coalesce(F.sum("__c").over(of_group.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    names = [*groups, "__b"]
    offsets = counts.select(*[F.col(c).alias(f"__g{k}") for k, c in enumerate(names)], before.alias("__o"), F.sum("__c").over(of_group).alias("__n"))
    same = [F.col(c).eqNullSafe(F.col(f"__g{k}")) for k, c in enumerate(names)]
    r = F.col("__o") + F.row_number().over(Window.partitionBy(*names).orderBy("__h", key))
    return rows.join(offsets, same).withColumn("__r", r).select(*df.columns, "__r", "__n")


def stratified(df: DataFrame, strata: list[str], key: str, seed: int = 42, train: float = TRAIN, validation: float = VALIDATION) -> DataFrame:
    """Adds split with the same shares in each stratum, in the order of a hash."""
    r, n = F.col("__r"), F.col("__n")
    split = F.when(r <= F.floor(n * train), "train").when(r <= F.floor(n * (train + validation)), "validation").otherwise("test")
    return hash_ranked(df, strata, key, seed).select(*df.columns, split.alias("split"))


def folds(df: DataFrame, label: str, key: str, k: int, name: str = "fold") -> DataFrame:
    """Adds the fold: round robin inside each class, in the order of the key."""
    return ranked(df, [label], [key]).select(*df.columns, ((F.col("__r") - 1) % k).alias(name))


def capped(df: DataFrame, strata: list[str], key: str, most: int, least: int = 1, seed: int = 42) -> DataFrame:
    """A sample of about most rows: every stratum in proportion, but at least least rows of it."""
    quota = F.greatest(F.lit(least), F.floor(F.col("__n") * min(1.0, most / max(df.count(), 1))))
    return hash_ranked(df, strata, key, seed).filter(F.col("__r") <= quota).drop("__r", "__n")


def extremes(df: DataFrame, score: str, key: str, high: int, low: int, seen: DataFrame | None = None) -> DataFrame:
    """The high best and low worst rows not among seen, with cohort; no row is in both."""
    rows = df if seen is None else df.join(seen.select(key), key, "left_anti")
    top = rows.orderBy(F.desc(score), key).limit(high).withColumn("cohort", F.lit("high"))
    rest = rows.join(top.select(key), key, "left_anti")
    return top.unionByName(rest.orderBy(F.asc(score), key).limit(low).withColumn("cohort", F.lit("low")))


def score_tails(df: DataFrame, score: str, low: float, high: float) -> DataFrame:
    reason = F.when(F.col(score) <= low, "low_score").when(F.col(score) >= high, "high_score")
    return df.withColumn("reason", reason).filter("reason is not null")
