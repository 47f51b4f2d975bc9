"""Listing state: reconciliation, queues, enrichment, retention, funnels and selections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.coerce import blank_to_null
from .ordered import ranked
from .splits import hash_ranked, time_ranked


def without_known(df: DataFrame, known: DataFrame, *keys: str) -> DataFrame:
    """Rows that match known by none of the keys. One hash anti-join a key: an OR in one join would compare all pairs."""
    return reduce(lambda out, k: out.join(known.select(k).filter(F.col(k).isNotNull()).distinct(), k, "left_anti"), keys, df).select(*df.columns)


def reconcile(old: DataFrame, new: DataFrame, key: str, sold: DataFrame, not_really: DataFrame, refresh: str) -> tuple[DataFrame, DataFrame]:
    """(refreshed: old rows seen again, with the new value of refresh; missing: old rows not seen, neither sold nor known as not really sold)."""
    seen = new.groupBy(key).agg(F.max(refresh).alias("__new"))
    refreshed = old.join(seen, key).withColumn(refresh, F.col("__new")).select(*old.columns)
    missing = old.join(new.select(key), key, "left_anti").join(not_really.select(key), key, "left_anti").join(sold.select(key), key, "left_anti")
    return refreshed, missing.select(*old.columns)


def labelled(df: DataFrame, key: str, *sold: DataFrame, name: str = "sold") -> DataFrame:
    """df with 1 where any of the sold tables has the key, else 0."""
    ids = reduce(DataFrame.unionByName, [s.select(key) for s in sold]).distinct().withColumn("__hit", F.lit(1))
    return df.join(ids, key, "left").withColumn(name, F.coalesce("__hit", F.lit(0))).drop("__hit")


def funnel(sold: DataFrame, key: str, **stages: DataFrame) -> DataFrame:
    """stage, kept (sold keys that it has), recall, lost (sold keys that the stage before had and it hasn't)."""
    base = sold.select(key).distinct()
    for name, stage in stages.items():
        base = base.join(stage.select(key).distinct().withColumn(f"__{name}", F.lit(1)), key, "left")
    aggs, before = [F.count(F.lit(1)).alias("total")], F.lit(True)
    for name in stages:
        here = F.col(f"__{name}").isNotNull()
        aggs += [F.count_if(here).alias(f"kept_{name}"), F.count_if(before & ~here).alias(f"lost_{name}")]
        before = here
    one = base.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(n).alias("stage"), F.col(f"kept_{n}").alias("kept"), F.try_divide(f"kept_{n}", "total").alias("recall"), F.col(f"lost_{n}").alias("lost")) for n in stages])
    return one.select(F.inline(rows))


def balanced(df: DataFrame, label: str, key: str, seed: int) -> DataFrame:
    """All positives and as many negatives, the first in the order of a hash of (key, seed): the same rows each time."""
    positives = df.filter(F.col(label) == 1)
    n = positives.count()
    return positives.unionByName(hash_ranked(df.filter(F.col(label) == 0), [], key, seed).filter(F.col("__r") <= n).drop("__r", "__n"))


def fill_missing(df: DataFrame, source: DataFrame, key: str, columns: list[str], protected: tuple[str, ...] = ()) -> DataFrame:
    """Blank values of df's columns from source (unique by key); protected columns are left as they are."""
    return _merged(df, source, key, [c for c in columns if c not in protected], lambda own, new: F.coalesce(own, new))


def overwrite_filled(df: DataFrame, source: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """df with source's values wherever these aren't blank."""
    return _merged(df, source, key, columns, lambda own, new: F.coalesce(new, own))


def _merged(df, source, key, columns, choose):
    right = source.select(F.col(key).alias("__key"), *[F.col(c).alias(f"__{c}") for c in columns])
    out = df.join(right, df[key] == F.col("__key"), "left")
    value = lambda c: F.when(blank_to_null(F.col(c)).isNotNull(), F.col(c))
    return out.select(*[choose(value(c), value(f"__{c}")).alias(c) if c in columns else F.col(c) for c in df.columns])


def new_columns(df: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """df with those columns of source that it lacks."""
    return df.join(source.select(key, *[c for c in source.columns if c not in df.columns]), key, "left")


def lookup(df: DataFrame, table: DataFrame, value: str, *keys: tuple[str, str]) -> DataFrame:
    """value from table by the first of the (df's, table's) key pairs that hits."""
    out, found = df, []
    for k, (own, other) in enumerate(keys):
        one = table.filter(F.col(other).isNotNull()).groupBy(F.col(other).alias(f"__k{k}")).agg(F.max(value).alias(f"__v{k}"))
        out = out.join(one, out[own] == F.col(f"__k{k}"), "left")
        found.append(F.col(f"__v{k}"))
    return out.select(*df.columns, F.coalesce(*found).alias(value))


def replace_slice(df: DataFrame, fresh: DataFrame, column: str, value) -> DataFrame:
    """df with the rows of one value of a column exchanged for fresh ones."""
    return df.filter(~F.col(column).eqNullSafe(F.lit(value))).unionByName(fresh, allowMissingColumns=True)


def overflow(df: DataFrame, room: int, ts: str, tie: str) -> tuple[DataFrame, DataFrame]:
    """(kept, moved): the oldest rows beyond room are moved, rows without a date last."""
    ranked, old = time_ranked(df, ts, tie), F.col("__r") <= F.col("__n") - room
    return ranked.filter(~old).drop("__r", "__n"), ranked.filter(old).drop("__r", "__n")


def queue_next(df: DataFrame, group: str, *order: str) -> DataFrame:
    """The next row of each group: fewest attempts, longest waiting, missing values last."""
    by = Window.partitionBy(group).orderBy(*[F.col(c).asc_nulls_last() for c in order])
    return df.withColumn("__n", F.row_number().over(by)).filter("__n = 1").drop("__n")


def requeue(df: DataFrame, result: Column, attempts: str) -> DataFrame:
    """After a check: failed ones stay with one attempt more, all others leave."""
    return df.filter(result.isin("FetchFailed", "MissingLink")).withColumn(attempts, F.coalesce(F.col(attempts), F.lit(0)) + 1)


def fresh(df: DataFrame, now: Column, days: int, *ts: str, keep_missing: bool = True) -> DataFrame:
    """Rows whose first filled time is less than days old; rows without one stay or go as told."""
    at = F.coalesce(*ts)
    old = at < now - F.make_dt_interval(F.lit(days))
    return df.filter(at.isNull() | ~old) if keep_missing else df.filter(at.isNotNull() & ~old)


def at_cursor(df: DataFrame, cursor: int, order: str) -> DataFrame:
    """The row at cursor modulo the number of rows, in order."""
    return ranked(df, [], [order]).filter(F.col("__r") == F.pmod(F.lit(cursor), F.col("__n")) + 1).drop("__r", "__n")


def image_accounting(df: DataFrame, search: str, count: str, url: str) -> DataFrame:
    """For each search and __TOTAL__: kept rows (a picture count over 0 or an URL), and rows skipped by reason."""
    has_url = blank_to_null(F.col(url)).isNotNull()
    reason = F.when((F.col(count) > 0) | has_url, "kept").when(F.col(count).isNull(), "no_count").otherwise("no_images")
    out = df.withColumn("__r", reason).rollup(search).agg(
        F.grouping(search).alias("__g"), *[F.count_if(F.col("__r") == r).alias(r) for r in ("kept", "no_count", "no_images")]
    )
    return out.select(F.when(F.col("__g") == 1, "__TOTAL__").otherwise(F.col(search)).alias(search), "kept", "no_count", "no_images")


#: Name parts of columns that tell the future. Fixed values.
LEAKY = ("sold", "status", "evaluated", "outcome", "label", "recheck", "lastcheck", "eventual")


def leak_safe(df: DataFrame, blocked: tuple[str, ...] = LEAKY) -> DataFrame:
    """The columns whose names hold none of the blocked parts."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if not any(b in c.lower() for b in blocked)])


def one_hot(df: DataFrame, column: str, values: list[str], prefix: str) -> DataFrame:
    import re

    name = lambda v: prefix + "__" + re.sub(r"[^a-z0-9]+", "_", v.lower()).strip("_")
    return df.select("*", *[F.coalesce((F.col(column) == v).cast("int"), F.lit(0)).alias(name(v)) for v in values])
