"""Outcomes over many horizons, in long form: one row for each key and horizon, pivoted only at the edge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.coerce import hours_between

#: Horizons in hours, checkpoints of the report, and recheck intervals by age. Fixed values.
HORIZONS = (*range(1, 25), *range(27, 49, 3), *range(60, 169, 12), 336, 504, 672, 840, 1008)
CHECKPOINTS = (2, 4, 6, 12, 24, 48, 72)
INTERVALS = ((24, 2), (48, 6), (168, 12))
LAST_INTERVAL = 168
GRACE = {"cascade": 0.25, "paper": 1.0}


def fold(checks: DataFrame, key: str, first: str, at: str, sold: Column, horizons=HORIZONS, grace: float = 0.25) -> DataFrame:
    """key, hours, sold, evaluated_at for every horizon that some check decides or touches.

    In the order of time: a sale within horizon + grace decides true; a check at or after the horizon that finds the item unsold decides
    false; a later sale leaves the outcome null but evaluated. The first decision stands, later touches only move evaluated_at
    while the outcome is open. Each check is turned into rows of the horizons it touches, and one partial aggregate takes the first decision.
    """
    rows = checks.select(F.col(key).alias("k"), F.col(at).alias("at"), hours_between(F.col(at), F.col(first)).alias("age"), sold.alias("is_sold")).filter("age is not null")
    each = rows.select("*", F.explode(F.array(*map(F.lit, horizons))).alias("hours"))
    within, due = F.col("is_sold") & (F.col("age") <= F.col("hours") + grace), F.col("age") >= F.col("hours")
    verdict = F.when(within, True).when(due & ~F.col("is_sold"), False)
    each = each.filter(within | due).withColumn("v", verdict)
    out = each.groupBy("k", "hours").agg(
        F.min_by("v", F.when(F.col("v").isNotNull(), F.struct("at", (~F.col("v")).alias("x")))).alias("sold"), F.min(F.when(F.col("v").isNotNull(), F.col("at"))).alias("decided"), F.max("at").alias("touched")
    )
    return out.select(F.col("k").alias(key), "hours", "sold", F.coalesce("decided", "touched").alias("evaluated_at"))


def wide(outcomes: DataFrame, key: str, horizons=HORIZONS) -> DataFrame:
    """One row for each key with sold_within_Nh columns; the horizons are given, so no job looks for them."""
    out = outcomes.groupBy(key).pivot("hours", list(horizons)).agg(F.first("sold"))
    return out.select(key, *[F.col(str(h)).alias(f"sold_within_{h}h") for h in horizons])


def matured_precision(items: DataFrame, g: list[str], first: str, sold_at: str, now: Column, hours=CHECKPOINTS) -> DataFrame:
    """For each group and checkpoint: items old enough, those sold within it, and their share; one pass, an aggregate a checkpoint."""
    age, took = hours_between(now, F.col(first)), hours_between(F.col(sold_at), F.col(first))
    aggs = []
    for h in hours:
        aggs += [F.count_if(age >= h).alias(f"m{h}"), F.count_if((age >= h) & (took <= h)).alias(f"s{h}")]
    one = items.groupBy(*g).agg(*aggs)
    return one.select(*g, F.inline(F.array(*[F.struct(F.lit(h).alias("hours"), F.col(f"m{h}").alias("matured"), F.col(f"s{h}").alias("sold"), F.try_divide(f"s{h}", f"m{h}").alias("precision")) for h in hours])))


def sold_hours(items: DataFrame, g: str, first: str, sold_at: str) -> DataFrame:
    """For each group, "hour:count" of sales by whole hours since the start, in order."""
    took = hours_between(F.col(sold_at), F.col(first))
    counts = items.filter(took >= 0).groupBy(g, F.floor(took).alias("h")).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(g).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("h", "n"))), lambda x: F.concat(x["h"].cast("string"), F.lit(":"), x["n"].cast("string"))), " ").alias("sold_hours"))


def window_performance(rows: DataFrame, approach: str, search: str, hours: str, passed: Column, evaluated: Column, sold: Column) -> DataFrame:
    """Passed, evaluated, sold, precision and coverage for each approach and horizon, over each search and __all__ (grouping sets)."""
    kept = rows.filter(passed)
    out = kept.groupingSets([[F.col(approach), F.col(search), F.col(hours)], [F.col(approach), F.col(hours)]], F.col(approach), F.col(search), F.col(hours)).agg(
        F.grouping(search).alias("__g"), F.count(F.lit(1)).alias("passed"), F.count_if(evaluated).alias("evaluated"), F.count_if(evaluated & sold).alias("sold")
    )
    name = F.when(F.col("__g") == 1, "__all__").otherwise(F.col(search)).alias(search)
    return out.select(approach, name, hours, "passed", "evaluated", "sold", F.try_divide("sold", "evaluated").alias("precision"), F.try_divide("evaluated", "passed").alias("coverage"))


def cascade_groups(rows: DataFrame, hours: str, passed: Column, evaluated: Column, sold: Column) -> DataFrame:
    """Three overlapping groups of evaluated rows for each horizon: each row is counted in its groups by exploding their names."""
    names = F.array(F.when(passed, "final_stage2_pass").otherwise("stage1_pass_stage2_reject"), F.lit("all_stage1_pass"))
    each = rows.filter(evaluated).select(F.col(hours).alias("hours"), F.coalesce(sold, F.lit(False)).alias("s"), F.explode(names).alias("group"))
    return each.groupBy("hours", "group").agg(F.count(F.lit(1)).alias("evaluated_count"), F.count_if("s").alias("sold_count")).withColumn("precision", F.col("sold_count") / F.col("evaluated_count"))


def recheck_interval(age: Column) -> Column:
    out = F.when(age.isNull(), 2)
    for end, hours in INTERVALS:
        out = out.when(age < end, hours)
    return out.otherwise(LAST_INTERVAL)


def due(first: Column, last: Column, sold_at: Column, stopped: Column, evaluated_hours: Column, now: Column, horizons=HORIZONS, max_age: float | None = None) -> Column:
    """Whether an item is due for a recheck: by its age's interval, or by a matured horizon that isn't among evaluated_hours (an array)."""
    limit = max_age if max_age is not None else max(horizons)
    age, rest = hours_between(now, first), hours_between(now, last)
    by_interval = (age <= limit) & (last.isNull() | (rest >= recheck_interval(age)))
    open_ = F.exists(F.array(*[F.lit(h) for h in horizons if h <= limit]), lambda h: (h <= age) & ~F.array_contains(F.coalesce(evaluated_hours, F.array().cast("array<int>")), h))
    return first.isNotNull() & sold_at.isNull() & (stopped.isNull() | (F.trim(stopped) == "")) & F.coalesce(by_interval | open_, F.lit(False))


def fast_sale(status: Column, first: Column, sold_at: Column, checked: Column, hours: float = 48) -> Column:
    """1 for a sale within the hours, 0 for a later sale or an item seen unsold at least so old, null for one that can't be judged yet."""
    took, seen = hours_between(sold_at, first), hours_between(checked, first)
    return F.when(F.lower(status) == "sold", (took <= hours).cast("int")).when((F.lower(status) == "active") & (seen >= hours), 0)


def recheck_delay(new: Column, sold: Column, good: Column, fast: Column, window_hours: float = 24, target: float = 4.0, low: int = 900, high: int = 14400, default: int = 3600) -> Column:
    """Seconds until the next scan: the value of recent activity per hour against the target, held to limits."""
    value = (good * 1.0 + fast * 1.5 + sold * 2.0) / window_hours
    return F.when(value > 0, F.least(F.greatest(F.bround(target / value * 3600.0), F.lit(low)), F.lit(high))).otherwise(default).cast("int")
