"""Summaries and row updates around collection: cohorts, audits, listing ages, network identities, rechecked status, comparisons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates
from ..functions.coerce import number, truth
from .ordered import quantiles


def collector_summary(df: DataFrame, search: str, cohort: str, sold_at: str, status: str, cohorts: tuple[str, ...] = ("high_score_candidate", "low_score_control")) -> DataFrame:
    """For each search: tracked, sold, full_scrape_success, and the rows of each named cohort (0 where there are none)."""
    c = F.col
    return df.filter(c(search).isNotNull()).groupBy(search).agg(
        F.count(F.lit(1)).alias("tracked"), F.count_if(c(sold_at).isNotNull()).alias("sold"), F.count_if(c(status) == "success").alias("full_scrape_success"),
        *[F.count_if(c(cohort) == name).alias(name) for name in cohorts],
    )


def audit_counts(df: DataFrame, keys: list[str], quality: str) -> DataFrame:
    """Rows of each label quality by source file or other keys; a missing quality is a value of its own."""
    return df.groupBy(*keys, F.coalesce(F.col(quality).cast("string"), F.lit("nan")).alias("label_quality")).agg(F.count(F.lit(1)).alias("rows"))


def label_summary(df: DataFrame, label: str, score: str) -> DataFrame:
    """count, mean, median, std, min and max of a score by label, with its name; a null label is kept."""
    s = F.col(score)
    name = F.when(F.col(label) == 1, "sold").when(F.col(label) == 0, "unsold")
    medians = quantiles(df, [label], s, [0.5]).select(F.col(label).alias("__label"), F.col("q")[0].alias("median"))
    out = df.groupBy(label).agg(F.count(s).alias("count"), F.avg(s).alias("mean"), F.stddev_samp(s).alias("std"), F.min(s).alias("min"), F.max(s).alias("max"))
    return out.join(medians, F.col(label).eqNullSafe(F.col("__label"))).select(label, name.alias("label_name"), "count", "mean", "median", "std", "min", "max")


def upload_distribution(df: DataFrame, search: str, phrase: str, label: str, price: str, likes: str) -> DataFrame:
    """By search and age band of the upload phrase: rows, sold rows and their rate, mean price and likes, median age in days; in the bands' order."""
    days = dates.upload_age_days(F.col(phrase))
    y = F.coalesce(number(F.col(label)).cast("int"), F.lit(0))
    bands = F.array(*[F.lit(name) for _, name in dates.AGE_BANDS], F.lit("1y+"), F.lit("unknown"))
    rows = df.select(search, days.alias("__d"), dates.age_band(days).alias("age_band"), y.alias("__y"), number(F.col(price)).alias("__p"), number(F.col(likes)).alias("__l"))
    return rows.groupBy(search, "age_band").agg(
        (F.first(F.array_position(bands, F.col("age_band"))) - 1).alias("band_order"), F.count(F.lit(1)).alias("rows"), F.sum("__y").alias("sold_rows"), F.avg("__y").alias("positive_rate"), F.avg("__p").alias("avg_price"),
        F.avg("__l").alias("avg_likes"), F.percentile("__d", 0.5).alias("median_days"),
    )


def phrase_distribution(df: DataFrame, search: str, phrase: str, label: str) -> DataFrame:
    """By search and upload phrase (a null one is kept): its days, rows, sold rows and their rate."""
    y = F.coalesce(number(F.col(label)).cast("int"), F.lit(0))
    rows = df.select(search, phrase, dates.upload_age_days(F.col(phrase)).alias("__d"), y.alias("__y"))
    return rows.groupBy(search, phrase).agg(F.percentile("__d", 0.5).alias("days"), F.count(F.lit(1)).alias("rows"), F.sum("__y").alias("sold_rows"), F.avg("__y").alias("positive_rate"))


def identity_rollup(df: DataFrame, transport: str, address: str, ok: str, changed: str, order: str, ts: str) -> DataFrame:
    """By transport: events, successes, changes, distinct addresses, the addresses' counts as a map, and the first and last time in the log's order.

    Addresses are counted one by one before they are gathered, so a transport's map holds one entry an address, however many events it has.
    """
    c, way = F.col, F.coalesce(F.nullif(F.col(transport), F.lit("")), F.lit("unknown"))
    there = F.nullif(c(address).cast("string"), F.lit(""))
    one = df.groupBy(way.alias("transport"), there.alias("__a")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(truth(c(ok))).alias("s"), F.count_if(truth(c(changed))).alias("g"), F.min(F.struct(order, ts)).alias("lo"), F.max(F.struct(order, ts)).alias("hi")
    )
    each = F.collect_list(F.when(c("__a").isNotNull(), F.struct("__a", "n")))
    out = one.groupBy("transport").agg(F.sum("n").alias("events"), F.sum("s").alias("successful_events"), F.sum("g").alias("change_events"), F.count("__a").alias("unique_addresses"), F.map_from_entries(each).alias("addresses"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return out.select("transport", "events", "successful_events", "change_events", "unique_addresses", "addresses", c(f"lo.{ts}").alias("first_ts"), c(f"hi.{ts}").alias("last_ts"))


def comparison(own: DataFrame, other: DataFrame, keys: list[str], columns: list[str], deltas: dict[str, str]) -> DataFrame:
    """own with other's columns by the keys: shared names become name_per_search and name_global; deltas maps a column to the name of its difference."""
    both = [c for c in columns if c in other.columns]
    left = own.select(*[F.col(c).alias(f"{c}_per_search") if c in both else F.col(c) for c in own.columns])
    right = other.select(*keys, *[F.col(c).alias(f"{c}_global") for c in both])
    out = left.join(right, keys, "left")
    return out.select("*", *[(F.col(f"{c}_per_search") - F.col(f"{c}_global")).alias(name) for c, name in deltas.items() if c in both])


def any_pass(df: DataFrame, passes: list[str], price: str, least: float = 30.0) -> DataFrame:
    """The rows that pass in any of the columns and cost more than least; none without such columns. A null pass or price is no pass."""
    if not passes:
        return df.limit(0)
    return df.filter(reduce(lambda a, b: a | b, [F.coalesce(truth(F.col(c)), F.lit(False)) for c in passes]) & F.coalesce(number(F.col(price)) > least, F.lit(False)))


def profit(paid: Column, sold: Column) -> Column:
    """What was sold for less what was paid; 0 if either is no number."""
    return F.coalesce(number(sold) - number(paid), F.lit(0.0))


def apply_status(df: DataFrame, found: DataFrame, key: str, recheck: bool = False) -> tuple[DataFrame, DataFrame]:
    """(df updated by a recheck, its rows found sold in it).

    found has, once for each key at most, key, status, upload_date, page_price, previous_price and price_changed. Rows that are sold already
    are only updated with recheck. A status is always noted; date and prices where they are known; a sold row takes its page's price.
    """
    names = ("status", "upload_date", "page_price", "previous_price", "price_changed")
    right = found.select(F.col(key).alias("__key"), *[F.col(n).alias(f"__{n}") for n in names])
    rows = df.join(right, df[key] == F.col("__key"), "left")
    open_ = F.lit(True) if recheck else ~F.col("market_status").eqNullSafe(F.lit("Sold"))
    hit = F.col("__key").isNotNull() & open_
    sold = hit & F.coalesce(F.col("__status") == "Sold", F.lit(False))
    date = F.when(~F.col("__upload_date").isin("Unknown", "None"), F.col("__upload_date"))
    days = dates.upload_days(date)
    take = lambda new, old, when=hit: F.when(when & new.isNotNull(), new).otherwise(F.col(old))
    kinds = {f.name: f.dataType for f in df.schema.fields}
    back = hit & F.lit(recheck) & F.coalesce(F.col("__status").isin("OnSale", "On Sale"), F.lit(False))
    made = {
        "last_check_status": take(F.col("__status"), "last_check_status"),
        "market_status": F.when(sold, F.lit("Sold")).when(back, F.lit("On Sale")).otherwise(F.col("market_status")),
        "upload_date": take(date, "upload_date"), "upload_days": take(days, "upload_days"), "observed_price": take(F.col("__page_price").cast("double"), "observed_price"),
        "previous_price": take(F.col("__previous_price").cast("double"), "previous_price"), "price_changed": F.when(hit, F.coalesce("__price_changed", F.lit(False))).otherwise(F.col("price_changed")),
        "price": take(F.col("__page_price").cast(kinds["price"]), "price", sold),
    }
    out = rows.select(*[made[c].alias(c) if c in made else df[c] for c in df.columns], sold.alias("__sold"))
    return out.drop("__sold"), out.filter("__sold").drop("__sold")
