"""Deals: robust price statistics of comparable items, resale estimates, scores and eligibility."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.coerce import clamp


@dataclass(frozen=True)
class DealRules:
    """The scoring constants. Fixed values."""

    fee: float = 0.10
    fixed_cost: float = 0.0
    safety_discount: float = 0.05
    min_count: int = 8
    min_confidence: float = 0.55
    min_margin: float = 0.10
    min_profit: float = 5.0
    min_informative: int = 2
    ranked_count: int = 4
    mad_ratio: float = 0.25
    hard_mad_ratio: float = 0.45
    silhouette: float = 0.35
    centroid: float = 0.55


#: The constants of the whole way from listings to deals, where variants are found rather than given. Fixed values.
BATCH_RULES = DealRules(min_count=3, min_confidence=0.35, min_margin=0.0, min_profit=0.0, mad_ratio=0.35, hard_mad_ratio=0.60, silhouette=0.15, centroid=0.45)


def price_stats(df: DataFrame, keys: list[str], price: str, weight: str | None = None) -> DataFrame:
    """For each group: n, med, q25, q75, mad (median distance from the median, unscaled) over finite prices above 0. weight: how many equal rows a row stands for.

    Equal prices of a group are counted first, on the map side too, so what follows holds distinct prices, not rows; the median joins back to these
    counts for the second pass.
    """
    good = df.filter((F.col(price) > 0) & ~F.isnan(price) & (F.col(price) < float("inf"))).groupBy(*keys, price).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("__c"))
    first = good.groupBy(*keys).agg(F.sum("__c").alias("n"), F.percentile(price, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("__c")).alias("__q"))
    first = first.select(*keys, "n", *[F.col("__q")[k].alias(c) for k, c in enumerate(("q25", "med", "q75"))])
    away = good.join(first.select(*keys, "med"), keys).groupBy(*keys).agg(F.percentile(F.abs(F.col(price) - F.col("med")), F.lit(0.5), F.col("__c")).alias("mad"))
    return first.join(away, keys)


def deal_z(price: Column, n: Column, med: Column, mad: Column) -> Column:
    """How many robust deviations the price is below the median; null under 3 prices."""
    return F.when(n >= 3, (med - price) / (1.4826 * mad + 1e-6))


def resale(med: Column, q25: Column, q75: Column, rules: DealRules = DealRules()) -> Column:
    """The expected resale price: the median less a safety discount, held between the quartiles."""
    return F.greatest(F.least(med * (1 - rules.safety_discount), q75), q25)


def net(price: Column, rules: DealRules = DealRules()) -> Column:
    return price * (1 - rules.fee) - rules.fixed_cost


def resale_safety(confidence: Column, z: Column, margin: Column, profit: Column) -> Column:
    part = lambda x, scale: F.coalesce(clamp(x / scale, 0.0, 1.0), F.lit(0.0))
    return clamp(100.0 * confidence * (0.4 * part(z, 6.0) + 0.4 * part(margin, 0.3) + 0.2 * part(profit, 20.0)), 0.0, 100.0)


def scored(df: DataFrame, rules: DealRules = DealRules()) -> DataFrame:
    """Adds expected_resale, profit, margin, confidence, score, eligible and notes.

    Reads price, n, med, q25, q75, mad, z, negative (boolean), generic, informative, has_code, snapshots, silhouette and
    centroid_sim; each of the last six may be null, its rule then doesn't apply.
    """
    c = F.col
    estimate = resale(c("med"), c("q25"), c("q75"), rules)
    df = df.withColumn("expected_resale", estimate)
    df = df.withColumn("profit", net(c("expected_resale"), rules) - c("price")).withColumn("margin", F.try_divide("profit", "price"))
    ratio = F.try_divide("mad", "med") - rules.mad_ratio
    silhouette, centroid = rules.silhouette - c("silhouette"), rules.centroid - c("centroid_sim")
    vague = c("informative") < rules.min_informative
    unsure = vague & ~c("has_code")
    low = F.lit(0.0)
    table = (  # rule, penalty, loss of confidence, hard failure, note
        (c("negative"), 0.6, F.lit(0.20), F.lit(False), "negative_flag"),
        (c("generic"), 1.1, F.lit(0.35), unsure, "generic_title"),
        (unsure & ~c("generic"), 0.5, F.lit(0.15), F.lit(False), "few_informative_tokens"),
        (c("snapshots") >= 3, 0.0, F.least(F.lit(0.25), 0.05 * (c("snapshots") - 2)), F.lit(False), "seen_often"),
        (c("n") < rules.min_count, 0.0, F.lit(0.35), F.lit(True), "small_group"),
        (ratio > 0, F.least(F.lit(1.0), 4 * ratio), F.least(F.lit(0.35), 1.5 * ratio), ratio > rules.hard_mad_ratio - rules.mad_ratio, "noisy_prices"),
        (silhouette > 0, F.least(F.lit(0.8), 2 * silhouette), F.least(F.lit(0.30), 1.2 * silhouette), F.lit(True), "weak_cluster"),
        (centroid > 0, F.least(F.lit(0.8), 2 * centroid), F.least(F.lit(0.25), 1.2 * centroid), F.lit(False), "far_from_centroid"),
        (c("price") < 0.45 * c("med"), 0.5, F.lit(0.10), F.lit(False), "suspiciously_cheap"),
        (c("margin") < rules.min_margin, 0.0, F.lit(0.20), F.lit(True), "low_margin"),
        (c("profit") < rules.min_profit, 0.0, F.lit(0.20), F.lit(True), "low_profit"),
    )
    total = lambda part: sum((F.when(rule, row[part]).otherwise(low) for rule, *row in table), low)
    hard = F.lit(False)
    for rule, _, _, fails, _ in table:
        hard = hard | F.coalesce(rule & fails, F.lit(False))
    confidence = clamp(1.0 - total(1), 0.0, 1.0)
    score = clamp((c("z") - total(0)) * confidence, -10.0, 10.0)
    notes = F.array_compact(F.array(*[F.when(rule, F.lit(note)) for rule, _, _, _, note in table]))
    df = df.select("*", confidence.alias("confidence"), score.alias("__score"), hard.alias("__hard"), notes.alias("__notes"))
    eligible = F.coalesce(c("__score").isNotNull() & (c("confidence") >= rules.min_confidence) & ~c("__hard"), F.lit(False))
    df = df.withColumn("eligible", eligible).withColumn("score", F.when(c("eligible"), c("__score")))
    df = df.withColumn("notes", F.array_join(F.when(c("eligible"), c("__notes")).otherwise(F.array_append("__notes", F.lit("not_eligible"))), "|"))
    return df.withColumn("safety", resale_safety(c("confidence"), c("z"), c("margin"), c("profit"))).drop("__score", "__hard", "__notes")


def ranked(df: DataFrame, rules: DealRules = DealRules(), *tie: str) -> DataFrame:
    """Eligible rows of large enough groups, the best deal first."""
    by = [F.desc_nulls_last(x) for x in ("safety", "margin", "score", "confidence")]
    return df.filter(F.col("eligible") & F.col("score").isNotNull() & (F.col("n") >= rules.ranked_count)).orderBy(*by, F.asc_nulls_last("snapshots"), *tie)


def legacy_score(z: Column, penalty: Column, n: Column, least: int = 4) -> Column:
    return F.when(n >= least, clamp(z - penalty, -10.0, 10.0))


def autotune(empty_rate: Column, mad_ratio: Column) -> dict[str, Column]:
    """Core fraction, price weight and threshold that suit a product's variants."""
    core = F.when(empty_rate > 0.55, 0.60).when(empty_rate > 0.40, 0.65).when(empty_rate < 0.15, 0.78).otherwise(0.70)
    weight = F.when(mad_ratio >= 0.22, 0.55).when(mad_ratio >= 0.14, 0.45).when(mad_ratio <= 0.06, 0.25).otherwise(0.35)
    threshold = F.when(mad_ratio >= 0.22, 0.30).when(mad_ratio >= 0.14, 0.31).when(mad_ratio <= 0.06, 0.36).otherwise(0.33)
    return {"core_frac": core, "price_weight": weight, "variant_threshold": threshold}


def common_tokens(df: DataFrame, keys: list[str], words: str, most: int, position: str) -> DataFrame:
    """The most common tokens of each group, by count, then by their first position; words: array column, position: row order."""
    from pyspark.sql import Window

    each = df.select(*keys, F.col(position).alias("__row"), F.posexplode(words).alias("__at", "token"))
    counts = each.groupBy(*keys, "token").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("__row", "__at")).alias("first"))
    best = counts.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("c"), "first"))).filter(F.col("r") <= most)
    return best.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "token"))), lambda x: x["token"]), " ").alias("canonical"))


def core_tokens(df: DataFrame, keys: list[str], words: str, fraction: float) -> DataFrame:
    """Tokens that at least this fraction of a group's rows have."""
    size = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    counts = df.select(*keys, F.explode(F.array_distinct(words)).alias("token")).groupBy(*keys, "token").agg(F.count(F.lit(1)).alias("c"))
    return counts.join(size, keys).filter(F.col("c") >= fraction * F.col("__n")).select(*keys, "token", "c")
