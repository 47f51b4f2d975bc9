"""Experiment metadata by SQL text, synchronised states, item rollups, balance of cohorts, threshold sweeps and rule search."""

from __future__ import annotations

from functools import reduce

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_runs(runs: DataFrame, metrics: DataFrame, metric: str, n: int, search: str | None = None, since: str | None = None) -> DataFrame:
    """The n best trained runs by a metric column of run_metrics; search and since are bound as parameters."""
    spark = runs.sparkSession
    text = (
        "select r.run_id, r.family, r.created_at, m.search_name, m.approach, m.{metric} as value from {runs} r join {metrics} m on r.run_id = m.run_id where m.status = 'trained'"
        " and (:search is null or m.search_name = :search) and (:since is null or r.created_at > cast(:since as timestamp)) order by value desc nulls last, r.run_id, m.approach limit :n"
    ).replace("{metric}", f"`{metric}`")
    return spark.sql(text, args={"search": search, "since": since, "n": n}, runs=runs, metrics=metrics)


def compare_approaches(runs: DataFrame, metrics: DataFrame, search: str, a: str, b: str, metric: str) -> DataFrame:
    text = (
        "select r.run_id, r.family, r.created_at, m.approach, m.{metric} as value from {runs} r join {metrics} m on r.run_id = m.run_id"
        " where m.search_name = :search and m.approach in (:a, :b) and m.status = 'trained' order by r.created_at desc, r.run_id, m.approach"
    ).replace("{metric}", f"`{metric}`")
    return runs.sparkSession.sql(text, args={"search": search, "a": a, "b": b}, runs=runs, metrics=metrics)


def promotion_candidates(runs: DataFrame, metrics: DataFrame) -> DataFrame:
    text = "select r.run_id, r.family, r.created_at, m.search_name, m.approach, m.test_precision from {runs} r join {metrics} m on r.run_id = m.run_id where m.qualified order by r.created_at desc, r.run_id"
    return runs.sparkSession.sql(text, runs=runs, metrics=metrics)


def synchronised(old: DataFrame, sold: DataFrame, not_really: DataFrame, checked: DataFrame, key: str, status: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(old, sold, not_really) after a batch of checks: sold items move and leave not_really, items on sale are refreshed and noted there; others change nothing."""
    is_sold, on_sale = F.col(status) == "Sold", F.col(status).isin("OnSale", "On Sale")
    gone, seen = checked.filter(is_sold), checked.filter(on_sale)
    decided = gone.unionByName(seen).select(key).distinct()
    fresh = lambda rows, like: rows.select(*[F.col(c) for c in like.columns])
    new_old = old.join(decided, key, "left_anti").select(*old.columns).unionByName(fresh(seen, old))
    new_sold = sold.join(gone.select(key), key, "left_anti").select(*sold.columns).unionByName(fresh(gone, sold))
    noted = not_really.select(key).join(gone.select(key), key, "left_anti").unionByName(seen.select(key)).distinct()
    return new_old, new_sold, noted


def unique_items(df: DataFrame, key: str, order: list[str], first: list[str], median: list[str], joined: list[str], flags: list[str], largest: list[str]) -> DataFrame:
    """One row for each item: first values in order, medians, distinct texts joined by |, any flag, and maxima; one aggregation."""
    at = F.struct(*order)
    texts = [F.array_join(F.array_sort(F.collect_set(F.when(F.trim(F.col(c)) != "", F.col(c)))), "|").alias(c) for c in joined]
    return df.groupBy(key).agg(
        *[F.min_by(c, at).alias(c) for c in first], *[F.percentile(c, 0.5).alias(c) for c in median], *texts, *[F.bool_or(c).alias(c) for c in flags], *[F.max(c).alias(c) for c in largest]
    )


def cohort_deficits(outcomes: DataFrame, g: str, hours: str, cohort: str, evaluated: Column, sold: Column) -> DataFrame:
    """For each group and horizon: sold high-score items, unsold controls, and how many controls are wanting."""
    high, low = F.col(cohort) == "high_score_candidate", F.col(cohort) == "low_score_control"
    won, lost = F.coalesce(sold, F.lit(False)), ~F.coalesce(sold, F.lit(False))
    out = outcomes.groupBy(g, hours).agg(F.count_if(high & evaluated & won).alias("high_sold"), F.count_if(low & evaluated & lost).alias("low_unsold"))
    return out.withColumn("deficit", F.greatest(F.col("high_sold") - F.col("low_unsold"), F.lit(0)))


def threshold_sweep(df: DataFrame, hours: str, s1: tuple[Column, Column], s2: tuple[Column, Column], evaluated: Column, sold: Column, deltas1: list[float], deltas2: list[float]) -> DataFrame:
    """Evaluated, sold and precision of rows that pass both stages, for each horizon and every two shifts of the stages' thresholds.

    s1 and s2 are (score, threshold). A row is first reduced to the largest shift it passes at each stage; rows of equal reach are counted, and only
    counts are set against the shifts.
    """
    d1, d2 = sorted(deltas1), sorted(deltas2)
    reach = lambda s, ds: F.aggregate(F.array(*[F.coalesce((s[0] >= s[1] + F.lit(d)).cast("int"), F.lit(0)) for d in ds]), F.lit(0), lambda a, x: a + x)
    cells = df.filter(evaluated).groupBy(F.col(hours).alias("hours"), reach(s1, d1).alias("r1"), reach(s2, d2).alias("r2")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(sold, F.lit(False))).alias("p"))
    shifts = F.array(*[F.struct(F.lit(float(a)).alias("stage1_delta"), F.lit(float(b)).alias("stage2_delta"), F.lit(i + 1).alias("n1"), F.lit(j + 1).alias("n2")) for i, a in enumerate(d1) for j, b in enumerate(d2)])
    each = cells.select("*", F.inline(F.filter(shifts, lambda x: (x["n1"] <= F.col("r1")) & (x["n2"] <= F.col("r2")))))
    out = each.groupBy("hours", "stage1_delta", "stage2_delta").agg(F.sum("n").alias("evaluated_count"), F.sum("p").alias("sold_count"))
    return out.withColumn("precision", F.col("sold_count") / F.col("evaluated_count"))


def random_weights(parts: int, rules: int, seed: int) -> np.ndarray:
    """Rows of weights that sum to 1, evenly spread: exponential draws, each from the first 52 bits of md5(rule|part|seed), by their sum."""
    bits = [int(hashlib.md5(f"{k}|{j}|{seed}".encode()).hexdigest()[:13], 16) for k in range(rules) for j in range(parts)]
    drawn = -np.log((np.array(bits, float) + 1) / 2.0**52).reshape(rules, parts)
    return drawn / np.maximum(drawn.sum(axis=1, keepdims=True), 1e-300)


def weight_search(df: DataFrame, parts: list[str], label: str, rules: int = 30_000, seed: int = 42, bar: float = 0.5) -> DataFrame:
    """Random weights (random_weights) of component scores: rule, weights, selected, positives, precision at score >= bar.

    Each batch of rows is multiplied with the matrix of rules; what leaves a task is two counts for each rule.
    """
    weights = random_weights(len(parts), rules, seed)

    def run(batches):
        n, pos = np.zeros(rules, np.int64), np.zeros(rules, np.int64)
        for b in batches:
            x = np.stack([np.nan_to_num(b.column(k).to_numpy(zero_copy_only=False).astype(float)) for k in range(len(parts))], axis=1)
            y = np.nan_to_num(b.column(len(parts)).to_numpy(zero_copy_only=False).astype(float))
            for a in range(0, len(x), 512):
                hit = x[a : a + 512] @ weights.T >= bar
                n, pos = n + hit.sum(axis=0), pos + (hit * y[a : a + 512, None]).sum(axis=0).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(rules)), pa.array(n), pa.array(pos)], ["rule", "selected", "positives"])

    counts = df.select(*parts, label).mapInArrow(run, "rule long, selected long, positives long").groupBy("rule").agg(F.sum("selected").alias("selected"), F.sum("positives").alias("positives"))
    names = df.sparkSession.createDataFrame([(k, [float(v) for v in w]) for k, w in enumerate(weights)], "rule long, weights array<double>")
    return counts.join(names, "rule").withColumn("precision", F.try_divide("positives", "selected"))


def seeded_draw(df: DataFrame, key: str, seed: int, n: int) -> DataFrame:
    return df.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(n)


def variant_vectors(df: DataFrame, keys: list[str], vector: str, price: str, weight: Column) -> DataFrame:
    """vector followed by weight times the standardised log price within the keys (population deviation; 0 for a missing price)."""
    w = Window.partitionBy(*keys)
    log = F.when(F.col(price) > 0, F.log(price))
    z = F.coalesce((log - F.avg(log).over(w)) / (F.stddev_pop(log).over(w) + 1e-6), F.lit(0.0))
    return df.withColumn("variant_vector", F.concat(F.transform(vector, lambda x: x.cast("double")), F.array(weight * z)))


def linear_shap(df: DataFrame, weights: dict[str, float]) -> DataFrame:
    """feature, importance (mean absolute contribution of a linear model, each feature about its mean) and share."""
    means = df.agg(*[F.avg(c).alias(f"__{c}") for c in weights])
    rows = df.join(F.broadcast(means), F.lit(True)).agg(*[F.avg(F.abs(F.lit(w) * (F.col(c) - F.col(f"__{c}")))).alias(c) for c, w in weights.items()])
    out = rows.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("importance")) for c in weights])))
    total = reduce(lambda a, b: a + b, [F.col(c) for c in weights])
    shares = rows.select(total.alias("__t"))
    return out.join(F.broadcast(shares), F.lit(True)).select("feature", "importance", F.try_divide("importance", "__t").alias("share"))
