"""Ensembles of models: weights from validation metrics, soft and hard votes, and what the votes look like. Scores are long: one row for each item and model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Schemes: vote mode and weight metric. Fixed values.
SCHEMES = {
    "uniform_soft_mean": ("soft", "uniform"), "auc_soft": ("soft", "auc"), "pr_auc_soft": ("soft", "pr_auc"), "p25_soft": ("soft", "p25"), "qualified_soft": ("soft", "qualified"),
    "uniform_hard": ("hard", "uniform"), "auc_hard": ("hard", "auc"), "qualified_hard": ("hard", "qualified"),
}


def raw_weight(metric: str) -> Column:
    """Reads roc_auc, pr_auc, base_rate, p25, qualified, threshold_precision and threshold_count."""
    c = F.col
    return {
        "uniform": F.lit(1.0),
        "auc": c("roc_auc") - 0.5,
        "pr_auc": c("pr_auc") - c("base_rate"),
        "p25": c("p25") - c("base_rate"),
        "qualified": F.when(c("qualified"), c("threshold_precision") * F.log1p(c("threshold_count"))),
    }[metric]


def weighted(metrics: DataFrame, g: list[str], metric: str) -> DataFrame:
    """metrics with weight: clipped at 0, summing to 1 in each group, equal if all are 0."""
    raw = F.greatest(F.coalesce(raw_weight(metric), F.lit(0.0)), F.lit(0.0))
    w = Window.partitionBy(*g)
    total = F.sum(raw).over(w)
    return metrics.withColumn("weight", F.when(total > 0, raw / total).otherwise(1.0 / F.count(F.lit(1)).over(w)))


def vote(scores: DataFrame, metrics: DataFrame, g: list[str], item: str, model: str, score: str, scheme: str) -> DataFrame:
    """The weighted mean of scores (soft) or of threshold votes (hard) of each item; metrics is a row for each group and model."""
    mode, metric = SCHEMES[scheme]
    w = weighted(metrics, g, metric).select(*g, model, "weight", "threshold")
    joined = scores.join(w, [*g, model])
    value = F.col(score) if mode == "soft" else (F.col(score) >= F.coalesce("threshold", F.lit(1.0))).cast("double")
    return joined.groupBy(*g, item).agg((F.sum(F.col("weight") * value) / F.sum("weight")).alias("vote"))


def vote_counts(votes: DataFrame, g: list[str], item: str, hit: Column, label: str) -> DataFrame:
    """For each number of positive votes: items, their share in the group, and their label rate."""
    per = votes.groupBy(*g, item).agg(F.count_if(hit).alias("votes"), F.max(label).alias("y"))
    out = per.groupBy(*g, "votes").agg(F.count(F.lit(1)).alias("items"), F.avg(F.col("y").cast("double")).alias("rate"))
    return out.withColumn("share", F.col("items") / F.sum("items").over(Window.partitionBy(*g)))


def ensemble(votes: DataFrame, g: list[str], item: str, score: str, hit: Column, label: str) -> DataFrame:
    """For each item: mean and maximum score, vote fraction, majority, any and unanimous votes, and the label."""
    out = votes.groupBy(*g, item).agg(F.avg(score).alias("mean_score"), F.max(score).alias("max_score"), F.avg(hit.cast("double")).alias("fraction"), F.max(label).alias("y"))
    return out.select("*", (F.col("fraction") > 0.5).alias("majority"), (F.col("fraction") > 0).alias("any_vote"), (F.col("fraction") == 1).alias("unanimous"))


def best_models(metrics: DataFrame, g: list[str], metric: str, n: int, tie: str) -> DataFrame:
    w = Window.partitionBy(*g).orderBy(F.desc_nulls_last(metric), tie)
    return metrics.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)
