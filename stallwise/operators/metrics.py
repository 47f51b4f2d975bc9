"""Evaluation of scores against labels. Exact at ties; every metric is one aggregation after at most one window by group.

Functions take group columns g (none for the whole frame), a score column s and a 0/1 label column y.
Where whole frames are ranked, distinct scores are counted first, so the single window sees scores, not rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import quantiles


def average_rank(x: Column, *partition) -> Column:
    """Rank from 1 with ties averaged, over all rows of a partition; nulls rank last among themselves."""
    order = Window.partitionBy(*partition).orderBy(x.asc_nulls_last())
    return F.rank().over(order) + (F.count(F.lit(1)).over(Window.partitionBy(*partition, x)) - 1) / 2.0


def with_average_rank(df: DataFrame, x: str, name: str, buckets: int = 256) -> DataFrame:
    """Adds the average rank of x over the whole frame, without sorting all rows in one task.

    Approximate quantiles only deal the rows into buckets of values; the ranks are exact: a bucket's offset is the count of the
    buckets below it (a window over the buckets), and rows are ranked inside their bucket. A value that fills a bucket is one tie there.
    """
    edges = df.approxQuantile(x, [k / buckets for k in range(1, buckets)], 1 / (4 * buckets))
    at = F.size(F.filter(F.array(*map(F.lit, sorted(set(edges)))).cast("array<double>"), lambda e: e < F.col(x)))
    rows = df.withColumn("__b", at)
    values = rows.groupBy("__b", x).agg(F.count(F.lit(1)).alias("__t"))
    sizes = values.groupBy("__b").agg(F.sum("__t").alias("__n"))
    below = sizes.select("__b", F.coalesce(F.sum("__n").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__o"))
    up = Window.partitionBy("__b").orderBy(x).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranks = values.join(below, "__b").select(F.col(x).alias("__x"), (F.col("__o") + F.sum("__t").over(up) - (F.col("__t") - 1) / 2.0).alias(name))
    return df.join(ranks, df[x].eqNullSafe(ranks["__x"])).drop("__x")


def by_score(df: DataFrame, g: list[str], s: str, y: str) -> DataFrame:
    """One row for each group and distinct score: n, pos, and their running sums from the highest score, n_up and pos_up, and totals.

    Pre-aggregated on the map side; what the window sorts is distinct scores.
    """
    counts = df.filter(F.col(s).isNotNull() & ~F.isnan(s)).groupBy(*g, s).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(y).cast("long")).alias("pos"))
    down = Window.partitionBy(*g).orderBy(F.desc(s)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.partitionBy(*g)
    return counts.select(
        "*", F.sum("n").over(down).alias("n_up"), F.sum("pos").over(down).alias("pos_up"), F.sum("n").over(everything).alias("n_all"), F.sum("pos").over(everything).alias("pos_all")
    )


def auc(df: DataFrame, g: list[str], s: str, y: str) -> DataFrame:
    """roc_auc (rank sums) and pr_auc (sum of recall steps times precision at distinct scores); null with one class only."""
    c = F.col
    rows = by_score(df, g, s, y)
    wins = c("pos") * ((c("n_all") - c("pos_all")) - (c("n_up") - c("pos_up")) + (c("n") - c("pos")) / 2.0)
    out = rows.groupBy(*g).agg(F.max("n_all").alias("rows"), F.max("pos_all").alias("positives"), F.sum(wins).alias("__w"), F.sum(c("pos") * c("pos_up") / c("n_up")).alias("__p"))
    negatives = c("rows") - c("positives")
    return out.select(
        *g, "rows", "positives",
        F.when((c("positives") > 0) & (negatives > 0), c("__w") / (c("positives") * negatives)).alias("roc_auc"),
        F.when((c("positives") > 0) & (negatives > 0), c("__p") / c("positives")).alias("pr_auc"),
    )


def calibration(df: DataFrame, g: list[str], s: str, y: str, bins: int = 10) -> DataFrame:
    """bin, n, mean score and rate, over bins of equal width of which the last is closed."""
    b = F.least(F.floor(F.col(s) * bins), F.lit(bins - 1)).cast("int")
    return df.withColumn("bin", b).groupBy(*g, "bin").agg(F.count(F.lit(1)).alias("n"), F.avg(s).alias("mean_score"), F.avg(F.col(y).cast("double")).alias("rate"))


def brier_ece(df: DataFrame, g: list[str], s: str, y: str, bins: int = 10) -> DataFrame:
    square = (F.col(y) - F.col(s)) * (F.col(y) - F.col(s))
    b = F.least(F.floor(F.col(s) * bins), F.lit(bins - 1)).cast("int")
    per = df.withColumn("__b", b).groupBy(*g, "__b").agg(F.count(F.lit(1)).alias("n"), F.sum(s).alias("ss"), F.sum(F.col(y).cast("double")).alias("sy"), F.sum(square).alias("sq"))
    return per.groupBy(*g).agg((F.sum("sq") / F.sum("n")).alias("brier"), (F.sum(F.abs(F.col("ss") - F.col("sy"))) / F.sum("n")).alias("ece"))


def at_k(df: DataFrame, g: list[str], s: str, y: str, ks: list[int], tie: str) -> DataFrame:
    """k, selected, positives, precision, recall of the k best scores (all, if fewer), ties by the tie column rising."""
    order = Window.partitionBy(*g).orderBy(F.desc_nulls_last(s), F.asc(tie))
    rows = df.select(*g, F.col(y).cast("long").alias("y"), F.row_number().over(order).alias("r"))  # Spark keeps max(ks) rows a group before the exchange
    each = rows.filter(F.col("r") <= max(ks)).select("*", F.explode(F.array(*map(F.lit, ks))).alias("k")).filter("r <= k")
    out = each.groupBy(*g, "k").agg(F.count(F.lit(1)).alias("selected"), F.sum("y").alias("positives"))
    total = df.groupBy(*[F.col(c).alias(f"__{c}") for c in g]).agg(F.sum(F.col(y).cast("long")).alias("all"))
    out = out.join(total, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in g] or F.lit(True))
    return out.select(*g, "k", "selected", "positives", (F.col("positives") / F.col("selected")).alias("precision"), F.try_divide("positives", "all").alias("recall"))


def at_thresholds(df: DataFrame, g: list[str], s: str, y: str, thresholds: list[float]) -> DataFrame:
    """threshold, selected, positives, precision at each: one pass, an aggregate per threshold."""
    aggs = []
    for k, t in enumerate(thresholds):
        aggs += [F.count_if(F.col(s) >= t).alias(f"n{k}"), F.sum(F.when(F.col(s) >= t, F.col(y)).otherwise(0)).alias(f"p{k}")]
    one = df.groupBy(*g).agg(*aggs)
    rows = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"n{k}").alias("selected"), F.col(f"p{k}").cast("long").alias("positives"), F.try_divide(f"p{k}", f"n{k}").alias("precision")) for k, t in enumerate(thresholds)])
    return one.select(*g, F.inline(rows))


def confusion(df: DataFrame, g: list[str], predicted: Column, y: Column) -> DataFrame:
    """tp, fp, tn, fn and the rates that follow from them; lift is precision over the base rate."""
    p, t = F.coalesce(predicted, F.lit(False)), y == 1
    counts = [F.count_if(p & t).alias("tp"), F.count_if(p & ~t).alias("fp"), F.count_if(~p & ~t).alias("tn"), F.count_if(~p & t).alias("fn")]
    out = df.agg(*counts) if not g else df.groupBy(*g).agg(*counts)
    c, n = F.col, F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")
    return out.select(
        *g, "tp", "fp", "tn", "fn",
        F.try_divide(c("tp"), c("tp") + c("fp")).alias("precision"), F.try_divide(c("tp"), c("tp") + c("fn")).alias("recall"),
        F.try_divide(c("tn"), c("tn") + c("fp")).alias("specificity"), F.try_divide(c("tp") + c("tn"), n).alias("accuracy"),
        F.try_divide(2 * c("tp"), 2 * c("tp") + c("fp") + c("fn")).alias("f1"), F.try_divide(c("tp") * n, (c("tp") + c("fp")) * (c("tp") + c("fn"))).alias("lift"),
    )


def correlations(df: DataFrame, a: str, b: str, g: list[str] | None = None) -> DataFrame:
    """pearson and spearman (Pearson's of average ranks) of rows where both are there."""
    g = g or []
    rows = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    if not g:
        rows = with_average_rank(with_average_rank(rows.select(F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b")), "a", "ra"), "b", "rb")
        return rows.agg(F.corr("a", "b").alias("pearson"), F.corr("ra", "rb").alias("spearman"))
    rows = rows.select(*g, F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b"), average_rank(F.col(a), *g).alias("ra"), average_rank(F.col(b), *g).alias("rb"))
    return rows.groupBy(*g).agg(F.corr("a", "b").alias("pearson"), F.corr("ra", "rb").alias("spearman"))


def regression_errors(df: DataFrame, truth: str, guess: str) -> DataFrame:
    e, t = F.col(truth) - F.col(guess), F.col(truth)
    out = df.agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.sum(e * e).alias("__e"), F.var_pop(t).alias("__v"), F.count(F.lit(1)).alias("__n"))
    return out.select("mae", "rmse", (1 - F.try_divide(F.col("__e"), F.col("__v") * F.col("__n"))).alias("r2"))


def log_loss(df: DataFrame, s: str, y: str) -> DataFrame:
    p = F.least(F.greatest(F.col(s), F.lit(1e-15)), F.lit(1 - 1e-15))
    return df.agg(F.avg(-(F.col(y) * F.log(p) + (1 - F.col(y)) * F.log(1 - p))).alias("log_loss"))


def agreement(votes: DataFrame, g: list[str], item: str, model: str, vote: str) -> DataFrame:
    """For each two models: rows, agreement, kappa and Jaccard of their positive votes.

    The votes of one item meet in an array bounded by the number of models; pairs are made inside it, without a self-join.
    """
    per = votes.groupBy(*g, item).agg(F.array_sort(F.collect_list(F.struct(F.col(model).alias("m"), F.col(vote).cast("int").alias("v")))).alias("vs"))
    pairs = F.flatten(F.transform("vs", lambda a: F.transform(F.filter("vs", lambda b: b["m"] > a["m"]), lambda b: F.struct(a["m"].alias("model_a"), b["m"].alias("model_b"), a["v"].alias("va"), b["v"].alias("vb")))))
    rows = per.select(*g, F.inline(pairs))
    out = rows.groupBy(*g, "model_a", "model_b").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.col("va") * F.col("vb")).alias("both"), F.sum("va").alias("a"), F.sum("vb").alias("b")
    )
    c, n = F.col, F.col("rows")
    same = (n - c("a") - c("b") + 2 * c("both")) / n
    chance = (c("a") * c("b") + (n - c("a")) * (n - c("b"))) / (n * n)
    return out.select(*g, "model_a", "model_b", "rows", same.alias("agreement"), F.try_divide(same - chance, 1 - chance).alias("kappa"), F.try_divide(c("both"), c("a") + c("b") - c("both")).alias("jaccard"))


def quantile_bins(df: DataFrame, x: str, bins: int, name: str = "bin") -> DataFrame:
    """Adds the number (from 0) of the quantile bin of x; equal edges are merged, bins are closed on the right, the first on both sides.

    The edges are exact quantiles in one row, joined by broadcast.
    """
    edges = quantiles(df, [], F.col(x), [k / bins for k in range(bins + 1)]).select(F.array_distinct("q").alias("__e"))
    below = F.size(F.filter("__e", lambda e: e < F.col(x)))
    return df.join(F.broadcast(edges), F.lit(True)).withColumn(name, F.when(F.col(x).isNotNull(), F.greatest(below - 1, F.lit(0)))).drop("__e")


#: Lower ends of the price bands, and their names. Fixed values.
PRICE_BANDS = ((0, "<=25"), (25, "25-50"), (50, "50-100"), (100, "100-200"), (200, "200-500"), (500, ">500"))


def price_band(price: Column) -> Column:
    """The band [a, b) of a price; unknown for a missing or negative one."""
    out = F.when(price.isNull() | F.isnan(price) | (price < 0), "unknown")
    for (_, name), (end, _) in zip(PRICE_BANDS, PRICE_BANDS[1:], strict=False):
        out = out.when(price < end, name)
    return out.otherwise(PRICE_BANDS[-1][1])
