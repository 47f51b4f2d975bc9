"""Inferential statistics as formulas over aggregates. Only p-values and resampling, which no built-in function has, run in Python, on aggregated rows."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .metrics import average_rank
from .ordered import quantiles


def normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def chi2_tail(x: float, dof: float) -> float:
    """P(chi-square with dof degrees > x): the regularised upper incomplete gamma function, by series or continued fraction."""
    if x <= 0 or dof <= 0:
        return 1.0
    a, z = dof / 2, x / 2
    log_front = a * math.log(z) - z - math.lgamma(a)
    if z < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > 1e-16 * abs(total):
            k += 1
            term *= z / k
            total += term
        return max(0.0, 1 - total * math.exp(log_front))
    tiny = 1e-300
    b = z + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return math.exp(log_front) * h


def fisher_exact(a: int, b: int, c: int, d: int) -> float:
    """Two-sided p of a 2 x 2 table: the tables of the same margins that are no likelier than this one."""
    row, col, n = a + b, a + c, a + b + c + d
    choose = lambda x, y: math.lgamma(x + 1) - math.lgamma(y + 1) - math.lgamma(x - y + 1)
    log_p = lambda k: choose(col, k) + choose(n - col, row - k) - choose(n, row)
    here = log_p(a)
    return min(1.0, sum(math.exp(p) for k in range(max(0, row + col - n), min(row, col) + 1) if (p := log_p(k)) <= here + 1e-9))


def crosstab(df: DataFrame, x: str, y: str) -> DataFrame:
    """value, n0, n1: counts of each value with label 0 and 1."""
    return df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(x).cast("string").alias("value")).agg(F.count_if(F.col(y) == 0).alias("n0"), F.count_if(F.col(y) == 1).alias("n1"))


def chi_square(table: DataFrame, yates: bool = True) -> DataFrame:
    """One row from a crosstab: n, levels, chi2, dof, min_expected, cramers_v; 2 x 2 tables are corrected (Yates) as is usual."""
    totals = table.agg(F.sum("n0").alias("t0"), F.sum("n1").alias("t1"), F.count(F.lit(1)).alias("levels"))
    c, n, row = F.col, F.col("t0") + F.col("t1"), F.col("n0") + F.col("n1")
    cells = table.join(F.broadcast(totals), F.lit(True))
    e0, e1 = row * c("t0") / n, row * c("t1") / n
    shrink = lambda o, e: F.when((c("levels") == 2) & F.lit(yates), F.abs(o - e) - F.least(F.lit(0.5), F.abs(o - e))).otherwise(F.abs(o - e))
    term = lambda o, e: F.when(e > 0, shrink(o, e) * shrink(o, e) / e).otherwise(0.0)
    out = cells.agg(F.max(n).alias("n"), F.max("levels").alias("levels"), F.sum(term(c("n0"), e0) + term(c("n1"), e1)).alias("chi2"), F.min(F.least(e0, e1)).alias("min_expected"))
    return out.select("n", "levels", "chi2", (c("levels") - 1).alias("dof"), "min_expected", F.when(c("levels") > 1, F.sqrt(c("chi2") / c("n"))).alias("cramers_v"))


def odds_ratio(n00: Column, n01: Column, n10: Column, n11: Column) -> dict[str, Column]:
    """Odds ratio of feature 1 against 0 for label 1, with half added to each cell, and its 95 % interval."""
    a, b, c, d = n00 + 0.5, n01 + 0.5, n10 + 0.5, n11 + 0.5
    log = F.log(a * d / (b * c))
    se = F.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
    return {"odds_ratio": F.exp(log), "ci_low": F.exp(log - 1.96 * se), "ci_high": F.exp(log + 1.96 * se)}


def rank_test(df: DataFrame, g: list[str], x: str, y: str) -> DataFrame:
    """Mann-Whitney from average ranks: n1, n0, u (of label 1), z and effect r without tie correction, and the two-sided p with it and with continuity."""
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*g, F.col(x).alias("x"), F.col(y).cast("long").alias("y"))
    counts = rows.groupBy(*g, "x").agg(F.count(F.lit(1)).alias("t"), F.sum("y").alias("t1"))
    up = Window.partitionBy(*g).orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counts.withColumn("rank", F.sum("t").over(up) - (F.col("t") - 1) / 2.0)
    c = F.col
    out = ranked.groupBy(*g).agg(F.sum("t").alias("n"), F.sum("t1").alias("n1"), F.sum(c("rank") * c("t1")).alias("r1"), F.sum(c("t").cast("double") * c("t") * c("t") - c("t")).alias("ties"))
    out = out.withColumn("n0", c("n") - c("n1")).withColumn("u", c("r1") - c("n1") * (c("n1") + 1) / 2.0)
    sigma = F.sqrt(c("n1") * c("n0") * (c("n") + 1) / 12.0)
    tied = F.sqrt(c("n1") * c("n0") / 12.0 * ((c("n") + 1) - c("ties") / (c("n") * (c("n") - 1))))
    mid = c("n1") * c("n0") / 2.0
    out = out.select(*g, "n1", "n0", "u", F.try_divide(c("u") - mid, sigma).alias("z"), F.try_divide(F.greatest(F.abs(c("u") - mid) - 0.5, F.lit(0.0)), tied).alias("__z"))
    tail = F.pandas_udf(lambda z: z.map(lambda v: min(1.0, 2 * normal_tail(v)) if v == v and v is not None else None), "double")
    return out.select(*g, "n1", "n0", "u", "z", (c("z") / F.sqrt(c("n1") + c("n0"))).alias("effect_r"), tail("__z").alias("p"))


def with_p(df: DataFrame, chi2: str = "chi2", dof: str = "dof") -> DataFrame:
    tail = F.pandas_udf(lambda x, d: pd.Series([chi2_tail(a, b) for a, b in zip(x, d, strict=True)]), "double")
    return df.withColumn("p", tail(F.col(chi2).cast("double"), F.col(dof).cast("double")))


def with_fisher(df: DataFrame, a: str, b: str, c: str, d: str) -> DataFrame:
    test = F.pandas_udf(lambda a, b, c, d: pd.Series([fisher_exact(*map(int, x)) for x in zip(a, b, c, d, strict=True)]), "double")
    return df.withColumn("fisher_p", test(a, b, c, d))


def false_discovery(df: DataFrame, p: str, tie: str, name: str = "q") -> DataFrame:
    """Benjamini-Hochberg adjusted p-values of a table of tests (as many rows as tests)."""
    up, down = Window.orderBy(F.asc(p), F.asc(tie)), Window.orderBy(F.desc(p), F.desc(tie)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    m = F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))
    raw = F.least(F.col(p) * m / F.row_number().over(up), F.lit(1.0))
    return df.withColumn("__raw", raw).withColumn(name, F.min("__raw").over(down)).drop("__raw")


def mean_difference(df: DataFrame, g: list[str], x: str, y: str) -> DataFrame:
    """Means by label, the standardised mean difference, and the pooled median distance from the median."""
    c = F.col
    rows = df.filter(c(y).isin(0, 1))
    medians = quantiles(rows, [*g, y], c(x), [0.5], "__med").select(*[c(k).alias(f"__g{i}") for i, k in enumerate(g)], c(y).alias("__y"), c("__med")[0].alias("__med"))
    away = rows.join(medians, [(c(y) == c("__y")), *[c(k) == c(f"__g{i}") for i, k in enumerate(g)]])
    mads = quantiles(away, [*g, y], F.abs(c(x) - c("__med")), [0.5], "__mad")
    mads = mads.groupBy(*g).agg(*[F.max(F.when(c(y) == k, c("__mad")[0])).alias(f"mad{k}") for k in (0, 1)])
    stats = df.groupBy(*g).agg(*[f(F.when(c(y) == k, c(x))).alias(f"{n}{k}") for k in (0, 1) for n, f in (("mean", F.avg), ("var", F.var_samp))])
    out = stats.na.drop(subset=g).join(mads, g, "left") if g else stats.join(F.broadcast(mads), F.lit(True))
    smd = F.try_divide(c("mean1") - c("mean0"), F.sqrt((c("var0") + c("var1")) / 2))
    return out.select(*g, "mean0", "mean1", smd.alias("smd"), F.sqrt((c("mad0") * c("mad0") + c("mad1") * c("mad1")) / 2).alias("pooled_mad"))


def bootstrap_median_difference(df: DataFrame, g: str, x: str, y: str, draws: int = 1000, seed: int = 42) -> DataFrame:
    """Median difference of label 1 and 0 by group with its 95 % interval, over seeded resamples of all of each label's rows.

    The middle ranks of n rows drawn with replacement are order statistics of n uniform numbers, which are beta distributed. So only they are
    drawn, for any n, and looked up in the sorted rows: the resampled median's law is exact, and no group is gathered.
    """
    c, label = F.col, [g, "y"]
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(g), F.col(x).cast("double").alias("x"), F.col(y).cast("int").alias("y"))
    counts = rows.groupBy(*label, "x").agg(F.count(F.lit(1)).alias("t"))
    sizes = counts.groupBy(*label).agg(F.sum("t").alias("n"))

    def middle(n: pd.Series, y: pd.Series) -> pd.Series:
        """Of each label: the two middle ranks (from 1) of the rows, and then of each resample, which are ranks of the rows too."""
        out = []
        for rows, k in zip(n, y, strict=True):
            rng, low, high = np.random.default_rng((seed, abs(int(k)))), (rows + 1) // 2, rows // 2 + 1
            u = rng.beta(low, rows - low + 1, draws)
            v = u + (1 - u) * rng.beta(1, rows - low, draws) if high > low else u
            drawn = np.minimum((np.stack([u, v], axis=1) * rows).astype(np.int64), rows - 1) + 1
            out.append(np.concatenate(([low, high], drawn.ravel())))
        return pd.Series(out)

    ranks = F.pandas_udf(middle, "array<bigint>")
    wanted = sizes.select(*label, F.posexplode(ranks("n", "y")).alias("p", "at"))
    up = Window.partitionBy(*label).orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    values = counts.select(*label, F.lit(None).cast("int").alias("p"), F.sum("t").over(up).alias("at"), "x")
    # A rank's value is that of the nearest cumulative count from there on.
    down = Window.partitionBy(*label).orderBy(F.desc("at"), F.asc_nulls_first("p")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = values.unionByName(wanted, allowMissingColumns=True).withColumn("x", F.last("x", ignorenulls=True).over(down)).filter("p is not null")
    one = lambda k: F.avg(F.when(c("y") == k, c("x")))
    each = met.groupBy(g, F.floor(c("p") / 2).alias("draw")).agg((one(1) - one(0)).alias("d"))
    again = F.when(c("draw") > 0, c("d"))
    return each.groupBy(g).agg(F.max(F.when(c("draw") == 0, c("d"))).alias("difference"), F.percentile(again, 0.025).alias("low"), F.percentile(again, 0.975).alias("high"))


def permutation_chi_square(df: DataFrame, x: str, y: str, draws: int = 500, seed: int = 42) -> DataFrame:
    """chi2 and its permutation p. Only the crosstab's margins matter, so labels are dealt to values by the hypergeometric law, on one small table."""

    def run(batches):
        table = pd.concat(list(batches))
        n0, n1 = table["n0"].to_numpy(), table["n1"].to_numpy()
        rng = np.random.default_rng(seed)

        def stat(a, b):
            rows, n = a + b, (a + b).sum()
            e0, e1 = rows * a.sum() / n, rows * b.sum() / n
            return float(np.sum(np.where(e0 > 0, (a - e0) ** 2 / np.maximum(e0, 1e-300), 0) + np.where(e1 > 0, (b - e1) ** 2 / np.maximum(e1, 1e-300), 0)))

        seen = stat(n0, n1)
        hits = 1 + sum(stat(n0 + n1 - d, d) >= seen - 1e-9 for d in rng.multivariate_hypergeometric(n0 + n1, int(n1.sum()), draws))
        yield pd.DataFrame({"chi2": [seen], "p": [hits / (draws + 1)]})

    return crosstab(df, x, y).coalesce(1).mapInPandas(run, "chi2 double, p double")


__all__ = [n for n, v in list(globals().items()) if callable(v) and getattr(v, "__module__", "") == __name__] + ["average_rank"]
