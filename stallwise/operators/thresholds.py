"""Choice of thresholds. All choosers share one harness: counts by distinct score with running sums from the highest score
(metrics.by_score), so each is linear in distinct scores and exact at ties; the best row is taken by max_by over a struct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .metrics import by_score
from .ordered import running


def candidates(df: DataFrame, g: list[str], s: str, y: str, digits: int | None, extra: tuple[float, ...] = ()) -> DataFrame:
    """For each group and candidate threshold t (scores rounded half-even, and extra ones): n and pos at s >= t, and totals."""
    scores = by_score(df, g, s, y)
    steps = scores.select(*g, F.col(s).alias("v"), "n", "pos", F.lit(False).alias("is_t"))
    t = F.bround(s, digits) if digits is not None else F.col(s)
    own = scores.select(*g, t.alias("v")).distinct()
    if extra:
        groups = scores.select(*g).distinct() if g else scores.limit(1).select(F.lit(1).alias("__one"))
        own = own.unionByName(groups.select(*g, F.explode(F.array(*map(F.lit, extra))).alias("v"))).distinct()
    marks = own.select(*g, "v", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("pos"), F.lit(True).alias("is_t"))
    down = Window.partitionBy(*g).orderBy(F.desc("v")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.partitionBy(*g)
    rows = steps.unionByName(marks).select(
        *g, F.col("v").alias("t"), "is_t", F.sum("n").over(down).alias("n"), F.sum("pos").over(down).alias("pos"), F.sum("n").over(every).alias("n_all"), F.sum("pos").over(every).alias("pos_all")
    )
    return rows.filter("is_t").drop("is_t").withColumn("precision", F.try_divide("pos", "n"))


def _best(df: DataFrame, g: list[str], *order: Column) -> DataFrame:
    rest = [c for c in df.columns if c not in g]
    best = df.groupBy(*g).agg(F.max_by(F.struct(*rest), F.struct(*[o.alias(f"o{k}") for k, o in enumerate(order)])).alias("b"))
    return best.select(*g, "b.*")


def choose(df: DataFrame, g: list[str], s: str, y: str, min_precision: float = 0.60, min_count: int = 20) -> DataFrame:
    """threshold, selected, positives, precision: the best valid candidate by (precision, positives, count, threshold), or else the best of all."""
    c = F.col
    rows = candidates(df, g, s, y, 4, (0.5, 0.6, 0.7, 0.8, 0.9))
    ok = (c("n") >= min_count) & (F.coalesce(c("precision"), F.lit(-1.0)) >= min_precision)
    return _best(rows, g, ok, F.coalesce("precision", F.lit(0.0)), c("pos"), c("n"), c("t")).select(*g, c("t").alias("threshold"), c("n").alias("selected"), c("pos").alias("positives"), "precision")


def choose_by(df: DataFrame, g: list[str], s: str, y: str, objective: str) -> DataFrame:
    """The candidate with the best "accuracy" (then f1, precision, the lowest threshold) or "f1" (then precision, recall, count)."""
    c = F.col
    rows = candidates(df, g, s, y, 6, (0.5,))
    rows = rows.withColumn("f1", F.try_divide(2 * c("pos"), c("n") + c("pos_all"))).withColumn("accuracy", (c("n_all") - c("pos_all") - c("n") + 2 * c("pos")) / c("n_all")).withColumn("recall", F.try_divide("pos", "pos_all"))
    none = lambda x: F.coalesce(x, F.lit(-1.0))
    order = (c("accuracy"), none(c("f1")), none(c("precision")), -c("t")) if objective == "accuracy" else (none(c("f1")), none(c("precision")), none(c("recall")), c("n"), c("t"))
    return _best(rows, g, *order).select(*g, c("t").alias("threshold"), c("n").alias("selected"), "precision", "recall", "f1", "accuracy")


def choose_accuracy(df: DataFrame, g: list[str], s: str, y: str) -> DataFrame:
    """Most correct rows with tied scores together, the strictest on a tie; a null threshold means that predicting none is best."""
    c = F.col
    rows = candidates(df, g, s, y, None)
    rows = rows.withColumn("correct", c("n_all") - c("pos_all") - c("n") + 2 * c("pos"))
    best = _best(rows, g, c("correct"), c("t"))
    none = c("n_all") - c("pos_all")
    return best.select(*g, F.when(c("correct") > none, c("t")).alias("threshold"), (F.greatest(c("correct"), none) / c("n_all")).alias("accuracy"))


def choose_for_precision(df: DataFrame, g: list[str], s: str, y: str, target: float) -> DataFrame:
    """Among thresholds that reach the target precision the one with most true positives, then most passed, then the lowest; null if none."""
    c = F.col
    rows = candidates(df, g, s, y, None)
    ok = F.coalesce(c("precision") >= target, F.lit(False))
    best = _best(rows, g, ok, F.when(ok, c("pos")).otherwise(0), F.when(ok, c("n")).otherwise(0), -c("t"))
    met = F.coalesce(c("precision") >= target, F.lit(False))
    return best.select(*g, F.when(met, "ok").otherwise("no_threshold_met_target").alias("status"), F.when(met, c("t")).alias("threshold"), F.when(met, c("n")).otherwise(0).alias("passed"), F.when(met, c("pos")).otherwise(0).alias("tp"))


def choose_for_recall(df: DataFrame, g: list[str], s: str, y: str, target: float) -> DataFrame:
    """The highest threshold that reaches the target recall."""
    c = F.col
    rows = candidates(df, g, s, y, None).filter(F.try_divide("pos", "pos_all") >= target)
    return _best(rows, g, c("t")).select(*g, c("t").alias("threshold"), c("n").alias("passed"), F.try_divide("pos", "pos_all").alias("recall"))


def choose_for_pass_rate(df: DataFrame, g: list[str], s: str, y: str, rate: float) -> DataFrame:
    """The lowest threshold that passes no more than this share of rows."""
    c = F.col
    rows = candidates(df, g, s, y, None).filter(c("n") <= rate * c("n_all"))
    return _best(rows, g, -c("t")).select(*g, c("t").alias("threshold"), c("n").alias("passed"), (c("n") / c("n_all")).alias("pass_rate"))


def choose_live(df: DataFrame, g: list[str], s: str, y: str, tie: str, min_precision: float, min_count: int) -> DataFrame:
    """By rows, ties split in the order of tie: the deepest rank with enough rows and precision, else the first rank of best precision."""
    c = F.col
    rows = running(df.filter(c(s).isNotNull()).select(*g, c(s).alias("t"), c(tie).alias("__tie"), c(y).cast("long").alias("__y")), g, [("t", False), "__tie"], {"n": F.lit(1).cast("long"), "pos": c("__y")})
    rows = rows.drop("__tie", "__y").withColumn("precision", c("pos") / c("n"))
    ok = (c("n") >= min_count) & (c("precision") >= min_precision)
    best = _best(rows, g, ok, F.when(ok, c("n").cast("double")).otherwise(c("precision")), -c("n"))
    return best.select(*g, c("t").alias("threshold"), "precision", c("n").alias("selected"))


def calibrated(df: DataFrame, g: list[str], s: str, y: str, fallback: float, min_precision: float, min_count: int) -> DataFrame:
    """For each group the best precision (then count) among candidates with enough rows that reach min_precision, else the best reachable, else the fallback."""
    c = F.col
    rows = candidates(df, g, s, y, 4)
    enough = c("n") >= min_count
    ok = enough & (c("precision") >= min_precision)
    best = _best(rows, g, ok, enough, F.when(enough, c("precision")).otherwise(-1.0), F.when(ok, c("n")).otherwise(0), c("t"))
    good = (c("n") >= min_count) & (c("precision") >= min_precision)
    return best.select(
        *g,
        F.when(c("n") >= min_count, c("t")).otherwise(fallback).alias("threshold"),
        F.when(good, "calibrated").when(c("n") >= min_count, "best_achievable").otherwise("global_fallback").alias("source"),
        F.when(c("n") >= min_count, c("precision")).alias("precision"),
        F.when(c("n") >= min_count, c("n")).otherwise(0).alias("selected"),
    )


def apply_to(df: DataFrame, thresholds: DataFrame, g: list[str], s: str, y: str) -> DataFrame:
    """Selected rows, positives, precision and recall of df at each group's threshold (a small table, broadcast by Spark's own size check)."""
    joined = df.join(thresholds.select(*g, "threshold"), g)
    passed = F.coalesce(F.col(s) >= F.col("threshold"), F.lit(False))
    out = joined.groupBy(*g).agg(F.first("threshold").alias("threshold"), F.count_if(passed).alias("selected"), F.sum(F.when(passed, F.col(y)).otherwise(0)).cast("long").alias("positives"), F.sum(F.col(y)).cast("long").alias("all_positives"))
    return out.select(*g, "threshold", "selected", "positives", F.try_divide("positives", "selected").alias("precision"), F.try_divide("positives", "all_positives").alias("recall"))


def material_precision(base: Column) -> Column:
    b = F.least(F.greatest(F.coalesce(base, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    return F.least(F.lit(0.95), F.greatest(F.lit(0.60), b + 0.20, b * 1.25))


def promotion(bar: float, extra: dict[str, Column] | None = None) -> tuple[Column, Column]:
    """(promoted, reasons) from val_precision, test_precision, val_p10, test_p10, val_count, test_count and base_rate columns."""
    c = F.col
    checks = {
        f"validation precision >= {bar:.2f}": c("val_precision") >= bar,
        f"test precision >= {bar:.2f}": c("test_precision") >= bar,
        f"validation precision@10 >= {bar:.2f}": c("val_p10") >= bar,
        f"test precision@10 >= {bar:.2f}": c("test_p10") >= bar,
        "at least 20 in validation": c("val_count") >= 20,
        "at least 10 in test": c("test_count") >= 10,
        "beats the base rate": c("test_precision") >= material_precision(c("base_rate")),
    } | (extra or {})
    reasons = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]))
    return F.size(reasons) == 0, F.array_join(reasons, "; ")


def variants(t: Column) -> dict[str, Column]:
    """The threshold itself (strict) and two lower ones, a step that small thresholds shrink."""
    hold = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    strict = hold(t)
    return {"strict": strict, "medium": hold(strict - F.least(F.lit(0.05), strict * 0.25)), "loose": hold(strict - F.least(F.lit(0.10), strict * 0.50))}
