"""Running sums, ranks and quantiles by pieces against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stallwise.operators import ordered


def rows_of(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([None, float("nan"), 0.0, -0.5, 1.5, 2.5, 1e300]) if rng.random() < 0.4 else rng.random(), i, rng.choice([None, 1, 2])) for i in range(3000)]
    return spark.createDataFrame(rows, "g string, x double, i long, w int"), rows


def order_key(r, up):
    x = r[1]
    key = (1, 0) if x is None else (0, float("inf") if x != x else x) if up else (0, -(float("inf") if x != x else x))
    return (key, r[2])


@pytest.mark.parametrize("up", [True, False])
@pytest.mark.parametrize("piece", [None, 100])
def test_running_sums(spark, up, piece):
    df, rows = rows_of(spark)
    got = {r["i"]: (r["s"], r["s_all"], r["n"], r["n_all"]) for r in ordered.running(df, ["g"], [("x", up), "i"], {"s": F.col("w"), "n": F.lit(1)}, totals=True, rows=piece).collect()}
    for g in ("a", "b", None):
        own, s = sorted((r for r in rows if r[0] == g), key=lambda r: order_key(r, up)), 0
        for n, r in enumerate(own, 1):
            s += r[3] or 0
            assert got[r[2]] == (s, sum(x[3] or 0 for x in own), n, len(own))


def test_pieces_split_ties_and_nulls(spark):
    """One value, or none, in all rows: the tie column cuts them."""
    df = spark.range(20_000).select(F.lit("g").alias("g"), F.lit(None).cast("timestamp").alias("t"), F.col("id").alias("i"))
    sizes = [r["count"] for r in ordered.pieces(df, ["g"], ["t", "i"], rows=1000).groupBy("__piece").count().collect()]
    assert len(sizes) >= 15 and max(sizes) < 4000
    ranks = ordered.ranked(df, ["g"], ["t", "i"], rows=1000)
    assert ranks.filter("__r != i + 1 or __n != 20000").count() == 0 and ordered.ranked(df.limit(0), ["g"], ["t", "i"]).count() == 0


@pytest.mark.parametrize("piece", [None, 50])
def test_quantiles_as_percentile(spark, piece):
    df, _ = rows_of(spark)
    df = df.unionByName(spark.createDataFrame([("none", None, 0, 0), ("one", 4.0, 1, 1)], df.schema))
    ps = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    same = lambda a, b: a is b or (a is not None and b is not None and all(x == y or (x != x and y != y) for x, y in zip(a, b, strict=True)))
    want = {r["g"]: r["q"] for r in df.groupBy("g").agg(F.percentile("x", F.array(*map(F.lit, ps))).alias("q")).collect()}
    got = {r["g"]: r["q"] for r in ordered.quantiles(df, ["g"], F.col("x"), ps, rows=piece).collect()}
    assert set(got) == set(want) and all(same(got[g], want[g]) for g in want)
    whole = ordered.quantiles(df.filter("not isnan(x)"), [], F.col("x"), ps, rows=piece).collect()
    assert len(whole) == 1 and same(whole[0]["q"], df.filter("not isnan(x)").agg(F.percentile("x", F.array(*map(F.lit, ps))).alias("q")).first()["q"])
    none = ordered.quantiles(df.limit(0), [], F.col("x"), ps).collect()
    assert len(none) == 1 and none[0]["q"] is None


def test_quantiles_of_a_million_values_in_one_group(spark):
    df = spark.range(1_000_000).select(F.lit(1).alias("g"), (F.pmod(F.col("id") * 7919, F.lit(1_000_003)) / 3).alias("x"))
    found = ordered.quantiles(df, ["g"], F.col("x"), [0.25, 0.5], rows=50_000)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan and "Percentile" not in plan
    x = np.sort((np.arange(1_000_000) * 7919 % 1_000_003) / 3)
    assert found.first()["q"] == pytest.approx(np.quantile(x, [0.25, 0.5]).tolist(), rel=1e-15)
