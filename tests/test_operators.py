"""Operators against small pandas or NumPy references, with ties, nulls and empty tables."""

import datetime as dt

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stallwise.operators import buy, cluster, deals, identity, metrics, outcomes, resolve, splits, state, stats, thresholds, voting
from stallwise.sources import tables


def frame(spark, seed, n=200, ties=20):
    rng = np.random.default_rng(seed)
    rows = [(i, "ab"[int(rng.integers(2))], float(rng.integers(ties)) / ties, int(rng.integers(2))) for i in range(n)]
    return spark.createDataFrame(rows, "id int, g string, s double, y int"), pd.DataFrame(rows, columns=["id", "g", "s", "y"])


def test_dedupe_keeps_first_and_last(spark):
    rows = [("a", 2, 1), ("a", 1, 2), ("a", None, 3), ("b", None, 4), (None, 1, 5), (" ", 1, 6)]
    df = spark.createDataFrame(rows, "k string, t int, i int")
    pick = lambda x: sorted(r["i"] for r in x.collect())
    assert pick(identity.dedupe(df, ["k"], ["t", "i"], "first")) == [2, 4]
    assert pick(identity.dedupe(df, ["k"], ["t", "i"], "last")) == [3, 4]
    assert pick(identity.dedupe(df, ["k"], ["t", "i"], "first", "keep")) == [2, 4, 5, 6]
    assert identity.dedupe(df.limit(0), ["k"], ["t", "i"]).count() == 0


def test_anti_join_matches_either_key(spark):
    df = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z"), (None, "w")], "id int, link string")
    known = spark.createDataFrame([(1, "q"), (None, "y")], "id int, link string")
    assert sorted(r["link"] for r in state.without_known(df, known, "id", "link").collect()) == ["w", "z"]


def test_retention_moves_the_oldest(spark):
    df = spark.createDataFrame([(i, None if i == 0 else i) for i in range(10)], "id int, d int")
    kept, moved = state.overflow(df, 7, "d", "id")
    assert sorted(r["id"] for r in moved.collect()) == [1, 2, 3] and kept.count() == 7


def test_enrichment_fills_only_blanks(spark):
    t = spark.createDataFrame([(1, "", "p"), (2, "own", "q"), (3, None, "r")], "k int, a string, b string")
    s = spark.createDataFrame([(1, "new", "zz"), (2, "other", "zz")], "k int, a string, b string")
    got = {r["k"]: (r["a"], r["b"]) for r in state.fill_missing(t, s, "k", ["a", "b"], protected=("b",)).collect()}
    assert got == {1: ("new", "p"), 2: ("own", "q"), 3: (None, "r")}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_auc(spark, seed):
    df, pdf = frame(spark, seed)
    got = {r["g"]: r for r in metrics.auc(df, ["g"], "s", "y").collect()}
    for g, x in pdf.groupby("g"):
        pos, neg = x.s[x.y == 1].to_numpy(), x.s[x.y == 0].to_numpy()
        want = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
        assert got[g]["roc_auc"] == pytest.approx(want)
        ap, seen = 0.0, 0
        for v in sorted(x.s.unique(), reverse=True):
            top = x[x.s >= v]
            ap += (top.y.sum() - seen) / len(pos) * top.y.mean()
            seen = top.y.sum()
        assert got[g]["pr_auc"] == pytest.approx(ap)


def test_auc_of_one_class_is_null(spark):
    df = spark.createDataFrame([("a", 0.5, 1), ("a", 0.7, 1)], "g string, s double, y int")
    assert metrics.auc(df, ["g"], "s", "y").first()["roc_auc"] is None


@pytest.mark.parametrize("seed", [4, 5])
def test_choose_threshold(spark, seed):
    df, pdf = frame(spark, seed)
    got = {r["g"]: r for r in thresholds.choose(df, ["g"], "s", "y", 0.5, 10).collect()}
    for g, x in pdf.groupby("g"):
        rows = []
        for t in set(np.round(x.s, 4)) | {0.5, 0.6, 0.7, 0.8, 0.9}:
            top = x[x.s >= t]
            p = top.y.mean() if len(top) else np.nan
            rows.append((len(top) >= 10 and p >= 0.5, 0 if np.isnan(p) else p, int(top.y.sum()), len(top), t))
        want = max(rows)
        assert (got[g]["threshold"], got[g]["selected"]) == (want[4], want[3])


def test_threshold_example(spark):
    df = spark.createDataFrame([("g", 0.9, int(i < 8)) for i in range(10)] + [("g", 0.1, 0)] * 10, "g string, s double, y int")
    got = thresholds.choose(df, ["g"], "s", "y", 0.6, 5).first()
    assert (got["selected"], got["precision"]) == (10, 0.8)


def test_qcut_matches_pandas(spark):
    rng = np.random.default_rng(0)
    x = rng.integers(0, 30, 300).astype(float)
    got = metrics.quantile_bins(spark.createDataFrame([(int(i), float(v)) for i, v in enumerate(x)], "i int, x double"), "x", 7).orderBy("i").collect()
    assert [r["bin"] for r in got] == pd.qcut(x, 7, labels=False, duplicates="drop").tolist()


def test_robust_statistics(spark):
    df = spark.createDataFrame([("a", v) for v in (1.0, 2.0, 4.0, 9.0, -1.0, float("nan"))] + [("b", 5.0)], "g string, p double")
    got = {r["g"]: r for r in deals.price_stats(df, ["g"], "p").collect()}
    assert (got["a"]["n"], got["a"]["med"], got["a"]["q25"], got["a"]["mad"]) == (4, 3.0, 1.75, 1.5) and got["b"]["mad"] == 0.0


def test_outcome_fold_first_decision_stands(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(1, t0, t0 + dt.timedelta(hours=h), sold) for h, sold in ((0.5, False), (1.1, False), (2.1, True))] + [(2, t0, t0 + dt.timedelta(hours=9), True)]
    df = spark.createDataFrame(rows, "k int, first timestamp, at timestamp, sold boolean")
    got = {(r["k"], r["hours"]): r["sold"] for r in outcomes.fold(df, "k", "first", "at", F.col("sold"), (1, 2, 12)).collect()}
    assert got == {(1, 1): False, (1, 2): True, (1, 12): True, (2, 1): None, (2, 2): None, (2, 12): True}


def test_time_split_counts(spark):
    df = spark.createDataFrame([(i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=7 * i)) for i in range(10)], "i int, t timestamp")
    got = {r["split"]: r["count"] for r in splits.by_time(df, "t", "i").groupBy("split").count().collect()}
    assert got == {"train": 6, "validation": 2, "test": 2}


def test_stratified_split_counts(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2], i // 2 % 2) for i in range(80)], "i int, g string, y int")
    got = {r["split"]: r["count"] for r in splits.stratified(df, ["g", "y"], "i").groupBy("split").count().collect()}
    assert got == {"train": 48, "validation": 16, "test": 16}


def test_average_linkage(spark):
    d = np.array([[0, 0.1, 0.9, 0.9], [0.1, 0, 0.8, 0.9], [0.9, 0.8, 0, 0.2], [0.9, 0.9, 0.2, 0]])
    assert cluster.average_linkage(d, 0.24).tolist() == [0, 0, 1, 1]
    assert cluster.average_linkage(d, 0.05).tolist() == [0, 1, 2, 3]
    assert cluster.average_linkage(d, 2.0).tolist() == [0, 0, 0, 0]


def test_large_blocks_are_clustered_whole(spark):
    # 2,100 rows in pairs that are close to each other only.
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1050, 64))[np.arange(2100) // 2] + rng.normal(size=(2100, 64)) * 0.01
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(x.tolist())], "block string, item long, v array<double>")
    got = {r["item"]: r for r in resolve.clusters(df, "block", "item", "v", 0.24).collect()}
    assert [got[i]["label"] for i in range(2100)] == [i // 2 for i in range(2100)]
    assert min(r["silhouette"] for r in got.values()) > 0.9


def test_clusters_of_vectors_are_those_of_the_distance_matrix():
    for seed in range(12):
        rng = np.random.default_rng(seed)
        n = int(rng.integers(1, 150))
        x = rng.normal(size=(9, 8))[rng.integers(0, 9, n)] + rng.normal(size=(n, 8)) * rng.uniform(0.1, 0.9)
        x[n // 2 :] = x[: n - n // 2] if seed % 3 == 0 else x[n // 2 :]
        x[0] *= seed % 5 > 0
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        d = np.maximum(1 - x @ x.T, 0)
        label = cluster.average_linkage(d, 0.24)
        assert cluster.average_linkage_of_vectors(x, 0.24, 64).tolist() == label.tolist()
        assert cluster.silhouette_of_vectors(x, label, 100) == pytest.approx(cluster.silhouette(d, label), abs=1e-9)



def test_statistics():
    assert stats.fisher_exact(8, 2, 1, 5) == pytest.approx(0.03496503, abs=1e-7)
    assert stats.chi2_tail(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    assert stats.chi2_tail(18.307038053275146, 10) == pytest.approx(0.05, abs=1e-9)


def test_votes_and_weights(spark):
    m = spark.createDataFrame([("s", "a", 0.8, 0.5), ("s", "b", 0.4, 0.5)], "search string, model string, roc_auc double, threshold double")
    s = spark.createDataFrame([("s", 1, "a", 0.9), ("s", 1, "b", 0.1)], "search string, item int, model string, score double")
    assert voting.vote(s, m, ["search"], "item", "model", "score", "auc_soft").first()["vote"] == pytest.approx(0.9)
    assert voting.vote(s, m, ["search"], "item", "model", "score", "uniform_hard").first()["vote"] == pytest.approx(0.5)


def test_rule_grid_counts(spark):
    df, pdf = frame(spark, 9)
    got = {(r["min_s"],): (r["selected"], r["positives"]) for r in buy.rule_grid(df, "y", "s", {"s": [0.0, 0.5, 0.9]}).collect()}
    assert got == {(t,): (int((pdf.s >= t).sum()), int(pdf.y[pdf.s >= t].sum())) for t in (0.0, 0.5, 0.9)}


def test_upsert_and_delete(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    c = spark.createDataFrame([(2, None, 9), (3, "c", 8)], "k int, v string, w int")
    got = {r["k"]: (r["v"], r["w"]) for r in tables.upsert(t, c, "k").collect()}
    assert got == {1: ("a", None), 2: ("b", 9), 3: ("c", 8)}
    assert [r["k"] for r in tables.delete(t, c, "k").collect()] == [1]


def test_sources(spark, tmp_path):
    (tmp_path / "x.csv").write_text('Title,Price,Dataid\n"a, b",1.5,7\n,bad,8\n')
    got = tables.read_csv(spark, str(tmp_path / "x.csv"), tables.LISTING).orderBy("Dataid").collect()
    assert (got[0]["Title"], got[0]["Price"], got[0]["Likes"]) == ("a, b", 1.5, None) and got[1]["Price"] is None
    assert tables.read_csv(spark, str(tmp_path / "no.csv"), tables.LISTING).count() == 0
    (tmp_path / "e.jsonl").write_text('{"kind": "a", "ok": true}\n\nbroken\n')
    assert tables.read_jsonl(spark, str(tmp_path / "e.jsonl"), tables.DOWNLOAD_EVENT).filter("kind = 'a'").count() == 1
    tables.write_json(spark, str(tmp_path / "m.json"), {"a": 1})
    assert tables.read_json(spark, str(tmp_path / "m.json")) == {"a": 1} and tables.read_json(spark, str(tmp_path / "n.json"), 5) == 5
    for run in ("run1", "run2"):
        (tmp_path / run).mkdir()
        (tmp_path / run / "f.csv").write_text("Title\nq\n")
    os.utime(tmp_path / "run1" / "f.csv", (4e9, 4e9))
    assert tables.latest_run(spark, str(tmp_path), "f.csv", "time").endswith("run1")
    for k in range(2):
        tables.append_jsonl(spark.createDataFrame([(k, "x" if k else None)], "k int, v string"), str(tmp_path / "log"))
    assert sorted(map(tuple, tables.read_jsonl(spark, str(tmp_path / "log"), spark.createDataFrame([], "k int, v string").schema).collect())) == [(0, None), (1, "x")]
    assert tables.latest_run(spark, str(tmp_path), "f.csv").endswith("run2") and tables.data_lines(spark, str(tmp_path / "run1" / "f.csv")) == 1
    assert {r["SearchName"] for r in tables.read_search_folders(spark, str(tmp_path), "f.csv", tables.LISTING).collect()} == {"run1", "run2"}


def test_bootstrap_takes_all_rows(spark):
    # 240,000 rows a label of few frequent values, beyond any cap and with ranks that are far apart.
    df = spark.range(480_000).select(F.lit("g").alias("g"), (F.col("id") % 2).alias("y"), F.when(F.col("id") % 2 == 1, F.floor(F.col("id") / 2) % 7 * 10).otherwise(F.floor(F.col("id") / 2) % 5).alias("x"))
    got = stats.bootstrap_median_difference(df, "g", "x", "y", 100).collect()
    assert [tuple(r) for r in got] == [("g", 28.0, 28.0, 28.0)]


@pytest.mark.parametrize("n", [40, 41])
def test_bootstrap_agrees_with_resampled_rows(spark, n):
    rng = np.random.default_rng(n)
    a, b = rng.normal(3, 2, n), np.round(rng.normal(0, 3, n + 9))
    rows = [("g", 1, float(v)) for v in a] + [("g", 0, float(v)) for v in b] + [(None, 1, 4.0), (None, 0, 1.0), ("one", 1, 2.0)]
    got = {r["g"]: tuple(r)[1:] for r in stats.bootstrap_median_difference(spark.createDataFrame(rows, "g string, y int, x double"), "g", "x", "y", 4000).collect()}
    assert got[None] == (3.0, 3.0, 3.0) and got["one"] == (None, None, None)
    d = np.median(rng.choice(a, (20_000, len(a))), axis=1) - np.median(rng.choice(b, (20_000, len(b))), axis=1)
    assert got["g"][0] == pytest.approx(np.median(a) - np.median(b))
    assert got["g"][1:] == pytest.approx(np.percentile(d, [2.5, 97.5]), abs=0.25)



def test_image_metrics(spark):
    ppm = b"P5 16 16 255\n" + bytes(range(256))
    df = spark.createDataFrame([("a", bytearray(ppm)), ("b", bytearray(b"junk"))], "path string, content binary")
    got = {r["path"]: r for r in cluster.image_metrics(df).collect()}
    assert got["a"]["brightness"] == pytest.approx(0.5) and got["b"]["hash"] is None


def test_files_of_one_header_are_one_scan(spark, tmp_path):
    """Odd folder names, headers in another order, a quoted line break, an empty file."""
    for name, text in (("a b+c%20", "id,v\n1,x\n2,\"two\nlines\"\n"), ("d", "id,v\n3,y\n"), ("e", "v,id\nz,4\n"), ("empty", ""), ("out", "id,v\n9,q\n")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "f.csv").write_text(text)
    schema = spark.createDataFrame([], "id int, v string").schema
    df = tables.read_search_folders(spark, str(tmp_path), "f.csv", schema, exclude=("out",))
    assert sorted(map(tuple, df.collect())) == [(1, "x", "a b+c%20"), (2, "two\nlines", "a b+c%20"), (3, "y", "d"), (4, "z", "e")]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Relation [") <= 3
    assert tables.read_tagged(spark, str(tmp_path / "d" / "*.csv"), schema).first()["source_file"] == "f.csv"
