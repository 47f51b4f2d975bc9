"""Shapley values of trees, truncated SVD and calibrated margins against direct computation."""

import itertools
import math

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from stallwise.operators import explain, ml
from stallwise.sources.scratch import Scratch


def table(spark, n=400):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(n, 5))
    x[:, 4] = rng.integers(0, 3, n)
    y = ((x[:, 0] > 0.2) ^ (x[:, 1] * x[:, 2] > 0.1) | (x[:, 4] == 2)).astype(float)
    df = spark.createDataFrame([(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y, strict=True))], "id int, a double, b double, c double, d double, e double, label double")
    return VectorAssembler(inputCols=list("abcde"), outputCol="features").transform(df)


def expectation(leaves, x, known):
    """What the model gives when only the known features are: leaves weighted by splits followed, or by shares."""
    total = 0.0
    for leaf in leaves:
        p = leaf.value
        for feature, share, splits in zip(leaf.features, leaf.shares, leaf.splits, strict=True):
            p *= all((x[feature] <= t if isinstance(t, float) else x[feature] in t) == left for left, t in splits) if feature in known else share
        total += p
    return total


@pytest.mark.parametrize("make", [lambda: DecisionTreeClassifier(maxDepth=4, seed=1), lambda: RandomForestClassifier(numTrees=5, maxDepth=4, seed=1), lambda: GBTClassifier(maxIter=4, maxDepth=4, seed=1)])
def test_shapley_values_by_all_subsets(spark, make):
    df = table(spark)
    model = make().fit(df)
    rows, average = explain.with_shapley(model, df.filter("id % 40 = 0"))
    got = model.transform(rows).select("id", "shap", vector_to_array("features").alias("x"), vector_to_array("probability")[1].alias("p"), vector_to_array("rawPrediction")[1].alias("m")).collect()
    leaves, same = explain.leaves_of(model)
    assert average == pytest.approx(same) and len(got) == 10
    for r in got:
        x, want = r["x"], np.zeros(5)
        for k in range(5):
            others = [j for j in range(5) if j != k]
            for size in range(5):
                for s in itertools.combinations(others, size):
                    weight = math.factorial(size) * math.factorial(4 - size) / math.factorial(5)
                    want[k] += weight * (expectation(leaves, x, {*s, k}) - expectation(leaves, x, set(s)))
        assert np.allclose(r["shap"], want, atol=1e-12)
        boosted = "GBT" in type(model).__name__
        assert average + sum(r["shap"]) == pytest.approx(r["m"] if boosted else r["p"], abs=1e-9)
    top = {r["feature"]: r["importance"] for r in explain.importance(rows).collect()}
    assert len(top) == 5 and max(top, key=top.get) in (0, 1, 2, 4)


def test_svd_spans_what_numpy_finds(spark):
    rng = np.random.default_rng(2)
    words = [f"w{k}" for k in range(30)]
    df = spark.createDataFrame([(i, " ".join(rng.choice(words[i % 3 * 8 : i % 3 * 8 + 12], 9))) for i in range(120)] + [(500, ""), (501, None)], "id int, t string")
    out, v, s = ml.svd_vectors(df, "t", k=6)
    model = ml.Pipeline(stages=ml.preparation([], ["t"])[:-1]).fit(df)
    rows = {r["id"]: np.array(r["x"]) for r in model.transform(df).select("id", vector_to_array("t__tfidf").alias("x")).collect()}
    x = np.stack([rows[i] for i in sorted(rows)])
    u, want, _ = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(s, want[:6], rtol=1e-6) and np.allclose(v.T @ v, np.eye(6), atol=1e-9)
    got = {r["id"]: np.array(r["svd"]) for r in out.collect()}
    made, best = np.stack([got[i] for i in sorted(got)]), u[:, :6] * want[:6]
    assert np.allclose(made @ made.T, best @ best.T, atol=1e-5 * want[0] ** 2) and not got[501].any()  # terms that tie have no fixed order, documents do


def test_platt_is_the_likeliest_of_smoothed_labels(spark):
    rng = np.random.default_rng(9)
    m = np.concatenate((rng.normal(1, 1, 60), rng.normal(-1, 1, 140)))
    y = np.arange(200) < 60
    a, b = ml.platt(spark.createDataFrame([(float(x), int(t)) for x, t in zip(m, y, strict=True)] + [(None, 1), (float("nan"), 0)], "m double, y int"), "m", "y")
    t = np.where(y, 61 / 62, 1 / 142)

    def loss(a, b):
        z = a * m + b
        return float((t * z + np.log1p(np.exp(-z))).sum())

    assert a < 0 and all(loss(a, b) <= loss(a + da, b + db) + 1e-9 for da in (-1e-3, 0, 1e-3) for db in (-1e-3, 0, 1e-3))
    assert ml.platt(spark.createDataFrame([], "m double, y int"), "m", "y")[0] == 0.0


def test_calibrated_svm(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 2))
    p = 1 / (1 + np.exp(-2 * x[:, 0]))
    df = spark.createDataFrame([(i, float(a), float(b), float(rng.random() < q)) for i, ((a, b), q) in enumerate(zip(x, p, strict=True))], "id int, a double, b double, y double")
    out = ml.calibrated_svm(df, df, "y", "id", numbers=["a", "b"]).orderBy("id").collect()
    score = np.array([r["score"] for r in out])
    assert np.abs(score - p).mean() < 0.06 and out[0].asDict().keys() == {"id", "a", "b", "y", "score"}


def test_vocabularies_of_all_folds(spark):
    """One pass finds each fold's vocabulary, ties cut alike however the rows lie."""
    rng = np.random.default_rng(6)
    rows = [(i, float(i % 2), " ".join(f"w{k:02d}" for k in rng.integers(0, 24, 6) + 6 * (i % 2)), float(rng.normal())) for i in range(150)]
    df = spark.createDataFrame([*rows, (150, 1.0, None, 0.0)], "id int, y double, t string, n double")
    columns = {"numbers": ["n"], "texts": ["t"]}
    dealt, scratch = ml.folds(df, "y", "id", 3, "__fold").cache(), Scratch(spark, "t")
    split = ml.Pipeline(stages=ml._terms("t", False)).fit(dealt)
    found = lambda rows, size, least: ml.vocabularies(split.transform(rows), "t__terms", "__fold", 3, size, least, scratch)
    for least in (2, 0.05):
        for k, v in enumerate(found(dealt, 10_000, least)):
            plain = ml.CountVectorizer(inputCol="t__terms", outputCol="c", vocabSize=10_000, minDF=least).fit(split.transform(dealt.filter(F.col("__fold") != k)))
            assert sorted(v) == sorted(plain.vocabulary) and len(v) > 20
    few = found(dealt.repartition(5), 9, 2)
    assert few == found(dealt.coalesce(1), 9, 2) and [len(v) for v in few] == [9, 9, 9]


def test_full_preparation(spark):
    df = spark.createDataFrame([(i, "É bello" if i < 4 else "e altro", "many" if i < 6 else f"few{i}", float(i)) for i in range(10)], "id int, t string, c string, n double")
    model = ml.Pipeline(stages=ml.preparation(["n"], ["t"], ["c"], **ml.FULL)).fit(df)
    terms = next(s.vocabulary for s in model.stages if getattr(s, "vocabulary", None) and "bello" in s.vocabulary)
    hot = next(s.vocabulary for s in model.stages if getattr(s, "vocabulary", None) and "many" in s.vocabulary)
    assert hot == ["many"] and all("é" not in t for t in terms)
    more = spark.range(300).select(F.col("id").cast("double").alias("n"), (F.col("id") > 140).cast("double").alias("y"))
    assert ml.pipeline("hist_gb_tuned", "y", numbers=["n"]).fit(more).transform(df).count() == 10
