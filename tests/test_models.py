"""Variants, students, stacking and text vectors on small tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stallwise.operators import cluster, ml, resolve


def test_variant_clusters(spark):
    rows = [("p", 1, [1.0, 0.0, 0.0], 10.0), ("p", 2, [1.0, 0.02, 0.0], 10.5), ("p", 3, [0.0, 1.0, 0.0], 80.0), ("p", 4, [0.01, 1.0, 0.0], 85.0), ("p", 5, [1.0, 0.01, 0.0], None), ("q", 6, [0.0, 0.0, 2.0], -1.0), (None, 7, [1.0, 0.0, 0.0], 1.0), ("q", 8, None, 2.0)]
    df = spark.createDataFrame(rows, "product string, item int, v array<double>, price double").withColumn("variant", F.lit(9))
    got = {r["item"]: r for r in resolve.variant_clusters(df, "product", "item", "v", "price").collect()}
    assert sorted(got) == [1, 2, 3, 4, 5, 6]
    assert got[1]["variant"] == got[2]["variant"] == 0 and got[3]["variant"] == got[4]["variant"] != 0 and got[6]["variant"] == 0
    same = [r["item"] for r in got.values() if r["product"] == "p" and r["variant"] == got[3]["variant"]]
    logs = np.log([10.0, 10.5, 80.0, 85.0])
    z = {i: (np.log(rows[i - 1][3]) - logs.mean()) / (logs.std() + 1e-6) for i in (1, 2, 3, 4)} | {5: 0.0}
    f = {i: np.array([*rows[i - 1][2], 0.35 * z[i]]) for i in z}
    f = {i: x / np.linalg.norm(x) for i, x in f.items()}
    mean = sum(f[i] for i in same)
    assert got[3]["similarity"] == pytest.approx(float(f[3] @ mean / np.linalg.norm(mean)))
    assert resolve.variant_clusters(df.limit(0), "product", "item", "v", "price").count() == 0


def test_variant_summary(spark):
    rows = [("a", p, s) for p, s in ((10.0, 1), (20.0, 0), (20.0, 0), (50.0, 1), (-1.0, 1), (None, 0))]
    got = cluster.variant_summary(spark.createDataFrame(rows, "v string, price double, sold int"), ["v"], "price", "sold").first()
    assert (got["n"], got["sold_rate"], got["q25"], got["med"], got["q75"], got["mad"]) == (6, 0.5, 17.5, 20.0, 27.5, 5.0)


def test_students_and_stacking(spark):
    rng = np.random.default_rng(0)
    rows = [(i, float(a), float(b), float(a + b > 0), float(min(max(0.5 + 0.4 * a, 0), 1))) for i, (a, b) in enumerate(rng.normal(0, 1, (300, 2)))]
    df = spark.createDataFrame(rows, "id long, a double, b double, y double, teacher double")
    out = ml.student(df, df, "teacher", numbers=["a", "b"])
    assert out.columns == [*df.columns, "score"] and out.select(F.avg(F.abs(F.col("score") - F.col("teacher")))).first()[0] < 0.1
    passes = ml.student(df, df, "teacher", 0.5, numbers=["a", "b"])
    assert passes.filter((F.col("score") >= 0.5) == (F.col("teacher") >= 0.5)).count() > 270
    stacked = ml.stacked_scores(df, df, "y", "id", ("logistic", "tree"), numbers=["a", "b"])
    assert stacked.columns == [*df.columns, "score"] and stacked.filter((F.col("score") >= 0.5) == (F.col("y") > 0)).count() > 270


def test_text_vectors_and_saving(spark, tmp_path):
    df = spark.createDataFrame([(1, "red shoe"), (2, "red shoe new"), (3, None), (4, "blue bag"), (5, "blue bag")], "id int, t string")
    out, model = ml.text_vectors(df, "t")
    norms = {r["id"]: float(np.linalg.norm(r["vector"].toArray())) for r in out.collect()}
    assert norms[3] == 0.0 and all(norms[i] == pytest.approx(1.0) for i in (1, 2, 4, 5))
    ml.save(model, str(tmp_path / "model"))
    again = ml.load(str(tmp_path / "model")).transform(df).select("id", "vector").collect()
    assert {r["id"]: r["vector"] for r in again} == {r["id"]: r["vector"] for r in out.collect()}
