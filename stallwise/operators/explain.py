"""Shapley values of tree ensembles, by the paths of their leaves, over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Leaf:
    """A leaf's value and its path: for each feature on it the share of rows that follow its splits, and the splits as (is left, threshold or left categories)."""

    value: float
    features: list[int]
    shares: list[float]
    splits: list[list[tuple[bool, object]]]


def leaves_of(model) -> tuple[list[Leaf], float]:
    """The leaves of all trees of a Spark ML tree, forest or boosted model, and what the model gives on average. A forest's or tree's value is the probability of label 1, a boosted model's its margin."""
    trees, weights = (model.trees, model.treeWeights) if hasattr(model, "trees") else ([model], [1.0])
    boosted = "GBT" in type(model).__name__
    total = 1.0 if boosted or "Regression" in type(model).__name__ else sum(weights)
    out: list[Leaf] = []

    def value(node) -> float:
        if boosted or "Regression" in type(model).__name__:
            return float(node.prediction())
        counts = list(node.impurityStats().stats())
        return float(counts[1] / sum(counts)) if len(counts) > 1 and sum(counts) else 0.0

    def walk(node, weight: float, path: dict[int, tuple[float, list]]) -> None:
        if node.subtreeDepth() == 0:
            out.append(Leaf(weight * value(node), list(path), [s for s, _ in path.values()], [x for _, x in path.values()]))
            return
        split, n = node.split(), float(node.impurityStats().count())
        at = int(split.featureIndex())
        test = float(split.threshold()) if hasattr(split, "threshold") and "Continuous" in split.getClass().getSimpleName() else frozenset(split.leftCategories())
        for left, child in ((True, node.leftChild()), (False, node.rightChild())):
            share, splits = path.get(at, (1.0, []))
            walk(child, weight, {**path, at: (share * float(child.impurityStats().count()) / n, [*splits, (left, test)])})

    for tree, weight in zip(trees, weights, strict=True):
        walk(tree._java_obj.rootNode() if hasattr(tree, "_java_obj") else tree._call_java("rootNode"), weight / total, {})
    return out, float(sum(x.value * np.prod(x.shares) for x in out))


def shapley(x: np.ndarray, leaves: list[Leaf]) -> np.ndarray:
    """Exact Shapley values (rows by features) of the game whose players are features, a missing one being averaged by the training rows' shares.

    A leaf's game is a product over its features of o (the row follows the splits) or of the share z; with the polynomial prod (z + o t) of the others its value has a closed form.
    """
    out = np.zeros_like(x, dtype=float)
    for leaf in leaves:
        m = len(leaf.features)
        if not m:
            continue
        o = np.ones((m, len(x)))
        for k, (feature, splits) in enumerate(zip(leaf.features, leaf.splits, strict=True)):
            for left, test in splits:
                goes = x[:, feature] <= test if isinstance(test, float) else np.isin(x[:, feature], list(test))
                o[k] *= goes == left
        weight = np.array([factorial(s) * factorial(m - 1 - s) / factorial(m) for s in range(m)])
        for k, feature in enumerate(leaf.features):
            p = np.zeros((m, len(x)))
            p[0] = 1.0
            for j in range(m):
                if j != k:
                    higher = p[:-1] * o[j]
                    p *= leaf.shares[j]
                    p[1:] += higher
            out[:, feature] += leaf.value * (o[k] - leaf.shares[k]) * (weight[:, None] * p).sum(axis=0)
    return out


def with_shapley(model, df: DataFrame, features: str = "features", name: str = "shap", step: int = 4096) -> tuple[DataFrame, float]:
    """(df with an array of each feature's Shapley value, the model's average). The values of a row and the average add up to what the model gives for it."""
    leaves, average = leaves_of(model)
    sent = df.sparkSession.sparkContext.broadcast(leaves)  # as large as the model

    @F.arrow_udf("array<double>")
    def values(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            x = batch.flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1) if len(batch) else np.zeros((0, 0))
            parts = [shapley(x[a : a + step], sent.value) for a in range(0, len(x), step)]
            flat = np.concatenate(parts) if parts else x
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * (x.shape[1] if len(x) else 0)), pa.array(flat.ravel()))

    return df.withColumn(name, values(vector_to_array(F.col(features)))), average


def importance(df: DataFrame, shap: str = "shap") -> DataFrame:
    """feature (its place from 0), importance (mean absolute Shapley value) and mean."""
    each = df.select(F.posexplode(shap).alias("feature", "value"))
    return each.groupBy("feature").agg(F.avg(F.abs("value")).alias("importance"), F.avg("value").alias("mean"))
