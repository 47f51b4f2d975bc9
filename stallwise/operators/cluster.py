"""Entity resolution: blocks, average-linkage clusters, representatives, centroids, outliers and near-duplicate images."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import Scratch
from .ordered import quantiles, ranked


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def let(value: Column, body) -> Column:
    """body of a value that is evaluated once: inside a lambda over an array, any other expression is evaluated again for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def unit(a: Column) -> Column:
    scaled = lambda v: let(norm(v), lambda n: F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double"))))
    return let(a, scaled)


def online_mean(mean: Column, n: Column, x: Column) -> Column:
    """The mean after one more vector: mean + (x - mean) / (n + 1)."""
    return F.zip_with(mean, x, lambda m, v: m + (v.cast("double") - m) / (n + 1))


def weighted_mean(x: Column, weight: Column) -> Column:
    """The mean of x, null values left out, over rows that each stand for weight equal ones."""
    return F.try_divide(F.sum(x * weight), F.sum(F.when(x.isNotNull(), weight)))


def centroids(df: DataFrame, keys: list[str], vector: str, weight: str | None = None) -> DataFrame:
    """The mean vector of each group: components are averaged by position, combined on the map side. weight: how many equal rows a row stands for."""
    each = df.select(*keys, F.posexplode(vector).alias("__at", "__v"), *([F.col(weight).alias("__w")] if weight else []))
    v = F.col("__v").cast("double")
    mean, n = (weighted_mean(v, F.col("__w")), F.sum("__w")) if weight else (F.avg(v), F.count(F.lit(1)))
    means = each.groupBy(*keys, "__at").agg(mean.alias("__m"), n.alias("__n"))
    return means.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("__at", "__m"))), lambda x: x["__m"]).alias("centroid"), F.max("__n").alias("n"))


def nearest(df: DataFrame, table: DataFrame, vector: str, key: str, threshold: float | None = None, most_bytes: int = 64 << 20) -> DataFrame:
    """df with the nearest centroid's key and dist = 1 - dot (centroids aren't normalised again), ties to the smaller key; -1 beyond the threshold.

    The centroids' size is measured. Up to most_bytes they are gathered into one array that is broadcast, so each row scans it in place and no pairs are
    made. More are dealt into blocks of that size, one after the other, with the best so far written in between, so that one block at a time is broadcast.
    """
    n_bytes = table.agg(F.sum(F.size("centroid") * 8 + 32)).first()[0] or 0
    blocks, out = max(1, math.ceil(n_bytes / most_bytes)), df
    scratch = Scratch(df.sparkSession, "nearest") if blocks > 1 else None
    for b in range(blocks):
        part = table if scratch is None else table.filter(F.pmod(F.xxhash64(key), F.lit(blocks)) == b)
        packed = part.agg(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), F.col("centroid").alias("c")))).alias("__t"))
        found = F.array_min(F.transform("__t", lambda t: F.struct((1 - dot(F.col(vector), t["c"])).alias("dist"), t["k"].alias("k"))))
        out = out.join(F.broadcast(packed), F.lit(True)).withColumn("__f", F.least("__f", found) if b else found).drop("__t")
        out = scratch.write(out) if scratch else out
    hit = F.col("__f.k") if threshold is None else F.when(F.col("__f.dist") <= threshold, F.col("__f.k")).otherwise(F.lit(-1))
    return out.select(*df.columns, hit.alias("nearest"), F.col("__f.dist").alias("dist"))


def representatives(df: DataFrame, keys: list[str], vector: str, item: str) -> DataFrame:
    """The item of each group with the largest dot product with the centroid, ties to the smaller item."""
    c = centroids(df, keys, vector)
    scored = df.join(c, keys).withColumn("__d", dot(F.col(vector), F.col("centroid")))
    return scored.groupBy(*keys).agg(F.min_by(item, F.struct(-F.col("__d"), F.col(item))).alias("representative"), F.max("n").alias("n"))


def average_linkage(distance: np.ndarray, threshold: float) -> np.ndarray:
    """Cluster labels from 0 in order of first members: the two nearest clusters (mean pair distance) merge while nearer than threshold."""
    n = len(distance)
    d = distance.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    size, alive, label = np.ones(n), np.ones(n, bool), np.arange(n)
    while alive.sum() > 1:
        i, j = divmod(int(np.argmin(d)), n)
        if d[i, j] >= threshold:
            break
        i, j = min(i, j), max(i, j)
        d[i] = d[:, i] = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        size[i] += size[j]
        alive[j] = False
        d[j] = d[:, j] = np.inf
        d[i, i] = np.inf
        label[label == j] = i
    return np.unique(label, return_inverse=True)[1]


def silhouette(distance: np.ndarray, label: np.ndarray) -> np.ndarray:
    out = np.zeros(len(label))
    groups = [np.flatnonzero(label == k) for k in range(label.max() + 1)]
    if len(groups) < 2:
        return out
    mean = np.stack([distance[:, g].mean(axis=1) for g in groups], axis=1)
    for i, k in enumerate(label):
        if len(groups[k]) > 1:
            a = mean[i, k] * len(groups[k]) / (len(groups[k]) - 1)
            b = np.delete(mean[i], k).min()
            out[i] = (b - a) / max(a, b) if max(a, b) > 0 else 0.0
    return out


def average_linkage_of_vectors(x: np.ndarray, threshold: float, tile: int = 512, weight: np.ndarray | None = None) -> np.ndarray:
    """average_linkage of the distances 1 - dot of the rows, without their matrix: a mean pair distance follows from the clusters' vector sums.

    weight: how many equal rows a row stands for; such rows merge at distance 0, before any others.
    Each cluster keeps its nearest one. A merge brings no cluster nearer to another than the nearer of the two was, so what is kept stays a
    lower bound, and is computed again only when it comes first. Memory is a few copies of x; time grows with the square of the rows.
    """
    n = len(x)
    size, label = np.ones(n) if weight is None else weight.astype(float), np.arange(n)
    x = x.astype(float)
    total = x * size[:, None]
    alive, fresh = np.ones(n, bool), np.ones(n, bool)
    near, far = np.zeros(n, np.int64), np.full(n, np.inf)
    for a in range(0, n, tile):
        d = np.maximum(1 - x[a : a + tile] @ x.T, 0)
        d[np.arange(len(d)), np.arange(a, a + len(d))] = np.inf
        near[a : a + tile] = d.argmin(axis=1)
        far[a : a + tile] = d.min(axis=1)

    def renew(i: int) -> None:
        d = np.maximum(1 - total @ total[i] / (size * size[i]), 0)
        d[~alive] = np.inf
        d[i] = np.inf
        near[i] = d.argmin()
        far[i], fresh[i] = d[near[i]], True

    while n > 1:
        i = int(far.argmin())
        if far[i] >= threshold:
            break
        if not fresh[i]:
            renew(i)
            continue
        i, j = sorted((i, int(near[i])))
        total[i] += total[j]
        size[i] += size[j]
        alive[j], far[j] = False, np.inf
        label[label == j] = i
        fresh[(near == i) | (near == j)] = False
        renew(i)
    return np.unique(label, return_inverse=True)[1]


def on_arc(x: np.ndarray) -> bool:
    """Whether all rows lie on less than half a circle: they have two components at most, the first above 0."""
    return x.shape[1] in (1, 2) and bool((x[:, 0] > 0).all())


def average_linkage_on_arc(x: np.ndarray, threshold: float, weight: np.ndarray | None = None) -> np.ndarray:
    """average_linkage_of_vectors of unit vectors for which on_arc holds, in time n log n.

    By angle, what lies between two clusters is nearer to both of them, pair by pair. So the nearest cluster is always a neighbour, clusters stay without gaps, and
    only neighbours are compared.
    """
    n = len(x)
    size, y = np.ones(n) if weight is None else weight.astype(float), x[:, 1] if x.shape[1] > 1 else np.zeros(n)
    order = np.argsort(y / x[:, 0], kind="stable")
    a, b, m, first = (size * x[:, 0])[order].tolist(), (size * y)[order].tolist(), size[order].tolist(), order.tolist()
    left, right, version, heap = list(range(-1, n - 1)), [*range(1, n), -1], [0] * n, []

    def meet(i: int, j: int) -> None:
        if i >= 0 and j >= 0 and (d := max(1 - (a[i] * a[j] + b[i] * b[j]) / (m[i] * m[j]), 0.0)) < threshold:
            heapq.heappush(heap, (d, min(first[i], first[j]), max(first[i], first[j]), i, j, version[i], version[j]))

    for i in range(n - 1):
        meet(i, i + 1)
    while heap:
        *_, i, j, vi, vj = heapq.heappop(heap)
        if version[i] == vi and version[j] == vj:
            a[i], b[i], m[i], first[i] = a[i] + a[j], b[i] + b[j], m[i] + m[j], min(first[i], first[j])
            version[i], version[j], right[i] = vi + 1, -1, right[j]
            if right[i] >= 0:
                left[right[i]] = i
            meet(left[i], i)
            meet(i, right[i])
    starts = np.array(version) >= 0
    label = np.empty(n, np.int64)
    label[order] = np.array(first)[starts][np.cumsum(starts) - 1]
    return np.unique(label, return_inverse=True)[1]


def silhouette_of_vectors(x: np.ndarray, label: np.ndarray, cells: int = 1 << 22, weight: np.ndarray | None = None) -> np.ndarray:
    """silhouette of the distances 1 - dot of the rows, from the clusters' vector sums, some rows at a time. weight: how many equal rows a row stands for."""
    out, size = np.zeros(len(label)), np.bincount(label, weight)
    if len(size) < 2:
        return out
    total = np.zeros((len(size), x.shape[1]))
    np.add.at(total, label, x if weight is None else x * weight[:, None])
    step = max(1, cells // len(size))
    for p in range(0, len(x), step):
        own, at = label[p : p + step], np.arange(len(x[p : p + step]))
        mean = np.maximum(1 - x[p : p + step] @ total.T / size, 0)
        a = mean[at, own] * size[own] / np.maximum(size[own] - 1, 1)
        mean[at, own] = np.inf
        b = mean.min(axis=1)
        most = np.maximum(a, b)
        out[p : p + step] = np.where((size[own] > 1) & (most > 0), (b - a) / np.where(most > 0, most, 1), 0.0)
    return out


def variant_summary(df: DataFrame, keys: list[str], price: str, sold: str) -> DataFrame:
    """For each variant: n, sold share, quartiles of its prices above 0 and their median distance from the median.

    Equal prices are counted first, so a task holds the distinct prices of a variant, not its rows.
    """
    c, p = F.col, F.when((F.col(price) > 0) & ~F.isnan(price), F.col(price).cast("double"))
    counts = df.groupBy(*keys, p.alias("__p")).agg(F.count(F.lit(1)).alias("__n"), F.sum(F.col(sold).cast("double")).alias("__s"))
    one = counts.groupBy(*keys).agg(F.sum("__n").alias("n"), (F.sum("__s") / F.sum("__n")).alias("sold_rate"), F.percentile("__p", F.array(*map(F.lit, (0.25, 0.5, 0.75))), F.col("__n")).alias("__q"))
    away = counts.join(one.select(*keys, c("__q")[1].alias("__m")), keys).groupBy(*keys).agg(F.percentile(F.abs(c("__p") - c("__m")), F.lit(0.5), c("__n")).alias("mad"))
    return one.join(away, keys).select(*keys, "n", "sold_rate", *[c("__q")[k].alias(n) for k, n in enumerate(("q25", "med", "q75"))], "mad")


def numbered(df: DataFrame, *keys: str, name: str = "product_id") -> DataFrame:
    """Ids from 0 of the distinct keys, in their order; rows with a null key have none and are left out.

    The distinct keys are ranked by pieces of their order, so neither a hot first key nor many first keys meet in one task.
    """
    ids = ranked(df.select(*keys).na.drop(subset=list(keys)).distinct(), [], list(keys))
    return df.join(ids.select(*keys, (F.col("__r") - 1).cast("int").alias(name)), list(keys))


def outlier_scores(df: DataFrame, vector: str) -> DataFrame:
    """Adds outlier: distance to the component-wise median vector, scaled from least to greatest; 0 if all are equal."""
    medians = quantiles(df.select(F.posexplode(vector).alias("p", "v")), ["p"], F.col("v"), [0.5]).select("p", F.col("q")[0].alias("m"))
    center = medians.agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "m"))), lambda x: x["m"]).alias("__c"))
    far = F.sqrt(F.aggregate(F.zip_with(vector, "__c", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    rows = df.join(F.broadcast(center), F.lit(True)).withColumn("__d", far)
    span = rows.agg(F.min("__d").alias("__lo"), F.max("__d").alias("__hi"))
    out = rows.join(F.broadcast(span), F.lit(True))
    scaled = F.when(F.col("__hi") - F.col("__lo") > 1e-9, (F.col("__d") - F.col("__lo")) / (F.col("__hi") - F.col("__lo"))).otherwise(0.0)
    return out.withColumn("outlier", scaled).drop("__c", "__d", "__lo", "__hi")


def mean_available(*scores: Column) -> Column:
    there = F.array_compact(F.array(*scores))
    return F.when(F.size(there) > 0, F.aggregate(there, F.lit(0.0), lambda s, x: s + x) / F.size(there))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def near_duplicates(hashes: Column, most: int = 4) -> Column:
    """How many of an ordered array of 64-bit image hashes are within so many bits of one kept before (greedy, as order matters)."""
    start = F.struct(F.array().cast("array<bigint>").alias("kept"), F.lit(0).alias("n"))
    return F.aggregate(
        hashes, start,
        lambda s, h: F.when(F.exists(s["kept"], lambda k: hamming(k, h) <= most), F.struct(s["kept"].alias("kept"), (s["n"] + 1).alias("n"))).otherwise(F.struct(F.array_append(s["kept"], h).alias("kept"), s["n"].alias("n"))),
        lambda s: s["n"],
    )


def image_metrics(images: DataFrame) -> DataFrame:
    """path, hash (64-bit average hash), brightness, contrast, sharpness, edges, saturation of binary images (path, content).

    PNG, JPEG and others need Pillow on the executors; binary PPM and PGM are read without it. Unreadable images give nulls.
    """

    def pixels(blob: bytes):
        import io

        if blob[:2] in (b"P5", b"P6"):
            head = blob.split(None, 4)
            w, h, depth = int(head[1]), int(head[2]), 3 if head[0] == b"P6" else 1
            return np.frombuffer(blob[-w * h * depth :], np.uint8).reshape(h, w, depth).astype(float) / 255
        from PIL import Image

        return np.asarray(Image.open(io.BytesIO(blob)).convert("RGB"), float) / 255

    def one(blob: bytes):
        try:
            x = pixels(blob)
        except Exception:  # an unreadable image is a value, not a failure of the job
            return (None,) * 6
        gray = x.mean(axis=2)
        ys, xs = (np.linspace(0, s, 9).astype(int) for s in gray.shape)
        small = np.array([[gray[a : max(b, a + 1), c : max(d, c + 1)].mean() for c, d in zip(xs, xs[1:], strict=False)] for a, b in zip(ys, ys[1:], strict=False)])
        bits = int("".join("1" if v else "0" for v in (small >= small.mean()).ravel()), 2)
        gy, gx = np.gradient(gray) if min(gray.shape) > 1 else (np.zeros_like(gray), np.zeros_like(gray))
        g = np.hypot(gx, gy)
        top, low = x.max(axis=2), x.min(axis=2)
        return bits - (1 << 64) if bits >> 63 else bits, float(gray.mean()), float(gray.std()), float(g.var() * 255**2), float((g > 0.1).mean()), float(np.where(top > 0, (top - low) / np.maximum(top, 1e-9), 0).mean())

    def run(batches):
        for b in batches:
            rows = [one(bytes(c)) for c in b["content"]]
            out = pd.DataFrame(rows, columns=["hash", "brightness", "contrast", "sharpness", "edges", "saturation"])
            out["hash"] = out["hash"].astype("Int64")
            yield pd.concat([b[["path"]].reset_index(drop=True), out], axis=1)

    return images.select("path", "content").mapInPandas(run, "path string, hash long, brightness double, contrast double, sharpness double, edges double, saturation double")
