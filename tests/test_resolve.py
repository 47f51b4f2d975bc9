"""Clusters of groups cut into tiles, components, variants and the way from listings to deals, against direct computation."""

import collections
import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from stallwise.operators import cluster, resolve
from stallwise.plans import deal_queries
from stallwise.sources.scratch import Scratch


def unit(x):
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def test_components_of_chains_stars_and_noise(spark):
    rng = np.random.default_rng(3)
    links = [(k, k + 1) for k in range(70)] + [(150, k) for k in range(100, 130)] + [tuple(map(int, rng.choice(np.arange(200, 260), 2))) for _ in range(45)]
    label = {x: x for a, b in links if a != b for x in (a, b)}
    for _ in label:
        for a, b in links:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    scratch = Scratch(spark, "t")
    got = {r["node"]: r["component"] for r in resolve.components(spark.createDataFrame(links, "a long, b long"), scratch).collect()}
    assert got == label
    scratch.close()


def groups(n=700):
    """Group big: clumps along a chain, loose rows and repeated vectors; group small: a few rows; ties everywhere."""
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(25, 6))
    x = np.vstack([centers[rng.integers(25, size=n)] + rng.normal(scale=0.25, size=(n, 6)), rng.normal(size=(60, 6)), np.repeat(centers[:3], 10, axis=0)])
    return [("big", int(i), [float(a) for a in v]) for i, v in enumerate(x)] + [("small", 1000 + i, [float(a) for a in rng.normal(size=6)]) for i in range(9)]


@pytest.mark.parametrize("tile", [10_000, 100, 37])
def test_clusters_by_tiles_are_average_linkage(spark, tile):
    rows = groups()
    df = spark.createDataFrame([*rows, (None, 1, [1.0] * 6), ("big", 5000, None)], "g string, i long, v array<double>").repartition(5)
    got = {(r["g"], r["i"]): (r["label"], r["silhouette"]) for r in resolve.clusters(df, "g", "i", "v", 0.24, tile).collect()}
    assert len(got) == len(rows)
    for g in ("big", "small"):
        own = sorted((i, v) for k, i, v in rows if k == g)
        x = unit(np.array([v for _, v in own]))
        d = np.maximum(1 - x @ x.T, 0)
        label = cluster.average_linkage_of_vectors(x, 0.24)
        s = cluster.silhouette(d, label)
        assert [got[g, i][0] for i, _ in own] == label.tolist() and len(set(label)) > 5
        assert np.allclose([got[g, i][1] for i, _ in own], s, atol=1e-9)
    assert resolve.clusters(df.limit(0), "g", "i", "v", 0.24).count() == 0


def test_uniformity(spark):
    rows = [("a", ["x", "y"]), ("a", ["x", "y"]), ("a", ["x", "z"]), ("a", ["x", "y", "x"]), ("b", []), ("b", []), ("c", ["q"]), ("c", ["r"])]
    got = {r["p"]: r["uniformity"] for r in resolve.uniformity(spark.createDataFrame(rows, "p string, w array<string>"), "p", "w").collect()}
    assert got == {"a": pytest.approx((1 + 1 + 1 / 3 + 1) / 4), "b": 1.0, "c": 0.0}


def listings(spark):
    rows = []
    for k in range(12):  # one product in two price variants, and one of another title
        rows.append((k, "Air Zoom Runner blue", "Nike", 40.0 + k % 3, 1))
        rows.append((100 + k, "Air Zoom Runner", "Nike", 400.0 + k % 3, 1))
    rows += [(200 + k, f"Heritage satchel leather shoulder strap {c}", "Prada", 100.0 + 2 * k, 4 if k == 1 else 1) for k, c in enumerate(["brown", "brown", "brown", "brown", "black"])]
    rows += [(300, "Air Zoom Runner blue", "Nike", 12.0, 1), (301, None, None, None, 1), (302, "", "Nike", float("nan"), 1), (303, "fake bag", "Prada", 5.0, 9)]
    return spark.createDataFrame(rows, "id long, t string, b string, p double, s int")


@pytest.mark.parametrize("tile", [2000, 5])
def test_listing_deals(spark, tile):
    got = {r["item"]: r for r in resolve.listing_deals(listings(spark), "id", "t", "b", "p", "s", tile=tile).collect()}
    assert len(got) == listings(spark).count()
    runners = {got[k]["product_id"] for k in [*range(12), *range(100, 112), 300]}
    assert len(runners) == 1 and len({got[k]["product_id"] for k in range(200, 205)}) == 1 and runners.isdisjoint({got[200]["product_id"]})
    blue, plain = {got[k]["variant_id"] for k in range(12)}, {got[k]["variant_id"] for k in range(100, 112)}
    assert len(blue) == len(plain) == 1 and blue != plain
    assert {got[k]["variant_text"] for k in range(12)} == {"blue"} and {got[k]["variant_text"] for k in range(100, 112)} == {""}
    cheap = got[300]
    assert cheap["block"] == "nike__toks__air-zoom" and cheap["product_silhouette"] > 0.15
    assert got[301]["variant_count"] == 1 and got[301]["z"] is None and not got[301]["eligible"] and "small_group" in got[301]["notes"]
    assert got[303]["negative"] and "negative_flag" in got[303]["notes"] and "seen_often" in got[303]["notes"]
    assert all(r["similarity"] is None or -1 <= r["similarity"] <= 1 + 1e-9 for r in got.values())
    again = {r["item"]: (r["product_id"], r["variant_id"], r["score"], r["notes"]) for r in resolve.listing_deals(listings(spark).repartition(7), "id", "t", "b", "p", "s").collect()}
    assert again == {k: (r["product_id"], r["variant_id"], r["score"], r["notes"]) for k, r in got.items()}


def test_groups_that_share_a_call(spark, monkeypatch):
    """Many small groups of unlike widths and thresholds, some in each call of Python, are clustered each on its own."""
    monkeypatch.setattr(resolve, "TOGETHER", 50)
    rng = np.random.default_rng(9)
    rows = [(f"g{g}", 100 * g + i, [float(a) for a in rng.normal(size=3 + g % 4)], 0.1 + 0.05 * (g % 7)) for g in range(60) for i in range(1 + g % 9)]
    df = spark.createDataFrame(rows, "g string, i long, v array<double>, t double").repartition(5)
    got = {r["i"]: (r["g"], r["label"], r["silhouette"]) for r in resolve.clusters(df, "g", "i", "v", F.col("t")).collect()}
    assert len(got) == len(rows)
    for g in range(60):
        own = [r for r in rows if r[0] == f"g{g}"]
        x = unit(np.array([v for _, _, v, _ in own]))
        d = np.maximum(1 - x @ x.T, 0)
        label = cluster.average_linkage(d, own[0][3])
        assert [got[i][:2] for _, i, _, _ in own] == [(f"g{g}", k) for k in label.tolist()]
        assert np.allclose([got[i][2] for _, i, _, _ in own], cluster.silhouette(d, label), atol=1e-9)
    assert len({k for _, k, _ in got.values()}) > 3


def test_missing_images_count_as_zeros(spark):
    rows = [(1 + k // 8, k, ["same"], 10.0, None if k % 8 == 0 or k >= 8 else [1.0, 0.0]) for k in range(16)]
    df = spark.createDataFrame(rows, "p int, i long, w array<string>, price double, image array<double>")
    got = {r["i"]: (r["p"], r["variant"]) for r in resolve.variants(df, "p", "i", "w", "price", image="image", image_weight=3.0, tune=False).collect()}
    assert len({got[k] for k in range(1, 8)}) == 1 and got[0] not in {got[k] for k in range(1, 8)} and {got[k] for k in range(8, 16)} == {(2, 0)}


def test_image_weight_parts_variants(spark):
    rows = [(1, k, ["same"], 10.0, [1.0, 0.0] if k % 2 else [0.0, 1.0]) for k in range(8)]
    df = spark.createDataFrame(rows, "p int, i long, w array<string>, price double, image array<double>")
    count = lambda weight: resolve.variants(df, "p", "i", "w", "price", image="image", image_weight=weight, tune=False).select("variant").distinct().count()
    assert count(0.0) == 1 and count(1.0) == 2


DATA = "/root/testdata/sf0.001"


def plain_vector(words, dims=64):
    v = np.zeros(dims)
    for w in words:
        v[zlib.crc32(w.encode()) % dims] += 1
    v[0] += not words
    return v


def labelled(x, threshold):
    x = unit(x)
    d = np.maximum(1 - x @ x.T, 0)
    return cluster.average_linkage(d, threshold), d


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_listing_deals_of_the_tables_against_a_plain_computation(spark):
    """Products, variants, similarity, silhouette, price statistics and z of the query, item by item; and what the scores follow from them."""
    rows = deal_queries.listing(spark, DATA).select("item_id", "supplier", "title", "brand", "price", *[c for c in deal_queries.ORDER if c not in ("supplier", "price")]).toPandas()
    rows = rows.sort_values(deal_queries.ORDER)
    rows["id"] = rows["item_id"].astype(str) + "-" + rows["supplier"].astype(str)
    items = rows.groupby("id").agg(title=("title", "last"), brand=("brand", "last"), price=("price", "last"), snapshots=("id", "size")).reset_index().sort_values("id")
    items["words"] = [[w for w in t.lower().split() if len(w) > 1] for t in items["title"]]
    blocks = collections.defaultdict(list)
    for k, (brand, words) in enumerate(zip(items["brand"], items["words"], strict=True)):
        blocks[brand, tuple(words[:2])].append(k)
    want, partition = {}, []
    price = items["price"].to_numpy(float)
    for members in blocks.values():
        label, _ = labelled(np.array([plain_vector(items["words"].iloc[k]) for k in members]), 0.24)
        for p in range(label.max() + 1):
            own = [members[i] for i in np.flatnonzero(label == p)]
            words = [items["words"].iloc[k] for k in own]
            counts = collections.Counter(w for x in words for w in set(x))
            core = lambda share: {w for w, c in counts.items() if c / len(own) >= share}  # noqa: B023, E731
            variant, text, sims, sil = np.zeros(len(own), int), [""] * len(own), [None] * len(own), None
            if len(own) >= 4:
                empty = np.mean([not [w for w in x if w not in core(0.7)] for x in words])
                med = np.median(price[own])
                spread = np.median(np.abs(price[own] - med)) / med
                share = 0.60 if empty > 0.55 else 0.65 if empty > 0.40 else 0.78 if empty < 0.15 else 0.70
                weight, t = (0.55, 0.30) if spread >= 0.22 else (0.45, 0.31) if spread >= 0.14 else (0.25, 0.36) if spread <= 0.06 else (0.35, 0.33)
                left = [[w for w in x if w not in core(share)] for x in words]
                z = (np.log(price[own]) - np.log(price[own]).mean()) / (np.log(price[own]).std() + 1e-6)
                f = unit(np.hstack([[plain_vector(x) for x in left], weight * z[:, None]]))
                variant, d = labelled(f, t)
                text = [" ".join(x) for x in left]
                means = [f[variant == v].mean(axis=0) for v in range(variant.max() + 1)]
                sims = [float(x @ means[v] / np.linalg.norm(x) / np.linalg.norm(means[v])) for x, v in zip(f, variant, strict=True)]
                sil = float(cluster.silhouette(d, variant).mean()) if variant.max() > 0 else None
            for v in range(variant.max() + 1):
                same = [own[i] for i in np.flatnonzero(variant == v)]
                partition.append(frozenset(items["id"].iloc[same]))
                med = np.median(price[same])
                mad = np.median(np.abs(price[same] - med))
                for i in np.flatnonzero(variant == v):
                    z = (med - price[own[i]]) / (1.4826 * mad + 1e-6) if len(same) >= 3 else None
                    want[items["id"].iloc[own[i]]] = (len(same), text[i], sims[i], sil, z)
    got = deal_queries.listing_deals(spark, DATA).collect()
    found = collections.defaultdict(set)
    for r in got:
        found[r["variant_id"]].add(r["item"])
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, partition)) and len(got) == len(want)
    near = lambda a, b: a is b or (a is not None and b is not None and a == pytest.approx(b, abs=2e-6, rel=1e-6))
    for r in got:
        n, text, sim, sil, z = want[r["item"]]
        assert r["variant_count"] == n and r["variant_text"] == text and near(r["similarity"], sim) and near(r["product_silhouette"], sil) and near(r["z"], z), (r, want[r["item"]])
        assert ("weak_cluster" in r["notes"]) == (sil is not None and sil < 0.15) and ("far_from_centroid" in r["notes"]) == (sim is not None and sim < 0.45) and ("small_group" in r["notes"]) == (n < 3)


def test_nearest_by_blocks(spark):
    rng = np.random.default_rng(8)
    rows = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(unit(rng.normal(size=(50, 4))))] + [(99, None)], "i int, v array<double>")
    table = spark.createDataFrame([(k, [float(a) for a in v]) for k, v in enumerate(unit(rng.normal(size=(40, 4))))] + [(77, [0.0] * 4)], "k int, centroid array<double>")
    one, many = ({r["i"]: (r["nearest"], r["dist"]) for r in cluster.nearest(rows, table, "v", "k", 0.4, most).collect()} for most in (1 << 20, 300))
    assert one == many and len(one) == 51 and len({k for k, _ in one.values()}) > 10 and -1 in {k for k, _ in one.values()}


def test_neighbours_on_an_arc_are_average_linkage():
    """Prices beside one text: merging neighbours by angle gives what comparing all pairs gives, of each row as often as its weight tells."""
    rng = np.random.default_rng(4)
    for k in range(12):
        w = rng.integers(1, 6, size=40)
        x = unit(np.column_stack([np.ones(40), rng.normal(scale=(0.3, 1.5, 6.0)[k % 3], size=40)]))
        each = np.repeat(np.arange(40), w)
        d = np.maximum(1 - x[each] @ x[each].T, 0)
        for t in (0.02, 0.33, 3.0):
            want = cluster.average_linkage(d, t)
            for got in (cluster.average_linkage_on_arc(x, t, w), cluster.average_linkage_of_vectors(x, t, weight=w)):
                assert got[each].tolist() == want.tolist()
            assert np.allclose(cluster.silhouette_of_vectors(x, got, weight=w.astype(float))[each], cluster.silhouette(d, want), atol=1e-9)
    assert cluster.average_linkage_on_arc(np.ones((3, 1)), 0.1).tolist() == [0, 0, 0]
    assert not cluster.on_arc(np.array([[1.0, 0.0], [-1.0, 0.0]])) and not cluster.on_arc(np.ones((2, 3)))


@pytest.mark.parametrize("tile", [10_000, 37])
def test_weighted_clusters_are_those_of_the_repeated_rows(spark, tile):
    rows = [(g, i, v, 1 + i % 4) for g, i, v in groups(200)] + [("arc", 2000 + i, [1.0, float(np.tan(0.02 * i - 1))], 1 + i % 3) for i in range(100)]
    one = spark.createDataFrame(rows, "g string, i long, v array<double>, w int")
    each = one.select("g", (F.col("i") * 10).alias("i"), "v", F.explode(F.sequence(F.lit(0), F.col("w") - 1)).alias("k")).withColumn("i", F.col("i") + F.col("k"))
    got = {(r["g"], r["i"] * 10): (r["label"], r["silhouette"]) for r in resolve.clusters(one, "g", "i", "v", 0.24, tile, "w").collect()}
    want = {(r["g"], r["i"]): (r["label"], r["silhouette"]) for r in resolve.clusters(each, "g", "i", "v", 0.24, tile).collect()}
    assert len(got) == len(rows) and len(want) == sum(r[3] for r in rows)
    for (g, i), (label, s) in want.items():
        assert got[g, i // 10 * 10][0] == label and got[g, i // 10 * 10][1] == pytest.approx(s, abs=1e-9)


def test_equal_listings_are_worked_on_once(spark, monkeypatch):
    """Thirty copies of each listing under other items: no more rows are clustered than without copies, and every copy has the result."""
    taken, plain = [], resolve.clusters
    monkeypatch.setattr(resolve, "clusters", lambda df, *a, **k: taken.append(df.count()) or plain(df, *a, **k))
    base = listings(spark).filter("id >= 100")
    many = base.withColumn("id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(29)), lambda k: F.col("id") + 1000 * k)))
    got = resolve.listing_deals(many, "id", "t", "b", "p", "s").collect()
    assert len(got) == 30 * base.count() and len({r["item"] for r in got}) == len(got)
    assert taken and max(taken) < base.count()
    of = {}
    for r in got:
        of.setdefault(r["item"] % 1000, set()).add((r["product_id"], r["variant_id"], r["variant_count"], r["z"], r["score"], r["notes"]))
    assert len(of) == base.count() and all(len(v) == 1 for v in of.values())
    assert {n for v in of.values() for _, _, n, *_ in v if n} >= {30 * 12}


def test_kinds_that_are_not_broadcast(spark, monkeypatch):
    key = lambda r: (r["item"], r["product_id"], r["variant_id"], r["score"], r["notes"])
    first = sorted(map(key, resolve.listing_deals(listings(spark), "id", "t", "b", "p", "s").collect()), key=str)
    monkeypatch.setattr(resolve, "BROADCAST", -1)
    assert sorted(map(key, resolve.listing_deals(listings(spark), "id", "t", "b", "p", "s").collect()), key=str) == first and len(first) == listings(spark).count()
