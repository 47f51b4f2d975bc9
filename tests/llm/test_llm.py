"""The operators of the llm subpackage against brute force, on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import collections
import hashlib
import math
import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stallwise.llm import chat, decontaminate, jaccard, language_model, packing, registry, shared, substring, topk, toxicity

DATA = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i % 3000}" for i in range(30_000))
PASSAGE = " ".join(f"passage{i}" for i in range(60))


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def spaced(t):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(t or ""))


def worded(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))


def documents(spark):
    """Texts of all awkward kinds, with columns whose names the operators use inside."""
    base = " ".join(f"Term{i}" for i in range(80))
    rows = [
        (1, base), (2, base + " one more"), (3, base.upper()), (3, base.upper()), (4, None), (5, ""), (6, " \n\t "), (7, "one two"), (8, "ONE  two"), (9, LONG), (10, LONG + " tail"), (None, "a null id here and some words to follow it"),
        (11, "È vero? Éanon éanon ß İ 中文 字"), (12, f"intro {PASSAGE} outro"), (13, f"other words {PASSAGE}\nnext line is here"), (14, PASSAGE), (15, " ".join(["same"] * 300)), (16, "idiot loser"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumn("node", F.lit("x")).withColumn("removed", F.lit(1)).withColumn("key", F.lit(2)).withColumn("at", F.lit(None).cast("int")).withColumn("lang", F.lit("en"))


def empty(spark):
    return documents(spark).limit(0)


# 1 ---------------------------------------------------------------------------------------------------------------


def brute_contamination(docs, items):
    grams = collections.defaultdict(set)
    for i, t in items:
        w = worded(t)
        k = min(13, len(w))
        for p in range(len(w) - k + 1):
            if k:
                grams[tuple(w[p : p + k])].add(i)
    out = []
    for d, t in docs:
        w, hit, found = worded(t), set(), set()
        for k in {len(g) for g in grams}:
            for p in range(len(w) - k + 1):
                if (g := tuple(w[p : p + k])) in grams:
                    hit |= set(range(p, p + k))
                    found |= grams[g]
        out.append((d, len(w), len(hit), sorted(map(str, found - {None})), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block_bytes", [1 << 27, 16_000])
def test_contamination(spark, block_bytes):
    items = [(1, PASSAGE), (2, "one two"), (3, None), (4, "!!"), (5, "É vero, éanon? éanon"), (6, PASSAGE), (None, "idiot loser")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("words", F.lit(1))
    docs = documents(spark)
    got = decontaminate.contamination(docs, bench, block_bytes).collect()
    got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], sorted(str(i) for i in r["item_ids"]), r["contaminated"]) for r in got), key=str)
    assert got == brute_contamination([(r["doc_id"], r["text"]) for r in docs.collect()], items)


def test_decontaminate_keeps_clean_documents(spark):
    bench = spark.createDataFrame([(1, PASSAGE)], "item_id long, text string")
    docs = documents(spark)
    kept = decontaminate.decontaminate(docs, bench)
    assert kept.columns == docs.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == sorted(i or 0 for i in [r["doc_id"] for r in docs.collect()] if i not in (12, 13, 14))
    cut = {r["doc_id"]: r["text"] for r in decontaminate.decontaminate(docs, bench, "spans").collect()}
    assert cut[12] == "intro outro" and cut[14] == "" and cut[13] == "other words next line is here" and cut[9] == LONG
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminate(docs, none).count() == docs.count() and decontaminate.decontaminate(empty(spark), bench).count() == 0


# 2 ---------------------------------------------------------------------------------------------------------------


def shingles(t):
    w = spaced(t)
    return frozenset(tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))) if w else frozenset()


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    least = {}
    for x, (d, _) in zip(label, rows, strict=True):
        if d is not None:
            least[x] = min(least.get(x, d), d)
    return sorted(((d, len(s), least.get(x) if s else d) for (d, _), s, x in zip(rows, sets, label, strict=True)), key=str)


def edited_copies(spark, n=60, most=5, first=100):
    """One large group whose members differ by edits, so that tiles beyond SMALL occur."""
    rng = np.random.default_rng(5)
    template, rows = [f"t{i}" for i in range(120)], []
    for i in range(n):
        w = list(template)
        for p in rng.choice(120, int(rng.integers(0, most)), replace=False):
            w[p] = f"e{i}_{p}"
        rows.append((first + i, " ".join(w)))
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_jaccard_components(spark):
    docs = documents(spark).select("doc_id", "text").unionByName(edited_copies(spark))
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(docs).collect()), key=str)
    assert got == brute_components([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_jaccard_components_of_a_loose_group(spark):
    """Copies with up to 12 edits of 120 words: many pairs lie on either side of the threshold, and many copies stay alone."""
    docs = edited_copies(spark, 150, 13)
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(docs).collect()), key=str)
    wanted = brute_components([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert len({w[2] for w in wanted}) > 20 and got == wanted


def test_cells_of_a_loose_group_grow_in_proportion(spark, tmp_path):
    """Texts of one template that are similar at some 0.69 and never link: four times the texts make four times the packed classes at most."""
    made = []
    for n in (1500, 6000):
        common = [f"c{k}" for k in range(84)]
        rows = [(i, " ".join([*common, *(f"o{i}_{k}" for k in range(16))])) for i in range(n)]
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        join = jaccard.Join(docs, shared.Workspace(spark, "loose"))
        _, large = join.tiles()
        own = large.select("node", F.col("node").alias("label")).distinct()
        wide = join.large_tiles(large, own)
        tiles = wide.select("shingle", "blocks").distinct().collect()
        assert tiles and all(r["blocks"] <= jaccard.STRIPS for r in tiles)
        made.append(wide.count() / len(tiles))
        if n == 1500:
            got = [tuple(r) for r in jaccard.jaccard_components(docs).collect()]
            assert sorted(got) == [(i, 96, i) for i in range(n)]
    assert made[1] <= 4.2 * made[0]


@pytest.mark.parametrize(("block", "strips", "wide"), [(8, 2, 16), (8, 4, 64), (4, 8, 8)])
def test_jaccard_components_by_blocks(spark, monkeypatch, block, strips, wide):
    """Tiles cut into many blocks and parts give the same links."""
    for k, v in (("BLOCK", block), ("STRIPS", strips), ("WIDE", wide)):
        monkeypatch.setattr(jaccard, k, v)
    docs = edited_copies(spark, 150, 13)
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(docs).collect()), key=str)
    assert got == brute_components([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_bitmaps_of_several_widths():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 1 << 62, n, dtype=np.uint64)) for n in (10, 200, 300, 700, 1500, 260, 90)]
    blobs = [jaccard.bitmap(x).tobytes() for x in sets]
    bits = jaccard.Bitmaps(blobs)
    for i in range(len(sets)):
        for j in range(len(sets)):
            w = min(len(blobs[i]), len(blobs[j]))
            a, b = (jaccard.folded(np.frombuffer(blobs[k], np.uint8)[None], w) for k in (i, j))
            assert bits.differing(i, np.array([j]))[0] == np.bitwise_count(a ^ b).sum()


def test_components_round_by_round(spark, tmp_path, monkeypatch):
    """Chains, stars and random links, all by distributed rounds."""
    monkeypatch.setattr(jaccard, "LAST", 0)
    rng = np.random.default_rng(3)
    links = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 130)] + [tuple(sorted(map(int, rng.choice(np.arange(200, 260), 2, replace=False)))) for _ in range(45)]
    label = {x: x for link in links for x in link}
    for _ in label:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    df = spark.createDataFrame(links, "a long, b long")
    got = {r["node"]: r["label"] for r in jaccard.components(df, shared.Workspace(spark, "t"), "t").collect()}
    assert set(got) == set(label) and len({(got[x], label[x]) for x in got}) == len(set(got.values())) == len(set(label.values()))
    assert jaccard.components(df.limit(0), shared.Workspace(spark, "t"), "e").count() == 0


def test_jaccard_links_are_all_links(spark):
    docs = documents(spark).select("doc_id", "text").unionByName(edited_copies(spark, 80, 9))
    links, members = jaccard.jaccard_links(docs)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    classes = {shingles(r["text"]): r["class"] for r in members.join(docs, "doc_id").collect() if r["doc_id"] != 3 and shingles(r["text"])}
    sets = list({shingles(t) for d, t in rows if d is not None and shingles(t)})
    wanted = {tuple(sorted((classes[x], classes[y]))) for i, x in enumerate(sets) for y in sets[i + 1 :] if 4 * len(x & y) >= 3 * len(x | y)}
    got = [(r["a"], r["b"]) for r in links.collect()]
    assert len(got) == len(set(got)) and set(got) == wanted and len(wanted) > 100


def test_keep_one(spark):
    docs = documents(spark)
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in docs.collect()} - {r["doc_id"] for r in kept.collect()} == {2, 3, 8, 10, 13, 14}
    assert jaccard.jaccard_components(empty(spark)).count() == 0
    assert jaccard.keep_one(empty(spark)).count() == 0


def test_keep_one_with_repeated_ids(spark):
    """Texts that share a doc_id are told apart; repeated rows and null ids leave one row a group."""
    a, b = (" ".join(f"{c}{i}" for i in range(40)) for c in "ab")
    rows = [(1, a), (5, a + " word"), (5, b), (7, b + " word"), (None, a), (8, ""), (8, ""), (9, "x y z"), (9, "X  y z"), (9, "x y z"), (None, "only here"), (None, "only here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit("x")).withColumn("row", F.lit(1)).withColumn("label", F.lit(2))
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted([(1, a), (5, b), (8, ""), (8, ""), (9, "X  y z"), (None, "only here")], key=str)


def test_tile_pairs_are_complete_in_small_tiles():
    n = np.array([10, 12, 13, 20, 30, 10, 11], np.int32)
    shingle, node, place = np.array([1, 1, 1, 1, 1, 2, 2], np.uint64), np.arange(7), np.zeros(7, np.int64)
    i, j, _, large = jaccard.tile_pairs(shingle, node, n, place)
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == {(0, 1), (0, 2), (1, 2), (5, 6)} and not len(large)
    i, j, _, _ = jaccard.tile_pairs(shingle, node, n, place + 1)  # with one shingle past, the 9 left of 10 are not enough for 12 or 13
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == {(1, 2), (5, 6)}


def test_places_are_rounded_down():
    for n in (1, 4, 7, 100, 1023, 5000):
        place = np.arange(jaccard.prefix_length(n))
        size = np.full(len(place), n)
        least = jaccard.least_place(jaccard.packed_place(place, size), size)
        assert (least <= place).all() and (place - least <= jaccard.prefix_length(n) // 256 + 1).all()


def test_bitmap_bound_never_undercounts():
    rng = np.random.default_rng(0)
    for most in [400] * 200 + [3000] * 40:
        a, b = (np.unique(rng.integers(0, 1 << 62, int(rng.integers(1, most)), dtype=np.uint64)) for _ in range(2))
        b = np.unique(np.concatenate((b, rng.choice(a, int(rng.integers(0, len(a) + 1)), replace=False))))
        bound = jaccard.bound(jaccard.bitmap(a)[None], jaccard.bitmap(b)[None], np.array([len(a)]), np.array([len(b)]))[0]
        assert bound >= len(np.intersect1d(a, b))


# 3 ---------------------------------------------------------------------------------------------------------------


def labelled(spark):
    rng = np.random.default_rng(1)
    vocabulary = [f"{a}{b}" for a in ("lo", "mi", "ra", "te", "su") for b in ("na", "ke", "pi", "dor", "zim", "fel")]
    rows, labels = [], []
    for i in range(600):
        words = list(rng.choice(vocabulary, 25))
        if i % 8 == 0:
            words[int(rng.integers(25))] = ["idiot", f"vexxo{i % 5}"][i // 8 % 2]
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 8 == 0)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_learns_words_that_labels_show(spark):
    docs, labels = labelled(spark)
    labels = labels.unionByName(spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int"))
    model = toxicity.train(docs.withColumn("toxic", F.lit(9)), labels)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.5) == (i % 8 == 0) for i in held]) > 0.97
    extra = spark.createDataFrame([(None, None), (1, ""), (1, ""), (2, LONG)], "doc_id long, text string")
    scores = [r["score"] for r in toxicity.score(extra, model).collect()]
    assert all(0 <= s < 0.5 for s in scores) and scores[0] == scores[1] == scores[2]


def test_toxicity_never_learns_from_the_held_out_fold(spark):
    docs, labels = labelled(spark)
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.train(docs, x) for x in (labels, flipped))
    assert (a.keys == b.keys).all() and np.allclose(a.weights, b.weights) and a.bias == pytest.approx(b.bias)


def test_toxicity_without_labels(spark):
    docs = documents(spark)
    model = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    got = {r["doc_id"]: r["score"] >= 0.5 for r in toxicity.score(docs, model).collect()}
    assert got[16] and not got[1] and toxicity.score(empty(spark), model).count() == 0


# 5 ---------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("block_bytes", [1 << 20, 4096])
def test_topk(spark, block_bytes):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 6) / 7]) for i in range(300)]
    rows += [(400, None), (401, []), (402, [float("nan")] * 6), (403, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (None, [1.0] * 6), (404, [float("inf")] + [0.0] * 5), (450, [0.5, 0.25]), (451, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("x", F.lit(1))
    got = [tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0, 5, block_bytes).orderBy("query_id", "rank").collect()]
    good = {i: [math.floor(256 * x) for x in v] for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    want = []
    for q in sorted(i for i in good if i % 50 == 0):
        s = sorted((-sum(a * b for a, b in zip(good[q], v, strict=True)), i) for i, v in good.items() if i != q and len(v) == len(good[q]))
        want += [(q, k + 1, i, -x) for k, (x, i) in enumerate(s[:5])]
    assert got == want


@pytest.mark.parametrize("scale", [2.0, 1e3, 1e5, 3e6, 1e9, 1e17])
def test_topk_ties_at_any_size(spark, scale):
    """Equal scores from 10^5 to beyond 2^53 and beyond a long go to the smallest ids."""
    rng = np.random.default_rng(11)
    rows = [(i, [scale, scale]) for i in range(400)] + [(400 + i, [scale * float(x) for x in rng.integers(-1, 2, 2)]) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    got = [tuple(r) for r in topk.top_k(df, F.col("vec_id") % 97 == 0, 5).orderBy("query_id", "rank").collect()]
    good, want = {i: [math.floor(256 * x) for x in v] for i, v in rows}, []
    held = lambda s: min(max(s, -(1 << 63)), (1 << 63) - 1)
    for q in [i for i in good if i % 97 == 0]:
        s = sorted((-held(sum(a * b for a, b in zip(good[q], v, strict=True))), i) for i, v in good.items() if i != q)
        want += [(q, k + 1, i, -x) for k, (x, i) in enumerate(s[:5])]
    assert got == want


def test_topk_bound_is_no_lower_than_any_score():
    rng = np.random.default_rng(4)
    for size in (1e2, 1e7, 1e12):
        block = topk.Block(np.arange(64), rng.normal(0, size, (64, 8)))
        x = block.x
        for q in np.floor(rng.normal(0, size, (20, 8))):
            at = np.where(q < 0, x.min(axis=0), x.max(axis=0))
            assert block.bound(q, at) >= sum(int(a) * int(b) for a, b in zip(q, at, strict=True))


def test_topk_stops_early():
    x = np.zeros((1000, 2))
    x[:, 0] = np.arange(1000)
    block = topk.Block(np.arange(1000), x)
    seen = []
    scores = block.scores
    block.scores = lambda q, rows: seen.append(len(rows)) or scores(q, rows)
    assert block.search(-1, np.array([1.0, 0.0]), 3, []) == [(-999 << 16, 999), (-998 << 16, 998), (-997 << 16, 997)] and sum(seen) < 100


def test_topk_repeated_candidates(spark):
    one = lambda k, v: [v * (k % 6 == d) for d in range(6)]
    rows = [(0, [1.0] * 6)] + [(7, one(k, 9.0)) for k in range(30)] + [(i, one(i, float(i))) for i in (1, 2, 3, 4, 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    got = [(r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(df, F.col("vec_id") == 0, 5).orderBy("rank").collect()]
    assert got == [(k + 1, i, x << 16) for k, (i, x) in enumerate([(7, 9), (8, 8), (4, 4), (3, 3), (2, 2)])]


# 7 ---------------------------------------------------------------------------------------------------------------


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    docs = documents(spark).unionByName(documents(spark).filter("doc_id = 9").withColumn("doc_id", F.lit(90).cast("long")))
    pieces = packing.pack(docs, path).collect()
    whole, tokenizer = collections.defaultdict(list), Tokenizer.from_file(path)
    for r in pieces:
        assert len(r["ids"]) == 4 * r["length"]
        whole[r["doc_id"], r["doc_tokens"]].append((r["start"], np.frombuffer(bytes(r["ids"]), "<u4").tolist()))
    want = collections.Counter((r["doc_id"], tuple([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 1])) for r in docs.collect())
    got = collections.Counter()
    for (d, n), parts in whole.items():
        copies = sum(1 for p in parts if p[0] == 0)
        for k in range(copies):
            ids, at = [], 0
            while at < n:
                ids += next(x for s, x in sorted(parts)[k:] + sorted(parts) if s == at)
                at = len(ids)
            got[d, tuple(ids)] += 1
    assert got == want
    by_sequence = collections.defaultdict(list)
    for r in pieces:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by_sequence.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at == 2048 or at < 2048 and at & (at - 1) == 0
    assert packing.pack(empty(spark), path).count() == 0


def test_chunks_tokenise_as_whole_texts():
    import random

    t = packing.tokenizer(packing.default_tokenizer())
    rng, parts = random.Random(3), [chr(i) for i in range(256)] + ["'re", "<|endoftext|>", " ", "\n", "ſ", "İ", "Ω", "中", "é", "word", "ÀB"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    assert [np.frombuffer(x, "<u4").tolist() for x in t(texts)] == [e.ids for e in t.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_distinct_chunks_of_a_call_are_looked_up_once():
    class Counted(dict):
        n = 0

        def __getitem__(self, key):
            Counted.n += 1
            return dict.__getitem__(self, key)

    t = packing.ChunkTokenizer(packing.default_tokenizer())
    t.chunks = Counted()
    texts = ["One one's 12 don't--stop,\tÀÉ  x\xa0y\n\nend" * 50, "", "   ", "\n", "Ω <|endoftext|>a ſ", "one " * 5000, "\t\r", "a<|b 'S'll"]
    for part in (texts, texts, [""], [" ", ""], []):
        Counted.n = 0
        got = [np.frombuffer(x, "<u4").tolist() for x in t(part)]
        assert got == [e.ids for e in t.tokenizer.encode_batch(part, add_special_tokens=False)]
        assert Counted.n <= len({c for x in part for c in x.replace("\n", " ").split(" ")})
    assert len(t.last) < 1 << 24  # so that no ids hold the mark between chunks


def test_fill_comes_as_close_as_any_subset():
    rng = np.random.default_rng(4)
    for _ in range(200):
        counts = {int(k): int(rng.integers(1, 4)) for k in rng.integers(1, 40, 6)}
        capacity = int(rng.integers(1, 60))
        reach = {0}
        for k, n in counts.items():
            reach |= {r + k * m for r in reach for m in range(1, n + 1) if r + k * m <= capacity}
        got = packing.fill(counts, capacity)
        assert sum(got) == max(reach) and all(got.count(k) <= counts[k] for k in got)


# 8 ---------------------------------------------------------------------------------------------------------------


def test_substring_units_and_offsets(spark):
    line = "this line of ten words stands in two of the documents"
    rows = [(1, f"first\n{line}\nend"), (2, f"{line.upper()}  \nkept words"), (3, f"start and go on with {PASSAGE} and then some"), (4, f"another {PASSAGE}"), (5, None), (6, ""), (7, "short\nshort"), (2, f"{line.upper()}  \nkept words"), (None, line)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("removed", F.lit(0)).withColumn("at", F.lit(1)).withColumn("gone", F.lit("g"))
    out = substring.dedup_units(docs)
    assert out.columns == ["doc_id", "text", "at", "gone", "removed"]
    got = collections.defaultdict(list)
    for r in out.collect():
        got[r["doc_id"]].append((r["text"], [(x["start"], x["end"], x["keeper"]) for x in r["removed"]]))
    texts = dict(rows)
    assert got[1] == [(texts[1], [])] and got[3] == [(texts[3], [])] and got[5] == [(None, [])] and got[6] == [("", [])] and got[7] == [("short\nshort", [])]
    assert got[2] == [("kept words", [(0, len(line) + 3, 1)])] * 2 and got[None] == [("", [(0, len(line), 1)])]
    text, spans = got[4][0]
    assert len(text.split()) < 30 and all(k == 3 for _, _, k in spans)
    rest = "".join(texts[4][a:b] for a, b in zip([0, *[e for _, e, _ in spans]], [*[s for s, _, _ in spans], len(texts[4])], strict=True))
    assert rest == text
    assert substring.dedup_units(empty(spark)).count() == 0


def test_substring_against_brute_force(spark):
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    seen, want = {}, {}
    for d, t in rows:
        data = np.frombuffer(t.encode(), np.uint8)
        found = sorted(zip(*(x.tolist() for x in substring.units(data, np.array([0, len(data)]), substring.MIN_WORDS)), strict=True), key=lambda u: (u[1], u[2]))
        gone = [(s, e) for _, s, e, a, b in found if seen.setdefault((a, b), (d, s)) != (d, s)]
        want[d] = gone
    got = {r["r_id"]: sorted((x["start"], x["end"]) for x in r["gone"]) for r in substring.repeats(docs).collect()}
    assert got == {d: sorted(g) for d, g in want.items() if g}


def _wrapped(words, rng, most):
    """The words, with a newline after each 1 to ``most`` of them."""
    out, left = [], 0
    for w in words:
        left = left or int(rng.integers(1, most + 1))
        left -= 1
        out.append(w + (" " if left else "\n"))
    return "".join(out).rstrip()


@pytest.mark.parametrize("most", [1, 5, 7, 12, 40, 1000])
def test_substring_no_shared_run_of_over_50_words_remains(spark, most):
    rng = np.random.default_rng(most)
    own = lambda n: [f"own{x}" for x in rng.integers(0, 1 << 40, n)]
    passages = [[f"p{k}x{i}" for i in range(n)] for k, n in enumerate([51, 51, 51, 52, 55, 60, 75, 130, 400])] + [["again"] * 90, ["one", "two", "three"] * 40]
    texts = [_wrapped(own(int(rng.integers(0, 30))) + p + own(int(rng.integers(0, 30))), rng, most) for p in passages for _ in range(3)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r["doc_id"]: r for r in substring.dedup_units(docs).collect()}
    seen = set()
    for d in sorted(out):
        words = spaced(out[d]["text"])
        runs = {tuple(words[i : i + 51]) for i in range(len(words) - 50)}
        assert not runs & seen
        seen |= runs
        at = [x for s in out[d]["removed"] for x in (s["start"], s["end"])]
        assert "".join(texts[d][a:b] for a, b in zip([0, *at[1::2]], [*at[::2], len(texts[d])], strict=True)) == out[d]["text"]
        assert d % 3 or len(words) == len(spaced(texts[d])) or d >= 27  # the first of the three stays whole, but for periods
    assert all(out[d]["removed"] for d in out if d % 3)


# 9 ---------------------------------------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    awkward = ["<|im_end|>", "<|im_start|>assistant\nok", "\x1b|", "<\x1b|", "", None, "é中" * 5, "a\nb", "<|" * 3 + "\x1b" * 4]
    rows = [(c, t, ["user", "assistant", None, "ro\nle"][t % 4], x) for c in (1, 2, None) for t, x in enumerate(awkward)] + [(1, 0, "user", "<|im_end|>"), (3, None, "assistant", "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    out = {r["conv_id"]: r for r in chat.format_conversations(turns).collect()}
    assert set(out) == {1, 2, None, 3}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or "")
    for c, r in out.items():
        want = [((role or "").encode(), (x or "").encode()) for _, _, role, x in sorted([y for y in rows if y[0] == c], key=key)]
        assert chat.read_back(bytes(r["formatted"])) == want and r["n_turns"] == len(want)
        loss = b"".join(chat.unescape(bytes(r["formatted"])[s["start"] : s["start"] + s["length"]]) for s in r["loss_spans"])
        assert loss == b"".join(x for role, x in want if role == b"assistant")
    assert chat.format_conversations(turns.limit(0)).count() == 0


def test_chat_batches_cut_between_conversations():
    rows = [(k // 3, "user", f"t{k}") for k in range(9000)]
    batches = [pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows[a : a + 1000]]) for c in range(3)], ["conv_id", "role", "text"]) for a in range(0, 9000, 1000)]
    out = list(chat._format(iter(batches)))
    assert [i for b in out for i in b.column(0).to_pylist()] == list(range(3000)) and len(out) > 1
    assert chat.read_back(out[0].column(2)[1].as_py()) == [(b"user", b"t3"), (b"user", b"t4"), (b"user", b"t5")]


def test_chat_long_turns():
    """Turns of 1 MB: batches close by bytes, and every text comes back."""
    rows = [(k // 2, "assistant", f"<|{k}" + "x" * 1_000_000 + "\x1b<|" * 50) for k in range(60)]
    batches = [pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows[a : a + 20]]) for c in range(3)], ["conv_id", "role", "text"]) for a in range(0, 60, 20)]
    out = list(chat._format(iter(batches)))
    assert [i for b in out for i in b.column(0).to_pylist()] == list(range(30)) and max(b.num_rows for b in out) <= 12
    turns = [t for b in out for x in b.column(2).to_pylist() for t in chat.read_back(x)]
    assert turns == [(r.encode(), t.encode()) for _, r, t in rows]


def test_chat_hash_of_the_probe(spark):
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    got = chat.op9_chat_format(spark, DATA).filter("conv_id = -1").first()
    p = chat.PROBE
    assert got["turns_sha256"] == hashlib.sha256(f"user\n{p}\nassistant\n{p}\n".encode()).hexdigest() and got["loss_chars"] == len(p)


# 10 --------------------------------------------------------------------------------------------------------------


def test_language_model(spark):
    rng = np.random.default_rng(6)
    tongues = [[f"{a}{b}" for b in ("la", "mo", "ki", "tu", "re", "sa")] for a in ("x", "y")]
    rows = [(i, " ".join(rng.choice(tongues[i % 2], 30))) for i in range(400)] + [(1000, None), (1001, ""), (1002, "never seen words"), (1003, LONG), (None, "xla xmo"), (5, "xla xmo")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit(1)).withColumn("n", F.lit(2))
    ws = shared.Workspace(spark, "test-lm")
    model, vocabulary = language_model.train(docs, ws, steps=4)
    got = collections.Counter((r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 5)) for r in language_model.score(docs, model, vocabulary, ws).collect())
    counts = collections.Counter()
    learned = lambda d: d is not None and zlib.crc32(str(d).encode()) % 5 != 1
    for d, t in rows:
        if learned(d):
            counts.update([*spaced(t), None])
    n, v = sum(counts.values()), len(counts)
    want = collections.Counter()
    for d, t in rows:
        tokens = [*spaced(t), None]
        want[d, len(tokens), sum(counts[w] > 0 for w in tokens), round(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens), 5)] += 1
    assert got == want and model.n == n and model.v == v
    scored = language_model.score(docs.filter("doc_id < 400"), model, vocabulary, shared.Workspace(spark, "test-lm")).agg(F.sum("base_score"), F.sum("score")).first()
    assert scored[1] > scored[0]  # two languages: the history tells which


def test_language_model_probabilities_sum_to_one():
    rng = np.random.default_rng(7)
    weights = rng.normal(size=(language_model._AT[-1], language_model.SLOTS)).astype(np.float32)
    p = np.exp(language_model.log_softmax(weights, rng.integers(0, language_model.SLOTS**3, 100)))
    assert np.allclose(p.sum(axis=1), 1, atol=1e-5)


def test_language_model_gradient():
    rng = np.random.default_rng(8)
    weights = rng.normal(size=(language_model._AT[-1], language_model.SLOTS))
    context, cls, n = rng.integers(0, 1000, 50), rng.integers(0, language_model.SLOTS, 50), rng.integers(1, 5, 50)
    g, loss = language_model.gradient(weights, context, cls, n)
    row, col = int(language_model.rows_of(context[:1])[0, 1]), int(cls[0])
    moved = weights.copy()
    moved[row, col] += 1e-5
    assert (language_model.gradient(moved, context, cls, n)[1] - loss) / 1e-5 == pytest.approx(g[row, col], rel=1e-2, abs=1e-3)


def test_language_model_without_training_text(spark):
    ws = shared.Workspace(spark, "test-lm")
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    docs = spark.createDataFrame([(held, "some text")], "doc_id long, text string")
    model, vocabulary = language_model.train(docs, ws, steps=1)
    r = language_model.score(docs, model, vocabulary, ws).first()
    assert (r["n_known"], r["n_tokens"]) == (0, 3) and math.isfinite(r["score"]) and model.n == 0
    assert language_model.score(docs.limit(0), model, vocabulary, shared.Workspace(spark, "test-lm")).count() == 0


# All ---------------------------------------------------------------------------------------------------------------


def test_word_hashes_depend_on_words_alone():
    texts = pa.array(["Hello wOrld", "world", None, "", "a\thello"])
    seen = {}
    for _, _, data, offsets in shared.text_steps(texts):
        h, row, start, end = shared.hashed_words(data, offsets)
        for x, r, s, e in zip(h.tolist(), row.tolist(), start.tolist(), end.tolist(), strict=True):
            word = bytes(data[s:e]).decode().lower()
            assert seen.setdefault(word, x) == x
    assert len(seen) == len(set(seen.values())) == 3
    assert shared.word_hash("hello") == seen["hello"]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_matches_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    want = con.execute(registry.SQL[name]).df()
    got = registry.QUERIES[name](spark, DATA).toPandas()
    rows = lambda x: sorted(map(str, x[sorted(x.columns)].astype(object).where(x[sorted(x.columns)].notna(), None).itertuples(index=False, name=None)))
    assert rows(got) == rows(want)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    ws = shared.Workspace(spark, "test-pipeline")
    kept = [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = ws.write(stage(spark, docs, DATA), f"s{k}")
        if k < 4:
            assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
            kept.append(out.count())
            docs = out
    assert kept == sorted(kept, reverse=True) and kept[3] == kept[2] and kept[1] > 0.8 * kept[0]
    assert {r["doc_id"] for r in out.select("doc_id").distinct().collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert corpus_pipeline.run(spark, DATA).count() == out.count()


def test_pipeline_on_awkward_tables(spark, tmp_path):
    """Nulls, repeated rows and ids, empty texts, clashing columns; what stays is worked out by hand."""
    import corpus_pipeline

    words = lambda c, n: " ".join(f"{c}{i}" for i in range(n))
    rows = [
        (1, words("a", 60)), (2, words("a", 60) + " more"), (1, words("a", 60)), (3, None), (4, ""), (4, ""), (5, words("b", 60)), (5, words("c", 60) + " idiot moron scum vermin"), (None, words("d", 60)),
        (6, words("e", 60) + " " + PASSAGE), (7, words("f", 400)), (7, words("a", 61)), (None, None), (8, PASSAGE + " tail"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit("x")).withColumn("label", F.lit(1)).withColumn("removed", F.lit(2)).withColumn("n_chars", F.length("text"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, words("f", 13)), (2, words("b", 60)), (3, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out, kept = docs, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, str(tmp_path))
        assert out.columns == docs.columns
        out = shared.Workspace(spark, "awkward").write(out, "t")
        kept.append(sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str))
    toxic = [r for r in rows if r[1] and "idiot" in r[1]]
    assert kept[0] == sorted([r for r in rows if r not in toxic], key=str)
    left = [(1, words("a", 60)), (3, None), (4, ""), (4, ""), (5, words("b", 60)), (None, words("d", 60)), (6, words("e", 60) + " " + PASSAGE), (7, words("f", 400)), (None, None), (8, PASSAGE + " tail")]
    assert kept[1] == sorted(left, key=str)
    assert len(kept[2]) == len(left) and [r for r in kept[2] if r[0] not in (6, 8)] == sorted([r for r in left if r[0] not in (6, 8)], key=str)
    assert all("passage40" not in (t or "") for d, t in kept[2] if d == 8) and all("passage40" in t for d, t in kept[2] if d == 6)
    assert kept[3] == [r for r in kept[2] if r[0] != 5]
    pieces = corpus_pipeline.STAGES[-1][1](spark, out, str(tmp_path))
    assert pieces.select("doc_id").distinct().count() == len({d for d, _ in kept[3]})
    docs.limit(0).write.mode("overwrite").parquet(str(tmp_path / "none" / "documents.parquet"))
    for t in ("labels", "benchmark"):
        spark.read.parquet(str(tmp_path / f"{t}.parquet")).write.parquet(str(tmp_path / "none" / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
