"""Source mixing, divergence audit and hard negatives against brute force, on small tables with nulls, ties, repeated rows and clashing columns."""

import collections
import itertools
import math
import re
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stallwise.llm import divergence, grid, mixing, negatives, topk

LONG = " ".join(f"w{i % 3000}" for i in range(30_000))


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


# 11 --------------------------------------------------------------------------------------------------------------


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    w, out, free = [weights[k % len(weights)] for k in range(len(sizes))], {}, set(range(len(sizes)))
    while free:
        left, level = sum(sizes) - sum(out.values()), sum(w[k] for k in free)
        over = {k for k in free if Fraction(left * w[k], level) > most * sizes[k]}
        if not over:
            return [out.get(k, Fraction(left * w[k], level)) for k in range(len(sizes))]
        out |= {k: Fraction(most * sizes[k]) for k in over}
        free -= over
    return [out[k] for k in range(len(sizes))]


def test_targets_by_repeated_sharing():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 5, 40):
        for _ in range(30):
            sizes = [int(x) for x in rng.integers(0, [3, 50, 10_000][int(rng.integers(3))], n)]
            got = mixing.targets(sizes)
            assert got == brute_targets(sizes) and sum(got) == sum(sizes)
    assert mixing.targets([]) == [] and mixing.targets([0, 0]) == [0, 0]


def sourced(spark):
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(f"t{k}" for k in range(int(rng.integers(0, 60)))), f"s{int(rng.integers(5)) ** 2}") for i in range(400)]
    rows += [(1, "one two", "s1"), (1, "one two", "s1"), (1, "one two", "s1"), (None, "a b c", "s0"), (900, None, "s0"), (901, "x y", None), (902, LONG, "big"), (903, "", "void"), (904, "  not space\x0b\x1f", "É")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash")).withColumn("source_no", F.lit(1)).withColumn("h", F.lit(None).cast("int"))


def words_of(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


@pytest.mark.parametrize("block", [7, 64, 1024])
def test_mix(spark, block):
    docs = sourced(spark)
    placed, pieces = mixing.mix(docs, block=block)
    placed, pieces = placed.collect(), pieces.collect()
    want = collections.Counter((r["doc_id"], len(words_of(r["text"])), r["source"]) for r in docs.collect())
    assert collections.Counter((r["doc_id"], r["size"], r["source"]) for r in placed) == want
    of = collections.defaultdict(int)
    for r in placed:
        of[r["source"]] += r["size"]
    names = sorted(of, key=lambda s: (s is None, (s or "").encode()))
    target = dict(zip(names, brute_targets([of[s] for s in names]), strict=True))
    number = {s: k for k, s in enumerate(names)}
    assert all(r["source_size"] == of[r["source"]] and r["source_no"] == number[r["source"]] and r["target"] == float(target[r["source"]]) for r in placed)
    size = {(r["source_no"], r["doc_no"]): r["size"] for r in placed if r["size"]}
    assert len(size) == sum(1 for r in placed if r["size"])
    taken, by_source, copies, slots = collections.Counter(), collections.Counter(), collections.defaultdict(list), collections.defaultdict(list)
    for r in pieces:
        taken[r["source_no"], r["doc_no"]] += r["length"]
        by_source[r["source_no"]] += r["length"]
        copies[r["source_no"], r["doc_no"], r["copy"]].append((r["start"], r["length"]))
        slots[r["slot"]].append((r["at"], r["length"], r["source_no"]))
    assert all(by_source[number[s]] == math.floor(target[s] + Fraction(1, 2)) for s in names)
    assert all(n <= 3 * size[key] for key, n in taken.items())
    for key, cut in copies.items():  # every copy is taken from its first word without a gap
        assert [a for a, _ in sorted(cut)] == [0, *itertools.accumulate(n for _, n in sorted(cut))][:-1] and sum(n for _, n in cut) <= size[key[:2]]
    for parts in slots.values():  # every slot is one source's, filled from its beginning
        assert len({s for _, _, s in parts}) == 1 and [a for a, _, _ in sorted(parts)] == [0, *itertools.accumulate(n for _, n, _ in sorted(parts))][:-1] and sum(n for _, n, _ in parts) <= block
    order = [parts[0][2] for _, parts in sorted(slots.items())]
    shares = {number[s]: float(target[s]) / float(sum(of.values())) for s in names}
    for n in range(20, len(order), 37):
        assert all(abs(order[:n].count(k) - n * x) <= 4 + 2 * math.log2(len(order)) for k, x in shares.items())


def test_mix_again_and_empty(spark):
    docs = sourced(spark)
    one, two = (sorted(map(tuple, mixing.mix(d, block=32)[1].collect())) for d in (docs, docs.repartition(7)))
    assert one == two
    for d in (docs.limit(0), docs.filter("doc_id = 903"), docs.filter("doc_id = 903").withColumn("text", F.lit(None).cast("string"))):
        placed, pieces = mixing.mix(d)
        assert placed.count() == d.count() and pieces.count() == 0


# 12 --------------------------------------------------------------------------------------------------------------


def brute_audit(rows, least, ranks=50):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    counts, docs, groups = collections.Counter(), collections.Counter(), set()
    for text, lang, source in rows:
        lang, source, found = lang or "", source or "", term.findall(lower(text or ""))
        groups.add((lang, source))
        counts.update((lang, source, t) for t in found)
        docs.update((lang, t) for t in set(found))
    out = []
    for lang in {g[0] for g in groups}:
        own = sorted((s for x, s in groups if x == lang), key=str.encode)
        kept = sorted((t for (x, t), n in docs.items() if x == lang and n >= least), key=str.encode)
        n = {s: {t: counts[lang, s, t] for t in kept} for s in own}
        whole = {t: sum(n[s][t] for s in own) for t in kept}
        p_of = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}
        p, q = {s: p_of(n[s]) for s in own}, p_of(whole)
        for s in own:
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in own if o != s)
            terms = sorted((q[t] - p[s][t], t.encode()) for t in kept if n[s][t] > 0 and p[s][t] > q[t])[:ranks]
            out += [(lang, s, part, i.decode(), -v, k + 1) for part, found in (("pair", pairs), ("term", terms)) for k, (v, i) in enumerate(found)]
    return sorted(out)


def audited(spark):
    rng = np.random.default_rng(6)
    words = ["the", "The", "théme", "them", "thematic", "a", "ab", "abc", "中文", "中", "ÀÉ", "àé", "x1y", "😀", "z"]
    rows = [(" ".join(rng.choice(words, int(rng.integers(0, 12)))), ["en", "de", None, ""][int(rng.integers(4))], ["a", "b", "é", None][int(rng.integers(4))]) for _ in range(300)]
    rows += [("same same", "en", "a")] * 9 + [(None, "en", "none"), ("1 2 3 !", "void", "a"), ("few", "void", "b"), ("alone " * 3, "one", "a"), (LONG.replace("w", "long"), "en", "b")]
    return spark.createDataFrame(rows, "text string, lang string, source string").withColumn("term", F.lit(1)).withColumn("value", F.lit(2)).withColumn("a", F.lit(3))


@pytest.mark.parametrize(("least", "ranks", "leaves", "cells", "pairs"), [(5, 50, 100_000, 1 << 20, 1 << 22), (2, 3, 20, 8, 4), (1, 2, 20, 8, 4)])
def test_audit(spark, monkeypatch, least, ranks, leaves, cells, pairs):
    monkeypatch.setattr(divergence, "MOST_LEAVES", leaves)
    docs = audited(spark)
    got = sorted(map(tuple, divergence.audit(docs, least, ranks).collect()))
    assert got == brute_audit([(r["text"], r["lang"], r["source"]) for r in docs.collect()], least, ranks)
    assert divergence.audit(docs.limit(0)).count() == 0


@pytest.mark.parametrize(("cells", "pairs"), [(8, 4), (64, 4), (8, 1 << 22)])
def test_walk_in_steps(cells, pairs, monkeypatch):
    """Small steps and early sums give what one step gives."""
    rng = np.random.default_rng(9)
    n = rng.integers(0, 9, (40, 5))
    terms = sorted(f"t{k}".encode() for k in range(40))
    kind = pa.list_(pa.struct([("s", pa.binary()), ("n", pa.int64())]))
    rows = pa.record_batch([pa.array([b"x"] * 40, pa.binary()), pa.array(terms, pa.binary()), pa.array([[{"s": f"{k}".encode(), "n": int(c)} for k, c in enumerate(r) if c] for r in n], kind)], ["lang", "term", "x"])

    class Sent:
        value = {b"x": divergence.Sources([f"{k}".encode() for k in range(5)], n.sum(axis=0).tolist(), 40)}

    def walked():
        sums, best = collections.Counter(), []
        for b in divergence._walk(Sent, 4)(iter([rows])):
            for r in b.to_pylist():
                if r["b"] is None:
                    best.append((r["a"], r["term"], r["value"]))
                else:
                    sums[r["a"], r["b"]] += r["value"]
        return sums, sorted(best)

    want = walked()
    monkeypatch.setattr(divergence, "STEP_CELLS", cells)
    monkeypatch.setattr(divergence, "MOST_PAIRS", pairs)
    assert walked() == want and len(want[0]) == 10


def test_shares_are_exact():
    rng = np.random.default_rng(1)
    for most in (10, 10**6, 10**12, 9 * 10**15, 10**17):
        total = rng.integers(1, most, 200)
        count = (total * rng.random(200)).astype(np.int64)
        got = divergence.share(count, total)
        assert [int(x) for x in got] == [1 + 10**9 * int(c) // int(t) for c, t in zip(count, total, strict=True)]


def test_flat_trie_against_plain_counts():
    rng = np.random.default_rng(2)
    texts = [b" ".join(bytes(rng.integers(97, 100, int(rng.integers(1, 7))).astype(np.uint8)) + [b"", b"\xc3\xbf", b"\xc3\xa9"][int(rng.integers(3))] for _ in range(int(rng.integers(0, 40)))) for _ in range(80)]
    trie, want, docs = divergence.Trie(), collections.Counter(), collections.Counter()
    for a in range(0, 80, 7):
        part = texts[a : a + 7]
        group = np.array([trie.group(b"xy"[i % 2 : i % 2 + 1], b"s%d" % (i % 3)) for i in range(a, a + len(part))])
        trie.add(*divergence.terms_of(np.frombuffer(b"".join(part), np.uint8), np.cumsum([0, *map(len, part)])), group)
    for i, t in enumerate(texts):
        for w in t.split():
            want[b"xy"[i % 2 : i % 2 + 1], w, b"s%d" % (i % 3)] += 1
        for w in set(t.split()):
            docs[b"xy"[i % 2 : i % 2 + 1], w, b"s%d" % (i % 3)] += 1
    rows = [r for b in trie.rows() for r in b.to_pylist()]
    leaves = [r for r in rows if r["term"]]
    assert {(r["lang"], r["term"], r["source"]): r["n"] for r in leaves} == want and {(r["lang"], r["term"], r["source"]): r["docs"] for r in leaves} == docs
    assert [(r["lang"], r["term"]) for r in leaves] == sorted((r["lang"], r["term"]) for r in leaves) and len(rows) - len(leaves) == 6


# 13 --------------------------------------------------------------------------------------------------------------


def vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.integers(-2, 5, 4) / 5], int(rng.integers(3))) for i in range(240)]
    rows += [(300, None, 1), (301, [], 1), (302, [1.0, None, 0.0, 0.0], 1), (303, [float("nan")] * 4, 1), (304, [float("inf")] * 4, 1), (None, [1.0] * 4, 1), (310, [1.0] * 4, None), (350, [0.5, 0.25], 1), (351, [1.0, 2.0], 1), (352, [0.9, 0.9], 2)]
    rows += [(400, [0.0] * 4, 0), (5, [2.0, 2.0, 2.0, 2.0], 1), (5, [2.0, 2.0, 2.0, 2.0], 1), (5, [2.0, 2.0, 2.0, 2.0], 2), (450, [-1.0] * 4, 9), (451, [0.1] * 4, 9)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("v", F.lit("x")).withColumn("score", F.lit(1)), rows


def brute_negatives(rows, every, k=5, n=3, low=50, high=95):
    good = {(i, tuple(math.floor(Fraction(x) * 256) for x in v), c) for i, v, c in rows if i is not None and c is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    hold = lambda s: min(max(s, -(1 << 63)), (1 << 63) - 1)
    out = []
    for i, q, c in good:
        if i % every:
            continue
        scores = sorted({(-hold(sum(a * b for a, b in zip(q, v, strict=True))), j, d == c) for j, v, d in good if j != i and len(v) == len(q)})
        for s, j, _ in [x for x in scores if x[2]][:k]:
            fit = [x for x in scores if not x[2] and low * -s <= 100 * -x[0] <= high * -s][:n]
            out += [(i, j, r + 1, x[1], -s, -x[0]) for r, x in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize("block_bytes", [1 << 25, 2000])
def test_hard_negatives(spark, block_bytes):
    df, rows = vectors(spark)
    got = sorted(map(tuple, negatives.mine(df, F.col("vec_id") % 10 == 0, block_bytes=block_bytes).collect()))
    assert got == brute_negatives(rows, 10) and len(got) > 100
    assert negatives.mine(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0


@pytest.mark.parametrize("size", [1e5, 3e8, 1e17, 1e307])
def test_hard_negatives_of_huge_components(spark, size):
    rng = np.random.default_rng(7)
    rows = [(i, [size * float(x) for x in rng.integers(0, 4, 3)], i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert sorted(map(tuple, negatives.mine(df, F.col("vec_id") % 20 == 0).collect())) == brute_negatives(rows, 20)


def repeating():
    """Rows that stand several times, ids with several labels and ids with several vectors, anchors among them."""
    rng = np.random.default_rng(23)
    rows = [(i, [float(x) for x in rng.integers(-2, 5, 4) / 5], int(rng.integers(3))) for i in range(260)]
    return rows + rows[:90] + rows[40:60] * 4 + [(i, v, (c + 1) % 3) for i, v, c in rows[95:160]] + [(i, v[::-1], c) for i, v, c in rows[145:210]]


def brute_rows(rows, every, k=5, n=3):
    """By the letter of the contract: each row is one, an anchor's own row is the only one left out."""
    x, out = np.array([[math.floor(Fraction(c) * 256) for c in v] for _, v, _ in rows]), []
    for a, (i, _, label) in enumerate(rows):
        if i % every:
            continue
        scores = sorted((-int(s), rows[b][0], rows[b][2] == label) for b, s in enumerate(x @ x[a]) if b != a)
        for s, j, _ in [r for r in scores if r[2]][:k]:
            fit = [r for r in scores if not r[2] and 50 * -s <= 100 * -r[0] <= 95 * -s][:n]
            out += [(i, j, r + 1, f[1], -s, -f[0]) for r, f in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize("block_bytes", [1 << 25, 2000])
def test_hard_negatives_count_every_row(spark, block_bytes):
    rows = repeating()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted(map(tuple, negatives.mine(df, F.col("vec_id") % 10 == 0, block_bytes=block_bytes, each_row=True).collect()))
    want = brute_rows(rows, 10)
    assert got == want and len(set(want)) < len(want)


def test_op13_counts_every_row(spark, tmp_path):
    rows = repeating()
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    moved = [(i, np.float32(v).tolist(), (c + 1) % 10 if i % 7 == 0 else c) for i, v, c in rows]
    got = sorted(map(tuple, negatives.op13_hard_negatives(spark, str(tmp_path)).collect()))
    assert got == brute_rows(moved, 50) and len(got) > 50


def test_limits_are_exact():
    for p in [*range(-300, 300), 10**18, -(10**18)]:
        least, most = negatives.limits(p, 50, 95)
        for s in {least - 1, least, most, most + 1, p, 0}:
            assert (least <= s <= most) == (50 * p <= 100 * s <= 95 * p)


# 5, on the same grid ---------------------------------------------------------------------------------------------


@pytest.mark.parametrize("size", [3e5, 1e307])
def test_topk_of_many_queries_and_huge_components(spark, size):
    """400 queries of 800 rows over cells of a few rows; the candidates are read as often as with one query."""
    rng = np.random.default_rng(13)
    rows = [(i, [size * float(x) for x in rng.integers(-1, 2, 3)]) for i in range(800)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 2 == 0, 3, block_bytes=8192).collect()))
    exact = {i: [math.floor(Fraction(x) * 256) for x in v] for i, v in rows}
    want = []
    for q in range(0, 800, 2):
        s = sorted((-grid.held(sum(a * b for a, b in zip(exact[q], v, strict=True))), i) for i, v in exact.items() if i != q)[:3]
        want += [(q, k + 1, i, -x) for k, (x, i) in enumerate(s)]
    assert got == sorted(want)


# 5 and 13, where Spark leaves the partitions as they are ----------------------------------------------------------


@pytest.fixture
def no_coalescing(spark):
    """Large tables' partitions aren't brought together; small ones' are, unless this is off, and then all cells meet in one task."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    yield
    spark.conf.unset(key)


@pytest.mark.parametrize("block_bytes", [1 << 25, 2000])
def test_topk_in_many_partitions(spark, no_coalescing, block_bytes):
    rng = np.random.default_rng(17)
    rows = [(i, [float(x) for x in rng.integers(-9, 10, 4) / 7]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 50 == 0, 5, block_bytes=block_bytes).collect()))
    x, want = np.array([[math.floor(256 * c) for c in v] for _, v in rows]), []
    for q in range(0, 300, 50):
        s = sorted((-int(a), i) for i, a in enumerate(x @ x[q]) if i != q)[:5]
        want += [(q, k + 1, i, -a) for k, (a, i) in enumerate(s)]
    assert got == want


@pytest.mark.parametrize("block_bytes", [1 << 25, 2000])
def test_hard_negatives_in_many_partitions(spark, no_coalescing, block_bytes):
    df, rows = vectors(spark)
    got = sorted(map(tuple, negatives.mine(df, F.col("vec_id") % 10 == 0, block_bytes=block_bytes).collect()))
    assert got == brute_negatives(rows, 10)
