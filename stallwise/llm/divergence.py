"""Source divergence audit: smoothed term shares of every source against every other and against its language, all in whole numbers.

Each task counts the terms of its documents in prefix tries, one for each language, with a counter for each source at the leaves. A trie is held flat: its leaves
in byte order, so that each stands after the one that it shares the longest prefix with, in Arrow and numpy arrays without an object for a node. Steps of text become small tries, which
are merged into the task's; one of ``MOST_LEAVES`` leaves is handed on. Leaves are dealt by prefix range (language, term), the tries of a range are merged, and
walking the merged one in UTF-8 order keeps the terms in enough documents. The kept terms are walked once more, in steps, with the sources' totals: each step adds up
the distances of all pairs of sources and keeps every source's first candidates by (value descending, term). Pairs and candidates are all that leaves a task.

The totals of sources (one row for each language and source) are broadcast in groups of ``GROUP_BYTES`` by a hash of the language. The result itself has the square of a
language's sources as rows, so these are few beside it.

Defined results: null text, lang and source count as ''; repeated rows are documents each; a source of a language occurs even if it has no
terms, and a language without kept terms gives its pairs the value 0 and no term rows; a language with one source has no pairs; an empty table has no rows. Only
text, lang and source are read, so other columns can't clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import Workspace, table, text_steps

#: A-Z to a-z, and every byte that belongs to no term to 0; bytes from 0x80 on are terms' bytes.
FOLD = np.array([b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x61 <= b <= 0x7A else 0 for b in range(256)], np.uint8)
#: Leaves (a term with a source) of a task's trie, and of a range, in the mean. Bytes of text in a step.
MOST_LEAVES, STEP_BYTES = 1 << 20, 4 << 20
GROUP_BYTES = 16 << 20
#: Counts that one step of the second walk holds, and sums of pairs that a task keeps between steps.
STEP_CELLS, MOST_PAIRS = 1 << 20, 1 << 22
SHARES = 1_000_000_000
LEAF, KEPT = "lang binary, term binary, source binary, n long, docs long", "lang binary, term binary, sources array<binary>, counts array<long>"


def terms_of(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """(term, row) of every term of the rows, in order."""
    folded = FOLD[data]
    inside = folded > 0
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    at = np.concatenate((np.zeros(1, np.int64), np.cumsum(end - start)))
    terms = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(at), pa.py_buffer(folded[inside])])
    return terms, np.searchsorted(offsets, start, "right") - 1


def _summed(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """(distinct keys, sums of each of the values)."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(len(key), 1), bool), key[1:] != key[:-1])))
    return key[first], *(np.add.reduceat(x[order], first) if len(first) else x[:0] for x in values)


class Trie:
    """Flat tries of one task: leaves (language, term) with the occurrences and documents in each source."""

    def __init__(self):
        self.groups: dict[tuple[bytes, bytes], int] = {}
        self.parts: list[tuple] = []
        self.leaves = 0

    def group(self, lang: bytes, source: bytes) -> int:
        return self.groups.setdefault((lang, source), len(self.groups))

    def add(self, terms: pa.Array, row: np.ndarray, group: np.ndarray) -> None:
        """One step's terms: row is each term's document, group each document's (language, source)."""
        coded = terms.dictionary_encode()
        size = max(len(coded.dictionary), 1)
        code, n = np.unique(row * size + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
        key, n, docs = _summed(code % size * len(self.groups) + group[code // size], n, np.ones(len(code), np.int64))
        self.parts.append((coded.dictionary, key // len(self.groups), key % len(self.groups), n, docs))
        self.leaves += len(key)

    def merged(self) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(terms in byte order, and for each leaf: term number, group, occurrences, documents)."""
        terms = pa.concat_arrays([p[0] for p in self.parts]) if self.parts else pa.array([], pa.large_binary())
        first = np.cumsum([0, *(len(p[0]) for p in self.parts)])
        coded = terms.dictionary_encode()
        order = pc.sort_indices(coded.dictionary).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        number = rank[coded.indices.to_numpy(zero_copy_only=False)]
        size = max(len(self.groups), 1)
        key = np.concatenate([number[p[1] + a] * size + p[2] for p, a in zip(self.parts, first, strict=False)] or [np.zeros(0, np.int64)])
        key, n, docs = _summed(key, *(np.concatenate([p[k] for p in self.parts] or [np.zeros(0, np.int64)]) for k in (3, 4)))
        return coded.dictionary.take(pa.array(order)), key // size, key % size, n, docs

    def rows(self) -> Iterator[pa.RecordBatch]:
        """The leaves by language in byte order, and for every group a row of the empty term, which names it."""
        terms, number, group, n, docs = self.merged()
        langs, sources = (pa.array([g[k] for g in self.groups], pa.binary()) for k in (0, 1))
        place = {lang: k for k, lang in enumerate(sorted({g[0] for g in self.groups}))}
        of = np.array([place[g[0]] for g in self.groups], np.int64)
        order = np.argsort(of[group], kind="stable") if len(group) else np.zeros(0, np.int64)
        names = ["lang", "term", "source", "n", "docs"]
        zero = pa.array(np.zeros(len(self.groups), np.int64))
        yield pa.RecordBatch.from_arrays([langs, pa.array([b""] * len(self.groups), pa.binary()), sources, zero, zero], names)
        for a in range(0, len(order), 65536):
            at = order[a : a + 65536]
            yield pa.RecordBatch.from_arrays([langs.take(pa.array(group[at])), terms.take(pa.array(number[at])).cast(pa.binary()), sources.take(pa.array(group[at])), pa.array(n[at]), pa.array(docs[at])], names)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (text, lang, source) to leaves."""
    trie = Trie()
    for batch in batches:
        langs, sources = (batch.column(k).cast(pa.binary()).fill_null(b"").to_pylist() for k in (1, 2))
        group = np.array([trie.group(lang, source) for lang, source in zip(langs, sources, strict=True)], np.int64)
        for a, b, data, offsets in text_steps(batch.column(0), STEP_BYTES):
            trie.add(*terms_of(data, offsets), group[a:b])
        if trie.leaves >= MOST_LEAVES:
            yield from trie.rows()
            trie = Trie()
    if trie.groups:
        yield from trie.rows()


def _merge(least: int):
    """The leaves of a range to its kept terms in order, with their sources; the empty term is kept."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(batches)
        if not parts:
            return
        leaves = pa.Table.from_batches(parts).group_by(["lang", "term", "source"]).aggregate([("n", "sum"), ("docs", "sum")])
        docs = leaves.group_by(["lang", "term"]).aggregate([("docs_sum", "sum")])
        docs = docs.filter(pc.or_(pc.greater_equal(docs["docs_sum_sum"], least), pc.equal(pc.binary_length(docs["term"]), 0))).select(["lang", "term"])
        kept = leaves.join(docs, ["lang", "term"], join_type="inner").sort_by([(c, "ascending") for c in ("lang", "term", "source")])
        lang, term, source, n = (kept[c].combine_chunks() for c in ("lang", "term", "source", "n_sum"))
        if not len(lang):
            return
        new = np.ones(len(lang), bool)
        new[1:] = ~np.asarray(pc.and_(pc.equal(lang[1:], lang[:-1]), pc.equal(term[1:], term[:-1])))
        first = np.flatnonzero(new)
        for a in range(0, len(first), 4096):
            at = np.append(first[a : a + 4096], first[a + 4096] if a + 4096 < len(first) else len(lang))
            cut, offsets = slice(int(at[0]), int(at[-1])), pa.array((at - at[0]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, x[cut]) for x in (source, n)]
            heads = [x.take(pa.array(at[:-1])) for x in (lang, term)]
            yield pa.RecordBatch.from_arrays([*heads, *lists], ["lang", "term", "sources", "counts"])

    return merge


def share(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 * count / total) for 0 <= count <= total, three digits at a time so that no product exceeds a long; Python integers beyond."""
    if int(np.max(total, initial=0)) >= (1 << 63) // 1000:
        return 1 + SHARES * count.astype(object) // total.astype(object)
    out, rest = np.zeros_like(count), count
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, total)
        out = out * 1000 + digits
    return out + 1


class Sources:
    """The sources of one language in order, with their smoothed totals; the language's own total is the last."""

    def __init__(self, names: list[bytes], n: list[int], v: int):
        self.names, self.v = pa.array(names, pa.binary()), v
        self.totals = np.array([*n, sum(n)], np.int64) + 5 * v

    def shares(self, sources: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """(counts, shares) of terms (rows) in the sources and the language (columns); sources is a list of {source, count} for each term."""
        flat = sources.flatten()
        at = pc.index_in(flat.field("s"), value_set=self.names).to_numpy(zero_copy_only=False)
        counts = np.zeros((len(sources), len(self.names) + 1), np.int64)
        counts[np.repeat(np.arange(len(sources)), np.diff(np.asarray(sources.offsets))), at] = flat.field("n").to_numpy(zero_copy_only=False)
        counts[:, -1] = counts[:, :-1].sum(axis=1)
        return counts, share(counts + 5, np.broadcast_to(self.totals, counts.shape))


def _walk(sent, ranks: int):
    """Kept leaves to (lang, a, b, value) sums of pairs a < b, and (lang, a, term, value) candidates."""

    def out(rows: dict[str, list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(rows[c], k) for c, k in (("lang", pa.binary()), ("a", pa.int32()), ("b", pa.int32()), ("term", pa.binary()), ("value", pa.int64()))], ["lang", "a", "b", "term", "value"])

    def pairs(lang: bytes, sums: np.ndarray) -> Iterator[pa.RecordBatch]:
        a, b = np.triu_indices(len(sums), 1)
        for k in range(0, len(a), 65536):
            i, j = a[k : k + 65536], b[k : k + 65536]
            yield out({"lang": [lang] * len(i), "a": i, "b": j, "term": [None] * len(i), "value": sums[i, j]})

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, Sources] = sent.value
        sums: dict[bytes, np.ndarray] = {}
        best: dict[tuple[bytes, int], list[tuple[int, bytes]]] = {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for lang in sorted(set(langs)):
                own, rows = known[lang], np.flatnonzero([x == lang for x in langs])
                step = max(1, STEP_CELLS // len(own.totals))
                for k in range(0, len(rows), step):
                    part = batch.take(pa.array(rows[k : k + step]))
                    terms, zipped = part.column(1).to_pylist(), part.column(2)
                    counts, p = own.shares(pa.ListArray.from_arrays(zipped.offsets, zipped.values))
                    n, held = len(own.names), sums.get(lang)
                    held = np.zeros((n, n), p.dtype) if held is None else held
                    for a in range(n - 1):
                        held[a, a + 1 :] += np.abs(p[:, a : a + 1] - p[:, a + 1 : n]).sum(axis=0)
                    sums[lang] = held
                    for a in range(n):
                        f = p[:, a] - p[:, n]
                        fit = np.flatnonzero((counts[:, a] > 0) & (f > 0))
                        if len(fit) > ranks:  # all that reach the value of the last rank; ties are settled by term
                            fit = fit[f[fit] >= -np.partition(-f[fit], ranks - 1)[ranks - 1]]
                        found = best.get((lang, a), []) + [(-int(f[t]), terms[t]) for t in fit]
                        best[lang, a] = sorted(found)[:ranks]
                    if sum(x.size for x in sums.values()) > MOST_PAIRS:
                        for name, x in sums.items():
                            yield from pairs(name, x)
                        sums = {}
        for name, x in sums.items():
            yield from pairs(name, x)
        for (lang, a), found in best.items():
            if found:
                yield out({"lang": [lang] * len(found), "a": [a] * len(found), "b": [None] * len(found), "term": [t for _, t in found], "value": [-f for f, _ in found]})

    return walk


def audit(docs: DataFrame, least_docs: int = 30, ranks: int = 50) -> DataFrame:
    """lang, source, part, item, value, rank. Part "pair": each other source of the language and the sum of |p - q| over all kept terms; part "term": the terms whose
    share in the source exceeds the language's the most, ranks at most. A share is p = 1 + floor(10^9 * (count + 5) / (N + 5 * V))."""
    spark, ws = docs.sparkSession, Workspace(docs.sparkSession, "divergence")
    counted = ws.write(docs.select("text", "lang", "source").mapInArrow(_count, LEAF), "leaves")
    ranges = max(2 * spark.sparkContext.defaultParallelism, math.ceil(counted.count() / MOST_LEAVES))
    kept = ws.write(counted.repartitionByRange(ranges, "lang", "term").mapInArrow(_merge(least_docs), KEPT), "kept")
    ws.drop("leaves")

    n_terms = kept.groupBy("lang").agg(F.count_if(F.octet_length("term") > 0).alias("v"))
    each = kept.select("lang", F.explode(F.arrays_zip(F.col("sources").alias("s"), F.col("counts").alias("n"))).alias("x"))
    each = each.groupBy("lang", F.col("x.s").alias("source")).agg(F.sum("x.n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = ws.write(each.join(n_terms, "lang").withColumn("a", place), "groups")

    with_terms = groups.filter("v > 0")
    n_bytes = with_terms.agg(F.sum(64 + F.octet_length("source") + F.octet_length("lang"))).first()[0] or 0
    blocks, found = max(1, math.ceil(n_bytes / GROUP_BYTES)), None
    terms = kept.filter(F.octet_length("term") > 0).select("lang", "term", F.arrays_zip(F.col("sources").alias("s"), F.col("counts").alias("n")).alias("x"))
    for k in range(blocks):
        mine = F.pmod(F.xxhash64("lang"), F.lit(blocks)) == k
        names: dict[bytes, tuple[list, list, int]] = {}
        for r in with_terms.filter(mine).orderBy("lang", "a").collect():
            own = names.setdefault(bytes(r["lang"]), ([], [], r["v"]))
            own[0].append(bytes(r["source"]))
            own[1].append(r["n"])
        sent = spark.sparkContext.broadcast({lang: Sources(*own) for lang, own in names.items()})
        part = terms.filter(mine).mapInArrow(_walk(sent, ranks), "lang binary, a int, b int, term binary, value long")
        found = part if found is None else found.unionByName(part)
    found = ws.write(found, "found")

    text = lambda c: F.col(c).cast("string").alias(c)
    one, other = groups.select("lang", "source", "a"), groups.select("lang", F.col("source").alias("item"), F.col("a").alias("b"))
    sums = found.filter("b is not null").groupBy("lang", F.col("a").alias("least"), F.col("b").alias("most")).agg(F.sum("value").alias("value"))
    pairs = one.join(other, "lang").filter("a != b").withColumn("least", F.least("a", "b")).withColumn("most", F.greatest("a", "b"))
    pairs = pairs.join(sums, ["lang", "least", "most"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
    best = found.filter("b is null").join(one, ["lang", "a"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = pairs.unionByName(best.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= ranks).drop("r")).withColumn("rank", F.row_number().over(order))
    return ranked.select(text("lang"), text("source"), "part", text("item"), "value", "rank")


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
with d as (
  select row_number() over () rn, coalesce(lang, '') lang, coalesce(source, '') source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') ws from documents),
t as (select lang, source, rn, unnest(ws) term from d),
k as (select lang, term from t group by 1, 2 having count(distinct rn) >= 30),
v as (select lang, count(*) v from k group by 1),
c as (select lang, source, term, count(*) n from t join k using (lang, term) group by 1, 2, 3),
g as (select lang, source, coalesce(v, 0) v, coalesce(n, 0) n from (select distinct lang, source from d) left join v using (lang) left join (select lang, source, sum(n) n from c group by 1, 2) using (lang, source)),
p as (
  select lang, source, term, coalesce(c.n, 0) n, 1 + (1000000000::hugeint * (coalesce(c.n, 0) + 5)) // (g.n + 5 * g.v) p
  from g join k using (lang) left join c using (lang, source, term)),
q as (select lang, term, 1 + (1000000000::hugeint * (sum(p.n) + 5)) // (any_value(t.n) + 5 * any_value(t.v)) q from p join (select lang, sum(n) n, any_value(v) v from g group by 1) t using (lang) group by 1, 2),
s as (select a.lang, a.source, b.source item, sum(abs(a.p - b.p)) f from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by 1, 2, 3),
pairs as (select a.lang, a.source, 'pair' part, b.source item, coalesce(f, 0)::bigint as value from g a join g b on a.lang = b.lang and a.source <> b.source left join s on s.lang = a.lang and s.source = a.source and s.item = b.source),
terms as (select lang, source, 'term' part, term item, (p - q)::bigint as value from p join q using (lang, term) where n > 0 and p > q)
select *, (row_number() over (partition by lang, source, part order by value desc, item))::int as rank from pairs
union all select * from (select *, (row_number() over (partition by lang, source, part order by value desc, item))::int as rank from terms) where rank <= 50
"""

QUERIES = {"op12_source_divergence": op12_source_divergence}
SQL = {"op12_source_divergence": OP12_SQL}
