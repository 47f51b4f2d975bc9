"""Substring deduplication by hashing lines and runs of words.

The units are lines, and runs of ``RUN`` words of the whole text, whatever its lines. Of all runs those are units whose
digest is the smallest among ``WINDOW`` successive ones (winnowing), so that words alone determine them: two texts that
share ``RUN + WINDOW - 1`` = 51 words in sequence have all the window's runs in common, and thus a unit, wherever the
passage stands and however it is wrapped. Along a longer shared passage units follow each other without gaps, as
``WINDOW`` <= ``RUN``; what remains of it are less than ``WINDOW`` words at either end. Of equal runs that overlap in a
text (its words recur with a period) only every ``RUN``-th word's or so is a unit, so that the first one stays whole.
Units are normalised (A-Z lower-cased, words without their white space) and digested to 128 bits.

Digests are grouped globally with a map-side partial aggregate that keeps the earliest ranked occurrence, the smallest
(doc_id, text hash, start); only digests that occur more than once are joined back, by an equi-join that Spark can
split where one digest is hot. Every other occurrence is removed, and listed with its offsets in the original
text and the document that keeps the unit. What a removed line holds is also held by the line that is kept.

Lines of fewer than ``min_words`` words are no units by themselves, and passages of 50 words or fewer need not hold a unit
other than lines: they recur by chance and as form, not as copied passages.

Defined results: a null text stays null; an empty one stays empty; both have no units. Documents rank by doc_id, nulls
last, then by the text's hash. Rows that repeat doc_id and text are one document, whose result is given as often
as it stands in the input. A whole copy under another doc_id loses its units and stays as a row with what is left.
All other columns are kept; an input column named ``removed`` is replaced by the result's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import hashed_words, mix, table, text_steps

MIN_WORDS = 8
#: Words of a run, and successive runs of which the smallest is a unit. Every passage of RUN + WINDOW - 1 words, 51, holds a unit.
RUN, WINDOW = 32, 20
REMOVED = "array<struct<start: bigint, end: bigint, keeper: bigint>>"
_Q, _QI = np.uint64(0xD6E8FEB86659FD93), np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))


def _digests(h: np.ndarray, first: np.ndarray, after: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each run of words first..after-1."""
    n = len(h)
    up, down = np.full(n + 1, _Q, np.uint64), np.full(n + 1, _QI, np.uint64)
    up[0] = down[0] = 1
    np.multiply.accumulate(up, out=up)
    np.multiply.accumulate(down, out=down)
    out = []
    for k in (1, 2):
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(mix(h + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64))) * up[:n], out=total[1:])
        out.append(mix((total[after] - total[first]) * down[first] + (after - first).astype(np.uint64) * np.uint64(8) + np.uint64(salt)))
    return out[0], out[1]


def _sliding(x: np.ndarray, size: int, least: bool) -> np.ndarray:
    """The least or largest of each size successive values."""
    pick, out, width = np.minimum if least else np.maximum, x, 1
    while width < size:
        step = min(width, size - width)
        out = pick(out[:-step], out[step:])
        width += step
    return out


def _apart(key: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The places, in order, without those that begin inside an equal run that stays: of each key's places the first, and then always the next one RUN words on."""
    order = np.lexsort((at, key))
    k, p = key[order], at[order]
    near = (k[1:] == k[:-1]) & (p[1:] - p[:-1] < RUN)
    if not near.any():
        return at
    keep = np.ones(len(p), bool)
    chain = np.flatnonzero(np.diff(np.concatenate(([False], near, [False])).astype(np.int8)))
    for a, b in zip(chain[::2], chain[1::2] + 1, strict=True):
        keep[a:b] = False
        while a < b:
            keep[a] = True
            a += int(np.searchsorted(p[a:b], p[a] + RUN))
    return np.sort(p[keep])


def _runs(h: np.ndarray, row: np.ndarray) -> np.ndarray:
    """First words of the runs that are units."""
    n = len(h)
    windows = n - RUN - WINDOW + 2
    if windows <= 0:
        return np.zeros(0, np.int64)
    first = np.arange(n - RUN + 1)
    key = _digests(h, first, first + RUN, 2)[0]
    least = _sliding(key, WINDOW, True)
    whole = row[:windows] == row[RUN + WINDOW - 2 :]  # windows inside one row
    # A run is the least of some window if the largest of its windows' least values is its own.
    pad = np.zeros(WINDOW - 1, np.uint64)
    best = _sliding(np.concatenate((pad, np.where(whole, least, np.uint64(0)), pad)), WINDOW, False)
    covered = np.concatenate(([0], np.cumsum(whole)))
    some = covered[np.minimum(first + 1, windows)] > covered[np.maximum(first - WINDOW + 1, 0)]
    at = np.flatnonzero((best == key) & some)
    return _apart(mix(key[at] + row[at].astype(np.uint64) * _Q), at)


def units(data: np.ndarray, offsets: np.ndarray, min_words: int) -> tuple[np.ndarray, ...]:
    """(row, start, end in code points of the row's text, digest 1, digest 2) of every unit that may be removed.

    A line reaches over its newline; a run from its first word to the next word, or to its last line's end.
    """
    h, row, start, _ = hashed_words(data, offsets)
    n = len(h)
    if not n:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    points = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=points[1:])
    breaks = np.flatnonzero(data == 10)
    begins = np.unique(np.concatenate((offsets[:-1], breaks + 1)))  # of lines, in bytes
    line = np.searchsorted(begins, start, "right") - 1
    new = np.empty(n, bool)
    new[0], new[1:] = True, line[1:] != line[:-1]
    first = np.flatnonzero(new)
    after = np.append(first[1:], n)

    long = after - first >= min_words
    a, b = first[long], after[long]
    line_from = begins[line[a]]
    stop = np.append(begins, len(data))[line[a] + 1]
    line_to = np.minimum(stop, offsets[row[a] + 1])
    l1, l2 = _digests(h, a, b, 1)

    s = _runs(h, row)
    t = s + RUN
    ends_line = (t == n) | new[np.minimum(t, n - 1)]
    last = line[t - 1]
    run_stop = np.minimum(np.append(begins, len(data))[last + 1], offsets[row[s] + 1])
    run_stop = run_stop - (data[run_stop - 1] == 10)
    run_to = np.where(ends_line, run_stop, start[np.minimum(t, n - 1)])
    s1, s2 = _digests(h, s, t, 2)

    rows = np.concatenate((row[a], row[s]))
    base = points[offsets[rows]]
    return rows, points[np.concatenate((line_from, start[s]))] - base, points[np.concatenate((line_to, run_to))] - base, np.concatenate((l1, s1)), np.concatenate((l2, s2))


def _unit_rows(min_words: int):
    names = ["r_id", "r_key", "start", "end", "h1", "h2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = batch.column(0), batch.column(1)
            for a, _b, data, offsets in text_steps(batch.column(2)):
                row, start, end, h1, h2 = units(data, offsets, min_words)
                where = pa.array(row + a)
                columns = [ids.take(where), keys.take(where), *(pa.array(x.view(np.int64)) for x in (start, end, h1, h2))]
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """A row for each document that has units to remove: r_id, r_key (its key) and gone, the units' spans and keepers."""
    rows = docs.filter("text is not null").select(F.col("doc_id").cast("long").alias("r_id"), F.xxhash64("text").alias("r_key"), "text")
    found = rows.mapInArrow(_unit_rows(min_words), "r_id long, r_key long, start long, end long, h1 long, h2 long")
    rank = F.struct(F.col("r_id").isNull().alias("last"), F.col("r_id").alias("id"), F.col("r_key").alias("key"), F.col("start").alias("start"))
    first = found.groupBy("h1", "h2").agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    later = found.join(first, ["h1", "h2"]).filter(~rank.eqNullSafe(F.col("first")))
    return later.groupBy("r_id", "r_key").agg(F.array_sort(F.collect_set(F.struct("start", "end", F.col("first.id").alias("keeper")))).alias("gone"))


#: Rows whose spans are Python objects at one time: a copied document has dozens of them.
CUT_ROWS = 256


def _cut(text: pa.Array, gone: pa.Array) -> pa.Array:
    parts = [_cut_rows(text.slice(a, CUT_ROWS), gone.slice(a, CUT_ROWS)) for a in range(0, max(len(text), 1), CUT_ROWS)]
    return pa.concat_arrays(parts)


def _cut_rows(text: pa.Array, gone: pa.Array) -> pa.Array:
    texts, removed = [], []
    for t, g in zip(text.to_pylist(), gone.to_pylist(), strict=True):
        if g is None or t is None:
            texts.append(t)
            removed.append([])
            continue
        at, kept, spans = 0, [], []
        for x in g:  # in order of start; lines and runs overlap
            if x["end"] <= at:
                continue
            x["start"] = max(x["start"], at)
            kept.append(t[at : x["start"]])
            if spans and x["start"] == at and spans[-1]["keeper"] == x["keeper"]:
                spans[-1]["end"] = x["end"]
            else:
                spans.append(x)
            at = x["end"]
        texts.append("".join([*kept, t[at:]]))
        removed.append(spans)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("keeper", pa.int64())]))
    return pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(removed, kind)], ["text", "removed"])


def dedup_units(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with text cut, and removed: array of (start, end, keeper), code points of the original text and the doc_id that keeps the unit.

    The spans do not overlap and are in order; adjoining ones with one keeper are one span. Only texts that lose something pass through Python a second time.
    """
    gone = repeats(docs, min_words)
    joined = docs.join(gone, docs["doc_id"].eqNullSafe(gone["r_id"]) & (F.xxhash64(docs["text"]) == gone["r_key"]), "left")
    cut = F.arrow_udf(_cut, f"struct<text: string, removed: {REMOVED}>")(F.when(gone["gone"].isNotNull(), docs["text"]), gone["gone"])
    keep = [docs[c] for c in docs.columns if c not in ("removed", "text")]
    out = joined.select(*keep, docs["text"].alias("__text"), gone["gone"].isNull().alias("__whole"), cut.alias("__cut"))
    text = F.when(F.col("__whole"), F.col("__text")).otherwise(F.col("__cut.text")).alias("text")
    columns = [text if c == "text" else F.col(f"`{c}`") for c in docs.columns if c != "removed"]
    return out.select(*columns, F.when(F.col("__whole"), F.array().cast(REMOVED)).otherwise(F.col("__cut.removed")).alias("removed"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the text that is left, n_removed, and the removed spans as start-end<keeper, comma-joined."""
    out = dedup_units(table(spark, sf_dir, "documents").select("doc_id", "text"))
    span = lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string"), F.lit("<"), F.coalesce(s["keeper"].cast("string"), F.lit("")))
    return out.select("doc_id", "text", F.size("removed").cast("long").alias("n_removed"), F.array_join(F.transform("removed", span), ",").alias("removed_spans"))


QUERIES = {"op8_substring_dedup": op8_substring_dedup}
SQL: dict[str, str] = {}
