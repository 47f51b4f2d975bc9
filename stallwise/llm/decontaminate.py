"""Benchmark decontamination with DataFrame functions only.

The benchmark's normalised windows (13 consecutive words; a shorter item is one window) become a table keyed by the
hash of each window's first, middle and last word. It is broadcast as a hash set, a block of measured size at a time
(``block_bytes``, of the distinct windows, so neither a huge item nor copies of one make a larger block); a larger benchmark
is swept in several blocks, never broadcast whole. Documents are scanned once a
block: their words are generated position by position, probed against the set, and each probe that hits is verified
word by word. Clean positions end there, in the scan's own stage; only hits and one marker row for each document are
shuffled.

Defined results: null or word-less texts have n_words 0 and no hit; a repeated row gives its result as often as it
stands in the input; null doc_ids are kept; benchmark rows without words do nothing; an item whose id is null still
marks words as hit but has no name among the items; an empty benchmark leaves every document clean. Input columns other
than doc_id and text (item_id and text of the benchmark) are never read, so their names can't clash.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Workspace, ascii_lower, table

WINDOW = 13
#: Bytes of windows in one broadcast block at most: some 40 bytes a byte of benchmark text.
BLOCK_BYTES = 128 << 20
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text):
    """The words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of a text, A-Z lower-cased; none of a null."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), _GAP), lambda w: w != "")


def _key(words, start, length):
    """Hash of a window's length and its first, middle and last word; start counts from 0."""
    return F.xxhash64(length, F.get(words, start), F.get(words, start + F.floor(length / 2).cast("int")), F.get(words, start + length - 1))


def windows(benchmark: DataFrame) -> DataFrame:
    """One row for each distinct window: w_key, w_len, w_words, w_items (the ids of the items that have it)."""
    items = benchmark.select(F.col("item_id").alias("w_item"), words_of(F.col("text")).alias("all")).filter(F.size("all") > 0)
    items = items.withColumn("w_len", F.least(F.size("all"), F.lit(WINDOW)))
    each = items.select("w_item", "w_len", "all", F.explode(F.sequence(F.lit(0), F.size("all") - F.col("w_len"))).alias("at"))
    each = each.select("w_item", "w_len", F.slice("all", F.col("at") + 1, F.col("w_len")).alias("w_words"))
    each = each.groupBy("w_len", "w_words").agg(F.collect_set("w_item").alias("w_items"))
    return each.select(_key(F.col("w_words"), F.lit(0), F.col("w_len")).alias("w_key"), "w_len", "w_words", "w_items")


def contamination(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """For each document: doc_id, text_key, n_words, n_hit, spans (array of first word from 0 and number of words), item_ids, contaminated.

    A document is contaminated if n_hit > 0 and 20 * n_hit >= n_words.
    """
    grams = windows(benchmark)
    held = F.aggregate("w_words", F.lit(0).cast("long"), lambda n, w: n + 16 + F.octet_length(w))
    n_bytes = grams.agg(F.sum(64 + held + 24 * F.size("w_items"))).first()[0] or 0
    blocks = math.ceil(2 * n_bytes / block_bytes) if n_bytes > block_bytes else 1  # dealt by hash, so none is twice the mean
    if blocks > 1:
        grams = Workspace(docs.sparkSession, "decontaminate").write(grams, "windows")
    hits = None
    for k in range(blocks):
        part = grams if blocks == 1 else grams.filter(F.pmod(F.xxhash64("w_words"), F.lit(blocks)) == k)
        found = _scan(docs, part, marker=k == 0)
        hits = found if hits is None else hits.unionByName(found)
    per = hits.groupBy("doc_id", "text_key").agg(
        F.max("n_words").alias("n_words"),
        F.sum(F.when(F.col("at") < 0, 1).otherwise(0)).alias("copies"),
        F.array_sort(F.collect_set(F.when(F.col("at") >= 0, F.struct("at", "w_len")))).alias("spans"),
        F.array_distinct(F.flatten(F.collect_set("w_items"))).alias("item_ids"),
    )
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("to"), F.lit(0).cast("long").alias("n")),
        lambda a, s: F.struct(
            F.greatest(a["to"], s["at"] + s["w_len"]).alias("to"),
            (a["n"] + F.greatest(F.lit(0), s["at"] + s["w_len"] - F.greatest(a["to"], s["at"]))).alias("n"),
        ),
        lambda a: a["n"],
    )
    per = per.withColumn("n_hit", covered).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
    per = per.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return per.select("doc_id", "text_key", "n_words", "n_hit", "spans", "item_ids", "contaminated")


def _scan(docs: DataFrame, grams: DataFrame, marker: bool) -> DataFrame:
    """A row for each verified hit, and with marker one (at -1) for each document."""
    lengths = sorted(r[0] for r in grams.select("w_len").distinct().collect())  # of 1 to WINDOW: WINDOW values at most
    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit("\0null"))).alias("text_key"), words_of(F.col("text")).alias("words"))
    rows = rows.withColumn("n_words", F.size("words").cast("long"))
    places = rows.select("*", F.explode(F.sequence(F.lit(-1 if marker else 0), F.col("n_words").cast("int"))).alias("at"))
    if len(lengths) > 1:
        places = places.withColumn("len", F.explode(F.when(F.col("at") < 0, F.array(F.lit(0))).otherwise(F.array(*map(F.lit, lengths)))))
    else:
        places = places.withColumn("len", F.lit(lengths[0] if lengths else WINDOW))
    fits = (F.col("at") >= 0) & (F.col("at") + F.col("len") <= F.col("n_words"))
    places = places.filter(fits | (F.col("at") < 0)).withColumn("key", F.when(fits, _key(F.col("words"), F.col("at"), F.col("len"))))
    same = (F.col("key") == F.col("w_key")) & (F.col("len") == F.col("w_len"))
    probed = places.join(F.broadcast(grams), same, "left")
    real = F.col("w_key").isNotNull() & (F.slice("words", F.col("at") + 1, F.col("w_len")) == F.col("w_words"))
    probed = probed.filter((F.col("at") < 0) | real)
    return probed.select("doc_id", "text_key", "n_words", "at", "w_len", "w_items")


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents") -> DataFrame:
    """The documents without contamination, in all their columns.

    remove="documents" drops contaminated documents whole and leaves all others as they are; remove="spans" keeps every
    document and cuts from contaminated ones the hit words, each with the gap that follows it.
    """
    found = contamination(docs, benchmark).filter("contaminated")
    found = found.select(F.col("doc_id").alias("__bad_id"), F.col("text_key").alias("__bad_key"), F.col("spans").alias("__bad_spans")).dropDuplicates(["__bad_id", "__bad_key"])
    same = docs["doc_id"].eqNullSafe(F.col("__bad_id")) & (F.xxhash64(F.coalesce(docs["text"], F.lit("\0null"))) == F.col("__bad_key"))
    if remove == "documents":
        return docs.join(found, same, "left_anti")
    joined = docs.join(found, same, "left")
    raw = F.regexp_extract_all("text", F.lit("([^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+)"), F.lit(1))
    gaps = F.split("text", r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", -1)
    hit = lambda i: F.exists("__bad_spans", lambda s: (s["at"] <= i) & (i < s["at"] + s["w_len"]))
    kept = F.transform(F.arrays_zip(raw.alias("w"), F.slice(gaps, 2, F.size(gaps)).alias("g")), lambda x, i: F.when(hit(i), F.lit("")).otherwise(F.concat(x["w"], F.coalesce(x["g"], F.lit("")))))
    cut = F.concat(F.get(gaps, F.lit(0)), F.array_join(kept, ""))
    return joined.withColumn("text", F.when(F.col("__bad_id").isNull() & F.col("__bad_key").isNull(), F.col("text")).otherwise(cut)).select(*docs.columns)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    names = F.array_sort(F.transform("item_ids", lambda i: i.cast("string")))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), "contaminated"
    )


OP1_SQL = r"""
with w as (
  select doc_id, row_number() over () rn,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws
  from documents),
i as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws
  from benchmark),
g as (
  select distinct item_id, least(len(ws), 13) k, array_to_string(list_slice(ws, p, p + least(len(ws), 13) - 1), ' ') gram
  from (select item_id, ws, unnest(generate_series(1, len(ws) - least(len(ws), 13) + 1)) p from i where len(ws) > 0)),
d as (
  select rn, k, p, array_to_string(list_slice(ws, p, p + k - 1), ' ') gram
  from (select rn, ws, k, unnest(generate_series(1, len(ws) - k + 1)) p from w, (select distinct k from g))),
h as (select d.rn, d.p, d.k, g.item_id from d join g using (k, gram)),
n as (select rn, count(*) n_hit from (select distinct rn, unnest(generate_series(p, p + k - 1)) q from h) group by rn),
m as (select rn, count(distinct item_id) n_items, sha256(string_agg(distinct item_id::varchar, ',' order by item_id::varchar)) items_sha256 from h group by rn)
select doc_id, len(ws)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items,
  coalesce(items_sha256, sha256('')) items_sha256, coalesce(n_hit > 0 and 20 * n_hit >= len(ws), false) contaminated
from w left join n using (rn) left join m using (rn)
"""

QUERIES = {"op1_decontaminate": op1_decontaminate}
SQL = {"op1_decontaminate": OP1_SQL}
