"""Mixing sources to target weights by a low-discrepancy schedule.

Every source's documents are put in a shuffled order (a hash of seed, id and text), one after the other, up to ``most`` times over, and this stream of words is cut
into blocks of equal length. A schedule deals slots to sources: slot n lies at the fractional part of n times the golden ratio, in 64-bit whole
numbers, and belongs to the source whose stretch of the cumulative targets holds that point, so any run of slots has nearly each source's share. Slots are ranked per source;
the slot of rank r takes the source's block r, by a join on both. Targets hold exactly, to the word: a source whose slots run out before its target (by the logarithm
of the number of slots at most) gets the rest at the schedule's end, slots beyond the target stay empty, and its last block is cut.

Scale: words are counted once and written with the ids, and no text is shuffled. Orders are made of pieces: a source's stream of the hash's leading bits, its slots of runs of
``RUN`` slots, with offsets from small tables, so no source is in one task. The number of sources alone goes to the driver, with two numbers for each
(``MOST_SOURCES``, beyond which it raises: a mix names its sources, like a configuration).

Defined results: null text has size 0; documents without words are in no block and are taken 0 times; a null source is one source, the last; repeated rows are documents each;
an empty table, or one without words, gives targets of 0. Only doc_id, text and source are read, so other columns can't clash. Reruns agree, whatever the partitions.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import Workspace, table

#: Words of a block. Weights by a source's place in order, repeating. How often a document is taken at most.
BLOCK, WEIGHTS, MOST = 1024, (5, 2, 1), 3
#: 2^64 divided by the golden ratio, as an odd number.
GOLDEN = 0x9E3779B97F4A7C15
RUN = 4096
MOST_SOURCES = 1 << 22
SEED = 17


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> list[Fraction]:
    """Each source's share of the sum of sizes by its weight, but most times its size at most; what is over is shared again until no source is above."""
    w = [weights[k % len(weights)] for k in range(len(sizes))]
    total, of_weights = sum(sizes), sum(w)
    out = [Fraction(0)] * len(sizes)
    order = sorted(range(len(sizes)), key=lambda k: Fraction(most * sizes[k], w[k]))
    for k in order:  # a source that is full at a level stays so at all higher ones
        if most * sizes[k] * of_weights > total * w[k]:
            break
        out[k] = Fraction(most * sizes[k])
        total, of_weights = total - most * sizes[k], of_weights - w[k]
    else:
        return out
    full = set(order[: order.index(k)])
    return [x if j in full else Fraction(total * w[j], of_weights) for j, x in enumerate(out)]


def _runs(sent):
    """Run numbers to (slot, source_no, run, place in the source's slots of the run from 0)."""

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends, n_slots = sent.value
        for batch in batches:
            for run in batch.column(0).to_pylist():
                n = np.arange(run * RUN, min((run + 1) * RUN, n_slots), dtype=np.uint64)
                source = np.searchsorted(ends, n * np.uint64(GOLDEN), "right")
                order = np.argsort(source, kind="stable")
                first = np.searchsorted(source[order], np.arange(len(ends) + 1))
                place = np.empty(len(n), np.int64)
                place[order] = np.arange(len(n)) - first[source[order]]
                yield pa.RecordBatch.from_arrays([pa.array(n.astype(np.int64)), pa.array(source.astype(np.int32)), pa.array(np.full(len(n), run, np.int64)), pa.array(place)], ["slot", "source_no", "run", "place"])

    return slots


def schedule(spark: SparkSession, words: list[int], block: int) -> DataFrame:
    """slot, source_no, block_no: a row for each block that the sources' words (whole targets, by source_no) need; slots in golden-ratio order, shortfalls last."""
    needs = [-(-x // block) for x in words]
    n_slots, total = sum(needs), max(sum(words), 1)
    ends = np.array([min((x << 64) // total, (1 << 64) - 1) for x in accumulate(words)][:-1], np.uint64)
    sent = spark.sparkContext.broadcast((ends, n_slots))
    runs = spark.range(0, -(-n_slots // RUN), 1, min(max(1, n_slots // (64 * RUN)), 100_000)).select("id")
    slots = runs.mapInArrow(_runs(sent), "slot long, source_no int, run long, place long")
    counts = slots.groupBy("source_no", "run").agg(F.count(F.lit(1)).alias("n"))
    of_source = Window.partitionBy("source_no").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("source_no", "run", F.coalesce(F.sum("n").over(of_source), F.lit(0)).alias("before"))
    ranked = slots.join(before, ["source_no", "run"]).select("slot", "source_no", (F.col("before") + F.col("place")).alias("block_no"))
    needed = spark.createDataFrame([(k, n) for k, n in enumerate(needs) if n], "source_no int, need long")
    had = counts.groupBy("source_no").agg(F.sum("n").alias("had"))
    short = needed.join(had, "source_no", "left").withColumn("had", F.coalesce("had", F.lit(0).cast("long"))).filter("had < need")
    late = F.coalesce(F.sum(F.col("need") - F.col("had")).over(Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    short = short.withColumn("late", late).select("source_no", "had", "late", F.explode(F.sequence("had", F.col("need") - 1)).alias("block_no"))
    short = short.select((F.lit(n_slots) + F.col("late") + F.col("block_no") - F.col("had")).alias("slot"), "source_no", "block_no")
    return ranked.join(needed, "source_no").filter("block_no < need").select("slot", "source_no", "block_no").unionByName(short)


def sized(docs: DataFrame, seed: int) -> DataFrame:
    """doc_id, source, size (words) and h, the hash that orders a source's documents."""
    size = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))
    return docs.select("doc_id", "source", F.coalesce(size, F.lit(0)).cast("long").alias("size"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("h"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, block: int = BLOCK, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(documents, pieces). documents: doc_no, doc_id, source, size, source_size, target; doc_no is null without words, else unique in the source.

    pieces, a row for each part of a document in a block: slot, source_no, doc_no, copy (from 0), start and length in the document's words, at (the place in the block).
    Read by (slot, at), the pieces are the mix.
    """
    spark, ws = docs.sparkSession, Workspace(docs.sparkSession, "mixing")
    rows = ws.write(sized(docs, seed), "sizes")
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    sources = ws.write(sources.withColumn("source_no", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1), "sources")
    n_sources, n_docs = sources.agg(F.count(F.lit(1)), F.sum("n")).first()
    if n_sources > MOST_SOURCES:
        raise ValueError(f"{n_sources} sources: a mix has {MOST_SOURCES} at most")
    sizes = [r[0] for r in sources.orderBy("source_no").select("source_size").collect()]
    wanted = targets(sizes, weights, most)
    words = [int(x + Fraction(1, 2)) for x in wanted]
    numbers = spark.createDataFrame([(k, float(x), n) for k, (x, n) in enumerate(zip(wanted, words, strict=True))], "source_no int, target double, words long")
    sources = sources.join(numbers, "source_no").select(F.col("source").alias("s"), "source_no", "source_size", "target", "words")
    rows = rows.join(sources, F.col("source").eqNullSafe(F.col("s"))).drop("s")

    bits = max(10, ((n_docs or 0) >> 16).bit_length())
    rows = rows.withColumn("piece", F.shiftrightunsigned("h", 64 - bits))
    full = rows.filter("size > 0")
    each = full.groupBy("source_no", "piece").agg(F.sum("size").alias("n"))
    below = Window.partitionBy("source_no").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    each = each.select("source_no", "piece", F.coalesce(F.sum("n").over(below), F.lit(0)).alias("below"))
    inside = Window.partitionBy("source_no", "piece").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = full.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(each, ["source_no", "piece"])
    placed = placed.withColumn("doc_no", F.col("below") + F.col("inside"))  # the document's first word in its source's stream
    columns = ["doc_no", "source_no", "doc_id", "source", "size", "source_size", "target", "words"]
    placed = ws.write(placed.select(*columns).unionByName(rows.filter("size = 0").withColumn("doc_no", F.lit(None).cast("long")).select(*columns)), "placed")

    copies = placed.filter("doc_no is not null").withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
    begin = F.col("copy") * F.col("source_size") + F.col("doc_no")
    parts = copies.withColumn("begin", begin).withColumn("end", F.least(F.col("begin") + F.col("size"), F.col("words"))).filter("begin < end")
    parts = parts.withColumn("block_no", F.explode(F.sequence(F.expr(f"begin div {block}"), F.expr(f"(end - 1) div {block}"))))
    a, b = F.greatest("begin", F.col("block_no") * block), F.least("end", (F.col("block_no") + 1) * block)
    parts = parts.select("source_no", "doc_no", "copy", "block_no", (a - F.col("begin")).alias("start"), (b - a).alias("length"), (a - F.col("block_no") * block).alias("at"))
    pieces = parts.join(schedule(spark, words, block), ["source_no", "block_no"]).select("slot", "source_no", "doc_no", "copy", "start", "length", "at")
    return placed.drop("words"), pieces


def op11_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed, pieces = mix(table(spark, sf_dir, "documents"))
    taken = pieces.groupBy("source_no", "doc_no").agg(F.sum("length").alias("taken"))
    out = placed.join(taken, ["source_no", "doc_no"], "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))


QUERIES, SQL = {"op11_source_mix": op11_source_mix}, {}
