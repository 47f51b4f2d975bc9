"""Hard-negative mining by a full sort of each anchor's scores.

Anchors and rows meet in the cells of a grid (``grid.meet``), twice. The first time each anchor's rows of a cell are sorted by (score descending, id),
and the first rows of its own label are its positives there; a window keeps the first few over all cells. The second time every anchor brings its positives
along: the cell's rows of other labels are sorted in the same way, each positive's upper limit is found by binary search, and the next rows
down to the lower limit are read off, as many as are asked for; a window ranks what the cells gave. So a cell passes on a fixed number of rows for each
anchor and positive, and no anchor's scores of all rows are ever in one place.

Defined results: rows with a null id, a null label, a null or empty vector, or a null or non-finite component take no part; only vectors of equal length
are compared. With each_row, as op13_hard_negatives has it, every row counts, also where its id, label or vector repeats: a row that stands m times is m anchors,
m positives or m negatives, and an anchor leaves out itself alone. Such rows travel once, with their number. Without each_row, rows that are equal in id, label and vector
are one row; rows with the anchor's own id are neither its positives nor its negatives; an anchor id that
stands with several labels or vectors is an anchor for each, and a positive or negative id that does so counts once for each distinct score. Scores are exact
integers, held to the range of a long. A negative positive_score leaves no room between the limits. Other columns are never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import grid
from .shared import table

#: Anchors whose scores are sorted together.
STEP = 64


def limits(positive: int, low: int, high: int) -> tuple[int, int]:
    """The least and the greatest negative score with low * positive <= 100 * negative <= high * positive."""
    return -((-low * positive) // 100), high * positive // 100


def _sorted_rows(anchors: pa.Table, rows: pa.Table, each: int):
    """(row of anchors, scores falling, ids, labels) of every anchor over the cell's rows of its length; ties by smaller id. With each, a row comes
    as often as it stands in the table, each times at most, without the anchor itself; with 0 it comes once, and the anchor's own id is left out."""
    labels, copies, labels_of_anchors = rows["label"].to_numpy(), rows["copies"].to_numpy(), anchors["label"].to_numpy()
    candidates = {m.shape[1]: (at, ids, m) for at, ids, m in grid.by_length(rows["vec_id"], rows["v"])}
    for own_at, own_ids, q in grid.by_length(anchors["anchor_id"], anchors["v"]):
        if q.shape[1] not in candidates:
            continue
        at, ids, v = candidates[q.shape[1]]
        x, own_labels, own_copies = grid.scaled(v), labels[at], copies[at]
        top = np.abs(x).max(axis=1, initial=0)
        for k, anchor, raw in zip(own_at, own_ids, q, strict=True):
            s = grid.scores(v, x, top, raw, grid.scaled(raw))
            order = np.argsort(~s, kind="stable")  # ids rise already; ~s falls as s rises, for the least long too
            if each:
                times = np.minimum(own_copies, each + 1)
                twins = np.arange(*np.searchsorted(ids, (anchor, anchor + 1)))
                times[twins[(own_labels[twins] == labels_of_anchors[k]) & (v[twins] == raw).all(axis=1)]] -= 1
                order = np.repeat(order, times[order])
            else:
                order = order[ids[order] != anchor]
            yield int(k), s[order], ids[order], own_labels[order]


def _distinct(scores: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Marks the first of equal (score, id) pairs, which stand side by side."""
    first = np.ones(len(ids), bool)
    first[1:] = (scores[1:] != scores[:-1]) | (ids[1:] != ids[:-1])
    return first


def _positives(k: int, each_row: bool):
    def cell(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        own, keys, labels = (anchors[c].to_numpy() for c in ("anchor_id", "anchor_key", "label"))
        found = []
        for a, scores, ids, of in _sorted_rows(anchors, rows, k if each_row else 0):
            same = of == labels[a]
            scores, ids = scores[same], ids[same]
            first = np.arange(len(ids))[:k] if each_row else np.flatnonzero(_distinct(scores, ids))[:k]
            found += [(int(own[a]), int(keys[a]), int(i), int(s)) for i, s in zip(ids[first], scores[first], strict=True)]
        return _table(found, ["anchor_id", "anchor_key", "positive_id", "positive_score"])

    return cell


def _negatives(k: int, low: int, high: int, each_row: bool):
    def cell(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        own, keys, labels, copies = (anchors[c].to_numpy() for c in ("anchor_id", "anchor_key", "label", "copies"))
        positives, found = anchors["positives"], []
        for a, scores, ids, of in _sorted_rows(anchors, rows, k if each_row else 0):
            other = of != labels[a]
            scores, ids = scores[other], ids[other]
            if not each_row:
                first = _distinct(scores, ids)
                scores, ids = scores[first], ids[first]
            for p in positives[a].as_py():
                least, most = (grid.held(x) for x in limits(p["positive_score"], low, high))
                start = int(np.searchsorted(~scores, ~np.int64(most), "left"))  # the first score that isn't above the upper limit
                for i, s in zip(ids[start : start + k], scores[start : start + k], strict=True):
                    if s >= least:
                        found.append((int(own[a]), int(keys[a]), int(copies[a]), p["n"], p["positive_id"], p["positive_score"], int(i), int(s)))
        return _table(found, ["anchor_id", "anchor_key", "copies", "n", "positive_id", "positive_score", "negative_id", "negative_score"])

    return cell


def _table(rows: list[tuple], names: list[str]) -> pa.Table:
    return pa.table([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * len(names))], names)


def mine(
    vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, block_bytes: int = grid.BLOCK_BYTES, each_row: bool = False
) -> DataFrame:
    """anchor_id, positive_id, rank from 1, negative_id, positive_score, negative_score: for each anchor and each of its first positives the first
    negatives with low * positive_score <= 100 * negative_score <= high * positive_score. vectors has vec_id, embedding, label; is_anchor is a condition on vec_id;
    each_row counts every row, also where ids, labels or vectors repeat."""
    rows = grid.taking_part(vectors.filter("label is not null"), F.col("label").cast("long").alias("label"))
    rows = rows.groupBy("vec_id", "v", "label").agg(F.count(F.lit(1)).alias("copies"))
    if not each_row:
        rows = rows.withColumn("copies", F.lit(1).cast("long"))
    anchors = rows.filter(is_anchor).select(F.col("vec_id").alias("anchor_id"), F.xxhash64("label", "v").alias("anchor_key"), "label", "v", "copies")
    by = ["anchor_id", "anchor_key"]
    found = grid.meet(anchors, rows, _positives(positives, each_row), "anchor_id long, anchor_key long, positive_id long, positive_score long", block_bytes)
    first = Window.partitionBy(*by).orderBy(F.desc("positive_score"), "positive_id")
    found = (found if each_row else found.distinct()).withColumn("n", F.row_number().over(first)).filter(F.col("n") <= positives)
    found = found.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("n", "positive_id", "positive_score"))).alias("positives"))
    with_positives = anchors.join(found, by)
    columns = "anchor_id long, anchor_key long, copies long, n long, positive_id long, positive_score long, negative_id long, negative_score long"
    met = grid.meet(with_positives, rows, _negatives(negatives, low, high, each_row), columns, block_bytes)
    order = Window.partitionBy(*by, "n").orderBy(F.desc("negative_score"), "negative_id")
    ranked = (met if each_row else met.distinct()).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    if each_row:
        ranked = ranked.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return mine(rows.select("vec_id", "embedding", moved.alias("label")), F.col("vec_id") % 50 == 0, each_row=True)


OP13_SQL = """
with e as (
  select distinct vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end lab, list_transform(embedding, lambda v: floor(256 * v::double)::bigint) x from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda v: v is null or not isfinite(v))) = 0),
s as (
  select a.vec_id anchor_id, c.vec_id, a.lab = c.lab same, list_sum(list_transform(range(1, len(a.x) + 1), lambda i: a.x[i] * c.x[i]))::bigint score
  from e a join e c on a.vec_id <> c.vec_id and len(a.x) = len(c.x) where a.vec_id % 50 = 0),
p as (
  select anchor_id, vec_id positive_id, score positive_score from s where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select anchor_id, positive_id, (row_number() over (partition by anchor_id, positive_id order by score desc, vec_id))::int as rank, vec_id negative_id, positive_score, score negative_score
from p join s using (anchor_id) where not same and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score
qualify row_number() over (partition by anchor_id, positive_id order by score desc, vec_id) <= 3
"""

QUERIES = {"op13_hard_negatives": op13_hard_negatives}
SQL = {"op13_hard_negatives": OP13_SQL}
