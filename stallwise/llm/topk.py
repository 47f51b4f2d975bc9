"""Exact top-k search by inner product with Fagin's threshold algorithm.

Candidates are cut into blocks. In a block every dimension has its list of rows sorted by value; for a query the lists
are walked in parallel, downwards where the query's component is positive and upwards where it is negative, a growing
depth at a time. A row that is met for the first time is scored exactly. The walk ends when the bound, the score of a
row that would stand at the current depth in every list, is below the k-th best score so far (an equal bound could
still hide a tie with a smaller id), or when every row has been met. The k-th best score carries over from block to
block of a cell, so later blocks stop earlier. Each cell passes on k rows a query, which a window ranks.

Queries are a stated set, dealt with the candidates over the cells of a grid (``grid.meet``): nothing goes through the driver.

Defined results: components are floor(256 * x) of x as double; vectors that are null, empty or hold null or non-finite
components take no part, neither as queries nor as candidates; only vectors of equal length are compared; rows with the query's own id aren't
candidates; a repeated candidate id counts once for each distinct score, a repeated query once for each distinct vector;
null ids take no part. Scores are exact integers, held to the range of a long, also where 256 * x exceeds a double.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import grid
from .shared import table

#: Rows of a block; its sorted lists take 12 bytes a row and dimension.
BLOCK_ROWS = 8192
FIRST_DEPTH = 8


class Block:
    """Candidates of one length with their sorted lists; v holds the raw components."""

    def __init__(self, ids: np.ndarray, v: np.ndarray):
        self.ids, self.v, self.x = ids, v, grid.scaled(v)
        self.order = np.argsort(self.x, axis=0, kind="stable").astype(np.int32)  # column d: rows by rising x[:, d]
        self.lists = np.take_along_axis(self.x, self.order, axis=0)
        self.tops = np.abs(self.x).max(axis=1, initial=0)
        self.top = float(self.tops.max(initial=0))

    def scores(self, q: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return grid.scores(self.v[rows], self.x[rows], self.tops[rows], q, grid.scaled(q))

    def bound(self, qx: np.ndarray, at: np.ndarray) -> float:
        """What no row that stands beyond these list values can exceed: exact where scores are, else raised by more than float64 can err."""
        with np.errstate(all="ignore"):
            if self.top * float(np.abs(qx).max(initial=0)) * len(qx) < 2.0**53:
                return float(qx @ at)
            bound = float(qx @ at) + float(np.abs(qx) @ np.abs(at)) * len(qx) * 2.0**-50 + 1
        return bound if np.isfinite(bound) else float("inf")

    def search(self, own: int, q: np.ndarray, k: int, best: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """q: raw components. best: (-score, id) pairs in order, k at most, from earlier blocks; returns them with this block's."""
        n, seen, depth, reached = len(self.ids), np.zeros(len(self.ids), bool), FIRST_DEPTH, 0
        qx = grid.scaled(q)
        up, down = np.flatnonzero(qx < 0), np.flatnonzero(qx >= 0)
        while reached < n:
            depth = min(depth, n)
            met = np.zeros(n, bool)
            met[self.order[reached:depth, up]] = True
            met[self.order[n - depth : n - reached, down]] = True
            fresh = np.flatnonzero(met & ~seen)
            seen |= met
            fresh_ids = fresh[self.ids[fresh] != own]
            if len(fresh_ids):
                s = self.scores(q, fresh_ids)
                if len(s) > 4 * k and len(best) >= k:
                    keep = s >= -best[k - 1][0]
                    s, fresh_ids = s[keep], fresh_ids[keep]
                if len(s) > k:
                    part = np.lexsort((self.ids[fresh_ids], ~s))  # ~s falls as s rises, and unlike -s holds for the least long too
                    ids, s = self.ids[fresh_ids][part], s[part]
                    other = np.ones(len(s), bool)  # repeated (score, id) pairs stand side by side
                    other[1:] = (s[1:] != s[:-1]) | (ids[1:] != ids[:-1])
                    best = sorted({*best, *((-int(a), int(b)) for a, b in zip(s[other][:k], ids[other][:k], strict=True))})
                else:
                    best = sorted({*best, *((-int(a), int(b)) for a, b in zip(s, self.ids[fresh_ids], strict=True))})
                best = best[:k]
            reached, depth = depth, depth * 2
            if reached < n and len(best) >= k:
                if self.bound(qx, np.where(qx < 0, self.lists[reached - 1], self.lists[n - reached])) < -best[k - 1][0]:
                    break
            if seen.all():
                break
        return best


def _cell(k: int):
    """The k best rows of a cell for each of its queries."""

    def search(queries: pa.Table, rows: pa.Table) -> pa.Table:
        found: list[tuple[int, int, int, int]] = []
        candidates = {m.shape[1]: (ids, m) for _, ids, m in grid.by_length(rows["vec_id"], rows["v"])}
        for at, ids, q in grid.by_length(queries["query_id"], queries["v"]):
            best: list[list[tuple[int, int]]] = [[] for _ in ids]
            own, m = candidates.get(q.shape[1], (np.zeros(0, np.int64), q[:0]))
            for a in range(0, len(own), BLOCK_ROWS):
                block = Block(own[a : a + BLOCK_ROWS], m[a : a + BLOCK_ROWS])
                best = [block.search(int(i), x, k, b) for i, x, b in zip(ids, q, best, strict=True)]
            keys = queries["query_key"].to_numpy()[at]
            found += [(int(i), int(key), b, -s) for i, key, pairs in zip(ids, keys, best, strict=True) for s, b in pairs]
        return pa.table([pa.array(c, pa.int64()) for c in (zip(*found, strict=True) if found else [[]] * 4)], ["query_id", "query_key", "vec_id", "score"])

    return search


def top_k(vectors: DataFrame, is_query, k: int = 5, block_bytes: int = grid.BLOCK_BYTES) -> DataFrame:
    """The k best candidates of every query: query_id, rank from 1, vec_id, score; ties go to the smaller vec_id. is_query is a condition on vec_id."""
    rows = grid.taking_part(vectors).distinct()
    queries = rows.filter(is_query).select(F.col("vec_id").alias("query_id"), F.xxhash64("v").alias("query_key"), "v").dropDuplicates(["query_id", "query_key"])
    found = grid.meet(queries, rows, _cell(k), "query_id long, query_key long, vec_id long, score long", block_bytes)
    order = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id")
    best = found.distinct().withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")


def op5_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)


OP5_SQL = """
with e as (
  select vec_id, list_transform(embedding, lambda v: floor(256 * v::double)::bigint) x from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda v: v is null or not isfinite(v))) = 0),
s as (
  select q.vec_id query_id, c.vec_id, list_sum(list_transform(range(1, len(q.x) + 1), lambda i: q.x[i] * c.x[i]))::bigint score
  from e q join e c on q.vec_id <> c.vec_id and len(q.x) = len(c.x) where q.vec_id % 50 = 0)
select query_id, rank::int as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) rank from s) where rank <= 5
"""

QUERIES = {"op5_topk_search": op5_topk_search}
SQL = {"op5_topk_search": OP5_SQL}
