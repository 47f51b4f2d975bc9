"""Vectors of whole numbers, and a grid in which every query meets every row.

Rows and queries are dealt into blocks of a measured size by a hash of all they hold, so that repeated ids don't make a large block; a cell is one
block of queries and one of rows, brought together by a cogroup on the executors. Neither the driver nor any task holds more than a cell, whatever
the numbers of rows and queries.

A component x counts as floor(256 * x), x as double. Scores are exact integers: float64 products while these stay below 2^53, Python integers
beyond (also where 256 * x exceeds a double), held to the range of a long.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE = 256
#: Bytes of vectors in a block.
BLOCK_BYTES = 32 << 20
#: Rows that are worth a block of their own while there are fewer blocks than cores.
LEAST_ROWS = 1024


def taking_part(vectors: DataFrame, *more: str) -> DataFrame:
    """vec_id, v (the components as doubles) and more: the rows with an id and a vector without null or non-finite components."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & finite
    return vectors.filter(good).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), *more)


def scaled(v: np.ndarray) -> np.ndarray:
    """floor(256 * v), infinite where a double ends."""
    with np.errstate(over="ignore"):
        return np.floor(v * SCALE)


def whole(v: np.ndarray) -> list[int]:
    """floor(256 * v) as Python integers; a double of 2^52 or more is whole already."""
    return [int(a) * SCALE if abs(a) >= 1 << 52 else math.floor(a * SCALE) for a in v.tolist()]


def held(score: int) -> int:
    return min(max(score, -(1 << 63)), (1 << 63) - 1)


def scores(v: np.ndarray, x: np.ndarray, top: np.ndarray, q: np.ndarray, qx: np.ndarray) -> np.ndarray:
    """Integer inner products of rows (raw v, scaled x, top their largest component) and one query (raw q, scaled qx)."""
    with np.errstate(all="ignore"):
        small = top * np.abs(qx).max(initial=0) * len(q) < 2.0**53  # every partial sum is then a whole number that float64 holds
        if small.all():
            return (x @ qx).astype(np.int64)
        out = np.zeros(len(v), np.int64)
        out[small] = (x[small] @ qx).astype(np.int64)
    own = whole(q)
    for k in np.flatnonzero(~small):
        out[k] = held(sum(a * b for a, b in zip(whole(v[k]), own, strict=True)))
    return out


def by_length(ids: pa.ChunkedArray, vectors: pa.ChunkedArray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row numbers, ids, matrix) for each length of vectors, rows by rising id."""
    if not len(ids):
        return []
    lists, own = vectors.combine_chunks(), ids.to_numpy()
    at, values = np.asarray(lists.offsets), np.asarray(lists.values)
    sizes, out = np.diff(at), []
    for n in np.unique(sizes):
        rows = np.flatnonzero(sizes == n)
        rows = rows[np.argsort(own[rows], kind="stable")]
        out.append((rows, own[rows], values[at[:-1][rows][:, None] + np.arange(n)]))
    return out


def blocks_of(rows: DataFrame, block_bytes: int) -> int:
    """Blocks of block_bytes at most, in the mean; as many as there are cores if each has LEAST_ROWS rows."""
    n, size = rows.agg(F.count(F.lit(1)), F.sum(F.size("v") * 8 + 64)).first()
    return max(math.ceil((size or 0) / block_bytes), min(rows.sparkSession.sparkContext.defaultParallelism, n // LEAST_ROWS), 1)


def meet(queries: DataFrame, rows: DataFrame, function: Callable[[pa.Table, pa.Table], pa.Table], schema: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """function(queries of a block, rows of a block) for every cell of the grid; both have the column v."""
    n_rows, n_queries = blocks_of(rows, block_bytes), max(1, math.ceil((queries.agg(F.sum(F.size("v") * 8 + 64)).first()[0] or 0) / block_bytes))

    def dealt(df: DataFrame, n: int) -> Column:
        return F.pmod(F.xxhash64(*df.columns), F.lit(n).cast("long"))

    def every(n: int) -> Column:
        """All blocks, of the type that dealt gives: a cogroup brings equal keys into one partition only if both sides' keys have the same types."""
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

    names = [f"row_{c}" for c in rows.columns]  # queries and rows come of one table: no column may be common to both sides
    q = queries.select("*", every(n_rows).alias("row_block")).withColumn("query_block", dealt(queries, n_queries))
    r = rows.toDF(*names).select("*", every(n_queries).alias("b"), dealt(rows.toDF(*names), n_rows).alias("a"))

    def cell(some_queries: pa.Table, some_rows: pa.Table) -> pa.Table:
        some_rows = some_rows.select(names)
        return function(some_queries, some_rows.rename_columns([c.removeprefix("row_") for c in names]))

    return q.groupBy("row_block", "query_block").cogroup(r.groupBy("a", "b")).applyInArrow(cell, schema)
