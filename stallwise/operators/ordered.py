"""Ranks, running sums and exact quantiles of groups of any size: no task sorts a whole group.

All rows are put in one order, by group first and then by the caller's keys, and this order is cut into pieces by bounds of a sample. A piece's offset in its group
comes from the pieces' totals, a table of at most one row for each group and piece; only within a piece are rows sorted. Bounds decide how even
the pieces are, never the result. Rows that are equal in all keys stay in one piece, so the keys should end in a column that tells rows apart.

Nulls come last whatever the direction; a null group is a group.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a piece, in the mean; sampled keys for each piece; pieces at most.
PIECE_ROWS, SAMPLED, MOST_PIECES = 200_000, 20, 1 << 14

#: A column's name, or (name, False) for falling order.
Key = str | tuple[str, bool]


def _keys(keys: list[Key]) -> list[tuple[str, bool]]:
    return [(k, True) if isinstance(k, str) else k for k in keys]


def _ordered(keys: list[tuple[str, bool]]) -> list[Column]:
    return [F.asc_nulls_last(c) if up else F.desc_nulls_last(c) for c, up in keys]


def _before(bound: Column, keys: list[tuple[str, bool]]) -> Column:
    """Whether a bound stands before the row in the order of the keys."""
    out = F.lit(False)
    for name, up in reversed(keys):
        b, x = bound[name], F.col(name)
        less = F.coalesce(b < x if up else b > x, b.isNotNull() & x.isNull())
        out = less | (b.eqNullSafe(x) & out)
    return out


def pieces(df: DataFrame, by: list[str], order: list[Key], name: str = "__piece", rows: int | None = None) -> DataFrame:
    """df with the number of each row's piece; numbers rise in the order of (by, order). rows: of a piece."""
    n, wanted = df.count(), rows or PIECE_ROWS
    k = min(MOST_PIECES, math.ceil(n / wanted))
    if k <= 1:
        return df.withColumn(name, F.lit(0))
    keys = [*((c, True) for c in by), *_keys(order)]
    cols = [c for c, _ in keys]
    sampled = df.select(*cols).sample(min(1.0, SAMPLED * k / n), seed=7).orderBy(*_ordered(keys)).collect()
    bounds = [sampled[round(i * (len(sampled) - 1) / k)] for i in range(1, k)] if sampled else []
    if not bounds:
        return df.withColumn(name, F.lit(0))
    kinds = {f.name: f.dataType for f in df.schema.fields}
    one = lambda r: F.struct(*[F.lit(r[c]).cast(kinds[c]).alias(c) for c in cols])
    step = math.isqrt(len(bounds)) + 1  # first among every step-th bound, then among those between two of them
    chunks = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    below = lambda found: F.size(F.filter(found, lambda b: _before(b, keys)))
    coarse = below(F.array(*[one(c[-1]) for c in chunks]))
    fine = F.get(F.array(*[F.array(*map(one, c)) for c in chunks]), coarse)
    return df.withColumn(name, coarse * step + F.coalesce(below(fine), F.lit(0)))


def running(df: DataFrame, by: list[str], order: list[Key], sums: dict[str, Column], totals: bool = False, rows: int | None = None) -> DataFrame:
    """df with, for each name in sums, its column's sum over the rows of the group up to this one; with totals also name_all, over the whole group.

    A null counts as 0.
    """
    cut = pieces(df.select("*", *[F.coalesce(x, F.lit(0)).alias(f"__x_{n}") for n, x in sums.items()]), by, order, rows=rows)
    each = cut.groupBy(*by, "__piece").agg(*[F.sum(f"__x_{n}").alias(f"__s_{n}") for n in sums])
    group = Window.partitionBy(*(by or [F.lit(1)]))
    below = group.orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    names = [*by, "__piece"]
    offsets = each.select(
        *[F.col(c).alias(f"__k{i}") for i, c in enumerate(names)], *[F.coalesce(F.sum(f"__s_{n}").over(below), F.lit(0)).alias(f"__o_{n}") for n in sums], *[F.sum(f"__s_{n}").over(group).alias(f"__a_{n}") for n in sums if totals]
    )
    inside = Window.partitionBy(*names).orderBy(*_ordered(_keys(order))).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = cut.select("*", *[F.sum(f"__x_{n}").over(inside).alias(f"__r_{n}") for n in sums])
    out = local.join(offsets, [F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(names)])
    more = [F.col(f"__a_{n}").alias(f"{n}_all") for n in sums if totals]
    return out.select(*[F.col(c) for c in df.columns], *[(F.col(f"__o_{n}") + F.col(f"__r_{n}")).alias(n) for n in sums], *more)


def ranked(df: DataFrame, by: list[str], order: list[Key], rank: str = "__r", size: str = "__n", rows: int | None = None) -> DataFrame:
    """df with each row's rank from 1 in its group and the group's number of rows."""
    out = running(df, by, order, {rank: F.lit(1).cast("long")}, totals=True, rows=rows)
    return out.withColumnRenamed(f"{rank}_all", size)


def quantiles(df: DataFrame, by: list[str], x: Column, ps: list[float], name: str = "q", rows: int | None = None) -> DataFrame:
    """One row for each group: an array of the exact quantiles of x at ps, linear between neighbours; null where the group has no value.

    Equal values are counted first. Then only pieces that hold a wanted rank are sorted.
    """
    groups = df.select(*by).distinct() if by else None
    values = df.select(*by, x.cast("double").alias("__x")).filter("__x is not null").groupBy(*by, "__x").agg(F.count(F.lit(1)).alias("__c"))
    cut = pieces(values, by, ["__x"], rows=rows)
    group = Window.partitionBy(*(by or [F.lit(1)]))
    sizes = cut.groupBy(*by, "__piece").agg(F.sum("__c").alias("__n"))
    upto = F.sum("__n").over(group.orderBy("__piece").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    places = F.array(*[F.lit(float(p)) * (F.sum("__n").over(group) - 1) for p in ps])
    sizes = sizes.select(*by, "__piece", (upto - F.col("__n")).alias("__o"), upto.alias("__u"), places.alias("__at"))
    wanted = F.array_distinct(F.flatten(F.transform("__at", lambda a: F.array(F.floor(a), F.ceil(a)))))
    sizes = sizes.withColumn("__w", F.filter(wanted, lambda r: (r >= F.col("__o")) & (r < F.col("__u")))).filter(F.size("__w") > 0)
    names = [*by, "__piece"]
    held = sizes.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(names)], "__o", "__at", "__w")
    local = cut.join(held, [F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(names)])
    end = F.col("__o") + F.sum("__c").over(Window.partitionBy(*names).orderBy("__x").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = local.withColumn("__end", end).withColumn("__r", F.explode(F.filter("__w", lambda r: (r >= F.col("__end") - F.col("__c")) & (r < F.col("__end")))))
    found = local.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("__r", "__x"))).alias("__v"), F.first("__at").alias("__at"))  # two ranks for each of ps at most

    def between(a: Column) -> Column:
        low, high = F.floor(a), F.ceil(a)
        below, above = F.element_at("__v", low), F.element_at("__v", high)
        return F.when((low == high) | (below == above), below).otherwise((high - a) * below + (a - low) * above)

    out = found.select(*by, F.transform("__at", between).alias(name))
    if groups is None:
        return out.agg(F.first(name).alias(name))  # one row also of an empty frame
    return groups.join(out.select(*[F.col(c).alias(f"__g{i}") for i, c in enumerate(by)], name), [F.col(c).eqNullSafe(F.col(f"__g{i}")) for i, c in enumerate(by)], "left").select(*by, name)
