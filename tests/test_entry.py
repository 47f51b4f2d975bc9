"""Every query with SQL gives the SQL's rows on the smallest tables; all others run."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from stallwise.plans import registry

DATA = "/root/testdata/sf0.001"


def shaped(df):
    def one(v):
        if v is None or (isinstance(v, float) and math.isnan(v)) or str(v) in ("NaT", "<NA>", "nan"):
            return "~"
        if isinstance(v, bool) or str(v) in ("True", "False"):
            return str(v)
        try:
            return f"{float(v):.9g}"
        except (TypeError, ValueError):
            return str(v)

    df = df[sorted(df.columns)]
    return sorted(tuple(map(one, r)) for r in df.itertuples(index=False))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    return c


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_matches_sql(spark, con, name):
    assert shaped(registry.QUERIES[name](spark, DATA).toPandas()) == shaped(con.execute(registry.SQL[name]).df())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
