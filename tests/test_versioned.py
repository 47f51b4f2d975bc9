"""Writers of one table at once, transitions, and versions."""

from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from stallwise.sources.versioned import Conflict, VersionedTable


def make(spark, path, **more):
    return VersionedTable(spark, str(path), spark.createDataFrame([], "cache_key string, status string, price double").schema, **more)


def test_two_writers_lose_nothing(spark, tmp_path):
    """Four writers add, update and remove their own keys at once."""
    rows = lambda w, n: spark.createDataFrame([(f"{w}-{k}", "recommended", None) for k in range(n)], "cache_key string, status string, price double")

    def write(w):
        t = make(spark, tmp_path)
        for k in range(1, 4):
            t.add(rows(w, k))
        t.update(spark.createDataFrame([(f"{w}-0", float(w)), ("nobody", 1.0)], "cache_key string, price double").withColumn("unknown", F.lit(1)))
        t.remove(spark.createDataFrame([(f"{w}-1",)], "cache_key string"))

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(write, range(4)))
    t = make(spark, tmp_path)
    got = {r["cache_key"]: r["price"] for r in t.read().collect()}
    assert got == {f"{w}-{k}": float(w) if k == 0 else None for w in range(4) for k in (0, 2)} and t.version() == 20
    assert t.read(0).count() == 0 and t.read(1).count() == 1
    t.vacuum(2)
    assert t.version() == 20 and t.read().count() == 8 and len(list((tmp_path / "data").iterdir())) == 2


def test_transitions(spark, tmp_path):
    t = make(spark, tmp_path, allowed={"recommended": {"bought", "skipped"}, "bought": {"listed"}, "listed": {"sold"}})
    t.add(spark.createDataFrame([("a", "recommended", None), ("b", "listed", 5.0), ("c", None, None)], "cache_key string, status string, price double"))
    t.transition(spark.createDataFrame([("a", 9.0), ("b", 1.0), ("c", 2.0), ("x", 3.0)], "cache_key string, price double"), "bought")
    assert {r["cache_key"]: (r["status"], r["price"]) for r in t.read().collect()} == {"a": ("bought", 9.0), "b": ("listed", 5.0), "c": (None, None)}
    t.transition(spark.createDataFrame([("b",)], "cache_key string"), "sold")
    t.transition(spark.createDataFrame([("b",)], "cache_key string"), "no such status")
    assert {r["cache_key"]: r["status"] for r in t.read().collect()}["b"] == "sold"
    free = make(spark, tmp_path)
    free.transition(spark.createDataFrame([("b",)], "cache_key string"), "recommended")
    assert {r["cache_key"]: r["status"] for r in t.read().collect()}["b"] == "recommended"


def test_conflict_is_told(spark, tmp_path):
    t = make(spark, tmp_path)
    one = spark.createDataFrame([("a", "s", 1.0)], "cache_key string, status string, price double")

    def change(df):  # another writer is always first
        make(spark, tmp_path).commit(lambda d: d.unionByName(one))
        return df

    with pytest.raises(Conflict):
        t.commit(change, tries=2)
    assert t.read().count() == 2 and len(list((tmp_path / "data").iterdir())) == 2
