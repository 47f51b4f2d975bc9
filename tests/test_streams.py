"""Streams give what their batch forms give."""

import collections
import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from stallwise.operators import outcomes
from stallwise.streaming import incremental, streams


def drained(spark, stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def test_outcome_fold_matches_batch(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(k, t0 + dt.timedelta(hours=h), s) for k in (1, 2) for h, s in ((0, "active"), (1.1 * k, "active"), (3.0, "sold"))]
    rows += [(3, t0, "active"), (3, t0 + dt.timedelta(hours=1.5), "sold")]  # too late for the first horizon, in time for the others
    df = spark.createDataFrame(rows, "k int, at timestamp, status string")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = streams.source(spark, str(tmp_path / "in"), df.schema)
    got = {(r["key"], r["hours"]): r["sold"] for r in drained(spark, streams.outcome_fold(stream, "k", "at", "status", horizons=(1, 2, 12)), "fold")}
    batch = outcomes.fold(df.withColumn("first", F.lit(t0)), "k", "first", "at", F.col("status") == "sold", (1, 2, 12))
    assert got == {(r["k"], r["hours"]): r["sold"] for r in batch.filter("evaluated_at is not null").collect()} and got[3, 1] is None


def test_first_seen_and_upsert(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([("a", t0, 1), ("a", t0 + dt.timedelta(hours=1), 2), ("b", t0, 3)], "k string, ts timestamp, v int")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = streams.source(spark, str(tmp_path / "in"), df.schema)
    assert sorted(r["k"] for r in drained(spark, streams.first_seen(stream, ["k"], "ts"), "seen")) == ["a", "b"]
    q = streams.source(spark, str(tmp_path / "in"), df.schema).writeStream.foreachBatch(streams.upserting(str(tmp_path / "state"), ["k"], "ts")).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    assert {r["k"]: r["v"] for r in spark.read.parquet(str(tmp_path / "state")).collect()} == {"a": 2, "b": 3}


def incoming():
    """Listings of two blocks; some new to all products, some without price or words."""
    rng = np.random.default_rng(2)
    rows = []
    for i in range(90):
        block = "ab"[i % 2]
        colour, kind = ["red", "blue", "green"][int(rng.integers(3))], ["zoom", "walk"][int(rng.integers(2))]
        words = ["air", kind, colour] if i % 11 else ["quite", "another", "thing"]
        price = None if i % 17 == 0 else float(np.exp(rng.normal(3 + (colour == "red"), 0.3)))
        rows.append((block, i, incremental.hashed(words[:2]).tolist(), words, price, " ".join(words), "Nike", 1 + i % 4))
    rows.append(("c", 200, incremental.hashed(["air"]).tolist(), ["air"], 5.0, "air", None, 1))
    return rows


SCHEMA = "block string, item long, v array<double>, words array<string>, price double, title string, brand string, seen long"


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set(key, before)


def test_incremental_products_and_variants(rocks, tmp_path):
    """A stream of three batches gives what one replay of all rows gives, and its scores are those of the batch columns."""
    spark, rows = rocks, incoming()
    index = [(b, 10 * k + p, incremental.hashed(["air", kind]).tolist(), 5, 0.24, ["air", kind]) for k, b in enumerate("ab") for p, kind in enumerate(["zoom", "walk"])]
    products = spark.createDataFrame(index, "block string, product long, centroid array<double>, n long, threshold double, core array<string>")
    for k in range(3):
        spark.createDataFrame(rows[k * 31 : k * 31 + 31], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = streams.source(spark, str(tmp_path / "in"), spark.createDataFrame([], SCHEMA).schema, files=1)
    got = {r["item"]: r for r in drained(spark, incremental.scored_listings(incremental.assigned(stream, products, "item"), "title", "brand", "seen"), "variants")}
    blocks, want = collections.defaultdict(incremental.Block), {}
    for b, p, v, n, t, core in index:
        blocks[b].products[p] = incremental.Product(np.array(v), n, t, core)
    for b, i, v, words, price, *_ in rows:
        want[i] = blocks[b].take(np.array(v), words, float("nan") if price is None else price)
    names = [c.split(" ")[0] for c in incremental.OUT.split(", ")]
    assert set(got) == set(want)
    for i, w in want.items():
        for name, x in zip(names, w, strict=True):
            assert got[i][name] == (pytest.approx(x) if isinstance(x, float) else x), (i, name)
    kept = [r for r in got.values() if r["product"] >= 0]
    assert len(kept) > 60 and {got[i]["product"] for i in range(0, 90, 11)} == {-1} and got[200]["product"] == -1 and len({(r["product"], r["variant"]) for r in kept}) > 4
    for r in got.values():  # the own price is in before the statistics
        first = r["product"] < 0 or r["n"] == 1
        assert (r["z"] is None) == (first or r["priced"] < 3 or r["price"] is None)
        if r["z"] is not None:
            assert r["z"] == pytest.approx((r["med"] - r["price"]) / (1.4826 * r["mad"] + 1e-6))


def test_price_buffers_are_bounded():
    block = incremental.Block()
    block.products[0] = incremental.Product(incremental.hashed(["x"]), 1, 0.24, ["x"])
    for k in range(500):
        out = block.take(incremental.hashed(["x"]), ["x"], 10.0 + k / 1000)
    assert out[:2] == (0, 0) and out[5:7] == (500, incremental.BUFFER) and out[7] == pytest.approx(10.3995)


def test_upserting_rewrites_only_its_buckets(spark, tmp_path):
    t0, path = dt.datetime(2024, 1, 1), str(tmp_path / "table")
    run = streams.upserting(path, ["k"], "ts", 8)
    make = lambda rows: spark.createDataFrame([(k, t0 + dt.timedelta(hours=h), v) for k, h, v in rows], "k string, ts timestamp, v int")
    run(make([(f"k{i}", 0, i) for i in range(40)]), 0)
    before = {f.name for f in tmp_path.glob("table/*/*.parquet")}
    for _ in range(2):  # again, as after a failure
        run(make([("k3", 1, 99), ("k4", -1, 98), ("new", 0, 1)]), 1)
    after = {f.name for f in tmp_path.glob("table/*/*.parquet")}
    got = {r["k"]: r["v"] for r in spark.read.parquet(path).collect()}
    assert got == {f"k{i}": i for i in range(40)} | {"k3": 99, "new": 1} and before & after
    run(make([]), 2)
