"""Reports, gates, rechecked status and photos on small tables with nulls, repeats and empty input."""

import pytest
from pyspark.sql import functions as F

from stallwise.operators import buy, reports, splits, state


def test_profit_and_gate(spark):
    df = spark.createDataFrame([("10", "25.5"), (None, "3"), ("x", "4"), ("7", None)], "paid string, sold string")
    assert [r[0] for r in df.select(reports.profit(F.col("paid"), F.col("sold"))).collect()] == [15.5, 0.0, 0.0, 0.0]
    rows = spark.createDataFrame([(1, "true", None, "31"), (2, None, None, "90"), (3, "false", "1", "30"), (4, "false", "true", "30.5"), (5, "true", "true", None)], "id int, a string, b string, price string")
    assert sorted(r["id"] for r in reports.any_pass(rows, ["a", "b"], "price").collect()) == [1, 4]
    assert reports.any_pass(rows, [], "price").count() == 0


def test_apply_status(spark):
    rows = [(1, "On Sale", 10.0), (2, "Sold", 20.0), (3, None, 30.0), (4, "On Sale", 40.0)]
    df = spark.createDataFrame(rows, "item int, market_status string, price double")
    none = {"last_check_status": "string", "upload_date": "string", "upload_days": "double", "observed_price": "double", "previous_price": "double", "price_changed": "boolean"}
    df = df.select("*", *[F.lit(None).cast(t).alias(n) for n, t in none.items()])
    found = spark.createDataFrame([(1, "Sold", "2 giorni fa", 8.0, 10.0, True), (2, "OnSale", None, 19.0, None, False), (3, "OnSale", "Unknown", None, None, None), (9, "Sold", None, 1.0, None, None)], "item int, status string, upload_date string, page_price double, previous_price double, price_changed boolean")
    out, sold = reports.apply_status(df, found, "item")
    got = {r["item"]: r for r in out.collect()}
    assert [r["item"] for r in sold.collect()] == [1] and out.columns == df.columns
    assert (got[1]["market_status"], got[1]["price"], got[1]["upload_days"], got[1]["previous_price"], got[1]["price_changed"]) == ("Sold", 8.0, 2.0, 10.0, True)
    assert (got[2]["market_status"], got[2]["last_check_status"], got[2]["price"]) == ("Sold", None, 20.0)
    assert (got[3]["market_status"], got[3]["last_check_status"], got[3]["upload_date"], got[3]["price_changed"]) == (None, "OnSale", None, False)
    assert got[4]["last_check_status"] is None and got[4]["price_changed"] is None
    again = {r["item"]: r for r in reports.apply_status(df, found, "item", recheck=True)[0].collect()}
    assert again[2]["market_status"] == "On Sale" and again[2]["observed_price"] == 19.0


def test_comparison_leaves_out_columns_that_the_other_lacks(spark):
    own = spark.createDataFrame([("a", "x", 3, 0.5), ("b", "x", 4, 0.6)], "search string, approach string, n int, auc double")
    other = spark.createDataFrame([("a", "x", 1)], "search string, approach string, n int")
    out = reports.comparison(own, other, ["search", "approach"], ["n", "auc"], {"n": "delta", "auc": "auc_delta"})
    assert out.columns == ["search", "approach", "n_per_search", "auc", "n_global", "delta"]
    assert sorted((r["search"], r["delta"]) for r in out.collect()) == [("a", 2), ("b", None)]


def test_identity_rollup(spark):
    rows = [(1, "t1", "web", "a", "true", "false"), (2, "t2", "web", "b", "false", "true"), (3, "t3", "web", "a", "true", None), (4, "t0", None, None, None, None), (5, "t9", "", "", "true", "true")]
    df = spark.createDataFrame(rows, "n int, ts string, transport string, ip string, ok string, changed string")
    got = {r["transport"]: r for r in reports.identity_rollup(df, "transport", "ip", "ok", "changed", "n", "ts").collect()}
    assert (got["web"]["events"], got["web"]["successful_events"], got["web"]["change_events"], got["web"]["unique_addresses"], got["web"]["addresses"]) == (3, 2, 1, 2, {"a": 2, "b": 1})
    assert (got["web"]["first_ts"], got["web"]["last_ts"]) == ("t1", "t3") and (got["unknown"]["events"], got["unknown"]["first_ts"], got["unknown"]["last_ts"], got["unknown"]["addresses"]) == (2, "t0", "t9", {})


@pytest.mark.parametrize(("search", "title", "want"), [("PS4", "gucci bag", 0.7), ("ps4", "x", 0.6), ("borse ", "x", 0.52), (None, None, 0.55), ("borse", "Hermes", 0.52)])
def test_minimum_score(spark, search, title, want):
    df = spark.createDataFrame([(search, title)], "s string, t string")
    assert df.select(buy.minimum_score(F.col("s"), F.col("t"), 0.55, {"luxury": 0.7, "game": 0.6, "borse": 0.52})).first()[0] == want


def brute_visual(shots, search, title):
    """As a listing's photos are judged one after the other."""
    held = lambda x: min(max(x, 0.0), 1.0)
    if not shots:
        return 0.45, 0.08, 0, "no_images"
    good = [s for s in shots[:6] if s[1] is not None]
    if not good:
        return 0.40, 0.10, 0, "all_images_failed"
    kept, notes = [], {n for s in good for n in s[3].split(";") if n} | ({"image_fetch_failed"} if len(good) < len(shots[:6]) else set())
    for bits, *_ in good:
        if all(sum(x != y for x, y in zip(bits, k, strict=True)) > 4 for k in kept):
            kept.append(bits)
    n, dup = len(good), (len(good) - len(kept)) / len(good)
    low, shot = sum(s[1] < 0.45 for s in good) / n, sum(s[2] > 0 for s in good) / n
    weighted = good[0][1] if n == 1 else 0.55 * good[0][1] + sum(s[1] * 0.45 / (n - 1) for s in good[1:])
    both = f"{search} {title}".lower()
    luxury, game = "prada" in both, "ps4" in both
    target = 4.0 if luxury else 2.0 if game else 3.0
    complete, quality = held(0.65 * held(len(kept) / target) + 0.35 * (1 - dup)), held(weighted - 0.2 * dup)
    consistent = held(0.58 + 0.22 * quality + 0.2 * (1 - shot))
    authentic = held(0.45 * complete + 0.35 * quality + 0.2 * consistent) if luxury else held(0.4 + 0.35 * complete + 0.25 * consistent)
    risk = 0.2 * (1 - quality) + 0.12 * (1 - complete) + 0.1 * (1 - consistent) + (0.12 if luxury else 0.06) * (1 - authentic) + 0.1 * dup + 0.08 * shot
    for test, note in ((luxury and authentic < 0.45, "low_authenticity_evidence"), (dup >= 0.5, "duplicate_images"), (len(kept) < target, "limited_visual_coverage"), (low >= 0.5, "mostly_low_quality_images")):
        notes |= {note} if test else set()
    return held(0.36 * quality + 0.24 * complete + 0.2 * consistent + 0.2 * authentic), min(risk, 0.55), len(kept), "|".join(sorted(notes))


def test_visual_summary(spark):
    bits = lambda n: "1" * n + "0" * (64 - n)
    items = {
        1: ("prada", "x", [(bits(0), 0.9, 0.0, ""), (bits(3), 0.4, 0.22, "blurry"), (bits(30), 0.7, 0.0, "")]),
        2: ("lamp", None, [(bits(5), 0.3, 0.22, "blurry;low_contrast")]),
        3: ("ps4", "y", [(bits(4 * k), 0.5, 0.0, "") for k in range(9)]),
        4: ("lamp", "y", [(None, None, None, None), (None, None, None, None)]),
        5: ("Prada", "z", [(bits(0), 0.1, 0.22, ""), (bits(1), 0.1, 0.22, ""), (None, None, None, None)]),
        6: ("lamp", "z", []),
    }
    rows = [(i, p, s, t, *shot) for i, (s, t, shots) in items.items() for p, shot in (enumerate(shots) if shots else [(None, (None, None, None, None))])]
    df = spark.createDataFrame(rows, "item int, pos int, search string, title string, hash_value string, quality_score double, screenshot_risk double, photo_notes string")
    got = {r["item"]: (r["visual"], r["visual_penalty"], r["unique_images"], r["visual_notes"]) for r in buy.visual_summary(df, "item", "pos", "search", "title").collect()}
    for i, (search, title, shots) in items.items():
        want = brute_visual(shots, search, title)
        assert got[i][0] == pytest.approx(want[0]) and got[i][1] == pytest.approx(want[1]) and got[i][2:] == want[2:], i
    assert buy.visual_summary(df.limit(0), "item", "pos", "search", "title").count() == 0


def test_ranks_by_pieces_are_whole(spark):
    df = spark.range(5000).select(F.col("id").alias("k"), F.when(F.col("id") % 10 > 0, F.col("id") % 3).alias("g"))
    ranks = splits.hash_ranked(df, ["g"], "k", 1).groupBy("g").agg(F.countDistinct("__r").alias("d"), F.max("__r").alias("top"), F.max("__n").alias("n"), F.count("*").alias("rows")).collect()
    assert len(ranks) == 4 and all(r["d"] == r["top"] == r["n"] == r["rows"] for r in ranks)
    assert splits.hash_ranked(df.limit(0), ["g"], "k", 1).count() == 0
    kept, moved = state.overflow(df.withColumn("t", F.timestamp_seconds(F.col("k") * 977)), 4990, "t", "k")
    assert kept.count() == 4990 and sorted(r["k"] for r in moved.collect()) == list(range(10))
    kept, moved = state.overflow(df.withColumn("t", F.timestamp_seconds("k")), 6000, "t", "k")
    assert kept.count() == 5000 and moved.count() == 0
