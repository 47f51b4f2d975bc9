"""Column functions on the numeric examples of the specification and on nulls, blanks and NaN."""

import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from stallwise.functions import coerce, dates, price, text
from stallwise.operators import buy


def values(spark, kind, rows, *columns):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(rows)], f"k int, v {kind}")
    return [tuple(r)[1:] if len(columns) > 1 else r[1] for r in df.select("k", *columns).orderBy("k").collect()]


def test_prices(spark):
    raw = ["1.234,30€", "273,70€", "1.071", "1,234.30", "1234,5", "1.234.567", "1.2.34", "12,345", "abc", "", None, "€ 5"]
    assert values(spark, "string", raw, price.parse_price(F.col("v"))) == [1234.30, 273.70, 1071.0, 1234.30, 1234.5, 1234567.0, 12.34, 12345.0, None, None, None, 5.0]


def test_fee_pairs(spark):
    raw = ["x, €110.00, €116.20 include la Protezione acquisti", "12,00 € 13,30 € with Buyer Protection", "€ 7,50.", "nothing", None]
    assert values(spark, "string", raw, price.listing_price_text(F.col("v"))) == ["116.20", "13,30", "7,50", "0", "0"]


@pytest.mark.parametrize(("raw", "want", "reason"), [("1.9852", "1890.00", "separator_recovered_then_fee_inverted"), ("1.071", "1071.00", "separator_recovered"), ("578.2", "578.20", "normalize_only"), ("12.50", "12.50", "normalize_only"), ("x", None, "unparsed"), (None, None, "unparsed"), ("37.450", "35.00", "fee_inverted_from_normalized")])
def test_repair(spark, raw, want, reason):
    got = values(spark, "string", [raw], price.repaired_price(F.col("v")))[0]
    assert (got["price"], got["reason"]) == (Decimal(want) if want else None, reason)


def test_repair_by_reference(spark):
    got = values(spark, "string", ["1.9852"], price.repaired_price(F.col("v"), F.lit("1890.00").cast("decimal(12,2)")))[0]
    assert (got["price"], got["reason"]) == (Decimal("1890.00"), "fee_inverted_separator_matched_old_df")


def test_relative_dates(spark):
    raw = ["2 giorni fa", "3 weeks ago", "oggi", "Ieri", "un mese fa", "30 minuti fa", "5 ore fa", "2 anni fa", "", None]
    assert values(spark, "string", raw, dates.upload_days(F.col("v"))) == [2.0, 21.0, 0.0, 1.0, None, 0.0208, 0.2083, 730.0, None, None]
    assert values(spark, "string", ["2 giorni fa", "un mese fa", "ieri", None], dates.upload_minutes(F.col("v"))) == [2880.0, 43200.0, None, None]
    assert values(spark, "string", ["ieri", "today", "un anno fa", "2 hours ago", ""], dates.upload_age_days(F.col("v"))) == [1.0, 0.0, 365.0, 2 / 24, None]


def test_age_bands(spark):
    assert values(spark, "double", [0.5, 1.0, 6.9, 7.0, 29.0, 89.0, 364.0, 400.0, None, float("nan")], dates.age_band(F.col("v"))) == ["<1d", "1d", "2-6d", "1-2w", "2-4w", "1-3m", "3-12m", "1y+", "unknown", "unknown"]


def test_countries(spark):
    assert values(spark, "string", ["Roma,  Italia", "Francia", "", None, "a, Ultima visita 3 ore fa", "x,"], dates.country(F.col("v"))) == ["Italia", "Francia", "unknown", "unknown", "unknown", "unknown"]


def test_titles(spark):
    title = "NÚOVA Prada borsa 120€"
    got = spark.createDataFrame([(title,), (None,), ("",)], "t string").select(*[c.alias(n) for n, c in text.title_features(F.col("t")).items()]).collect()
    assert got[0]["title_norm"] == "nuova prada borsa 120"
    assert (got[0]["title_has_new"], got[0]["title_has_price"], got[0]["title_tokens"], got[0]["title_digit_tokens"]) == (1, 1, 4, 1)
    assert got[1]["title_norm"] == got[2]["title_norm"] == "" and got[1]["title_tokens"] == 0


def test_blocks(spark):
    df = spark.createDataFrame([("Nike", "Air AF1 max97 2021"), ("", "scarpe rosse belle"), (None, "x")], "b string, t string")
    got = [r[0] for r in df.select(text.block_key(F.col("b"), text.normalise(F.col("t")))).collect()]
    assert got == ["nike__codes__max97-2021", "nobrand__toks__scarpe-rosse", "nobrand__notoks"]


def test_flags_are_substrings_but_title_words_are_bounded(spark):
    assert values(spark, "string", ["unlike", "renew"], text.negative_flags(F.col("v")), text.flag(F.col("v"), text.NEW_WORD)) == [(["like"], 0), ([], 0)]


def test_coercions(spark):
    got = values(spark, "string", ["12.0", " 7 ", "x", "NaN", None], coerce.number(F.col("v")), coerce.id_text(F.col("v")), coerce.truth(F.col("v")))
    assert got == [(12.0, "12", None), (7.0, "7", None), (None, "x", None), (None, "", None), (None, "", None)]
    assert values(spark, "string", ["yes", "SOLD", "0"], coerce.truth(F.col("v"), "live")) == [True, True, False]


def test_timestamps(spark):
    got = values(spark, "string", ["2024-02-03 04:05:06", "3/2/2024 4:5:6", "bad", None], coerce.timestamp(F.col("v")))
    assert got[0] == got[1] == datetime.datetime(2024, 2, 3, 4, 5, 6) and got[2:] == [None, None]


def test_required_profit(spark):
    df = spark.createDataFrame([(14.0, "ps4", "x"), (100.0, "borse", "y"), (None, "borse", "z")], "p double, s string, t string")
    got = [round(r[0], 2) for r in df.select(buy.required_profit(F.col("p"), F.col("s"), F.col("t"))).collect()]
    assert got == [3.92, 8.0, 8.0]


def test_stars_and_condition(spark):
    assert values(spark, "string", ["45", "4,5", "60", "x", None], buy.stars(F.col("v"))) == [4.5, 4.5, None, None, None]
    assert values(spark, "string", ["Nuovo con cartellino", "NEW", "fair", None, "ok"], buy.condition_score(F.col("v"))) == [1.0, 0.9, 0.2, 0.6, 0.55]


def test_lost_separators(spark):
    assert values(spark, "string", ["1.9852", "3.67465", "578.2", None], price.separator_recovered(F.col("v"))) == [Decimal("1985.20"), Decimal("3674.65"), None, None]
