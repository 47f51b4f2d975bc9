"""Prices in listing texts, and their repair in exact decimals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The buyer's fee: 5 % and 0.70. Fixed values.
FEE_RATE, FIXED_FEE = "0.05", "0.70"
#: Cents that listing prices usually end in. Fixed values.
ROUNDISH_CENTS = (0, 50, 90, 95, 99)
#: Two prices of which the second includes the buyer's fee. Fixed values.
FEE_PAIRS = (
    r"(?i)€\s*([\d.,]+)\D{0,40}€\s*([\d.,]+)\D{0,120}protezione acquisti",
    r"(?i)([\d.,]+)\s*€\D{0,40}([\d.,]+)\s*€\D{0,120}protezione acquisti",
    r"(?i)€\s*([\d.,]+)\D{0,40}€\s*([\d.,]+)\D{0,120}(?:buyer|purchase) protection",
    r"(?i)([\d.,]+)\s*€\D{0,40}([\d.,]+)\s*€\D{0,120}(?:buyer|purchase) protection",
)


def listing_price_text(c: Column) -> Column:
    """The second price of a fee pair, else the first after a euro sign, else 0."""
    text = F.coalesce(c, F.lit(""))
    clean = lambda x: F.nullif(F.rtrim(F.trim(x), F.lit(",.")), F.lit(""))
    pairs = [clean(F.regexp_extract(text, p, 2)) for p in FEE_PAIRS]
    split = F.when(F.contains(text, F.lit("€")), F.rtrim(F.trim(F.get(F.split(text, "€"), F.lit(1))), F.lit(",.")))
    return F.coalesce(*pairs, clean(F.regexp_extract(text, r"€\s*([\d.,]+)", 1)), split, F.lit("0"))


def parse_price(c: Column) -> Column:
    """The double that a European or American price text means; null if none.

    With both separators, the last is the decimal one. A lone comma is decimal before one or two digits. Of several points, the
    last is decimal before one or two digits. A single point before three digits groups thousands.
    """
    p = F.regexp_replace(c.cast("string"), r"[^\d.,]", "")
    comma, point = F.contains(p, F.lit(",")), F.contains(p, F.lit("."))
    last_comma, last_point = F.length(p) - F.instr(F.reverse(p), ","), F.length(p) - F.instr(F.reverse(p), ".")
    bare = F.translate(p, ".,", "")
    tail = lambda sep: F.regexp_extract(p, rf"[{sep}]([^{sep}]*)$", 1)
    decimal = lambda sep: F.concat(F.translate(F.regexp_replace(p, rf"[{sep}][^{sep}]*$", ""), ".,", ""), F.lit("."), tail(sep))
    points = F.length(p) - F.length(F.translate(p, ".", ""))
    text = (
        F.when(comma & point & (last_comma > last_point), F.translate(F.translate(p, ".", ""), ",", "."))
        .when(comma & point, F.translate(p, ",", ""))
        .when(comma, F.when(F.length(tail(",")).isin(1, 2), decimal(",")).otherwise(bare))
        .when(points > 1, F.when(F.length(tail(".")).isin(1, 2), decimal(".")).otherwise(bare))
        .when((points == 1) & p.rlike(r"^\d+\.\d{3}$"), bare)
        .otherwise(p)
    )
    return F.nullif(text, F.lit("")).try_cast("double")


def listing_title(c: Column) -> Column:
    return F.trim(F.get(F.split(c, ",", 2), F.lit(0)))


def listing_attribute(c: Column, name: str, default: str) -> Column:
    """The text after name: up to the next comma."""
    details = F.get(F.split(c, ",", 2), F.lit(1))
    return F.when(F.contains(details, F.lit(f"{name}:")), F.trim(F.regexp_extract(details, rf"{name}:([^,]*)", 1))).otherwise(default)


def _cents(c: Column) -> Column:
    return F.round(c, 2).cast("decimal(12,2)")


def numeric_token(c: Column) -> Column:
    """The first number of a raw price, comma read as point; null if none."""
    return F.nullif(F.regexp_extract(F.translate(c.cast("string"), ",", "."), r"(-?\d+(?:\.\d+)?)", 1), F.lit(""))


def places(token: Column) -> Column:
    """Digits after the point; 0 without one."""
    return F.length(F.regexp_extract(token, r"\.(\d+)$", 1))


def normalised_price(token: Column) -> Column:
    return _cents(token.try_cast("decimal(30,10)"))


def separator_recovered(token: Column) -> Column:
    """Reads 1.9852 as 1985.20: a point that grouped thousands, with the decimal point lost; needs three digits after it."""
    whole, part = F.regexp_extract(token, r"^(\d+)\.(\d+)$", 1), F.regexp_extract(token, r"^(\d+)\.(\d+)$", 2)
    missing = F.pmod(2 - F.length(part), F.lit(3))  # after groups of three come two digits of cents; zeros that were lost are put back
    cents = F.concat(whole, F.rpad(part, F.length(part) + missing, "0")).try_cast("decimal(30,0)")
    return F.when(F.length(part) >= 3, _cents((cents / 100).cast("decimal(30,10)")))


def without_fee(gross: Column) -> Column:
    """The listing price whose price with the buyer's fee is gross."""
    fixed, rate = F.lit(FIXED_FEE).cast("decimal(12,2)"), F.lit(FEE_RATE).cast("decimal(4,2)") + 1
    return F.when(gross > fixed, _cents(((gross - fixed) / rate).cast("decimal(30,10)")))


def with_fee(price: Column) -> Column:
    fixed, rate = F.lit(FIXED_FEE).cast("decimal(12,2)"), F.lit(FEE_RATE).cast("decimal(4,2)") + 1
    return F.when(price >= 0, _cents((price * rate + fixed).cast("decimal(30,10)")))


def repaired_price(raw: Column, reference: Column | None = None) -> Column:
    """struct(price, reason, confidence) of a damaged raw price; a reference price within a cent decides first."""
    token = numeric_token(raw)
    n, plain, recovered = places(token), normalised_price(token), separator_recovered(token)
    fee_plain, fee_recovered = without_fee(plain), without_fee(recovered)
    exact_plain, exact_recovered = with_fee(fee_plain) == plain, with_fee(fee_recovered) == recovered
    made = lambda price, reason, confidence: F.struct(price.alias("price"), F.lit(reason).alias("reason"), F.lit(confidence).alias("confidence"))
    roundish = ((fee_recovered * 100).cast("long") % 100).isin(*ROUNDISH_CENTS)
    out = (
        F.when(plain.isNull(), made(F.lit(None).cast("decimal(12,2)"), "unparsed", "low"))
        .when(n <= 2, made(plain, "normalize_only", "high"))
        .when((n == 3) & exact_plain & (fee_plain >= 1) & (recovered >= plain * 100), made(fee_plain, "fee_inverted_from_normalized", "medium"))
        .when((n == 3) & recovered.isNotNull(), made(recovered, "separator_recovered", "medium"))
        .when((n > 3) & exact_recovered & roundish, made(fee_recovered, "separator_recovered_then_fee_inverted", "medium"))
        .when((n > 3) & recovered.isNotNull(), made(recovered, "separator_recovered", "high"))
        .otherwise(made(plain, "normalize_only", "medium"))
    )
    if reference is None:
        return out
    near = [
        F.when(value.isNotNull() & ok, F.struct(F.abs(value - reference).alias("far"), F.lit(k).alias("k"), value.cast("decimal(12,2)").alias("price"), F.lit(name).alias("name")))
        for k, (name, value, ok) in enumerate(
            (("normalized", plain, F.lit(True)), ("separator_recovered", recovered, F.lit(True)), ("fee_inverted_normalized", fee_plain, exact_plain), ("fee_inverted_separator", fee_recovered, exact_recovered))
        )
    ]
    best = F.array_min(F.array_compact(F.array(*near)))
    match = F.struct(best["price"].alias("price"), F.concat(best["name"], F.lit("_matched_old_df")).alias("reason"), F.lit("high").alias("confidence"))
    return F.when(best["far"] <= F.lit("0.01").cast("decimal(4,2)"), match).otherwise(out)


#: Places of an item page that hold its price, in order: text of an element, or content of a meta tag. Fixed values.
PAGE_PLACES = (
    r'<[^>]*data-testid="item-price-current"[^>]*>([^<]*)<', r'<[^>]*data-testid="item-price"[^>]*>([^<]*)<', r'<[^>]*itemprop="price"[^>]*>([^<]+)<',
    r'<meta[^>]*itemprop="price"[^>]*content="([^"]*)"', r'<meta[^>]*property="product:price:amount"[^>]*content="([^"]*)"', r'<meta[^>]*name="twitter:data1"[^>]*content="([^"]*)"',
)


def page_price(html: Column, offers: Column | None = None) -> Column:
    """The price on an item's page: the larger of a fee pair, else the first positive price of the known places, else of the given JSON-LD offers (sources.pages.offer_prices)."""
    over = lambda x: F.when(x > 0, x)
    pairs = []
    for p in FEE_PAIRS:
        a, b = (over(parse_price(F.rtrim(F.regexp_extract(html, p, k), F.lit(",. ")))) for k in (1, 2))
        pairs.append(F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b)))
    places_ = [over(parse_price(F.regexp_extract(html, p, 1))) for p in PAGE_PLACES]
    listed = F.get(F.filter(F.transform(offers, parse_price), lambda x: x > 0), F.lit(0)) if offers is not None else F.lit(None).cast("double")
    return F.coalesce(*pairs, *places_, listed)
