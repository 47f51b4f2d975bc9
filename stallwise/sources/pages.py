"""Web pages as rows: the cards of a listing page, and the offers of a page's JSON-LD at any depth."""

from __future__ import annotations

import json
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.price import listing_attribute, listing_price_text, listing_title, parse_price

#: Elements that have no end. Fixed values.
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))


class _Cards(HTMLParser):
    """Collects the elements with a tag and class as cards; of each, the first attribute or text found for each field. A card that is never closed ends with the page or the next card."""

    def __init__(self, card: tuple[str, str], fields: dict[str, tuple[str, str, str]]):
        super().__init__(convert_charrefs=True)
        self.card, self.fields = card, fields
        self.cards: list[dict[str, str | None]] = []
        self.depth, self.texts = 0, {}

    def _is(self, tag: str, attrs: dict, wanted: tuple[str, str]) -> bool:
        return tag == wanted[0] and (not wanted[1] or wanted[1] in (attrs.get("class") or "").split())

    def handle_starttag(self, tag, attrs):
        found = dict(attrs)
        if self._is(tag, found, self.card):
            self.depth, self.texts = 1, {}
            self.cards.append(dict.fromkeys(self.fields))
        elif self.depth and tag == self.card[0]:
            self.depth += 1
        if self.depth:
            for name, (of, kind, attribute) in self.fields.items():
                if self.cards[-1][name] is None and self._is(tag, found, (of, kind)):
                    if attribute != "text":
                        self.cards[-1][name] = found.get(attribute)
                    elif name not in self.texts and tag not in VOID:
                        self.texts[name] = [1, tag, []]
                elif name in self.texts and self.texts[name][0] and tag == self.texts[name][1]:
                    self.texts[name][0] += 1

    def handle_data(self, data):
        for text in self.texts.values():
            if text[0]:
                text[2].append(data)

    def handle_endtag(self, tag):
        for name, text in self.texts.items():
            if text[0] and tag == text[1]:
                text[0] -= 1
                if not text[0]:
                    self.cards[-1][name] = "".join(text[2])
        if self.depth and tag == self.card[0]:
            self.depth -= 1
            if not self.depth:
                self.texts = {}


def cards(df: DataFrame, html: str, card: tuple[str, str], fields: dict[str, tuple[str, str, str]]) -> DataFrame:
    """A row for each card of each page: df's columns, card_no (from 0) and the fields. card: tag and class ("" for any); a field: tag, class, and attribute or "text".

    A field that a card lacks is null; a page without cards, or without html, has no rows. Markup is read as browsers do, so broken pages give what they have.
    """

    def make():
        class Cards:
            def eval(self, text: str):
                parser = _Cards(card, fields)
                parser.feed(text or "")
                parser.close()
                for k, c in enumerate(parser.cards):
                    yield (k, *c.values())

        return Cards

    kinds = ", ".join(["card_no int", *(f"`{n}` string" for n in fields)])
    found = F.udtf(make(), returnType=kinds, useArrow=True)
    return df.lateralJoin(found(F.col(html).outer()))


#: A listing page's cards: the picture, and the link over it, whose title holds name, price, brand and size. Fixed values.
LISTING_CARD = ("div", "feed-grid__item")
LISTING_FIELDS = {"image": ("img", "", "src"), "title": ("a", "new-item-box__overlay", "title"), "link": ("a", "new-item-box__overlay", "href"), "testid": ("a", "new-item-box__overlay", "data-testid")}


def listing_rows(found: DataFrame) -> DataFrame:
    """The listings among cards (LISTING_FIELDS): those with a title of a name and details, a catalog link and an id; adds Title, Price (0 if it can't be read), Brand, Size, Link, Dataid, Images."""
    c = F.col
    parts = F.split(c("testid"), "-")
    data_id = F.when(F.size(parts) == 7, F.get(parts, F.lit(3))).when(F.size(parts) > 1, F.get(parts, F.lit(1))).otherwise("")
    rows = found.filter(F.contains(c("title"), F.lit(",")) & F.contains(c("link"), F.lit("referrer=catalog")) & (listing_title(c("title")) != "") & (F.coalesce(data_id, F.lit("")) != ""))
    return rows.select(
        *[x for x in found.columns if x not in LISTING_FIELDS], listing_title(c("title")).alias("Title"), F.coalesce(parse_price(listing_price_text(c("title"))), F.lit(0.0)).alias("Price"), listing_attribute(c("title"), "brand", "No brand").alias("Brand"),
        listing_attribute(c("title"), "taglia", "0").alias("Size"), c("link").alias("Link"), data_id.alias("Dataid"), c("image").alias("Images"),
    )


def _prices(scripts: list[str]) -> list[str]:
    """The offers' prices of all scripts, objects before what they hold, in the order of the page."""
    out = []
    for script in scripts:
        try:
            stack = [json.loads(script)]
        except (ValueError, RecursionError):
            continue
        while stack:
            x = stack.pop()
            if isinstance(x, dict):
                offers = x.get("offers")
                for offer in [offers] if isinstance(offers, dict) else offers if isinstance(offers, list) else []:
                    if isinstance(offer, dict) and offer.get("price") is not None:
                        out.append(str(offer["price"]))
                stack.extend(reversed(list(x.values())))
            elif isinstance(x, list):
                stack.extend(reversed(x))
    return out


def offer_prices(html: Column) -> Column:
    """array<string>: the prices of all offers in all JSON-LD scripts of a page, at any depth; scripts that are no JSON are passed over."""
    scripts = F.regexp_extract_all(html, F.lit(r"""(?is)<script[^>]*type=["']?application/ld\+json["']?[^>]*>(.*?)</script>"""), F.lit(1))

    @F.arrow_udf("array<string>")
    def found(texts: pa.Array) -> pa.Array:
        return pa.array([_prices(t) if t else [] for t in texts.to_pylist()], pa.list_(pa.string()))

    return F.when(F.contains(F.lower(html), F.lit("ld+json")), found(scripts)).otherwise(F.array().cast("array<string>"))
