"""Cards and offers of web pages, broken ones too."""

from pyspark.sql import functions as F

from stallwise.functions.price import page_price
from stallwise.sources import pages

CARD = """<div class="x feed-grid__item"><div><img src="{img}"><a class="new-item-box__overlay y" href="{link}" title="{title}" data-testid="{testid}"></a></div></div>"""


def card(k, title="Scarpe &amp; co, brand: Nike, condizioni: Nuovo, taglia: 45, €110.00, €116.20 include la Protezione acquisti", link="/items/1?referrer=catalog", testid="grid-item-x-77-a-b-c"):
    return CARD.format(img=f"i{k}.jpg", link=link, title=title, testid=testid)


def test_listing_cards(spark):
    page = "<html><body>" + card(0) + card(1, title="no details") + card(2, link="/other") + card(3, title="Borsa, €1.234,50", testid="product-99") + card(4, testid="") + "<div class='feed-grid__item'><p>no overlay</p></div></body></html>"
    df = spark.createDataFrame([(1, page), (2, None), (3, ""), (4, "<div class='feed-grid__item'><img src=z><a class=new-item-box__overlay title='Open, brand: B, €5' href='?referrer=catalog' data-testid=p-5")], "page int, html string").withColumn("title", F.lit("clash"))
    found = pages.cards(df.drop("title"), "html", pages.LISTING_CARD, pages.LISTING_FIELDS)
    assert sorted((r["page"], r["card_no"]) for r in found.collect()) == [(1, k) for k in range(6)] + [(4, 0)]
    rows = {(r["page"], r["card_no"]): r for r in pages.listing_rows(found.drop("html")).collect()}
    assert set(rows) == {(1, 0), (1, 3)}  # the last page ends inside its link, which is therefore none
    first, bag = rows[1, 0], rows[1, 3]
    assert (first["Title"], first["Price"], first["Brand"], first["Size"], first["Dataid"], first["Images"]) == ("Scarpe & co", 116.2, "Nike", "45", "77", "i0.jpg")
    assert (bag["Title"], bag["Price"], bag["Brand"], bag["Size"], bag["Dataid"]) == ("Borsa", 1234.5, "No brand", "0", "99")
    assert pages.cards(df.limit(0), "html", pages.LISTING_CARD, {"image": ("img", "", "src")}).count() == 0


def test_texts_of_nested_elements(spark):
    html = "<ul><li>a <b>bold <i>x</i></b> c</li><li><b></b></li><li>open <b>never closed"
    got = pages.cards(spark.createDataFrame([(html,)], "h string"), "h", ("li", ""), {"b": ("b", "", "text")}).collect()
    assert [(r["card_no"], r["b"]) for r in got] == [(0, "bold x"), (1, ""), (2, None)]


def test_offers_at_any_depth(spark):
    deep = "[" * 60 + '{"offers": {"price": "9,50"}}' + "]" * 60
    pages_ = {
        1: '<script type="application/ld+json">{"a": {"offers": [{"price": 0}, {"price": "12.00"}]}, "offers": {"price": "n/a"}}</script>',
        2: "<script type='application/ld+json'>{broken</script><p/><SCRIPT TYPE=application/ld+json id=x>" + deep + "</SCRIPT>",
        3: '<script>{"offers": {"price": 3}}</script>', 4: None, 5: '<script type="application/ld+json">[{"offers": [1, null, {"x": 2}]}, {"offers": "5"}]</script>', 6: '<meta itemprop="price" content="7"><script type="application/ld+json">{"offers": {"price": 8}}</script>',
    }
    df = spark.createDataFrame(list(pages_.items()), "id int, h string").withColumn("o", pages.offer_prices(F.col("h")))
    got = {r["id"]: (r["o"], r["p"]) for r in df.select("id", "o", page_price(F.col("h"), F.col("o")).alias("p")).collect()}
    assert got[1] == (["n/a", "0", "12.00"], 12.0) and got[2] == (["9,50"], 9.5) and got[3] == ([], None) and got[5] == ([], None) and got[6][1] == 7.0 and got[4][1] is None
