"""Scalar functions over titles, texts and prices."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import coerce, dates, price, text
from ..operators import cluster, deals
from ..sources import pages, tables
from .adapters import query, r, table

_NORM = "trim(regexp_replace(regexp_replace({x}, 'https?://\\S+|www\\.\\S+', ' ', 'g'), '[^a-z0-9]+', ' ', 'g'))"
_TITLE = _NORM.format(x="strip_accents(lower(trim(t)))")


@query(r"select doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(strip_accents(lower(trim(text))), '\baf\s?1\b', 'air force 1', 'g'), '\baf1\b', 'air force 1', 'g'), '\blv\b', 'louis vuitton', 'g'), '[^\p{L}\p{N}]+', ' ', 'g'))) norm from documents")
def normalise_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.normalise(F.col("text"))).alias("norm"))


@query(rf"""with t as (select p_partkey, p_name t from part union all select page_id + 1000000, html from pages),
n as (select p_partkey, t, {_TITLE} n from t), w as (select *, case when n = '' then [] else string_split(n, ' ') end ws from n),
f as (select *, regexp_matches(n, '\b(?:new|nuov[aoei]?|nueva|neuf|neu|nwt|cartellino)\b')::int nw, regexp_matches(n, '\b(?:original|authentic|autentico|autentica|vero|genuine)\b')::int au,
  regexp_matches(n, '\b(?:limited edition|edizione limitata|raro|rara|rare)\b')::int li, regexp_matches(n, '\b(?:lotto|bundle|set|stock|blocco)\b')::int bu,
  regexp_matches(n, '\b(?:difett\w*|rovinat\w*|usurat\w*|macchiat\w*|strapp\w*|da riparare)\b')::int de,
  regexp_matches(t, '(?i)(?:\b\d{{1,3}}(?:[.,]\d{{1,2}})?\s*[€$£]|\d{{1,3}}(?:[.,]\d{{1,2}})?\s*(?:euro|eur)\b|[€$£]\s*\d{{1,3}}(?:[.,]\d{{1,2}})?)')::int pr from w)
select p_partkey k, length(n)::int title_char_len, len(ws)::int title_tokens, len(list_distinct(ws))::int title_unique_tokens, len(list_filter(ws, lambda x: regexp_matches(x, '\d')))::int title_digit_tokens,
  regexp_matches(n, '\d')::int title_has_digit, nw title_has_new, au title_has_auth, li title_has_limited, bu title_has_bundle, de title_has_defect, pr title_has_price, (nw + au + li)::int title_positive, (bu + de + pr)::int title_caution from f""")
def title_features(spark, sf_dir):
    t = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("t")).unionByName(table(spark, sf_dir, "pages").select((F.col("page_id") + 1000000).alias("k"), F.col("html").alias("t")))
    return text.with_title_features(t, "t").drop("t", "title_norm")


@query(rf"""with t as (select p_partkey, p_name t, p_brand b, p_size s, p_retailprice p, {_NORM.format(x="lower(trim(p_name))")} n from part), w as (select *, case when n = '' then [] else string_split(n, ' ') end ws from t)
select p_partkey, ln(1 + p)::double log_price, length(t)::int title_char_len, len(regexp_extract_all(t, '[a-z0-9]+'))::int title_token_count, len(ws)::int title_norm_token_count,
  round(1.0 - len(list_distinct(ws)) / len(ws), 6)::double title_duplicate_token_ratio, round(length(array_to_string(ws, '')) / len(ws), 6)::double title_avg_token_len,
  len(regexp_extract_all(t, '[^\p{{L}}\p{{N}}_\s]'))::int title_punct_count, round(len(regexp_extract_all(t, '[A-Z]')) / greatest(len(regexp_extract_all(t, '[A-Za-z]')), 1), 6)::double title_upper_ratio, (trim(b) <> '')::int brand_present, s::double size_num from w""")
def snapshot_features(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    made = text.snapshot_features(F.col("p_name"), F.col("p_retailprice"), F.lit(0), F.lit(1), F.col("p_brand"), F.col("p_size"))
    keep = ("log_price", "title_char_len", "title_token_count", "title_norm_token_count", "title_duplicate_token_ratio", "title_avg_token_len", "title_punct_count", "title_upper_ratio", "brand_present", "size_num")
    rounded = ("title_duplicate_token_ratio", "title_avg_token_len", "title_upper_ratio")
    return p.select("p_partkey", *[(r(made[k]) if k in rounded else made[k]).alias(k) for k in keep])


_BLOCK = r"with p as (select p_partkey, trim(regexp_replace(strip_accents(lower(p_brand)), '[^\p{L}\p{N}]+', ' ', 'g')) b, trim(regexp_replace(strip_accents(lower(p_name || ' ' || p_size)), '[^\p{L}\p{N}]+', ' ', 'g')) t from part), q as (select *, regexp_extract_all(t, '\b[a-z]{1,4}\d{2,6}\b|\b\d{2,4}\b') cs, list_filter(regexp_extract_all(t, '[a-z0-9]+'), lambda x: length(x) > 1) ws from p)"


@query(_BLOCK + " select p_partkey, coalesce(nullif(b, ''), 'nobrand') || case when len(cs) > 0 then '__codes__' || array_to_string(list_slice(list_reverse(list_sort(list_distinct(cs))), 1, 5), '-') when len(ws) > 0 then '__toks__' || array_to_string(list_slice(ws, 1, 2), '-') else '__notoks' end block from q")
def block_keys(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", text.block_key(F.col("p_brand"), text.normalise(F.concat_ws(" ", "p_name", F.col("p_size").cast("string")))).alias("block"))


@query("select doc_id, len(list_filter(['replica','fake','falso','tarocco','ispirato','inspired','like','stile','lotto','bundle','stock','solo scatola','scatola','dustbag','ricambio','solo','rovinato','strappato','macchia','difetto','da riparare','rott','kids','bambino','bimbi','ragazzo','ragazza'], lambda k: contains(lower(text), k)))::int hits from documents")
def negative_flags(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(text.found_in(F.col("text"), text.NEGATIVE)).alias("hits"))


@query(r"""with w as (select conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) ws from conversations)
select a.conv_id, a.turn, case when len(list_distinct(list_concat(a.ws, b.ws))) = 0 then 0.0 else round(len(list_intersect(a.ws, b.ws)) / len(list_distinct(list_concat(a.ws, b.ws))), 6) end::double overlap from w a join w b on a.conv_id = b.conv_id and b.turn = a.turn + 1""")
def token_overlap(spark, sf_dir):
    w = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_distinct(text.tokens(F.lower("text"), least=1)).alias("ws"))
    nxt = w.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("ws").alias("vs"))
    return w.join(nxt, ["conv_id", "turn"]).select("conv_id", "turn", r(text.jaccard(F.col("ws"), F.col("vs"))).alias("overlap"))


_WORDS = r"select p_partkey, p_type, list_filter(regexp_extract_all(lower(p_name), '[a-z0-9]+'), lambda x: length(x) > 1) ws from part"


@query(f"with w as ({_WORDS}), n as (select p_type, count(*) n from w group by 1), t as (select p_type, token, count(*) c from (select p_type, p_partkey, unnest(list_distinct(ws)) token from w) group by 1, 2) select p_type, token, c from t join n using (p_type) where c >= 0.1 * n")
def core_tokens(spark, sf_dir):
    w = table(spark, sf_dir, "part").select("p_type", text.tokens(F.lower("p_name")).alias("ws"))
    return deals.core_tokens(w, ["p_type"], "ws", 0.1)


@query(f"with w as ({_WORDS}), e as (select p_type, p_partkey, unnest(ws) token, unnest(range(len(ws))) pos from w), c as (select p_type, token, count(*) c, min((p_partkey, pos)) f from e group by 1, 2), k as (select *, row_number() over (partition by p_type order by c desc, f) n from c) select p_type, string_agg(token, ' ' order by n) canonical from k where n <= 10 group by 1")
def canonical_names(spark, sf_dir):
    w = table(spark, sf_dir, "part").select("p_type", "p_partkey", text.tokens(F.lower("p_name")).alias("ws"))
    return deals.common_tokens(w, ["p_type"], "ws", 10, "p_partkey")


_PRICES = "(select p_partkey, p_retailprice::decimal(12,2) d, unnest(range(4)) k from part)"


@query(f"select p_partkey, k::int k, case when k = 3 then (floor(d * 100) * 10)::double else d::double end parsed from {_PRICES}")
def parse_prices(spark, sf_dir):
    """Four spellings of one price: 1.234,30€, 1,234.30, 1234,30 €, and thousands grouped by a point."""
    d = F.col("p_retailprice").cast("decimal(12,2)")
    us = F.format_number("p_retailprice", 2)
    eu = F.translate(us, ".,", ",.")
    grouped = F.concat(F.floor(d * 100).cast("long").cast("string"), F.lit("0"))
    forms = F.array(F.concat(eu, F.lit("€")), us, F.concat(F.translate(eu, ".", ""), F.lit(" €")), F.regexp_replace(grouped, r"(\d)(\d{3})$", "$1.$2"))
    p = table(spark, sf_dir, "part").select("p_partkey", F.posexplode(forms).alias("k", "raw"))
    return p.select("p_partkey", "k", price.parse_price(F.col("raw")).alias("parsed"))


@query("select p_partkey, p_name || ' item' title, p_brand brand, case when p_partkey % 2 = 0 then p_size::varchar else '0' end as size, (round(p_retailprice) + 1)::bigint || '.00' price_text from part")
def split_listing_text(spark, sf_dir):
    c = F.col
    p = F.round("p_retailprice").cast("long")
    raw = F.concat(c("p_name"), F.lit(" item, brand: "), c("p_brand"), F.when(c("p_partkey") % 2 == 0, F.concat(F.lit(", taglia: "), c("p_size").cast("string"))).otherwise(""), F.lit(", €"), p.cast("string"), F.lit(".00, €"), (p + 1).cast("string"), F.lit(".00 include la Protezione acquisti"))
    t = table(spark, sf_dir, "part").select("p_partkey", raw.alias("t"))
    return t.select("p_partkey", price.listing_title(c("t")).alias("title"), price.listing_attribute(c("t"), "brand", "No brand").alias("brand"), price.listing_attribute(c("t"), "taglia", "0").alias("size"), price.listing_price_text(c("t")).alias("price_text"))


@query("select p_partkey, p_retailprice::decimal(12,2)::double repaired from part")
def repair_prices(spark, sf_dir):
    """Prices whose decimal point was lost and whose thousands are set off by a point instead: 1234.50 as 1.23450; each is recovered."""
    cents = F.round(F.col("p_retailprice") * 100).cast("long").cast("string")
    raw = F.when(F.length(cents) > 5, F.regexp_replace(cents, r"^(\d+)(\d{5})$", "$1.$2")).otherwise(F.col("p_retailprice").cast("decimal(12,2)").cast("string"))
    reference = F.col("p_retailprice").cast("decimal(12,2)")
    return table(spark, sf_dir, "part").select("p_partkey", price.repaired_price(raw, reference)["price"].cast("double").alias("repaired"))


_AGES = "(select event_id, (event_id % 9)::int n, (event_id % 7)::int u from events)"
_PHRASES = ("minuti fa", "ore fa", "giorni fa", "weeks ago", "months ago", "anni fa", "oggi")


@query(f"""select event_id, case u when 0 then round(n / 1440.0, 4) when 1 then round(n / 24.0, 4) when 2 then n when 3 then n * 7 when 4 then n * 30 when 5 then n * 365 else 0 end::double as "days",
  case u when 0 then n when 1 then n * 60 when 2 then n * 1440 when 3 then n * 10080 when 4 then n * 43200 end::double as "minutes", case when u = 6 then null when u = 0 then round(n / 1440.0, 9) when u = 1 then round(n / 24.0, 9) when u = 2 then n when u = 3 then n * 7 when u = 4 then n * 30 else n * 365 end::double age_days,
  case when u = 6 then 'unknown' when u < 2 then '<1d' else (case when d < 1 then '<1d' when d < 2 then '1d' when d < 7 then '2-6d' when d < 14 then '1-2w' when d < 30 then '2-4w' when d < 90 then '1-3m' when d < 365 then '3-12m' else '1y+' end) end band
from (select *, case u when 2 then n when 3 then n * 7 when 4 then n * 30 when 5 then n * 365 else 0 end d from {_AGES})""")
def relative_dates(spark, sf_dir):
    phrase = F.get(F.array(*map(F.lit, _PHRASES)), (F.col("event_id") % 7).cast("int"))
    t = table(spark, sf_dir, "events").select("event_id", F.concat((F.col("event_id") % 9).cast("string"), F.lit(" "), phrase).alias("t"))
    age = dates.upload_age_days(F.col("t"))
    return t.select("event_id", dates.upload_days(F.col("t")).alias("days"), dates.upload_minutes(F.col("t")).alias("minutes"), r(age, 9).alias("age_days"), dates.age_band(age).alias("band"))


@query("select c_custkey, case when c_custkey % 4 = 0 then 'unknown' when c_custkey % 4 = 1 then 'unknown' else n_name end country, case when c_acctbal >= 0 then c_acctbal end balance from customer join nation on c_nationkey = n_nationkey")
def countries(spark, sf_dir):
    c, k = F.col, F.col("c_custkey") % 4
    where = F.when(k == 0, "").when(k == 1, "Ultima visita 3 ore fa").when(k == 2, c("n_name")).otherwise(F.concat(F.lit("Via  Roma, "), c("n_name")))
    joined = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), c("c_nationkey") == c("n_nationkey"))
    return joined.select("c_custkey", dates.country(where).alias("country"), dates.not_negative(c("c_acctbal")).alias("balance"))


@query("select event_id, json_extract(props, '$.k')::bigint k, (json_extract(props, '$.k')::bigint)::double number, lower(trim(event_type)) || '::' || user_id as key, 'Dataid:' || user_id prefixed from events")
def coerced_events(spark, sf_dir):
    c = F.col
    k = F.get_json_object("props", "$.k")
    return table(spark, sf_dir, "events").select("event_id", coerce.whole(k).alias("k"), coerce.first_number(F.concat(F.lit("n="), k)).alias("number"), coerce.tracking_key(c("event_type"), F.concat(c("user_id").cast("string"), F.lit(".0"))).alias("key"), coerce.prefixed_key(c("user_id"), F.lit("x")).alias("prefixed"))


@query("select event_id, case (event_id % 6)::int when 0 then true when 1 then false when 2 then null when 3 then true when 4 then false else null end speed, (event_id % 6) in (0, 3) cascade, (event_id % 6) in (0, 3, 5) live from events")
def truth_sets(spark, sf_dir):
    t = F.get(F.array(*map(F.lit, ("TRUE", "no", "?", "1.0", "0", "Sold"))), (F.col("event_id") % 6).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", coerce.truth(t, "speed").alias("speed"), coerce.truth(t, "cascade").alias("cascade"), coerce.truth(t, "live").alias("live"))


@query("""select event_id, date_trunc('second', ts) as "at" from events""")
def mixed_timestamps(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    iso, eu = F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.date_format("ts", "d/M/yyyy H:m:s")
    return e.select("event_id", coerce.timestamp(F.when(F.col("event_id") % 2 == 0, iso).otherwise(eu)).alias("at"))


@query("select page_id, nullif(regexp_extract(html, 'href=\"([^\"]*)\"', 1), '') href, regexp_extract(html, '<title>([^<]*)</title>', 1) title, length(html)::int n from pages")
def html_attributes(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", tables.html_attribute(F.col("html"), "href").alias("href"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.length("html").alias("n"))


@query("select c_custkey, ['a', c_mktsegment] parsed_list, c_custkey % 100 = 0 changed from customer".replace("['a', c_mktsegment] parsed_list", "'a|' || c_mktsegment parsed_list"))
def parse_lists(spark, sf_dir):
    c = F.col
    raw = F.when(c("c_custkey") % 2 == 0, F.concat(F.lit("['a', '"), c("c_mktsegment"), F.lit("']"))).otherwise(F.concat(F.lit('["a", "'), c("c_mktsegment"), F.lit('"]')))
    fresh = F.when(c("c_custkey") % 100 == 0, c("c_acctbal") + 1).otherwise(c("c_acctbal") + 0.001)
    t = tables.price_change(table(spark, sf_dir, "customer").withColumn("fresh", fresh).withColumn("raw", raw), "fresh", "c_acctbal")
    return t.select("c_custkey", F.array_join(tables.parse_list(c("raw")), "|").alias("parsed_list"), c("PriceChanged").alias("changed"))


@query("""with l as (select page_id, unnest(regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 1)) href, unnest(regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 2)) label,
  unnest(range(len(regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 1)))) card_no from pages)
select page_id, card_no::int card_no, replace(replace(replace(replace(href, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&') href, replace(replace(replace(replace(label, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&') as label from l""")
def html_cards(spark, sf_dir):
    """Every entry of every page's navigation: one page to many rows."""
    p = table(spark, sf_dir, "pages").select("page_id", "html")
    return pages.cards(p, "html", ("li", ""), {"href": ("a", "", "href"), "label": ("a", "", "text")}).select("page_id", "card_no", "href", "label")


@query("""with o as (select o_orderkey, o_orderpriority p, o_custkey, o_totalprice, case when o_orderkey % 5 > 0 then o_custkey::varchar || '.0' else ' ' end id, case when o_orderkey % 7 > 0 then 'https://x/items/' || o_orderkey || '-a' end link, (o_orderkey % 500) - 1 as days from orders)
select o_orderkey, lower(trim(p)) || '::' || trim(replace(id, '.0', '')) tracking, trim(p) || '::' || trim(replace(id, '.0', '')) derived, case when id <> ' ' then 'Dataid:' || replace(id, '.0', '') when link is not null then 'Link:' || link else '' end prefixed,
  coalesce(nullif(trim(id), ''), link, p || '|' || o_custkey) as identity, case when link is not null then o_orderkey::varchar end link_id, regexp_replace(lower(p), '[^a-z0-9]', '', 'g') as status, trim(regexp_replace(lower(p), '[^a-z0-9]+', '_', 'g'), '_') as slug,
  case when days < 0 then 'unknown' when days < 1 then '<1d' when days < 2 then '1d' when days < 7 then '2-6d' when days < 14 then '1-2w' when days < 30 then '2-4w' when days < 90 then '1-3m' when days < 365 then '3-12m' else '1y+' end as band from o""")
def keys_and_bands(spark, sf_dir):
    """Keys of listings, with ids or links missing in some; statuses, names of folders, and age bands."""
    c = F.col
    o = table(spark, sf_dir, "orders").withColumn("id", F.when(c("o_orderkey") % 5 > 0, F.concat(c("o_custkey").cast("string"), F.lit(".0"))).otherwise(" "))
    o = o.withColumn("link", F.when(c("o_orderkey") % 7 > 0, F.concat(F.lit("https://x/items/"), c("o_orderkey").cast("string"), F.lit("-a"))))
    days = F.nullif((c("o_orderkey") % 500 - 1).cast("double"), F.lit(-1.0))
    return o.select(
        "o_orderkey", coerce.tracking_key(c("o_orderpriority"), c("id")).alias("tracking"), coerce.derived_key(c("o_orderpriority"), c("id")).alias("derived"), coerce.prefixed_key(c("id"), c("link")).alias("prefixed"),
        coerce.item_identity(c("id"), c("link"), c("o_orderpriority"), c("o_custkey")).alias("identity"), coerce.id_from_link(c("link")).alias("link_id"), text.status(c("o_orderpriority")).alias("status"), text.slug(c("o_orderpriority")).alias("slug"), dates.age_band(days).alias("band"),
    )


@query("""with e as (select vec_id, label, list_transform(embedding, lambda x: round(x::double, 3)) v from embeddings)
select vec_id, round(list_sum(v), 3) total, round((coalesce(a, 0) + coalesce(b, 0)) / nullif((a is not null)::int + (b is not null)::int, 0), 6)::double bad_photo, case when label >= 4 then least(greatest(v[1] * 20 - v[2], -10.0), 10.0) end legacy,
  case when label % 3 = 0 and vec_id % 2 = 0 then 1.0 when label % 3 = 0 or vec_id % 2 = 0 then 0.0 else len(list_intersect(['a', 'b'], ['b', 'c' || label])) / 3.0 end::double alike
from (select *, case when vec_id % 3 > 0 then v[1] end a, case when vec_id % 2 > 0 then v[2] end b from e)""")
def vector_scores(spark, sf_dir):
    """Vectors read from JSON; photo scores of which some are missing; the older deal score; similarity of word sets, two empty ones being alike."""
    c = F.col
    e = table(spark, sf_dir, "embeddings").withColumn("json", F.to_json(F.transform("embedding", lambda x: F.round(x.cast("double"), 3))))
    e = e.withColumn("v", F.transform(tables.parse_vector(c("json")), lambda x: F.round(x.cast("double"), 3)))
    one, two = F.get("v", F.lit(0)), F.get("v", F.lit(1))
    none = F.array().cast("array<string>")
    a = F.when(c("label") % 3 == 0, none).otherwise(F.array(F.lit("a"), F.lit("b")))
    b = F.when(c("vec_id") % 2 == 0, none).otherwise(F.array(F.lit("b"), F.concat(F.lit("c"), c("label").cast("string"))))
    return e.select(
        "vec_id", F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 3).alias("total"), r(cluster.mean_available(F.when(c("vec_id") % 3 > 0, one), F.when(c("vec_id") % 2 > 0, two))).alias("bad_photo"),
        deals.legacy_score(one * 20, two, c("label")).alias("legacy"), text.jaccard(a, b, both_empty=1.0).alias("alike"),
    )
