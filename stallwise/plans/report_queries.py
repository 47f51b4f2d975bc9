"""Summaries around collection, comparisons, gates, categories, rechecked status and photos."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import buy, reports
from .adapters import SCORES, query, r, scores, table


@query("""select o_orderpriority search, count(*) tracked, count(*) filter (o_orderstatus = 'F') sold, count(*) filter (o_custkey % 4 = 0) full_scrape_success,
  count(*) filter (o_custkey % 3 = 0) high_score_candidate, count(*) filter (o_custkey % 3 = 1) low_score_control from orders group by 1""")
def collector_summary(spark, sf_dir):
    c, kind = F.col, F.col("o_custkey") % 3
    o = table(spark, sf_dir, "orders").select(
        c("o_orderpriority").alias("search"), F.when(kind == 0, "high_score_candidate").when(kind == 1, "low_score_control").alias("cohort"),
        F.when(c("o_orderstatus") == "F", c("o_orderdate")).alias("sold_at"), F.when(c("o_custkey") % 4 == 0, "success").alias("status"),
    )
    return reports.collector_summary(o, "search", "cohort", "sold_at", "status")


@query("select l_returnflag file, case when l_quantity > 40 then 'exact' when l_quantity > 5 then 'window' else 'nan' end label_quality, count(*) as \"rows\" from lineitem group by 1, 2")
def audit_counts(spark, sf_dir):
    q = F.col("l_quantity")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("file"), F.when(q > 40, "exact").when(q > 5, "window").alias("quality"))
    return reports.audit_counts(rows, ["file"], "quality")


@query(f"""with {SCORES}, t as (select s, case when doc_id % 7 > 0 then toxic end y from scores)
select y, case y when 1 then 'sold' when 0 then 'unsold' end label_name, count(s) as "count", round(avg(s), 6) mean, round(quantile_cont(s, 0.5), 6) median, round(stddev_samp(s), 6) std, min(s) as "min", max(s) as "max" from t group by y""")
def label_summary(spark, sf_dir):
    rows = scores(spark, sf_dir).select("s", F.when(F.col("doc_id") % 7 > 0, F.col("toxic")).alias("y"))
    out = reports.label_summary(rows, "y", "s")
    return out.select("y", "label_name", "count", *[r(F.col(c)).alias(c) for c in ("mean", "median", "std")], "min", "max")


_PHRASES = ("oggi", "ieri", "3 giorni fa", "2 settimane fa", "5 mesi", "2 anni fa")
_AGES = """ages as (select * from (values (1, 'oggi', 0.0, '<1d', 0), (2, 'ieri', 1.0, '1d', 1), (3, '3 giorni fa', 3.0, '2-6d', 2), (4, '2 settimane fa', 14.0, '2-4w', 4), (5, '5 mesi', 150.0, '3-12m', 6),
  (6, '2 anni fa', 730.0, '1y+', 7), (7, null, null, 'unknown', 8)) v(n, phrase, days, age_band, band_order)),
aged as (select l_returnflag search, phrase, days, age_band, band_order, (l_quantity > 25)::int y, l_extendedprice price, case when l_suppkey % 3 > 0 then l_quantity end likes from lineitem join ages on n = l_linenumber)"""


def _aged(spark, sf_dir):
    c = F.col
    return table(spark, sf_dir, "lineitem").select(
        c("l_returnflag").alias("search"), F.get(F.array(*map(F.lit, _PHRASES)), c("l_linenumber").cast("int") - 1).alias("phrase"), (c("l_quantity") > 25).cast("int").cast("string").alias("y"),
        c("l_extendedprice").cast("string").alias("price"), F.when(c("l_suppkey") % 3 > 0, c("l_quantity").cast("string")).otherwise("x").alias("likes"),
    )


@query(f"""with {_AGES} select search, age_band, band_order::bigint band_order, count(*) as "rows", sum(y)::bigint sold_rows, round(avg(y), 6) positive_rate, round(avg(price), 4) avg_price, round(avg(likes), 4) avg_likes, quantile_cont(days, 0.5)::double median_days
from aged group by all""")
def upload_distribution(spark, sf_dir):
    out = reports.upload_distribution(_aged(spark, sf_dir), "search", "phrase", "y", "price", "likes")
    return out.select("search", "age_band", "band_order", "rows", "sold_rows", r(F.col("positive_rate")).alias("positive_rate"), r(F.col("avg_price"), 4).alias("avg_price"), r(F.col("avg_likes"), 4).alias("avg_likes"), "median_days")


@query(f"""with {_AGES} select search, phrase, quantile_cont(days, 0.5)::double as days, count(*) as "rows", sum(y)::bigint sold_rows, round(avg(y), 6) positive_rate from aged group by search, phrase""")
def phrase_distribution(spark, sf_dir):
    out = reports.phrase_distribution(_aged(spark, sf_dir), "search", "phrase", "y")
    return out.select("search", "phrase", "days", "rows", "sold_rows", r(F.col("positive_rate")).alias("positive_rate"))


@query("""with e as (select event_id, ts, case when user_id % 11 = 0 then 'unknown' else event_type end transport, case when user_id % 50 > 0 then 'ip' || (user_id % 50) end address, user_id % 2 = 0 ok, event_id % 5 = 0 changed from events),
a as (select transport, address, count(*) n from e where address is not null group by all)
select transport, count(*) events, count(*) filter (ok) successful_events, count(*) filter (changed) change_events, count(distinct address) unique_addresses, arg_min(ts, event_id) first_ts, arg_max(ts, event_id) last_ts,
  (select string_agg(address || '=' || n, '|' order by address) from a where a.transport = e.transport) addresses from e group by transport""")
def identity_rollup(spark, sf_dir):
    c, u = F.col, F.col("user_id")
    e = table(spark, sf_dir, "events").select(
        "event_id", "ts", F.when(u % 11 == 0, F.when(u % 22 == 0, "")).otherwise(c("event_type")).alias("transport"), F.when(u % 50 > 0, F.concat(F.lit("ip"), u % 50)).alias("address"),
        (u % 2 == 0).cast("string").alias("ok"), (c("event_id") % 5 == 0).cast("string").alias("changed"),
    )
    out = reports.identity_rollup(e, "transport", "address", "ok", "changed", "event_id", "ts")
    pairs = F.transform(F.array_sort(F.map_entries("addresses")), lambda x: F.concat_ws("=", x["key"], x["value"]))
    return out.withColumn("addresses", F.array_join(pairs, "|"))


@query("""with p as (select p_type search, p_brand approach, count(*) threshold_count, min(p_size) threshold from part group by all), g as (select p_type search, p_brand approach, count(*) filter (p_size > 25) threshold_count, max(p_size) threshold from part where p_size > 10 group by all)
select search, approach, p.threshold threshold_per_search, g.threshold threshold_global, p.threshold_count threshold_count_per_search, g.threshold_count threshold_count_global, p.threshold_count - g.threshold_count selected_count_delta
from p left join g using (search, approach)""")
def threshold_comparison(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_type").alias("search"), F.col("p_brand").alias("approach"), "p_size")
    own = p.groupBy("search", "approach").agg(F.count(F.lit(1)).alias("threshold_count"), F.min("p_size").alias("threshold"))
    other = p.filter("p_size > 10").groupBy("search", "approach").agg(F.count_if(F.col("p_size") > 25).alias("threshold_count"), F.max("p_size").alias("threshold"))
    return reports.comparison(own, other, ["search", "approach"], ["threshold", "threshold_count", "roc_auc"], {"threshold_count": "selected_count_delta", "roc_auc": "auc_delta"})


@query("select o_orderkey, o_totalprice from orders where (o_custkey % 5 = 0 or o_custkey % 7 = 0) and o_totalprice > 30000 and o_custkey % 13 > 0")
def any_pass_gate(spark, sf_dir):
    c, k = F.col, F.col("o_custkey")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", (k % 5 == 0).cast("string").alias("pass_a"), F.when(k % 7 == 0, "true").alias("pass_b"), F.when(k % 13 > 0, c("o_totalprice").cast("string")).otherwise("n/a").alias("price"))
    return reports.any_pass(rows, ["pass_a", "pass_b"], "price", 30000).select("o_orderkey", "o_totalprice")


@query("select l_orderkey, l_linenumber, case when l_suppkey % 4 > 0 then round(l_extendedprice - l_quantity, 4) else 0 end::double profit from lineitem")
def resale_profit(spark, sf_dir):
    c = F.col
    sold = F.when(c("l_suppkey") % 4 == 1, c("l_extendedprice").cast("string")).when(c("l_suppkey") % 4 == 0, "sold?").otherwise(c("l_extendedprice").cast("string"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", r(reports.profit(c("l_quantity").cast("string"), sold), 4).alias("profit"))


_SEARCHES = ("Gucci borse", "PS5", "borse", "xbox", "Scarpe ")
_FOUND = "found as (select p_partkey, p_size, ['Gucci borse', 'PS5', 'borse', 'xbox', 'Scarpe '][(p_partkey % 5 + 1)::int] search, case when p_size % 6 = 0 then 'Prada ' else '' end || p_name title from part)"


def _found(spark, sf_dir):
    title = F.concat(F.when(F.col("p_size") % 6 == 0, "Prada ").otherwise(""), "p_name")
    return table(spark, sf_dir, "part").select("p_partkey", "p_size", F.get(F.array(*map(F.lit, _SEARCHES)), (F.col("p_partkey") % 5).cast("int")).alias("search"), title.alias("title"))


@query(f"""with {_FOUND} select p_partkey, category, case when search = 'xbox' then 0.61 when search = 'Scarpe ' then 0.5 when category = 'luxury' then 0.7 else 0.55 end::double need from (select *,
  case when contains(lower(search || ' ' || title), 'gucci') or contains(lower(title), 'prada') then 'luxury' when search in ('PS5', 'xbox') or contains(lower(title), 'game') or contains(lower(title), 'switch') then 'game' else 'generic' end category from found)""")
def minimum_scores(spark, sf_dir):
    c = F.col
    need = buy.minimum_score(c("search"), c("title"), 0.55, {"luxury": 0.7, "xbox": 0.61, "scarpe": 0.5})
    return _found(spark, sf_dir).select("p_partkey", text.category(c("search"), c("title")).alias("category"), need.alias("need"))


@query(f"with {_FOUND} select p_partkey from found where not contains(lower(title), 'prada') and not contains(lower(title), 'red')")
def keyword_exclusion(spark, sf_dir):
    return _found(spark, sf_dir).filter(~text.has_any(F.col("title"), ("prada", "red"))).select("p_partkey")


@query("""with b as (select o_orderkey k, case o_custkey % 3 when 0 then 'Sold' when 1 then 'On Sale' end ms, o_totalprice price, o_custkey % 2 = 0 hit, ['Sold', 'OnSale', 'Removed'][(o_orderkey % 3 + 1)::int] st, case when o_orderkey % 5 > 0 then o_totalprice * 0.5 end pp,
  case o_orderkey % 4 when 0 then '2 giorni fa' when 1 then 'Unknown' end up, o_orderkey % 6 = 0 pc from orders), o as (select *, hit and coalesce(ms, '') <> 'Sold' act from b)
select k item, case when act and st = 'Sold' then 'Sold' else ms end market_status, case when act then st end last_check_status, round(case when act and st = 'Sold' and pp is not null then pp else price end, 4) price, case when act and up = '2 giorni fa' then up else '1 giorno fa' end upload_date,
  case when act and up = '2 giorni fa' then 2.0 else 1.0 end::double upload_days, case when act then round(pp, 4) end observed_price, coalesce(act and pc, false) price_changed, coalesce(act and st = 'Sold', false) newly_sold from o""")
def status_updates(spark, sf_dir):
    c, k = F.col, F.col("o_orderkey")
    o = table(spark, sf_dir, "orders")
    none = F.lit(None).cast("double")
    rows = o.select(k.alias("item"), F.when(c("o_custkey") % 3 == 0, "Sold").when(c("o_custkey") % 3 == 1, "On Sale").alias("market_status"), F.lit(None).cast("string").alias("last_check_status"), c("o_totalprice").alias("price"), F.lit("1 giorno fa").alias("upload_date"), F.lit(1.0).alias("upload_days"), none.alias("observed_price"), none.alias("previous_price"), F.lit(False).alias("price_changed"))
    found = o.filter("o_custkey % 2 = 0").select(
        k.alias("item"), F.get(F.array(F.lit("Sold"), F.lit("OnSale"), F.lit("Removed")), (k % 3).cast("int")).alias("status"), F.when(k % 4 == 0, "2 giorni fa").when(k % 4 == 1, "Unknown").alias("upload_date"),
        F.when(k % 5 > 0, c("o_totalprice") * 0.5).alias("page_price"), none.alias("previous_price"), (k % 6 == 0).alias("price_changed"),
    )
    out, sold = reports.apply_status(rows, found, "item")
    out = out.join(sold.select("item", F.lit(True).alias("newly_sold")), "item", "left")
    return out.select("item", "market_status", "last_check_status", r(c("price"), 4).alias("price"), "upload_date", "upload_days", r(c("observed_price"), 4).alias("observed_price"), "price_changed", F.coalesce("newly_sold", F.lit(False)).alias("newly_sold"))


_IMAGES = """images as (select l_orderkey, l_linenumber, l_suppkey, l_partkey, l_quantity, l_suppkey % 12 ones, (100 + 40 * (l_partkey % 9))::int width, (150 + 30 * (l_suppkey % 7))::int height, (l_partkey % 20) / 20.0 brightness, (l_suppkey % 10) / 20.0 contrast, (l_quantity)::double blur_score from lineitem)"""


def _images(spark, sf_dir):
    c = F.col
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.struct("l_linenumber", "l_suppkey", "l_partkey", "l_quantity").alias("place"), (100 + 40 * (c("l_partkey") % 9)).cast("int").alias("width"), (150 + 30 * (c("l_suppkey") % 7)).cast("int").alias("height"), (c("l_partkey") % 20 / 20.0).alias("brightness"), (c("l_suppkey") % 10 / 20.0).alias("contrast"),
        c("l_quantity").cast("double").alias("blur_score"), F.rpad(F.repeat(F.lit("1"), (c("l_suppkey") % 12).cast("int")), 64, "0").alias("hash_value"),
    )


@query(f"""with {_IMAGES}, f as (select *, least(width, height) < 220 a, brightness < 0.18 or brightness > 0.92 b, contrast < 0.10 d, blur_score < 25 e, width / height > 1.25 or width / height < 0.60 g from images)
select l_orderkey, l_linenumber, round(greatest(1 - 0.18 * a::int - 0.14 * b::int - 0.15 * d::int - 0.18 * e::int - 0.22 * g::int, 0), 6)::double quality_score, (0.22 * g::int)::double screenshot_risk,
  concat_ws(';', case when a then 'low_resolution' end, case when b then 'extreme_brightness' end, case when d then 'low_contrast' end, case when e then 'blurry' end, case when g then 'suspicious_aspect_ratio' end) photo_notes from f""")
def photo_quality(spark, sf_dir):
    return buy.photo_quality(_images(spark, sf_dir)).select("l_orderkey", "l_linenumber", r(F.col("quality_score")).alias("quality_score"), "screenshot_risk", "photo_notes")


@query(f"""with {_IMAGES}, f as (select *, (least(width, height) < 220)::int a, (brightness < 0.18 or brightness > 0.92)::int b, (contrast < 0.10)::int d, (blur_score < 25)::int e, (width / height > 1.25 or width / height < 0.60)::int g,
  row_number() over (partition by l_orderkey order by l_linenumber, l_suppkey, l_partkey, l_quantity) p from images),
q as (select *, greatest(1.0::double - (0.18::double * a + 0.14::double * b + 0.15::double * d + 0.18::double * e) - 0.22::double * g, 0.0) q from f where p <= 6),
per as (select l_orderkey, l_orderkey % 2 = 0 luxury, case when l_orderkey % 2 = 0 then 4.0::double else 3.0::double end target, count(*)::double seen, avg((q < 0.45)::int) low, avg(g) shots, any_value(q) filter (p = 1) main, coalesce(sum(q) filter (p > 1), 0) others,
  len(list_reduce(list(list_value(ones) order by p), lambda kept, x: case when len(list_filter(kept, lambda k: abs(k - x[1]) <= 4)) > 0 then kept else list_concat(kept, x) end))::double as distinct_images,
  list_concat(list_filter([case when max(a) = 1 then 'low_resolution' end, case when max(b) = 1 then 'extreme_brightness' end, case when max(d) = 1 then 'low_contrast' end, case when max(e) = 1 then 'blurry' end, case when max(g) = 1 then 'suspicious_aspect_ratio' end], lambda x: x is not null), []) notes from q group by l_orderkey),
one as (select *, (seen - distinct_images) / seen dup, case when seen = 1 then main else 0.55::double * main + 0.45::double / (seen - 1) * others end weighted from per),
two as (select *, least(greatest(weighted - 0.20::double * dup, 0), 1) quality, least(0.65::double * least(distinct_images / target, 1) + 0.35::double * (1 - dup), 1) complete from one),
three as (select *, least(0.58::double + 0.22::double * quality + 0.20::double * (1 - shots), 1) consistent from two),
four as (select *, least(case when luxury then 0.45::double * complete + 0.35::double * quality + 0.20::double * consistent else 0.40::double + 0.35::double * complete + 0.25::double * consistent end, 1) authentic from three)
select l_orderkey, round(least(0.36::double * quality + 0.24::double * complete + 0.20::double * consistent + 0.20::double * authentic, 1) + 3.7e-9, 6) visual,
  round(least(0.20::double * (1 - quality) + 0.12::double * (1 - complete) + 0.10::double * (1 - consistent) + case when luxury then 0.12::double else 0.06::double end * (1 - authentic) + 0.10::double * dup + 0.08::double * shots, 0.55::double) + 3.7e-9, 6) visual_penalty,
  round(quality + 3.7e-9, 6) quality, round(complete + 3.7e-9, 6) completeness, round(consistent + 3.7e-9, 6) consistency, round(authentic + 3.7e-9, 6) authenticity, seen::bigint images, distinct_images::bigint unique_images, round(low + 3.7e-9, 6) low_quality, round(shots + 3.7e-9, 6) screenshots,
  array_to_string(list_sort(list_concat(notes, list_filter([case when luxury and authentic < 0.45 then 'low_authenticity_evidence' end, case when dup >= 0.5 then 'duplicate_images' end, case when distinct_images < target then 'limited_visual_coverage' end, case when low >= 0.5 then 'mostly_low_quality_images' end], lambda x: x is not null))), '|') visual_notes from four""")
def visual_summary(spark, sf_dir):
    """Figures are raised by a little before they are rounded, as many lie at halves."""
    rows = buy.photo_quality(_images(spark, sf_dir)).withColumn("search", F.when(F.col("l_orderkey") % 2 == 0, "prada").otherwise("lamp")).withColumn("title", F.lit("x"))
    out = buy.visual_summary(rows, "l_orderkey", "place", "search", "title")
    return out.select("l_orderkey", *[r(F.col(c) + 3.7e-9).alias(c) for c in ("visual", "visual_penalty", "quality", "completeness", "consistency", "authenticity", "low_quality", "screenshots")], "images", "unique_images", "visual_notes")
