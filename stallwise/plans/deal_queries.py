"""Pricing analytics, ranked deals and the buy decision."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import coerce, text
from ..operators import buy, deals, resolve
from .adapters import LISTING, LISTING_ORDER, ORDER, listing, query, r, table


_STATS = """first as (select brand, search, count(*) n, quantile_cont(price, 0.25) q25, quantile_cont(price, 0.5) med, quantile_cont(price, 0.75) q75 from listing where price > 0 group by all),
stats as (select brand, search, any_value(n) n, any_value(q25) q25, any_value(med) med, any_value(q75) q75, quantile_cont(abs(price - med), 0.5) mad from listing join first using (brand, search) where price > 0 group by all)"""


@query(f"with {LISTING}, {_STATS} select brand, search, n, round(med, 6) med, round(q25, 6) q25, round(q75, 6) q75, round(mad, 6) mad from stats")
def price_stats(spark, sf_dir):
    s = deals.price_stats(listing(spark, sf_dir), ["brand", "search"], "price")
    return s.select("brand", "search", "n", r(F.col("med")).alias("med"), r(F.col("q25")).alias("q25"), r(F.col("q75")).alias("q75"), r(F.col("mad")).alias("mad"))


def _items(spark, sf_dir):
    """The latest snapshot of each item with its group's statistics and its title's similarity to the group's. A group stands for a variant here, so there is no silhouette (see listing_deals)."""
    rows = listing(spark, sf_dir)
    counts = rows.groupBy("item_id").agg(F.count(F.lit(1)).alias("snapshots"), F.max_by(F.struct(*[c for c in rows.columns if c != "item_id"]), F.struct(*ORDER)).alias("row"))
    items = counts.select("item_id", "snapshots", "row.*")
    stats = deals.price_stats(rows, ["brand", "search"], "price")
    c = F.col
    items = items.withColumn("norm", text.normalise(c("title"))).withColumn("words", text.tokens(c("norm")))
    near = resolve.token_similarity(items, ["brand", "search"], "item_id", "words").withColumnRenamed("similarity", "centroid_sim")
    joined = items.join(stats, ["brand", "search"]).join(near, "item_id", "left").withColumn("z", deals.deal_z(c("price"), c("n"), c("med"), c("mad")))
    joined = joined.withColumn("informative", F.size(text.informative_tokens(c("norm"), c("brand")))).withColumn("has_code", F.size(text.model_codes(c("norm"))) > 0)
    return joined.select("*", (F.size(text.negative_flags(c("norm"))) > 0).alias("negative"), text.is_generic(c("informative"), c("has_code")).alias("generic"), F.lit(None).cast("double").alias("silhouette"))


_ITEMS = f"""{LISTING}, {_STATS},
latest as (select * from (select *, row_number() over (partition by item_id order by {LISTING_ORDER.replace(',', ' desc,')} desc) k, count(*) over (partition by item_id) snapshots from listing) where k = 1),
neg as (select unnest(['replica','fake','falso','tarocco','ispirato','inspired','like','stile','lotto','bundle','stock','solo scatola','scatola','dustbag','ricambio','solo','rovinato','strappato','macchia','difetto','da riparare','rott','kids','bambino','bimbi','ragazzo','ragazza']) w),
gen as (select ['the','with','and','pour','avec','game','games','gioco','giochi','jeu','juego','ps4','playstation','borsa','bag','sac','purse','wallet','portafoglio','scarf','prada','gucci','no','brand','uomo','donna','woman','man'] g),
items as (select l.*, s.n, s.q25, s.med, s.q75, s.mad, case when s.n >= 3 then (s.med - l.price) / (1.4826 * s.mad + 1e-6) end z, trim(regexp_replace(strip_accents(lower(trim(l.title))), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) norm,
  trim(regexp_replace(strip_accents(lower(trim(l.brand))), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) bnorm, g from latest l join stats s using (brand, search), gen),
flagged as (select *, exists (select 1 from neg where contains(norm, w)) negative, len(regexp_extract_all(norm, '\\b[a-z]{{1,4}}\\d{{2,6}}\\b|\\b\\d{{2,4}}\\b')) > 0 has_code,
  len(list_filter(list_distinct(regexp_extract_all(norm, '[a-z0-9]+')), lambda x: length(x) > 1 and not list_contains(g, x) and not list_contains(regexp_extract_all(bnorm, '[a-z0-9]+'), x) and not regexp_matches(x, '^\\d+$'))) informative from items),
tok as (select item_id, brand, search, unnest(list_distinct(list_filter(regexp_extract_all(norm, '[a-z0-9]+'), lambda x: length(x) > 1))) w from flagged),
cnt as (select brand, search, w, count(*) c from tok group by all),
sim as (select item_id, sum(c) / (sqrt(count(*)) * any_value(q)) sim from tok join cnt using (brand, search, w) join (select brand, search, sqrt(sum(c * c)) q from cnt group by all) using (brand, search) group by item_id),
priced as (select *, greatest(least(med * 0.95, q75), q25) est, greatest(least(med * 0.95, q75), q25) * 0.9 - price profit, mad / med - 0.25 dr, informative <= 1 and not has_code generic, null::double sil, 0.55 - sim cen from flagged left join sim using (item_id)),
ruled as (select *, profit / price margin, informative < 2 and not has_code unsure from priced),
summed as (select *,
  (case when negative then 0.6 else 0 end) + (case when generic then 1.1 else 0 end) + (case when unsure and not generic then 0.5 else 0 end) + (case when dr > 0 then least(1.0, 4 * dr) else 0 end) + (case when sil > 0 then least(0.8, 2 * sil) else 0 end) + (case when cen > 0 then least(0.8, 2 * cen) else 0 end) + (case when price < 0.45 * med then 0.5 else 0 end) penalty,
  (case when negative then 0.20 else 0 end) + (case when generic then 0.35 else 0 end) + (case when unsure and not generic then 0.15 else 0 end) + (case when sil > 0 then least(0.30, 1.2 * sil) else 0 end) + (case when cen > 0 then least(0.25, 1.2 * cen) else 0 end) + (case when snapshots >= 3 then least(0.25, 0.05 * (snapshots - 2)) else 0 end) + (case when n < 8 then 0.35 else 0 end)
  + (case when dr > 0 then least(0.35, 1.5 * dr) else 0 end) + (case when price < 0.45 * med then 0.10 else 0 end) + (case when margin < 0.10 then 0.20 else 0 end) + (case when profit < 5.0 then 0.20 else 0 end) loss,
  n < 8 or dr > 0.2 or margin < 0.10 or profit < 5.0 or coalesce(sil > 0, false) or (generic and unsure) hard from ruled),
confident as (select *, least(greatest(1.0 - loss, 0.0), 1.0)::double confidence from summed),
scored as (select *, least(greatest((z - penalty) * confidence, -10.0), 10.0) raw from confident),
final as (select *, coalesce(raw is not null and confidence >= 0.55 and not hard, false) eligible,
  least(greatest(100 * confidence * (0.4 * coalesce(least(greatest(z / 6, 0), 1), 0) + 0.4 * coalesce(least(greatest(margin / 0.3, 0), 1), 0) + 0.2 * coalesce(least(greatest(profit / 20, 0), 1), 0)), 0), 100) safety from scored)"""


@query(f"with {_ITEMS} select item_id, round(est, 6) expected_resale, round(profit, 6) profit, round(margin, 6) margin, round(confidence, 6) confidence, eligible, round(case when eligible then raw end, 6) score, round(safety, 6)::double safety from final")
def deal_scores(spark, sf_dir):
    s = deals.scored(_items(spark, sf_dir))
    return s.select("item_id", *[r(F.col(c)).alias(c) for c in ("expected_resale", "profit", "margin", "confidence")], "eligible", r(F.col("score")).alias("score"), r(F.col("safety")).alias("safety"))


@query(f"with {_ITEMS} select item_id, brand, search, price, round(raw, 6) score, round(safety, 6)::double safety from final where eligible and raw is not null and n >= 4")
def ranked_deals(spark, sf_dir):
    """Flagship: latest snapshots, robust statistics, scores, eligibility; in rank order."""
    out = deals.ranked(deals.scored(_items(spark, sf_dir)), deals.DealRules(), "item_id")
    return out.select("item_id", "brand", "search", "price", r(F.col("score")).alias("score"), r(F.col("safety")).alias("safety"))


@query(f"""with {LISTING}, {_STATS},
tok as (select brand, search, l_orderkey, page, list_distinct(list_filter(regexp_extract_all(trim(regexp_replace(strip_accents(lower(trim(title))), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), '[a-z0-9]+'), lambda x: length(x) > 1)) ws from listing),
sizes as (select brand, search, count(*) size from tok group by all),
core as (select brand, search, list(w) core from (select brand, search, w, count(*) c from (select brand, search, unnest(ws) w from tok) group by all) join sizes using (brand, search) where c / size >= 0.7 group by all),
rate as (select brand, search, avg((len(list_filter(ws, lambda w: not coalesce(list_contains(core, w), false))) = 0)::int) e, avg(case when len(ws) = 0 and len(coalesce(core, [])) = 0 then 1.0 when len(ws) = 0 or len(coalesce(core, [])) = 0 then 0.0
  else len(list_intersect(ws, core)) / len(list_distinct(list_concat(ws, core))) end) u from tok left join core using (brand, search) group by all)
select search, brand, round(u, 6) uniformity, round(e, 6) empty_rate, case when e > 0.55 then 0.60 when e > 0.40 then 0.65 when e < 0.15 then 0.78 else 0.70 end::double core_frac, case when m >= 0.22 then 0.55 when m >= 0.14 then 0.45 when m <= 0.06 then 0.25 else 0.35 end::double price_weight, case when m >= 0.22 then 0.30 when m >= 0.14 then 0.31 when m <= 0.06 then 0.36 else 0.33 end::double variant_threshold from (select search, brand, mad / med m, e, u from stats join rate using (brand, search))""")
def autotune(spark, sf_dir):
    """Uniformity of titles, share of empty variant texts, and what follows from it and the prices' spread, by brand and search."""
    rows = listing(spark, sf_dir).withColumn("group", F.struct("brand", "search")).withColumn("words", text.tokens(text.normalise(F.col("title"))))
    s = deals.price_stats(rows, ["group"], "price").join(resolve.empty_rates(rows, "group", "words"), "group").join(resolve.uniformity(rows, "group", "words"), "group")
    tuned = deals.autotune(F.col("empty_rate"), F.col("mad") / F.col("med"))
    return s.select("group.search", "group.brand", r(F.col("uniformity")).alias("uniformity"), r(F.col("empty_rate")).alias("empty_rate"), *[v.cast("double").alias(k) for k, v in tuned.items()])


@query()
def listing_deals(spark, sf_dir):
    """The whole way: the latest snapshot of each supplier's listing of a part goes through blocks, products, variants and prices to a score; held to a plain computation in the tests."""
    rows = listing(spark, sf_dir).repartition("item_id", "supplier")  # else the aggregate sorts all rows before its shuffle and after
    latest = rows.groupBy("item_id", "supplier").agg(F.count(F.lit(1)).alias("snapshots"), F.max_by(F.struct("title", "brand", "price"), F.struct(*ORDER)).alias("row"))
    rows = resolve.listings(latest.select(F.concat_ws("-", "item_id", "supplier").alias("id"), "snapshots", "row.*"), "id", "title", "brand", "price", "snapshots")
    out = resolve.kind_deals(resolve.kinds(rows))  # numbers are rounded once a kind
    names = ["product_id", "variant_id", "variant_text", "variant_count", "similarity", "product_silhouette", "z", "expected_resale", "profit", "confidence", "score", "safety", "eligible", "notes"]
    out = out.select(*resolve.KIND, *[r(F.col(c)).alias(c) if c in names[4:12] else F.col(c) for c in names])
    return resolve.of_each(rows, out).select("item", *names)


@query(f"with {LISTING} select search, count(*) n, count(distinct item_id) items, min(price) low, round(quantile_cont(price, 0.5), 6) med, max(price) high, mode(brand order by brand) brand, round(avg((page > 3)::int), 6) rate from (select * from listing order by brand) group by search".replace("mode(brand order by brand) brand, ", ""))
def group_summary(spark, sf_dir):
    return listing(spark, sf_dir).groupBy("search").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("item_id").alias("items"), F.min("price").alias("low"), r(F.percentile("price", 0.5)).alias("med"), F.max("price").alias("high"), r(F.avg((F.col("page") > 3).cast("int"))).alias("rate")
    )


_BUY = """b as (select l_orderkey, l_linenumber, l_suppkey, l_partkey, l_extendedprice, l_quantity, (l_partkey % 60)::double stars, (l_suppkey % 12)::double reviews, (l_orderkey % 15)::double interested, (l_orderkey % 90)::double views, (l_partkey % 40)::double upload_days,
  ['Nuovo con cartellino', 'new', 'Very good', 'good', 'poor', 'unknown', 'x'][(l_partkey % 7 + 1)::int] as condition, ['ok', 'replica, broken', 'graffi e bundle', 'no box'][(l_suppkey % 4 + 1)::int] description, (l_orderkey % 101)::double safety, (l_partkey % 50 - 5)::double profit, (l_suppkey % 13 - 2)::double / 20 margin from lineitem)"""


def _buy_rows(spark, sf_dir):
    c = F.col
    pick = lambda names, n: F.get(F.array(*map(F.lit, names)), n.cast("int"))
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice", "l_quantity", *[(c(k) % n).cast("double").alias(a) for a, k, n in (("stars", "l_partkey", 60), ("reviews", "l_suppkey", 12), ("interested", "l_orderkey", 15), ("views", "l_orderkey", 90), ("upload_days", "l_partkey", 40), ("safety", "l_orderkey", 101))],
        pick(("Nuovo con cartellino", "new", "Very good", "good", "poor", "unknown", "x"), c("l_partkey") % 7).alias("condition"), pick(("ok", "replica, broken", "graffi e bundle", "no box"), c("l_suppkey") % 4).alias("description"),
        (c("l_partkey") % 50 - 5).cast("double").alias("profit"), ((c("l_suppkey") % 13 - 2).cast("double") / 20).alias("margin"), *[F.lit(None).cast("double").alias(n) for n in ("score", "confidence", "visual", "visual_penalty")],
    )


@query(f"""with {_BUY},
s as (select *, case when stars > 50 then null when stars > 5 then stars / 10 else stars end st from b),
p as (select *, (reviews > 0) rev, least(ln(1 + reviews) / ln(51.0), 1.0) rc from s),
c as (select *, case when rev and st is not null then st / 5 * (0.70 + 0.30 * rc) when not rev and st is null then 0.35 else 0.20 + 0.15 * rc end seller,
  0.6 * least(interested / 10, 1) + 0.4 * (case when views > 0 then least(interested / views / 0.15, 1) when interested > 0 then 0.5 else 0 end) demand,
  case when upload_days <= 1 then 1.0 when upload_days <= 3 then 0.9 when upload_days <= 7 then 0.75 when upload_days <= 14 then 0.55 when upload_days <= 30 then 0.35 else 0.15 end fresh,
  case condition when 'Nuovo con cartellino' then 1.0 when 'new' then 0.9 when 'Very good' then 0.82 when 'good' then 0.68 when 'poor' then 0.2 when 'unknown' then 0.6 else 0.55 end cond,
  description = 'replica, broken' hard, (case description when 'graffi e bundle' then 2 when 'no box' then 1 else 0 end) + (condition = 'poor')::int soft from p),
t as (select *, 0.34 * least(safety / 100, 1) + 0.18 * least(greatest(profit / 40, 0), 1) + 0.14 * least(greatest(margin / 0.5, 0), 1) + 0.14 * seller + 0.08 * demand + 0.06 * fresh + 0.06 * cond total,
  (case when hard then 0.55 else 0 end) + (case when soft > 0 then least(0.25, 0.06 * soft) else 0 end) + (case when seller < 0.30 then 0.20 else 0 end) + (case when cond < 0.35 then 0.20 else 0 end) + (case when margin < 0.10 then 0.18 else 0 end) + (case when profit < 8 then 0.12 else 0 end) pen from c)
select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, round(least(greatest(total - pen, 0), 1), 6)::double buy_score, least(greatest(total - pen, 0), 1) >= 0.55 and not hard worth_buying,
  concat_ws(';', case when hard then 'hard_description_risk' end, case when soft > 0 then 'description_or_condition_risk' end, case when not rev and st is null then 'new_unreviewed_seller' when not (rev and st is not null) then 'seller_metrics_incomplete' end, case when seller < 0.30 then 'weak_seller_profile' end,
    case when cond < 0.35 then 'poor_condition' end, case when margin < 0.10 then 'thin_expected_margin' end, case when profit < 8 then 'thin_expected_profit' end, case when hard then 'hard:replica|broken' end,
    case when soft > 0 then 'soft:' || concat_ws('|', case when description = 'graffi e bundle' then 'bundle|graffi' when description = 'no box' then 'no box' end, case when condition = 'poor' then 'poor' end) end) buy_notes from t""")
def buy_decisions(spark, sf_dir):
    out = buy.decide(_buy_rows(spark, sf_dir))
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", r(F.col("buy_score")).alias("buy_score"), "worth_buying", "buy_notes")


@query(f"with {_BUY}, q as (select *, case when l_quantity <= 30 or l_partkey % 9 = 0 then least(8.0, greatest(3.0, l_quantity * 0.28)) else 8.0 end need from b) select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, round(need, 6)::double need from q where profit >= need and safety >= 20 and margin >= 0.1")
def buy_candidates(spark, sf_dir):
    c = F.col
    need = buy.required_profit(c("l_quantity"), F.when(c("l_partkey") % 9 == 0, "PS4 games").otherwise("borse"), F.lit("item"))
    rows = _buy_rows(spark, sf_dir).withColumn("need", need).filter((c("profit") >= c("need")) & (c("safety") >= 20) & (c("margin") >= 0.1))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", r(c("need")).alias("need"))


@query(f"""with {_BUY}, g as (select * from (select unnest([0, 20, 40, 60, 80]) a), (select unnest([0, 5, 10, 20]) p), (select unnest([0.0, 0.1, 0.3]) m)),
x as (select *, l_quantity >= 25 y from b) select a::double min_safety, p::double min_profit, m::double min_margin, count(*) selected, sum(y::int)::bigint positives, round(sum(profit), 4) profit, round(avg(y::int), 6) as "precision" from g join x on safety >= a and x.profit >= p and margin >= m group by all""")
def rule_grid(spark, sf_dir):
    rows = _buy_rows(spark, sf_dir).withColumn("y", (F.col("l_quantity") >= 25).cast("int"))
    out = buy.rule_grid(rows, "y", "profit", {"safety": [0, 20, 40, 60, 80], "profit": [0, 5, 10, 20], "margin": [0.0, 0.1, 0.3]})
    return out.select("min_safety", "min_profit", "min_margin", "selected", "positives", r(F.col("profit"), 4).alias("profit"), r(F.col("precision")).alias("precision"))


@query(f"with {LISTING}, q as (select quantile_cont(price, 0.1) a, quantile_cont(price, 0.5) b, quantile_cont(likes, 0.9) l from listing) select item_id, l_orderkey, page, price, round(0.62 * least(greatest(1 - (price - a) / (b - a), 0), 1) + 0.23 * least(likes / greatest(l, 1), 1) + 0.15 * least(greatest(1 - (page - 1) / 9, 0), 1), 6)::double rule_score from listing, q")
def rule_scores(spark, sf_dir):
    return buy.rule_score(listing(spark, sf_dir), "price", "likes", "page").select("item_id", "l_orderkey", "page", "price", r(F.col("rule_score")).alias("rule_score"))


@query("""with p as (select p_partkey k, (p_partkey % 11 = 0)::int mi, (p_size % 5) / 4.0 lq, (p_size % 2) one, (p_size % 6)::double du, p_size / 200.0 co, p_size::double sh, p_retailprice / 5 pr, (p_partkey % 3 > 0)::int br, (p_partkey % 4 > 0)::int cn, p_size % 4 pics from part),
s as (select k, least(greatest(0.15 + 0.35 * lq + 0.15 * one + 0.10 * least(du / 3, 1) + 0.10 * (co < 0.10)::int + 0.10 * (sh < 25)::int + 0.20 * mi, 0), 1) bad, least(0.25 * br + 0.35 * least(greatest(1 - (pr - 20) / 180, 0), 1) + 0.15 * cn + 0.10 * (case when pics >= 2 then 1 else 0.25 end) + 0.15, 1) val, least(0.35 * mi + 0.10 * (1 - br) + 0.20 * (pr > 250)::int, 1) risk from p)
select k, round(bad, 9)::double bad_photo, round(val, 9)::double value_signal, round(risk, 9)::double risk_penalty, round(least(greatest(0.55 * bad + 0.35 * val - 0.25 * risk, 0), 1), 9)::double opportunity from s""")
def photo_scores(spark, sf_dir):
    c, k = F.col, F.col("p_partkey")
    size = c("p_size")
    made = buy.photo_scores((k % 11 == 0).cast("int"), size % 5 / 4.0, size % 2, (size % 6).cast("double"), size / 200.0, size.cast("double"), c("p_retailprice") / 5, (k % 3 > 0).cast("int"), (k % 4 > 0).cast("int"), size % 4)
    return table(spark, sf_dir, "part").select(k.alias("k"), *[r(v, 9).alias(n) for n, v in made.items()])


@query("select o_orderkey, least(greatest(o_totalprice / 100000, 0.25), 1.5) held, case when o_shippriority then 1 end dummy from (select *, false o_shippriority from orders)".replace(", case when o_shippriority then 1 end dummy", ""))
def clamped(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", coerce.clamp(F.col("o_totalprice") / 100000, 0.25, 1.5).alias("held"))


