"""Experiment metadata, synchronised states, rollups, sweeps and rule search."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import price
from ..operators import ml, tracking
from ..sources import pages
from .adapters import SCORES, query, r, scores, table

_RUNS = """runs as (select o_orderkey run_id, o_orderpriority family, o_orderdate created_at from orders), mets as (select l_orderkey run_id, l_shipmode_ search_name, l_returnflag approach, l_discount test_precision, case when l_linestatus = 'F' then 'trained' else 'skipped' end status, l_quantity >= 45 qualified, l_linenumber, l_suppkey, l_extendedprice from (select *, 's' || (l_suppkey % 4) l_shipmode_ from lineitem))"""


def _runs(spark, sf_dir):
    c = F.col
    runs = table(spark, sf_dir, "orders").select(c("o_orderkey").alias("run_id"), c("o_orderpriority").alias("family"), c("o_orderdate").cast("timestamp").alias("created_at"))
    mets = table(spark, sf_dir, "lineitem").select(
        c("l_orderkey").alias("run_id"), F.concat(F.lit("s"), (c("l_suppkey") % 4).cast("string")).alias("search_name"), c("l_returnflag").alias("approach"), c("l_discount").alias("test_precision"),
        F.when(c("l_linestatus") == "F", "trained").otherwise("skipped").alias("status"), (c("l_quantity") >= 45).alias("qualified"),
    )
    return runs, mets


@query(f"with {_RUNS} select r.run_id, m.approach, test_precision as value from runs r join mets m using (run_id) where m.status = 'trained' and search_name = 's1' order by value desc, r.run_id, m.approach limit 5")
def best_runs(spark, sf_dir):
    runs, mets = _runs(spark, sf_dir)
    return tracking.best_runs(runs, mets, "test_precision", 5, search="s1").select("run_id", "approach", "value")


@query(f"with {_RUNS} select r.run_id, r.family, m.approach, test_precision as value from runs r join mets m using (run_id) where m.status = 'trained' and search_name = 's2' and approach in ('A', 'R')")
def compare_approaches(spark, sf_dir):
    runs, mets = _runs(spark, sf_dir)
    return tracking.compare_approaches(runs, mets, "s2", "A", "R", "test_precision").select("run_id", "family", "approach", "value")


@query(f"with {_RUNS} select r.run_id, r.family, search_name, approach, test_precision from runs r join mets m using (run_id) where qualified")
def promotion_candidates(spark, sf_dir):
    return tracking.promotion_candidates(*_runs(spark, sf_dir)).select("run_id", "family", "search_name", "approach", "test_precision")


@query("""with o as (select o_orderkey k, o_totalprice p from orders where o_orderkey % 2 = 0), s as (select o_orderkey k, o_totalprice p from orders where o_orderkey % 5 = 0), n as (select o_orderkey k from orders where o_orderkey % 7 = 0),
c as (select o_orderkey k, o_totalprice + 1 p, case o_orderkey % 3 when 0 then 'Sold' when 1 then 'OnSale' else 'FetchFailed' end st from orders where o_orderkey % 11 = 0), d as (select k from c where st <> 'FetchFailed')
select 'old' part, k, p from o where k not in (select k from d) union all select 'old', k, p from c where st = 'OnSale' union all select 'sold', k, p from s where k not in (select k from c where st = 'Sold') union all select 'sold', k, p from c where st = 'Sold'
union all select 'not_really', k, null from (select k from n where k not in (select k from c where st = 'Sold') union select k from c where st = 'OnSale')""")
def synchronised(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("p"))
    st = F.when(F.col("k") % 3 == 0, "Sold").when(F.col("k") % 3 == 1, "OnSale").otherwise("FetchFailed")
    checked = o.filter("k % 11 = 0").select("k", (F.col("p") + 1).alias("p"), st.alias("st"))
    old, sold, noted = tracking.synchronised(o.filter("k % 2 = 0"), o.filter("k % 5 = 0"), o.filter("k % 7 = 0").select("k"), checked, "k", "st")
    part = lambda df, n: df.select(F.lit(n).alias("part"), "k", "p")
    return part(old, "old").unionByName(part(sold, "sold")).unionByName(part(noted.withColumn("p", F.lit(None).cast("double")), "not_really"))


@query("""select l_partkey, arg_min(l_returnflag, (l_shipdate, l_orderkey, l_linenumber, l_suppkey, l_extendedprice)) "first", round(quantile_cont(l_extendedprice, 0.5), 6) med, string_agg(distinct l_linestatus, '|' order by l_linestatus) states, bool_or(l_quantity > 49) big, max(l_discount) top from lineitem group by 1""")
def unique_items(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", F.col("l_returnflag").alias("first"), F.col("l_extendedprice").alias("med"), F.col("l_linestatus").alias("states"), (F.col("l_quantity") > 49).alias("big"), F.col("l_discount").alias("top"))
    out = tracking.unique_items(li, "l_partkey", ["l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice"], ["first"], ["med"], ["states"], ["big"], ["top"])
    return out.withColumn("med", r(F.col("med")))


_COHORT = "c as (select 's' || (user_id % 5) g, (event_id % 4)::int h, case when event_id % 3 = 0 then 'high_score_candidate' else 'low_score_control' end cohort, event_type <> 'error' ev, event_type = 'purchase' or event_id % 6 = 0 sold from events)"


@query(f"with {_COHORT}, n as (select g, h, count(*) filter (cohort = 'high_score_candidate' and ev and sold) high_sold, count(*) filter (cohort = 'low_score_control' and ev and not sold) low_unsold from c group by 1, 2) select *, greatest(high_sold - low_unsold, 0) deficit from n")
def cohort_deficits(spark, sf_dir):
    c, e = F.col, F.col("event_id")
    rows = table(spark, sf_dir, "events").select(F.concat(F.lit("s"), (c("user_id") % 5).cast("string")).alias("g"), (e % 4).cast("int").alias("h"), F.when(e % 3 == 0, "high_score_candidate").otherwise("low_score_control").alias("cohort"), (c("event_type") != "error").alias("ev"), ((c("event_type") == "purchase") | (e % 6 == 0)).alias("sold"))
    return tracking.cohort_deficits(rows, "g", "h", "cohort", c("ev"), c("sold"))


@query("""with b as (select (event_id % 3)::int h, (event_id % 101) / 100.0::double s1, (user_id % 97) / 96.0::double s2, event_type <> 'error' ev, event_type = 'purchase' sold from events), d as (select a::double a, b::double b from (select unnest([-0.1, 0.0, 0.1, 0.2]) a), (select unnest([-0.2, 0.0, 0.2]) b))
select h::int as "hours", a stage1_delta, b stage2_delta, count(*) evaluated_count, count(*) filter (sold) sold_count, round(count(*) filter (sold) / count(*), 6) as "precision" from b, d where ev and s1 >= 0.5::double + a and s2 >= 0.4::double + b group by 1, 2, 3""".replace("from b, d where", "from b bb, d where").replace("a stage1_delta, b stage2_delta", "d.a stage1_delta, d.b stage2_delta").replace("+ a and", "+ d.a and").replace("+ b group", "+ d.b group"))
def threshold_sweep(spark, sf_dir):
    c = F.col
    rows = table(spark, sf_dir, "events").select((c("event_id") % 3).cast("int").alias("h"), (c("event_id") % 101 / F.lit(100.0)).alias("s1"), (c("user_id") % 97 / F.lit(96.0)).alias("s2"), (c("event_type") != "error").alias("ev"), (c("event_type") == "purchase").alias("sold"))
    out = tracking.threshold_sweep(rows, "h", (c("s1"), F.lit(0.5)), (c("s2"), F.lit(0.4)), c("ev"), c("sold"), [-0.1, 0.0, 0.1, 0.2], [-0.2, 0.0, 0.2])
    return out.withColumn("precision", r(c("precision")))


@query("select v.vec_id, round((coalesce((ln(p) - avg(ln(p)) over w) / (stddev_pop(ln(p)) over w + 1e-6), 0)) * 0.35, 6) tail, len(embedding)::int + 1 size from (select vec_id, label, embedding, (vec_id % 50 + 1)::double p from embeddings) v window w as (partition by label)")
def variant_vectors(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").withColumn("p", (F.col("vec_id") % 50 + 1).cast("double"))
    out = tracking.variant_vectors(e, ["label"], "embedding", "p", F.lit(0.35))
    return out.select("vec_id", r(F.element_at("variant_vector", -1)).alias("tail"), F.size("variant_vector").alias("size"))


@query("with m as (select avg(l_quantity) a, avg(l_discount) b from lineitem), i as (select avg(abs(0.5 * (l_quantity - a))) x, avg(abs(-3.0 * (l_discount - b))) y from lineitem, m) select 'l_quantity' feature, round(x, 6) importance, round(x / (x + y), 6) share from i union all select 'l_discount', round(y, 6), round(y / (x + y), 6) from i")
def linear_importance(spark, sf_dir):
    out = tracking.linear_shap(table(spark, sf_dir, "lineitem"), {"l_quantity": 0.5, "l_discount": -3.0})
    return out.select("feature", r(F.col("importance")).alias("importance"), r(F.col("share")).alias("share"))


@query("select p_partkey k, case p_partkey % 4 when 0 then round(p_retailprice) + 2 when 1 then round(p_retailprice) when 2 then round(p_retailprice) else null end::double price from part")
def page_prices(spark, sf_dir):
    n = F.round("p_retailprice").cast("long")
    p, q = n.cast("string"), (n + 2).cast("string")
    k = F.col("p_partkey") % 4
    html = (
        F.when(k == 0, F.concat(F.lit("<p>"), p, F.lit(".00 € "), q, F.lit(".00 € incl. Buyer Protection</p>"))).when(k == 1, F.concat(F.lit('<meta property="product:price:amount" content="'), p, F.lit('.00">')))
        .when(k == 2, F.concat(F.lit('<script type="application/ld+json">{broken</script><script type="application/ld+json">{"@graph": [{"a": {"offers": {"price": 0}}}, {"deep": [[{"offers": [{"price": "none"}, {"price": "'), p, F.lit('.00"}]}]]}, {"offers": {"price": 1}}]}</script>'))).otherwise("<p>none</p>")
    )
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), html.alias("html")).select("k", price.page_price(F.col("html"), pages.offer_prices(F.col("html"))).alias("price"))


@query(f"""with {SCORES}, e as (select k, -ln((('0x' || substr(md5(k || '|0|42'), 1, 13))::bigint + 1) / 4503599627370496.0::double) a, -ln((('0x' || substr(md5(k || '|1|42'), 1, 13))::bigint + 1) / 4503599627370496.0::double) b from (select unnest(range(30000)) k)),
w as (select k, a / (a + b) a, b / (a + b) b from e), h as (select k, count(*) filter (s * a + toxic * b >= 0.5) n, coalesce(sum(y) filter (s * a + toxic * b >= 0.5), 0) p from w, scores group by k)
select k as rule, n selected, p::bigint positives, round(case when n > 0 then p / n end, 6)::double as precision from h""")
def weight_search(spark, sf_dir):
    rows = scores(spark, sf_dir).withColumn("t", F.col("toxic").cast("double"))
    return tracking.weight_search(rows, ["s", "t"], "y").select("rule", "selected", "positives", r(F.col("precision")).alias("precision"))


@query()
def wald_intervals(spark, sf_dir):
    rows = scores(spark, sf_dir).select(F.col("s"), F.log1p("n_chars").alias("n"), F.col("y").cast("double").alias("y"))
    return ml.wald(rows, ["s", "n"], "y")


@query(f"""with {SCORES}, r as (select doc_id, y, s, ln(1 + n_chars) n from scores), m as (select avg(s) filter (y = 0) s0, avg(s) filter (y = 1) s1, avg(n) filter (y = 0) n0, avg(n) filter (y = 1) n1 from r where doc_id % 5 > 0),
d as (select doc_id, sqrt((s - s0) ** 2 + (n - n0) ** 2) a, sqrt((s - s1) ** 2 + (n - n1) ** 2) b from r, m) select doc_id, round(case when a + b > 0 then a / (a + b) else 0.5 end, 6)::double score from d""")
def centroid_model(spark, sf_dir):
    rows = scores(spark, sf_dir).withColumn("n", F.log1p("n_chars"))
    return ml.centroid_scores(rows.filter("doc_id % 5 > 0"), rows, ["s", "n"], "y").select("doc_id", r(F.col("score")).alias("score"))


@query()
def student_scores(spark, sf_dir):
    """A student of one model's scores, from the text's length and label; every row is scored."""
    rows = scores(spark, sf_dir).select("doc_id", F.log1p("n_chars").alias("n"), F.col("y").cast("double").alias("y"), F.col("s").alias("teacher"), "search")
    out = ml.student(rows, rows, "teacher", numbers=["n", "y"], categories=["search"])
    return ml.student(rows, out, "teacher", 0.5, "passes", numbers=["n", "y"], categories=["search"]).select("doc_id", r(F.col("score")).alias("score"), r(F.col("passes")).alias("passes"))
