"""Identity, state, joins and set operations over the listing view."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import identity, splits, state
from .adapters import LISTING, LISTING_ORDER, NOW, ORDER, listing, query, r, table

_ROW = "item_id, ts, l_orderkey, page, price"


def _shaped(df):
    return df.select("item_id", "ts", "l_orderkey", "page", "price")


@query(f"with {LISTING} select {_ROW} from (select *, row_number() over (partition by item_id order by {LISTING_ORDER}) n from listing) where n = 1")
def dedupe_first(spark, sf_dir):
    return _shaped(identity.dedupe(listing(spark, sf_dir), ["item_id"], ORDER, "first"))


@query(f"with {LISTING} select {_ROW} from (select *, row_number() over (partition by item_id order by {LISTING_ORDER.replace(',', ' desc,')} desc) n from listing) where n = 1")
def dedupe_last(spark, sf_dir):
    return _shaped(identity.dedupe(listing(spark, sf_dir), ["item_id"], ORDER, "last"))


@query(f"with {LISTING} select {_ROW} from (select *, row_number() over (partition by item_id order by {LISTING_ORDER.replace(',', ' desc,')} desc) n from listing) where n = 1")
def latest_by_max(spark, sf_dir):
    return _shaped(identity.latest(listing(spark, sf_dir), ["item_id"], *ORDER))


@query("""
with c as (select c_custkey, case when c_custkey % 3 = 0 then null else c_nationkey end id, c_mktsegment link, c_acctbal from customer)
select * from (
  select c_custkey, id, link from (select *, row_number() over (partition by id order by c_acctbal, c_custkey) n from c where id is not null) where n = 1
  union all select c_custkey, id, link from (select *, row_number() over (partition by link order by c_acctbal, c_custkey) n from c where id is null) where n = 1)""")
def dedupe_id_or_link(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 != 0, F.col("c_nationkey")).alias("id"), F.col("c_mktsegment").alias("link"), "c_acctbal")
    return identity.dedupe_id_or_link(c, "id", "link", ["c_acctbal", "c_custkey"]).select("c_custkey", "id", "link")


@query("""
with c as (select c_custkey, case when c_custkey % 7 = 0 then ' ' else c_mktsegment || c_nationkey end k, c_acctbal from customer)
select c_custkey, k from (select *, row_number() over (partition by k order by c_acctbal, c_custkey) n from c) where n = 1 or k = ' '""")
def dedupe_keep_blank(spark, sf_dir):
    k = F.when(F.col("c_custkey") % 7 == 0, " ").otherwise(F.concat("c_mktsegment", F.col("c_nationkey").cast("string")))
    return identity.dedupe(table(spark, sf_dir, "customer").select("c_custkey", k.alias("k"), "c_acctbal"), ["k"], ["c_acctbal", "c_custkey"], blank="keep").select("c_custkey", "k")


@query(f"with {LISTING} select item_id, min(ts) first_seen, count(*) snapshots from listing group by item_id")
def first_seen(spark, sf_dir):
    return listing(spark, sf_dir).groupBy("item_id").agg(F.min("ts").alias("first_seen"), F.count(F.lit(1)).alias("snapshots"))


@query("select sum(n)::bigint as rows, sum(n)::bigint identity_rows, count(*) unique_keys, count(*) filter (n > 1) duplicate_groups, sum(n - 1)::bigint extra_rows, max(n) max_group from (select count(*) n from lineitem group by l_orderkey, l_linenumber)")
def duplicate_audit(spark, sf_dir):
    return identity.duplicate_audit(table(spark, sf_dir, "lineitem"), F.concat_ws("::", "l_orderkey", "l_linenumber"))


@query("select l_orderkey || '::' || l_linenumber as key, count(*) n from lineitem group by 1 having count(*) > 1 order by n desc, key limit 20")
def top_duplicates(spark, sf_dir):
    return identity.top_duplicates(table(spark, sf_dir, "lineitem"), F.concat_ws("::", "l_orderkey", "l_linenumber"), 20)


@query(f"with {LISTING} select search, item_id, price from (select *, row_number() over (partition by search order by price desc, {LISTING_ORDER}) n from listing) where n = 1")
def best_per_key(spark, sf_dir):
    return identity.best_per_key(listing(spark, sf_dir), ["search"], F.desc("price"), *[F.asc(c) for c in ORDER]).select("search", "item_id", "price")


@query("""select o_orderkey from orders where o_orderkey not in (select l_orderkey from lineitem where l_quantity >= 45) and o_custkey not in (select c_custkey from customer where c_acctbal < 0)""")
def anti_either(spark, sf_dir):
    known = table(spark, sf_dir, "lineitem").filter("l_quantity >= 45").select(F.col("l_orderkey").alias("o_orderkey"), F.lit(None).cast("long").alias("o_custkey"))
    known = known.unionByName(table(spark, sf_dir, "customer").filter("c_acctbal < 0").select(F.lit(None).cast("long").alias("o_orderkey"), F.col("c_custkey").alias("o_custkey")))
    return state.without_known(table(spark, sf_dir, "orders"), known, "o_orderkey", "o_custkey").select("o_orderkey")


_STATES = """old as (select o_orderkey k, o_orderdate d from orders where o_orderstatus in ('O', 'P') and o_orderkey % 2 = 0),
new as (select o_orderkey k, o_orderdate + interval 1 day d from orders where o_orderstatus = 'O' and o_orderkey % 3 = 0),
sold as (select o_orderkey k from orders where o_orderkey % 5 = 0), notreally as (select o_orderkey k from orders where o_orderkey % 7 = 0)"""


def _states(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderdate").alias("d"), "o_orderstatus")
    old = o.filter("o_orderstatus in ('O', 'P') and k % 2 = 0").select("k", "d")
    new = o.filter("o_orderstatus = 'O' and k % 3 = 0").select("k", (F.col("d") + F.expr("interval 1 day")).alias("d"))
    return old, new, o.filter("k % 5 = 0").select("k"), o.filter("k % 7 = 0").select("k")


@query(f"with {_STATES} select 'refreshed' part, old.k, max(new.d) d from old join new on old.k = new.k group by old.k union all select 'missing', k, d from old where k not in (select k from new) and k not in (select k from sold) and k not in (select k from notreally)")
def reconcile(spark, sf_dir):
    old, new, sold, notreally = _states(spark, sf_dir)
    refreshed, missing = state.reconcile(old, new, "k", sold, notreally, "d")
    return refreshed.select(F.lit("refreshed").alias("part"), "k", "d").unionByName(missing.select(F.lit("missing").alias("part"), "k", "d"))


@query(f"with {_STATES} select k, d, (k in (select k from sold union select k from notreally))::int sold from old")
def label_union(spark, sf_dir):
    old, _, sold, notreally = _states(spark, sf_dir)
    return state.labelled(old, "k", sold, notreally)


@query("""with s as (select distinct o_custkey k from orders where o_orderstatus = 'F'),
a as (select c_custkey k from customer where c_acctbal > 0), b as (select c_custkey k from customer where c_acctbal > 3000), c as (select c_custkey k from customer where c_acctbal > 3000 and c_mktsegment = 'BUILDING'),
j as (select s.k, a.k is not null ia, b.k is not null ib, c.k is not null ic from s left join a using (k) left join b using (k) left join c using (k))
select 'raw' stage, count(*) filter (ia) kept, count(*) filter (ia) / count(*) recall, count(*) filter (not ia) lost from j
union all select 'items', count(*) filter (ib), count(*) filter (ib) / count(*), count(*) filter (ia and not ib) from j
union all select 'deals', count(*) filter (ic), count(*) filter (ic) / count(*), count(*) filter (ib and not ic) from j""")
def sold_funnel(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), "c_acctbal", "c_mktsegment")
    sold = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k"))
    return state.funnel(sold, "k", raw=c.filter("c_acctbal > 0"), items=c.filter("c_acctbal > 3000"), deals=c.filter("c_acctbal > 3000 and c_mktsegment = 'BUILDING'"))


@query("""with c as (select c_custkey, (c_acctbal < 0)::int y, ('0x' || substr(md5(c_custkey || '|42'), 1, 15))::bigint h from customer)
select c_custkey, y from (select *, row_number() over (partition by y order by h, c_custkey) r from c) where y = 1 or r <= (select sum(y) from c)""")
def balanced_sample(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_acctbal") < 0).cast("int").alias("y"))
    return state.balanced(c, "y", "c_custkey", 42)


_ENRICH = "t as (select c_custkey k, case when c_custkey % 4 = 0 then '' when c_custkey % 4 = 1 then null else c_name end a, c_mktsegment b from customer), s as (select c_custkey k, case when c_custkey % 3 = 0 then ' ' else 'src' || c_custkey end a, 'B' b from customer where c_custkey % 2 = 0)"


def _enrich(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    t = c.select(k.alias("k"), F.when(k % 4 == 0, "").when(k % 4 == 1, None).otherwise(F.col("c_name")).alias("a"), F.col("c_mktsegment").alias("b"))
    return t, c.filter(k % 2 == 0).select(k.alias("k"), F.when(k % 3 == 0, " ").otherwise(F.concat(F.lit("src"), k.cast("string"))).alias("a"), F.lit("B").alias("b"))


@query(f"with {_ENRICH} select t.k, coalesce(nullif(trim(t.a), ''), nullif(trim(s.a), '')) a, t.b from t left join s using (k)")
def fill_missing(spark, sf_dir):
    t, s = _enrich(spark, sf_dir)
    return state.fill_missing(t, s, "k", ["a", "b"], protected=("b",))


@query(f"with {_ENRICH} select t.k, coalesce(nullif(trim(s.a), ''), nullif(trim(t.a), '')) a, coalesce(s.b, t.b) b from t left join s using (k)")
def overwrite_filled(spark, sf_dir):
    t, s = _enrich(spark, sf_dir)
    return state.overwrite_filled(t, s, "k", ["a", "b"])


@query("select c_custkey, c_name, c_nationkey, n_name, n_regionkey from customer left join (select n_nationkey c_nationkey, n_name, n_regionkey from nation) using (c_nationkey)")
def join_new_columns(spark, sf_dir):
    n = table(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    return state.new_columns(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey"), n, "c_nationkey").select("c_custkey", "c_name", "c_nationkey", "n_name", "n_regionkey")


@query("select l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(p, s) as value from lineitem left join (select p_partkey l_partkey, p_retailprice p from part where p_partkey % 2 = 0) using (l_partkey) left join (select s_suppkey l_suppkey, s_acctbal s from supplier) using (l_suppkey)")
def reference_lookup(spark, sf_dir):
    p = table(spark, sf_dir, "part").filter("p_partkey % 2 = 0").select(F.col("p_partkey").alias("pk"), F.lit(None).cast("long").alias("sk"), F.col("p_retailprice").alias("value"))
    s = table(spark, sf_dir, "supplier").select(F.lit(None).cast("long").alias("pk"), F.col("s_suppkey").alias("sk"), F.col("s_acctbal").alias("value"))
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return state.lookup(li, p.unionByName(s), "value", ("l_partkey", "pk"), ("l_suppkey", "sk"))


@query("select n_nationkey, n_name from nation where n_regionkey <> 2 union all select 100, 'NEW'")
def replace_slice(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    fresh = spark.range(1).select(F.lit(100).alias("n_nationkey"), F.lit("NEW").alias("n_name"), F.lit(2).alias("n_regionkey"))
    return state.replace_slice(n, fresh, "n_regionkey", 2).select("n_nationkey", "n_name")


@query("select o_orderkey, o_orderdate from orders order by o_orderdate, o_orderkey limit greatest(0, (select count(*) from orders) - 1000)")
def retention_overflow(spark, sf_dir):
    return state.overflow(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), 1000, "o_orderdate", "o_orderkey")[1]


@query("select o_custkey, o_orderkey from (select *, row_number() over (partition by o_custkey order by o_orderkey % 3, o_orderdate, o_orderkey) n from orders) where n = 1")
def queue_next(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("attempts", F.col("o_orderkey") % 3)
    return state.queue_next(o, "o_custkey", "attempts", "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey")


@query("select o_orderkey, (o_orderkey % 3 + 1)::bigint attempts from orders where o_orderstatus <> 'F'")
def requeue_failed(spark, sf_dir):
    result = F.when(F.col("o_orderstatus") == "O", "FetchFailed").when(F.col("o_orderstatus") == "P", "MissingLink").otherwise("Sold")
    return state.requeue(table(spark, sf_dir, "orders").withColumn("attempts", F.col("o_orderkey") % 3), result, "attempts").select("o_orderkey", "attempts")


@query(f"select event_id from events where event_type = 'error' or ts >= timestamp '{NOW}' - interval 10 day")
def drop_stale(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("at", F.when(F.col("event_type") != "error", F.col("ts")))
    return state.fresh(e, F.lit(NOW).cast("timestamp"), 10, "at").select("event_id")


@query(f"select event_id from events where event_type <> 'error' and ts >= timestamp '{NOW}' - interval 10 day")
def age_filter(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("at", F.when(F.col("event_type") != "error", F.col("ts")))
    return state.fresh(e, F.lit(NOW).cast("timestamp"), 10, "at", keep_missing=False).select("event_id")


@query("select o_orderkey from orders order by o_orderkey limit 1 offset (select 123457 % count(*) from orders)")
def cursor_pick(spark, sf_dir):
    return state.at_cursor(table(spark, sf_dir, "orders").select("o_orderkey"), 123457, "o_orderkey")


@query("""with p as (select p_brand search, case when p_partkey % 5 = 0 then null else p_size % 3 end n, case when p_partkey % 11 = 0 then 'u' else '' end url from part),
q as (select search, case when n > 0 or url <> '' then 'kept' when n is null then 'no_count' else 'no_images' end x from p)
select coalesce(search, '__TOTAL__') search, count(*) filter (x = 'kept') kept, count(*) filter (x = 'no_count') no_count, count(*) filter (x = 'no_images') no_images from q group by rollup (search)""")
def image_accounting(spark, sf_dir):
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("search"), F.when(k % 5 != 0, F.col("p_size") % 3).alias("n"), F.when(k % 11 == 0, "u").otherwise("").alias("url"))
    return state.image_accounting(p, "search", "n", "url")


@query("select c_custkey, (c_mktsegment = 'BUILDING')::int search__building, (c_mktsegment = 'MACHINERY')::int search__machinery, (c_mktsegment = 'AUTOMOBILE')::int search__automobile from customer")
def one_hot_search(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return state.one_hot(c, "c_mktsegment", ["BUILDING", "MACHINERY", "AUTOMOBILE"], "search").drop("c_mktsegment")


@query(f"with {LISTING} select item_id, l_orderkey, page, price, likes from listing where flag = 'N' and likes >= 10 and price < 5000 order by price desc, {LISTING_ORDER} limit 100")
def predicate_top(spark, sf_dir):
    rows = listing(spark, sf_dir).filter((F.col("flag") == "N") & (F.col("likes") >= 10) & (F.col("price") < 5000))
    return rows.orderBy(F.desc("price"), *ORDER).limit(100).select("item_id", "l_orderkey", "page", "price", "likes")


@query("select event_id, case when n <= floor(c * 0.6) then 'train' when n <= floor(c * 0.8) then 'validation' else 'test' end split from (select event_id, row_number() over (order by ts, event_id) n, count(*) over () c from events)")
def time_split(spark, sf_dir):
    return splits.by_time(table(spark, sf_dir, "events"), "ts", "event_id").select("event_id", "split")


@query("""with c as (select c_custkey, c_mktsegment, (c_acctbal < 0)::int y, ('0x' || substr(md5(c_custkey || '|42'), 1, 15))::bigint h from customer),
n as (select *, row_number() over (partition by c_mktsegment, y order by h, c_custkey) r, count(*) over (partition by c_mktsegment, y) n from c)
select c_custkey, case when r <= floor(n * 0.6) then 'train' when r <= floor(n * 0.8) then 'validation' else 'test' end split from n""")
def stratified_split(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", (F.col("c_acctbal") < 0).cast("int").alias("y"))
    return splits.stratified(c, ["c_mktsegment", "y"], "c_custkey").select("c_custkey", "split")


@query("select c_custkey, ((row_number() over (partition by c_acctbal < 0 order by c_custkey) - 1) % 5)::int fold from customer")
def class_folds(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_acctbal") < 0).alias("y"))
    return splits.folds(c, "y", "c_custkey", 5).select("c_custkey", "fold")


@query("""with r as (select * from orders where o_custkey not in (select c_custkey from customer where c_acctbal < 0)), h as (select o_orderkey k, o_totalprice s from r order by s desc, k limit 50)
select k, 'high' cohort from h union all (select o_orderkey, 'low' from r where o_orderkey not in (select k from h) order by o_totalprice, o_orderkey limit 30)""")
def cohort_extremes(spark, sf_dir):
    seen = table(spark, sf_dir, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    o = table(spark, sf_dir, "orders").join(seen, "o_custkey", "left_anti").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("s"))
    return splits.extremes(o, "s", "k", 50, 30).select("k", "cohort")


@query("select o_orderkey, case when o_totalprice <= 5000 then 'low_score' else 'high_score' end reason from orders where o_totalprice <= 5000 or o_totalprice >= 200000")
def score_tails(spark, sf_dir):
    return splits.score_tails(table(spark, sf_dir, "orders"), "o_totalprice", 5000, 200000).select("o_orderkey", "reason")


@query("""with f as (select 'a' family, c_nationkey k, avg(c_acctbal) m, count(*) n from customer group by 2 union all select 'b', s_nationkey, avg(s_acctbal), count(*) from supplier group by 2)
select k, max(case when n2 = 1 then family end) best, max(case when n2 = 2 then family end) runner_up, round(max(case when n2 = 1 then m end), 6) best_value from (select *, row_number() over (partition by k order by m desc, family) n2 from f where n >= 3) group by k""")
def family_verdict(spark, sf_dir):
    one = lambda t, p, f: table(spark, sf_dir, t).groupBy(F.col(f"{p}_nationkey").alias("k")).agg(F.avg(f"{p}_acctbal").alias("m"), F.count(F.lit(1)).alias("n")).withColumn("family", F.lit(f))
    both = one("customer", "c", "a").unionByName(one("supplier", "s", "b"), allowMissingColumns=True).filter("n >= 3")
    from pyspark.sql import Window

    placed = both.withColumn("p", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("m"), "family"))).filter("p <= 2")
    pick = lambda c, p: F.max(F.when(F.col("p") == p, F.col(c)))
    return placed.groupBy("k").agg(pick("family", 1).alias("best"), pick("family", 2).alias("runner_up"), r(pick("m", 1)).alias("best_value"))
