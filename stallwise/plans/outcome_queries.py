"""Outcomes, telemetry, clusters, embeddings and models."""

from __future__ import annotations


from pyspark.sql import functions as F

from ..functions.coerce import hours_between
from ..operators import cluster, explain, ml, outcomes, resolve
from ..streaming import streams
from .adapters import CHECKS, LISTING, NOW, TRACKED, checks, listing, query, r, scores, table, tracked

_H = (1, 2, 4, 6, 12, 24, 48, 72)
_HS = f"(select unnest({list(_H)}) h)"


@query(f"""with {CHECKS}, e as (select user_id, h, at, case when is_sold and age <= h + 0.25 then true when age >= h and not is_sold then false end v from checks, {_HS} where (is_sold and age <= h + 0.25) or age >= h)
select user_id, h::int as "hours", arg_min(v, (at, not v)) filter (v is not null) sold, coalesce(min(at) filter (v is not null), max(at)) evaluated_at from e group by 1, 2""".replace(" at,", ' "at",').replace("(at,", '("at",').replace("min(at)", 'min("at")').replace("max(at)", 'max("at")'))
def outcome_windows(spark, sf_dir):
    c = checks(spark, sf_dir)
    return outcomes.fold(c, "user_id", "first_at", "at", F.col("is_sold"), horizons=_H)


@query(f"with {TRACKED}, a as (select *, (epoch_us(timestamp '{NOW}') - epoch_us(first_at)) / 3.6e9 age, (epoch_us(sold_at) - epoch_us(first_at)) / 3.6e9 took from tracked) select search, h::int as \"hours\", count(*) filter (age >= h) matured, count(*) filter (age >= h and took <= h) sold, round(count(*) filter (age >= h and took <= h) / nullif(count(*) filter (age >= h), 0), 6) as \"precision\" from a, (select unnest([2, 4, 6, 12, 24, 48, 72]) h) group by 1, 2")
def matured_precision(spark, sf_dir):
    out = outcomes.matured_precision(tracked(spark, sf_dir), ["search"], "first_at", "sold_at", F.lit(NOW).cast("timestamp"))
    return out.select("search", "hours", "matured", "sold", r(F.col("precision")).alias("precision"))


@query(f"with {TRACKED}, b as (select search, floor((epoch_us(sold_at) - epoch_us(first_at)) / 3.6e9)::bigint h, count(*) n from tracked where sold_at is not null group by 1, 2) select search, string_agg(h || ':' || n, ' ' order by h) sold_hours from b group by 1")
def sold_hour_buckets(spark, sf_dir):
    return outcomes.sold_hours(tracked(spark, sf_dir), "search", "first_at", "sold_at")


_LONG = f"""long as (select user_id, search, passed, h, case when h % 4 = 0 then 'x' else 'y' end approach, (epoch_us(timestamp '{NOW}') - epoch_us(first_at)) / 3.6e9 >= h * 10 evaluated, coalesce((epoch_us(sold_at) - epoch_us(first_at)) / 3.6e9 <= h * 10, false) sold from tracked, {_HS})"""


def _long(spark, sf_dir):
    t = tracked(spark, sf_dir)
    h = F.explode(F.array(*map(F.lit, _H))).alias("hours")
    rows = t.select("*", h)
    age, took = hours_between(F.lit(NOW).cast("timestamp"), F.col("first_at")), hours_between(F.col("sold_at"), F.col("first_at"))
    return rows.select("user_id", "search", "passed", "hours", F.when(F.col("hours") % 4 == 0, "x").otherwise("y").alias("approach"), (age >= F.col("hours") * 10).alias("evaluated"), F.coalesce(took <= F.col("hours") * 10, F.lit(False)).alias("sold"))


@query(f"""with {TRACKED}, {_LONG} select approach, coalesce(search, '__all__') search, h::int as "hours", count(*) passed, count(*) filter (evaluated) evaluated, count(*) filter (evaluated and sold) sold, round(count(*) filter (evaluated and sold) / nullif(count(*) filter (evaluated), 0), 6) as "precision", round(count(*) filter (evaluated) / count(*), 6) coverage
from long where passed group by grouping sets ((approach, search, h), (approach, h))""")
def window_performance(spark, sf_dir):
    c = F.col
    out = outcomes.window_performance(_long(spark, sf_dir), "approach", "search", "hours", c("passed"), c("evaluated"), c("sold"))
    return out.select("approach", "search", "hours", "passed", "evaluated", "sold", r(c("precision")).alias("precision"), r(c("coverage")).alias("coverage"))


@query(f"""with {TRACKED}, {_LONG}, g as (select h, sold, case when passed then 'final_stage2_pass' else 'stage1_pass_stage2_reject' end g from long where evaluated union all select h, sold, 'all_stage1_pass' from long where evaluated)
select h::int as "hours", g as "group", count(*) evaluated_count, count(*) filter (sold) sold_count, round(count(*) filter (sold) / count(*), 6) as "precision" from g group by 1, 2""")
def cascade_precision(spark, sf_dir):
    c = F.col
    return outcomes.cascade_groups(_long(spark, sf_dir), "hours", c("passed"), c("evaluated"), c("sold")).withColumn("precision", r(c("precision")))


@query(f"""with {TRACKED}, {_LONG} select user_id, bool_or(sold) filter (h = 1) sold_within_1h, bool_or(sold) filter (h = 24) sold_within_24h, bool_or(sold) filter (h = 72) sold_within_72h from long group by 1""")
def outcomes_wide(spark, sf_dir):
    return outcomes.wide(_long(spark, sf_dir).select("user_id", "hours", "sold"), "user_id", (1, 24, 72))


@query(f"""with {TRACKED}, l as (select user_id, max(ts) last_at from events group by 1), a as (select t.user_id, sold_at, (epoch_us(timestamp '{NOW}') - epoch_us(first_at)) / 3.6e9 age, (epoch_us(timestamp '{NOW}') - epoch_us(last_at)) / 3.6e9 rest from tracked t join l using (user_id))
select user_id, sold_at is null and (age <= 72 and rest >= case when age < 24 then 2 when age < 48 then 6 when age < 168 then 12 else 168 end or age >= 72) due from a""")
def due_rechecks(spark, sf_dir):
    c = F.col
    last = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("last_at"))
    rows = tracked(spark, sf_dir).join(last, "user_id")
    done = F.array(*map(F.lit, (1, 2, 4, 6, 12, 24, 48)))
    return rows.select("user_id", outcomes.due(c("first_at"), c("last_at"), c("sold_at"), F.lit(None).cast("string"), done, F.lit(NOW).cast("timestamp"), horizons=_H).alias("due"))


@query(f"""with {TRACKED} select user_id, case when sold_at is not null then ((epoch_us(sold_at) - epoch_us(first_at)) / 3.6e9 <= 48)::int when (epoch_us(timestamp '{NOW}') - epoch_us(first_at)) / 3.6e9 >= 48 then 0 end fast_sale from tracked""")
def fast_sale_labels(spark, sf_dir):
    c = F.col
    status = F.when(c("sold_at").isNotNull(), "Sold").otherwise("active")
    return tracked(spark, sf_dir).select("user_id", outcomes.fast_sale(status, c("first_at"), c("sold_at"), F.lit(NOW).cast("timestamp")).alias("fast_sale"))


@query("""with a as (select user_id, count(*) filter (event_type = 'view') n, count(*) filter (event_type = 'purchase') s, count(*) filter (event_type = 'click') g, count(*) filter (event_type = 'signup') f from events group by 1), v as (select *, (g * 1.0 + f * 1.5 + s * 2.0)::double / 24 v from a)
select user_id, case when v > 0 then least(greatest(round_even(4.0 / v * 3600, 0), 900), 14400)::int else 3600 end delay from v""")
def activity_delays(spark, sf_dir):
    n = lambda t: F.count_if(F.col("event_type") == t)
    a = table(spark, sf_dir, "events").groupBy("user_id").agg(n("view").alias("n"), n("purchase").alias("s"), n("click").alias("g"), n("signup").alias("f"))
    c = F.col
    return a.select("user_id", outcomes.recheck_delay(c("n"), c("s"), c("g"), c("f")).alias("delay"))


@query("""select coalesce(event_type, '__all__') kind, coalesce(source, '__all__') source, count(*) n, sum(b)::bigint bytes, min(ts) first_ts, max(ts) last_ts, count(distinct user_id) users, count(*) filter (event_type <> 'error') ok from (select *, 't' || (user_id % 3) source, (value * 100)::bigint b from (select *, floor(value * 100) / 100 value2 from events)) group by grouping sets ((event_type), (source), ())""".replace("(value * 100)::bigint b", "floor(value)::bigint b").replace(", floor(value * 100) / 100 value2", ""))
def telemetry(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", F.concat(F.lit("t"), (F.col("user_id") % 3).cast("string")).alias("source"), "ts", "user_id", F.floor("value").alias("b"))
    out = e.groupingSets([[F.col("event_type")], [F.col("source")], []], F.col("event_type"), F.col("source")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("b").alias("bytes"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.countDistinct("user_id").alias("users"), F.count_if(F.col("event_type") != "error").alias("ok")
    )
    return out.select(F.coalesce("event_type", F.lit("__all__")).alias("kind"), F.coalesce("source", F.lit("__all__")).alias("source"), "n", "bytes", "first_ts", "last_ts", "users", "ok")


@query("select event_id, coalesce(lag(event_type) over (partition by user_id order by ts, event_id) <> event_type, false) changed from events")
def identity_changes(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("o", F.struct("ts", "event_id"))
    return streams.identity_changes(e, "user_id", "o", "event_type").select("event_id", "changed")


@query("select ts::date::timestamp as \"day\", count(*) n, round(coalesce(sum(value), 0), 4) total, count(*) filter (event_type = 'error') errors from events where ts >= (select max(ts) from events) - interval 7 day group by 1")
def daily_health(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    last = e.agg(F.max("ts").alias("last"))
    rows = e.join(F.broadcast(last), F.lit(True)).filter(F.col("ts") >= F.col("last") - F.expr("interval 7 day"))
    return rows.groupBy(F.date_trunc("day", "ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), r(F.coalesce(F.sum("value"), F.lit(0.0)), 4).alias("total"), F.count_if(F.col("event_type") == "error").alias("errors"))


@query("select user_id, count(*) filter (event_type = 'view') as \"view\", count(*) filter (event_type = 'click') click, count(*) filter (event_type = 'purchase') purchase from events group by 1")
def cohort_pivot(spark, sf_dir):
    p = table(spark, sf_dir, "events").groupBy("user_id").pivot("event_type", ["view", "click", "purchase"]).count()
    return p.na.fill(0)


@query("with n as (select unnest(string_split(event_type || '|' || case when user_id % 2 = 0 then 'even' else 'odd' end, '|')) note from events) select note, count(*) n from n group by 1 order by n desc, note limit 10")
def note_counts(spark, sf_dir):
    notes = F.concat_ws("|", "event_type", F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd"))
    return table(spark, sf_dir, "events").select(F.explode(F.split(notes, "[|]")).alias("note")).groupBy("note").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "note").limit(10)


@query("select lang, count(*) filter (contains(lower(text), 'the')) the, count(*) filter (contains(lower(text), 'license')) license from documents group by 1")
def needle_counts(spark, sf_dir):
    has = lambda w: F.count_if(F.contains(F.lower("text"), F.lit(w)))
    return table(spark, sf_dir, "documents").groupBy("lang").agg(has("the").alias("the"), has("license").alias("license"))


@query(f"with {LISTING} select search, round(avg((p90 + 0)::double), 4) p90, count(*) n, round(avg(price), 4) mean from (select *, 0 p90 from listing) group by 1".replace("round(avg((p90 + 0)::double), 4) p90", "round(quantile_cont(price, 0.9), 4) p90").replace("(select *, 0 p90 from listing)", "listing"))
def live_score_summary(spark, sf_dir):
    return listing(spark, sf_dir).groupBy("search").agg(r(F.percentile("price", 0.9), 4).alias("p90"), F.count(F.lit(1)).alias("n"), r(F.avg("price"), 4).alias("mean"))


@query("""with e as (select label, unnest(embedding)::double v, unnest(range(len(embedding))) p from embeddings), m as (select label, p, avg(v) m from e group by 1, 2), c as (select label, list(m order by p) c from m group by 1),
d as (select vec_id, label, list_sum(list_transform(range(1, len(c) + 1), lambda i: c[i] * embedding[i]::double)) d from embeddings join c using (label))
select label, arg_min(vec_id, (-d, vec_id)) representative, count(*) n from d group by 1""")
def cluster_representatives(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return cluster.representatives(e, ["label"], "embedding", "vec_id").select("label", "representative", "n")


@query("""with e as (select label, unnest(embedding)::double v, unnest(range(len(embedding))) p from embeddings), m as (select label, p, avg(v) m from e group by 1, 2), c as (select label k, list(m order by p) c from m group by 1),
d as (select vec_id, k, 1 - list_sum(list_transform(range(1, len(c) + 1), lambda i: c[i] * embedding[i]::double)) d from embeddings, c)
select vec_id, arg_min(k, (d, k)) nearest, round(min(d), 6) dist from d group by 1""")
def nearest_centroids(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    c = cluster.centroids(e, ["label"], "embedding")
    out = cluster.nearest(e.select("vec_id", "embedding"), c, "embedding", "label")
    return out.select("vec_id", "nearest", r(F.col("dist")).alias("dist"))


@query("""with e as (select unnest(embedding)::double v, unnest(range(len(embedding))) p from embeddings), m as (select list(q order by p) c from (select p, quantile_cont(v, 0.5) q from e group by 1)),
d as (select vec_id, sqrt(list_sum(list_transform(range(1, len(c) + 1), lambda i: (embedding[i]::double - c[i]) ** 2))) d from embeddings, m) select vec_id, round((d - min(d) over ()) / (max(d) over () - min(d) over ()), 6) outlier from d""")
def vector_outliers(spark, sf_dir):
    return cluster.outlier_scores(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding").select("vec_id", r(F.col("outlier")).alias("outlier"))


@query("select p_brand, p_type, p_partkey, dense_rank() over (order by p_brand, p_type)::int - 1 product_id from part")
def product_ids(spark, sf_dir):
    return cluster.numbered(table(spark, sf_dir, "part").select("p_brand", "p_type", "p_partkey"), "p_brand", "p_type")


@query("select p_partkey, bit_count(xor(p_partkey, p_size::bigint * 31))::int far from part")
def hash_distances(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", cluster.hamming(F.col("p_partkey"), F.col("p_size").cast("long") * 31).alias("far"))


@query()
def blocked_clusters(spark, sf_dir):
    """Average-linkage clusters inside each label's block; not expressible in SQL."""
    e = table(spark, sf_dir, "embeddings")
    out = resolve.clusters(e.select(F.col("label").alias("block"), F.col("vec_id").alias("item"), "embedding"), "block", "item", "embedding", resolve.PRODUCT)
    return out.select("block", "item", "label", r(F.col("silhouette")).alias("silhouette"))


@query()
def variant_clusters(spark, sf_dir):
    """Variants of each label's vectors with a made-up price; not expressible in SQL."""
    e = table(spark, sf_dir, "embeddings").withColumn("price", (10 + F.col("vec_id") % 37).cast("double"))
    out = resolve.variant_clusters(e, "label", "vec_id", "embedding", "price")
    return out.select("product", "item", "variant", r(F.col("similarity")).alias("similarity"), r(F.col("silhouette")).alias("silhouette"))


@query(f"""with {LISTING}, q as (select brand, state, count(*) n, round(avg((likes > 30)::int), 6) sold_rate, quantile_cont(price, 0.25) q25, quantile_cont(price, 0.5) med, quantile_cont(price, 0.75) q75 from listing group by all)
select brand, state, any_value(n) n, any_value(sold_rate) sold_rate, round(any_value(q25), 6) q25, round(any_value(med), 6) med, round(any_value(q75), 6) q75, round(quantile_cont(abs(price - med), 0.5), 6) mad from listing join q using (brand, state) group by all""")
def variant_summary(spark, sf_dir):
    rows = listing(spark, sf_dir).withColumn("sold", F.col("likes") > 30).withColumn("sold", F.col("sold").cast("int"))
    out = cluster.variant_summary(rows, ["brand", "state"], "price", "sold")
    return out.select("brand", "state", "n", *[r(F.col(c)).alias(c) for c in ("sold_rate", "q25", "med", "q75", "mad")])


def _labelled_texts(spark, sf_dir):
    """Labelled documents, four fifths of them to learn from."""
    rows = scores(spark, sf_dir, "text").select("doc_id", F.col("n_chars").cast("double").alias("n"), "s", "text", "search", F.col("y").cast("double").alias("label"))
    rows = rows.withColumn("fold", F.when(F.col("doc_id") % 5 > 0, "train").otherwise("test"))
    return rows, ml.balanced_weights(rows.filter("fold = 'train'"), "label")


_COLUMNS = {"numbers": ["n", "s"], "texts": ["text"], "categories": ["search"]}


def _model(name):
    def run(spark, sf_dir):
        rows, train = _labelled_texts(spark, sf_dir)
        if name == "svm":
            return ml.calibrated_svm(train, rows, "label", "doc_id", weight="weight", **_COLUMNS).select("doc_id", "fold", "score")
        model = ml.pipeline(name, "label", "weight", **_COLUMNS, **ml.FULL).fit(train)
        return ml.with_scores(model, rows).select("doc_id", "fold", "score")

    run.__name__ = f"model_{name}"
    return run


@query()
def tree_importance(spark, sf_dir):
    """Mean absolute Shapley value of each feature of a boosted model over all labelled documents."""
    rows, train = _labelled_texts(spark, sf_dir)
    model = ml.pipeline("xgboost", "label", **_COLUMNS, **ml.FULL).fit(train)
    values, _ = explain.with_shapley(model.stages[-1], ml.PipelineModel(model.stages[:-1]).transform(rows))
    return explain.importance(values).select("feature", r(F.col("importance")).alias("importance"), r(F.col("mean")).alias("mean"))


@query()
def text_directions(spark, sf_dir):
    """Each document's TF-IDF vector in the first 50 singular directions, by its length there and its share of the squared length."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out, _, _ = ml.svd_vectors(docs, "text", **ml.FULL)
    return out.select("doc_id", r(F.aggregate("svd", F.lit(0.0), lambda a, x: a + x * x)).alias("squared"))


for _name in ("logistic", "svm", "tree", "extra_trees_tuned", "hist_gb_tuned", "lightgbm"):
    query()(_model(_name))

