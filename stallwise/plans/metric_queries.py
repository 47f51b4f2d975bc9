"""Evaluation: ranks, curves, thresholds, votes, calibration and inference over given scores."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import metrics, splits, stats, thresholds, voting
from .adapters import MODEL_SCORES, SCORES, model_scores, query, r, scores, table


@query(f"with {SCORES} select doc_id, rank() over (order by s) + (count(*) over (partition by s) - 1) / 2.0 avg_rank from scores".replace("/ 2.0 avg_rank", "/ 2::double avg_rank"))
def average_ranks(spark, sf_dir):
    return metrics.with_average_rank(scores(spark, sf_dir), "s", "avg_rank").select("doc_id", "avg_rank")


@query(f"with {SCORES} select doc_id, row_number() over (partition by search order by s desc, doc_id) stage_rank, count(*) over (partition by search) group_size from scores")
def stage_ranks(spark, sf_dir):
    w = Window.partitionBy("search")
    return scores(spark, sf_dir).select("doc_id", F.row_number().over(w.orderBy(F.desc("s"), "doc_id")).alias("stage_rank"), F.count(F.lit(1)).over(w).alias("group_size"))


_CUM = """c as (select search, s, count(*) n, sum(y) pos from scores group by all),
u as (select *, sum(n) over w nu, sum(pos) over w pu, sum(n) over (partition by search) na, sum(pos) over (partition by search) pa from c window w as (partition by search order by s desc rows unbounded preceding))"""


@query(f"""with {SCORES}, r as (select *, rank() over (partition by search order by s) + (count(*) over (partition by search, s) - 1) / 2.0 rk from scores), a as (select search, count(*) as n, sum(y) p, sum(case when y = 1 then rk else 0 end) rs from r group by 1), {_CUM},
ap as (select search, sum(pos / pa * pu / nu) pr from u group by 1) select search, n as "rows", p::bigint positives, round((rs - p * (p + 1) / 2) / (p * (n - p)), 6)::double roc_auc, round(case when p > 0 and n > p then pr end, 6)::double pr_auc from a join ap using (search)""")
def auc_by_search(spark, sf_dir):
    out = metrics.auc(scores(spark, sf_dir), ["search"], "s", "y")
    return out.select("search", "rows", "positives", r(F.col("roc_auc")).alias("roc_auc"), r(F.col("pr_auc")).alias("pr_auc"))


@query(f"with {SCORES} select least(floor(s * 10), 9)::int bin, count(*) n, round(avg(s), 6) mean_score, round(avg(y), 6) rate from scores group by 1")
def calibration_curve(spark, sf_dir):
    out = metrics.calibration(scores(spark, sf_dir), [], "s", "y")
    return out.select("bin", "n", r(F.col("mean_score")).alias("mean_score"), r(F.col("rate")).alias("rate"))


@query(f"with {SCORES}, b as (select search, least(floor(s * 10), 9) b, count(*) n, abs(sum(s) - sum(y)) d, sum((y - s) * (y - s)) q from scores group by 1, 2) select search, round(sum(q) / sum(n), 6) brier, round(sum(d) / sum(n), 6) ece from b group by 1")
def brier_and_ece(spark, sf_dir):
    out = metrics.brier_ece(scores(spark, sf_dir), ["search"], "s", "y")
    return out.select("search", r(F.col("brier")).alias("brier"), r(F.col("ece")).alias("ece"))


_KS = (10, 20, 50, 100, 200, 500, 1000)


@query(f"""with {SCORES}, o as (select search, y, row_number() over (partition by search order by s desc, doc_id) n, sum(y) over (partition by search) total from scores)
select search, k::int k, count(*) selected, sum(y)::bigint positives, round(avg(y), 6) as "precision", round(sum(y) / max(total), 6) recall from o, (select unnest({list(_KS)}) k) where n <= k group by 1, 2""")
def precision_at_k(spark, sf_dir):
    out = metrics.at_k(scores(spark, sf_dir), ["search"], "s", "y", list(_KS), "doc_id")
    return out.select("search", "k", "selected", "positives", r(F.col("precision")).alias("precision"), r(F.col("recall")).alias("recall"))


_TS = (0.2, 0.35, 0.5, 0.65, 0.8)


@query(f"""with {SCORES} select search, t::double threshold, count(*) filter (s >= t) selected, coalesce(sum(y) filter (s >= t), 0)::bigint positives, round(avg(y) filter (s >= t), 6) as "precision" from scores, (select unnest({[float(t) for t in _TS]}::double[]) t) group by 1, 2""")
def precision_at_thresholds(spark, sf_dir):
    out = metrics.at_thresholds(scores(spark, sf_dir), ["search"], "s", "y", list(_TS))
    return out.select("search", "threshold", "selected", "positives", r(F.col("precision")).alias("precision"))


@query(f"""with {SCORES}, c as (select search, count(*) filter (s >= 0.5 and y = 1) tp, count(*) filter (s >= 0.5 and y = 0) fp, count(*) filter (s < 0.5 and y = 0) tn, count(*) filter (s < 0.5 and y = 1) fn from scores group by 1)
select search, tp, fp, tn, fn, round(tp / (tp + fp), 6) as "precision", round(tp / (tp + fn), 6) recall, round(tn / (tn + fp), 6) specificity, round((tp + tn) / (tp + fp + tn + fn), 6) accuracy, round(2 * tp / (2 * tp + fp + fn), 6) f1, round(tp * (tp + fp + tn + fn) / ((tp + fp) * (tp + fn)), 6) lift from c""")
def confusion_report(spark, sf_dir):
    out = metrics.confusion(scores(spark, sf_dir), ["search"], F.col("s") >= 0.5, F.col("y"))
    return out.select("search", "tp", "fp", "tn", "fn", *[r(F.col(c)).alias(c) for c in ("precision", "recall", "specificity", "accuracy", "f1", "lift")])


@query(f"with {SCORES}, k as (select n_chars::double a, s b, rank() over (order by n_chars) + (count(*) over (partition by n_chars) - 1) / 2.0 ra, rank() over (order by s) + (count(*) over (partition by s) - 1) / 2.0 rb from scores) select round(corr(a, b), 6) pearson, round(corr(ra, rb), 6) spearman from k")
def correlations(spark, sf_dir):
    out = metrics.correlations(scores(spark, sf_dir), "n_chars", "s")
    return out.select(r(F.col("pearson")).alias("pearson"), r(F.col("spearman")).alias("spearman"))


@query(f"with {SCORES} select round(avg(abs(y - s)), 6) mae, round(sqrt(avg((y - s) * (y - s))), 6) rmse, round(1 - sum((y - s) * (y - s)) / (var_pop(y) * count(*)), 6) r2, round(avg(-(y * ln(greatest(s, 1e-15)) + (1 - y) * ln(1 - greatest(s, 1e-15)))), 6) log_loss from scores")
def regression_errors(spark, sf_dir):
    rows = scores(spark, sf_dir)
    out = metrics.regression_errors(rows, "y", "s").join(F.broadcast(metrics.log_loss(rows, "s", "y")), F.lit(True))
    return out.select(*[r(F.col(c)).alias(c) for c in ("mae", "rmse", "r2", "log_loss")])


@query(f"with {SCORES}, e as (select list_distinct([quantile_cont(n_chars, q) for q in [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]]) es from scores) select 1".split(" select 1")[0].split(", e as")[0] + ", e as (select list_distinct(quantile_cont(n_chars, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])) es from scores) select bin::int bin, count(*) n, round(avg(y), 6) rate, min(n_chars) lo, max(n_chars) hi from (select greatest(len(list_filter(es, lambda x: x < n_chars)) - 1, 0) bin, y, n_chars from scores, e) group by 1")
def quantile_bin_rates(spark, sf_dir):
    rows = metrics.quantile_bins(scores(spark, sf_dir), "n_chars", 10)
    return rows.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), r(F.avg("y")).alias("rate"), F.min("n_chars").alias("lo"), F.max("n_chars").alias("hi"))


@query("""with p as (select p_brand search, p_partkey k, case when p_partkey % 13 = 0 then null else p_retailprice - 890 end price, p_size from part)
select search, case when price is null or price < 0 then 'unknown' when price < 25 then '<=25' when price < 50 then '25-50' when price < 100 then '50-100' when price < 200 then '100-200' when price < 500 then '200-500' else '>500' end band, count(*) n, count(distinct p_size) sizes, min(price) low, round(avg(price), 6) mean, round(quantile_cont(price, 0.5), 6) med, max(price) high from p group by 1, 2""")
def price_bands(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("search"), F.when(F.col("p_partkey") % 13 != 0, F.col("p_retailprice") - 890).alias("price"), "p_size")
    return p.groupBy("search", metrics.price_band(F.col("price")).alias("band")).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("p_size").alias("sizes"), F.min("price").alias("low"), r(F.avg("price")).alias("mean"), r(F.percentile("price", 0.5)).alias("med"), F.max("price").alias("high")
    )


_CANDS = """t as (select distinct search, round_even(s, 4) t from scores union select search, unnest([0.5, 0.6, 0.7, 0.8, 0.9]) from (select distinct search from scores)),
m as (select t.search, t.t, count(*) filter (s >= t) n, coalesce(sum(y) filter (s >= t), 0) pos, count(*) n_all, sum(y) pos_all from t join scores using (search) group by 1, 2),
k as (select *, case when n > 0 then pos / n end p from m)"""


@query(f"""with {SCORES}, {_CANDS} select search, t::double threshold, n selected, pos::bigint positives, round(p, 6) as "precision" from (select *, row_number() over (partition by search order by (n >= 20 and coalesce(p, -1) >= 0.6) desc, coalesce(p, 0) desc, pos desc, n desc, t desc) z from k) where z = 1""")
def choose_threshold(spark, sf_dir):
    out = thresholds.choose(scores(spark, sf_dir), ["search"], "s", "y")
    return out.select("search", "threshold", "selected", "positives", r(F.col("precision")).alias("precision"))


@query(f"""with {SCORES}, {_CANDS}, f as (select *, 2 * pos / (n + pos_all) f1, pos / pos_all rec, (n_all - pos_all - n + 2 * pos) / n_all acc from k)
select search, t::double threshold, n selected, round(f1, 6) f1, round(acc, 6) accuracy from (select *, row_number() over (partition by search order by coalesce(f1, -1) desc, coalesce(p, -1) desc, rec desc, n desc, t desc) z from f) where z = 1""")
def choose_f1(spark, sf_dir):
    out = thresholds.choose_by(scores(spark, sf_dir), ["search"], "s", "y", "f1")
    return out.select("search", "threshold", "selected", r(F.col("f1")).alias("f1"), r(F.col("accuracy")).alias("accuracy"))


@query(f"""with {SCORES}, {_CUM}, f as (select *, na - pa - nu + 2 * pu correct from u), g as (select *, row_number() over (partition by search order by correct desc, s desc) z from f)
select search, case when correct > na - pa then s end threshold, round(greatest(correct, na - pa) / na, 6) accuracy from g where z = 1""")
def choose_accuracy(spark, sf_dir):
    out = thresholds.choose_accuracy(scores(spark, sf_dir), ["search"], "s", "y")
    return out.select("search", "threshold", r(F.col("accuracy")).alias("accuracy"))


@query(f"""with {SCORES}, {_CUM}, g as (select *, pu / nu >= 0.55 ok from u), h as (select *, row_number() over (partition by search order by ok desc, case when ok then pu else 0 end desc, case when ok then nu else 0 end desc, s) z from g)
select search, case when ok then 'ok' else 'no_threshold_met_target' end status, case when ok then s end threshold, (case when ok then nu else 0 end)::bigint passed, (case when ok then pu else 0 end)::bigint tp from h where z = 1""")
def choose_precision_target(spark, sf_dir):
    return thresholds.choose_for_precision(scores(spark, sf_dir), ["search"], "s", "y", 0.55)


@query(f"with {SCORES}, {_CUM} select search, max(s) threshold, min(nu)::bigint passed, round(min(pu / pa), 6) recall from u where pu / pa >= 0.8 group by 1")
def choose_recall_target(spark, sf_dir):
    out = thresholds.choose_for_recall(scores(spark, sf_dir), ["search"], "s", "y", 0.8)
    return out.select("search", "threshold", "passed", r(F.col("recall")).alias("recall"))


@query(f"with {SCORES}, {_CUM} select search, min(s) threshold, max(nu)::bigint passed, round(max(nu / na), 6) pass_rate from u where nu <= 0.25 * na group by 1")
def choose_pass_rate(spark, sf_dir):
    out = thresholds.choose_for_pass_rate(scores(spark, sf_dir), ["search"], "s", "y", 0.25)
    return out.select("search", "threshold", "passed", r(F.col("pass_rate")).alias("pass_rate"))


_LIVE = "o as (select search, s, row_number() over w n, sum(y) over w pos from scores window w as (partition by search order by s desc, doc_id rows unbounded preceding)), q as (select *, pos / n p from o)"


@query(f"""with {SCORES}, {_LIVE}, z as (select *, n >= 10 and p >= 0.6 ok from q), d as (select *, row_number() over (partition by search order by ok desc, case when ok then n else p end desc, n) zz from z) select search, s threshold, round(p, 6) as "precision", n selected from d where zz = 1""")
def choose_live_threshold(spark, sf_dir):
    out = thresholds.choose_live(scores(spark, sf_dir), ["search"], "s", "y", "doc_id", 0.6, 10)
    return out.select("search", "threshold", r(F.col("precision")).alias("precision"), "selected")


@query(f"""with {SCORES}, t as (select distinct search, round_even(s, 4) t from scores), m as (select t.search, t.t, count(*) filter (s >= t) n, coalesce(sum(y) filter (s >= t), 0) pos from t join scores using (search) group by 1, 2), k as (select *, pos / n p from m where n > 0),
z as (select *, row_number() over (partition by search order by (n >= 20 and p >= 0.6) desc, n >= 20 desc, case when n >= 20 then p else -1 end desc, case when n >= 20 and p >= 0.6 then n else 0 end desc, t desc) zz from k)
select search, case when n >= 20 then t else 0.7 end::double threshold, case when n >= 20 and p >= 0.6 then 'calibrated' when n >= 20 then 'best_achievable' else 'global_fallback' end source, round(case when n >= 20 then p end, 6) as "precision", (case when n >= 20 then n else 0 end)::bigint selected from z where zz = 1""")
def calibrate_per_search(spark, sf_dir):
    out = thresholds.calibrated(scores(spark, sf_dir), ["search"], "s", "y", 0.7, 0.6, 20)
    return out.select("search", "threshold", "source", r(F.col("precision")).alias("precision"), "selected")


@query(f"""with {SCORES}, v as (select * from scores where doc_id % 2 = 0), w as (select * from scores where doc_id % 2 = 1), c as (select search, s, count(*) n, sum(y) pos from v group by all), u as (select *, sum(n) over w2 nu, sum(pos) over w2 pu, sum(pos) over (partition by search) pa from c window w2 as (partition by search order by s desc rows unbounded preceding)),
t as (select search, max(s) threshold from u where pu / pa >= 0.5 group by 1)
select search, threshold, count(*) filter (s >= threshold) selected, coalesce(sum(y) filter (s >= threshold), 0)::bigint positives, round(avg(y) filter (s >= threshold), 6) as "precision", round(coalesce(sum(y) filter (s >= threshold), 0) / sum(y), 6) recall from w join t using (search) group by 1, 2""")
def tune_then_test(spark, sf_dir):
    rows = scores(spark, sf_dir)
    t = thresholds.choose_for_recall(rows.filter("doc_id % 2 = 0"), ["search"], "s", "y", 0.5)
    out = thresholds.apply_to(rows.filter("doc_id % 2 = 1"), t, ["search"], "s", "y")
    return out.select("search", "threshold", "selected", "positives", r(F.col("precision")).alias("precision"), r(F.col("recall")).alias("recall"))


@query("""with b as (select n_name, n_nationkey / 30.0 base, (n_nationkey % 10) / 10.0 p, n_nationkey * 2 n from nation), q as (select *, least(0.95, greatest(0.6, base + 0.2, base * 1.25)) need from b)
select n_name, round(need, 6)::double need, p >= 0.6 and n >= 20 and n >= 10 and p >= need promoted, (case when p < 0.6 then 4 else 0 end + case when n < 20 then 1 else 0 end + case when n < 10 then 1 else 0 end + case when p < need then 1 else 0 end)::int failed from q""")
def promotion_gates(spark, sf_dir):
    c, k = F.col, F.col("n_nationkey")
    rows = table(spark, sf_dir, "nation").select("n_name", (k / 30.0).alias("base_rate"), *[(k % 10 / 10.0).alias(n) for n in ("val_precision", "test_precision", "val_p10", "test_p10")], (k * 2).alias("val_count"), (k * 2).alias("test_count"))
    ok, reasons = thresholds.promotion(0.6)
    return rows.select("n_name", r(thresholds.material_precision(c("base_rate"))).alias("need"), ok.alias("promoted"), F.when(reasons == "", 0).otherwise(F.size(F.split(reasons, "; "))).alias("failed"))


@query("select c_custkey, t strict, least(greatest(t - least(0.05, t * 0.25), 0), 1) medium, least(greatest(t - least(0.10, t * 0.5), 0), 1) loose from (select c_custkey, (c_custkey % 100) / 100.0::double t from customer)")
def threshold_variants(spark, sf_dir):
    t = (F.col("c_custkey") % 100) / F.lit(100.0)
    return table(spark, sf_dir, "customer").select("c_custkey", *[v.alias(k) for k, v in thresholds.variants(t).items()])


@query(f"""with {MODEL_SCORES}, v as (select search, doc_id, model, (score >= 0.5)::int v from model_scores), p as (select a.search, a.model model_a, b.model model_b, a.v va, b.v vb from v a join v b on a.search = b.search and a.doc_id = b.doc_id and a.model < b.model),
q as (select search, model_a, model_b, count(*) n, sum(va * vb) ab, sum(va) a, sum(vb) b from p group by 1, 2, 3), s as (select *, (n - a - b + 2 * ab) / n po, (a * b + (n - a) * (n - b)) / (n * n) pe from q)
select search, model_a, model_b, n as "rows", round(po, 6) agreement, round((po - pe) / (1 - pe), 6) kappa, round(ab / (a + b - ab), 6) jaccard from s""")
def model_agreement(spark, sf_dir):
    out = metrics.agreement(model_scores(spark, sf_dir).withColumn("v", F.col("score") >= 0.5), ["search"], "doc_id", "model", "v")
    return out.select("search", "model_a", "model_b", "rows", *[r(F.col(c)).alias(c) for c in ("agreement", "kappa", "jaccard")])


_METRICS = "ms as (select * from (values ('a', 0.7, 0.6, 0.5, 0.8, true, 0.9, 30, 0.5), ('b', 0.6, 0.7, 0.5, 0.4, false, 0.5, 10, 0.4), ('c', 0.45, 0.5, 0.5, 0.9, true, 0.7, 100, 0.6)) v(model, roc_auc, pr_auc, base_rate, p25, qualified, threshold_precision, threshold_count, threshold))"


def _metrics(spark, sf_dir):
    rows = [("a", 0.7, 0.6, 0.5, 0.8, True, 0.9, 30, 0.5), ("b", 0.6, 0.7, 0.5, 0.4, False, 0.5, 10, 0.4), ("c", 0.45, 0.5, 0.5, 0.9, True, 0.7, 100, 0.6)]
    m = spark.createDataFrame(rows, "model string, roc_auc double, pr_auc double, base_rate double, p25 double, qualified boolean, threshold_precision double, threshold_count int, threshold double")
    return scores(spark, sf_dir).select("search").distinct().join(F.broadcast(m), F.lit(True))


@query(f"with {MODEL_SCORES}, {_METRICS}, w as (select model, threshold::double threshold, greatest(roc_auc - 0.5, 0)::double / sum(greatest(roc_auc - 0.5, 0)) over () weight from ms) select search, doc_id, round(sum(weight * score) / sum(weight), 6) soft, round(sum(weight * (score >= threshold)::int) / sum(weight), 6) hard from model_scores join w using (model) group by 1, 2")
def weighted_votes(spark, sf_dir):
    m, s = _metrics(spark, sf_dir), model_scores(spark, sf_dir)
    soft = voting.vote(s, m, ["search"], "doc_id", "model", "score", "auc_soft").withColumnRenamed("vote", "soft")
    hard = voting.vote(s, m, ["search"], "doc_id", "model", "score", "auc_hard").withColumnRenamed("vote", "hard")
    return soft.join(hard, ["search", "doc_id"]).select("search", "doc_id", r(F.col("soft")).alias("soft"), r(F.col("hard")).alias("hard"))


@query(f"with {_METRICS}, w as (select model, case when qualified then threshold_precision * ln(1 + threshold_count) else 0 end x from ms), {SCORES} select search, model, round(x / sum(x) over (partition by search), 6)::double weight from w, (select distinct search from scores)")
def vote_weights(spark, sf_dir):
    return voting.weighted(_metrics(spark, sf_dir), ["search"], "qualified").select("search", "model", r(F.col("weight")).alias("weight"))


@query(f"with {MODEL_SCORES}, p as (select search, doc_id, count(*) filter (score >= 0.5) votes, max(y) y from model_scores group by 1, 2) select search, votes, count(*) items, round(avg(y), 6) rate, round(count(*) / sum(count(*)) over (partition by search), 6) share from p group by 1, 2")
def vote_distribution(spark, sf_dir):
    out = voting.vote_counts(model_scores(spark, sf_dir), ["search"], "doc_id", F.col("score") >= 0.5, "y")
    return out.select("search", "votes", "items", r(F.col("rate")).alias("rate"), r(F.col("share")).alias("share"))


@query(f"with {MODEL_SCORES}, p as (select search, doc_id, avg((score >= 0.5)::int) f from model_scores group by 1, 2) select search, count(*) items, count(*) filter (f > 0.5) majority, count(*) filter (f > 0) any_vote, count(*) filter (f = 1) unanimous from p group by 1")
def ensemble_summary(spark, sf_dir):
    e = voting.ensemble(model_scores(spark, sf_dir), ["search"], "doc_id", "score", F.col("score") >= 0.5, "y")
    return e.groupBy("search").agg(F.count(F.lit(1)).alias("items"), *[F.count_if(c).alias(c) for c in ("majority", "any_vote", "unanimous")])


@query(f"with {SCORES}, t as (select source as value, count(*) filter (y = 0) n0, count(*) filter (y = 1) n1 from scores group by 1), z as (select *, sum(n0) over () t0, sum(n1) over () t1, count(*) over () l from t), e as (select *, (n0 + n1) * t0 / (t0 + t1) e0, (n0 + n1) * t1 / (t0 + t1) e1 from z) select max(t0 + t1)::bigint n, max(l) levels, round(sum((n0 - e0) ** 2 / e0 + (n1 - e1) ** 2 / e1), 6) chi2, (max(l) - 1)::bigint dof, round(min(least(e0, e1)), 6) min_expected, round(sqrt(sum((n0 - e0) ** 2 / e0 + (n1 - e1) ** 2 / e1) / max(t0 + t1)), 6) cramers_v from e")
def chi_square_source(spark, sf_dir):
    out = stats.chi_square(stats.crosstab(scores(spark, sf_dir), "source", "y"))
    return out.select("n", "levels", r(F.col("chi2")).alias("chi2"), "dof", r(F.col("min_expected")).alias("min_expected"), r(F.col("cramers_v")).alias("cramers_v"))


@query(f"with {SCORES}, t as (select search, count(*) filter (toxic = 0 and y = 0) + 0.5 a, count(*) filter (toxic = 0 and y = 1) + 0.5 b, count(*) filter (toxic = 1 and y = 0) + 0.5 c, count(*) filter (toxic = 1 and y = 1) + 0.5 d from scores group by 1), l as (select search, ln(a * d / (b * c)) lo, sqrt(1 / a + 1 / b + 1 / c + 1 / d) se from t) select search, round(exp(lo), 6)::double odds_ratio, round(exp(lo - 1.96 * se), 6)::double ci_low, round(exp(lo + 1.96 * se), 6)::double ci_high from l")
def odds_ratios(spark, sf_dir):
    n = lambda t, y: F.count_if((F.col("toxic") == t) & (F.col("y") == y))
    rows = scores(spark, sf_dir).groupBy("search").agg(*[n(t, y).alias(f"n{t}{y}") for t in (0, 1) for y in (0, 1)])
    return rows.select("search", *[r(v).alias(k) for k, v in stats.odds_ratio(*[F.col(f"n{t}{y}") for t in (0, 1) for y in (0, 1)]).items()])


@query(f"""with {SCORES}, k as (select search, y, rank() over (partition by search order by s) + (count(*) over (partition by search, s) - 1) / 2.0 rk from scores), a as (select search, count(*) n, sum(y) n1, sum(case when y = 1 then rk else 0 end) r1 from k group by 1)
select search, n1::bigint n1, (n - n1)::bigint n0, round(r1 - n1 * (n1 + 1) / 2, 6)::double u, round((r1 - n1 * (n1 + 1) / 2 - n1 * (n - n1) / 2) / sqrt(n1 * (n - n1) * (n + 1) / 12), 6)::double z, round((r1 - n1 * (n1 + 1) / 2 - n1 * (n - n1) / 2) / sqrt(n1 * (n - n1) * (n + 1) / 12) / sqrt(n), 6)::double effect_r from a""")
def rank_tests(spark, sf_dir):
    out = stats.rank_test(scores(spark, sf_dir), ["search"], "s", "y")
    return out.select("search", "n1", "n0", *[r(F.col(c)).alias(c) for c in ("u", "z", "effect_r")])


@query("with t as (select n_nationkey k, ((n_nationkey * 7) % 25 + 1) / 500.0 p from nation), q as (select *, least(p * count(*) over () / row_number() over (order by p, k), 1.0) w from t) select k, round(min(w) over (order by p desc, k desc rows unbounded preceding), 9)::double q from q")
def benjamini_hochberg(spark, sf_dir):
    t = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), (((F.col("n_nationkey") * 7) % 25 + 1) / 500.0).alias("p"))
    return stats.false_discovery(t, "p", "k").select("k", r(F.col("q"), 9).alias("q"))


@query(f"""with {SCORES}, a as (select search, avg(n_chars) filter (y = 0) m0, avg(n_chars) filter (y = 1) m1, var_samp(n_chars) filter (y = 0) v0, var_samp(n_chars) filter (y = 1) v1, quantile_cont(n_chars, 0.5) filter (y = 0) q0, quantile_cont(n_chars, 0.5) filter (y = 1) q1 from scores group by 1),
d as (select search, quantile_cont(abs(n_chars - q0), 0.5) filter (y = 0) d0, quantile_cont(abs(n_chars - q1), 0.5) filter (y = 1) d1 from scores join a using (search) group by 1)
select search, round(m0, 6) mean0, round(m1, 6) mean1, round((m1 - m0) / sqrt((v0 + v1) / 2), 6) smd, round(sqrt((d0 * d0 + d1 * d1) / 2), 6) pooled_mad from a join d using (search)""")
def mean_differences(spark, sf_dir):
    out = stats.mean_difference(scores(spark, sf_dir), ["search"], "n_chars", "y")
    return out.select("search", *[r(F.col(c)).alias(c) for c in ("mean0", "mean1", "smd", "pooled_mad")])


@query()
def bootstrap_medians(spark, sf_dir):
    return stats.bootstrap_median_difference(scores(spark, sf_dir), "search", "n_chars", "y", draws=200)


@query()
def permutation_test(spark, sf_dir):
    return stats.permutation_chi_square(scores(spark, sf_dir), "search", "y")


@query(f"""with {SCORES}, t as (select search, count(*) filter (toxic = 0 and y = 0) n00, count(*) filter (toxic = 0 and y = 1) n01, count(*) filter (toxic = 1 and y = 0) n10, count(*) filter (toxic = 1 and y = 1) n11 from scores group by search),
m as (select *, n00 + n01 r, n00 + n10 c, n00 + n01 + n10 + n11 n from t),
k as (select *, unnest(generate_series(greatest(0, r + c - n), least(r, c))) k from m),
p as (select *, lgamma(c + 1) - lgamma(k + 1) - lgamma(c - k + 1) + lgamma(n - c + 1) - lgamma(r - k + 1) - lgamma(n - c - r + k + 1) - lgamma(n + 1) + lgamma(r + 1) + lgamma(n - r + 1) lp from k),
h as (select *, max(case when k = n00 then lp end) over (partition by search) here from p)
select search, any_value(n00) n00, any_value(n01) n01, any_value(n10) n10, any_value(n11) n11, round(least(1.0, sum(exp(lp)) filter (lp <= here + 1e-9)), 6)::double fisher_p from h group by search""")
def fisher_tests(spark, sf_dir):
    n = lambda t, y: F.count_if((F.col("toxic") == t) & (F.col("y") == y))
    rows = scores(spark, sf_dir).groupBy("search").agg(*[n(t, y).alias(f"n{t}{y}") for t in (0, 1) for y in (0, 1)])
    return stats.with_fisher(rows, "n00", "n01", "n10", "n11").withColumn("fisher_p", r(F.col("fisher_p")))


@query(f"""with {SCORES}, h as (select *, ('0x' || substr(md5(doc_id || '|42'), 1, 15))::bigint h, count(*) over () c from scores),
n as (select *, row_number() over (partition by search, y order by h, doc_id) r, count(*) over (partition by search, y) n from h)
select doc_id, search, y from n where r <= greatest(1, floor(n * least(1.0::double, 100.0::double / c)))""")
def stratified_cap(spark, sf_dir):
    return splits.capped(scores(spark, sf_dir), ["search", "y"], "doc_id", 100).select("doc_id", "search", "y")
