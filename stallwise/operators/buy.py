"""The buy decision: component scores, penalties, vetoes and their weighted sum, all as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.coerce import clamp, number
from ..functions.text import category, found_in
from .ordered import quantiles

#: Weights, words and limits of the decision. Fixed values.
WEIGHTS = {"resale": 0.34, "profit": 0.18, "margin": 0.14, "seller": 0.14, "demand": 0.08, "fresh": 0.06, "condition": 0.06, "visual": 0.0}
HARD_WORDS = ("replica", "fake", "falso", "contraff", "ispirat", "inspired", "non funziona", "doesn't work", "doesnt work", "not working", "rotto", "broken")
SOFT_WORDS = (
    "difetto", "defect", "difett", "graffi", "graffio", "scratch", "stain", "macchia", "senza scatola", "no box", "senza dust bag", "no dust bag", "missing", "manca",
    "solo disco", "disc only", "solo cartuccia", "no manual", "senza accessori", "bundle", "lotto", "stock", "blocco", "untested", "da pulire", "da sistemare",
)
BAD_CONDITIONS = ("satisfactory", "acceptable", "fair", "da sistemare", "poor", "rotto", "broken")
LOW_PRICE_SEARCHES = ("ps4", "ps5", "switch", "xbox", "game", "games")
FRESHNESS = ((1, 1.0), (3, 0.9), (7, 0.75), (14, 0.55), (30, 0.35))


def stars(c: Column) -> Column:
    """Stars 0 to 5; larger values are tenths; others null."""
    x = number(F.translate(F.trim(c.cast("string")), ",", "."))
    x = F.when(x > 5, x / 10.0).otherwise(x)
    return F.when(x.between(0, 5), x)


def seller_state(star: Column, reviews: Column) -> Column:
    n = number(reviews)
    return F.when((n > 0) & star.isNotNull(), "reviewed").when((n.isNull() | (n <= 0)) & star.isNull(), "new_unreviewed").otherwise("incomplete")


def seller_score(star: Column, reviews: Column) -> Column:
    n = F.greatest(F.coalesce(number(reviews), F.lit(0.0)), F.lit(0.0))
    r = F.least(F.log1p(n) / F.log1p(F.lit(50.0)), F.lit(1.0))
    state = seller_state(star, reviews)
    return F.when(state == "new_unreviewed", 0.35).when(state == "incomplete", 0.20 + 0.15 * r).otherwise(star / 5.0 * (0.70 + 0.30 * r))


def demand_score(interested: Column, views: Column) -> Column:
    i, v = (F.greatest(F.coalesce(number(x), F.lit(0.0)), F.lit(0.0)) for x in (interested, views))
    share = F.when(v > 0, F.least(i / v / 0.15, F.lit(1.0))).when(i > 0, 0.5).otherwise(0.0)
    return 0.6 * F.least(i / 10.0, F.lit(1.0)) + 0.4 * share


def freshness_score(days: Column) -> Column:
    d = number(days)
    out = F.when(d.isNull(), 0.55)
    for end, score in FRESHNESS:
        out = out.when(d <= end, score)
    return out.otherwise(0.15)


def condition_score(c: Column) -> Column:
    text = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    has = lambda *ws: reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in ws])
    return (
        F.when(text.isin("", "unknown"), 0.6).when(has(*BAD_CONDITIONS), 0.2).when(has("new with tags", "nuovo con cartellino"), 1.0).when(has("new", "nuovo"), 0.9)
        .when(has("very good", "ottime", "excellent"), 0.82).when(has("good", "buone"), 0.68).otherwise(0.55)
    )


def decide(df: DataFrame, min_score: float = 0.55, min_seller: float = 0.30, weights: dict[str, float] | None = None, visual_scale: float = 1.0) -> DataFrame:
    """Adds buy_score, worth_buying and buy_notes.

    Reads safety, score, confidence, margin, profit, stars, reviews, interested, views, upload_days, condition, description, visual, visual_penalty;
    any may be null.
    """
    c, w = F.col, weights or WEIGHTS
    star = stars(c("stars"))
    fallback = clamp(F.coalesce(c("score"), F.lit(0.0)) / 6.0, 0.0, 1.0) * clamp(F.coalesce(c("confidence"), F.lit(0.0)), 0.0, 1.0) * F.coalesce(clamp((c("margin") + 0.05) / 0.55, 0.0, 1.0), F.lit(1.0))
    parts = {
        "resale": F.coalesce(clamp(c("safety") / 100.0, 0.0, 1.0), fallback),
        "profit": F.coalesce(clamp(c("profit") / 40.0, 0.0, 1.0), F.lit(0.45)),
        "margin": F.coalesce(clamp(c("margin") / 0.50, 0.0, 1.0), F.lit(0.45)),
        "seller": seller_score(star, c("reviews")),
        "demand": demand_score(c("interested"), c("views")),
        "fresh": freshness_score(c("upload_days")),
        "condition": condition_score(c("condition")),
        "visual": F.coalesce(clamp(c("visual"), 0.0, 1.0), F.lit(0.0)),
    }
    df = df.select("*", *[v.alias(f"__{k}") for k, v in parts.items()], found_in(c("description"), HARD_WORDS).alias("__hard"), F.array_sort(F.array_distinct(F.concat(found_in(c("description"), SOFT_WORDS), found_in(c("condition"), BAD_CONDITIONS)))).alias("__soft"), seller_state(star, c("reviews")).alias("__state"))
    hard, soft = F.size("__hard") > 0, F.size("__soft")
    rules = (  # condition, penalty, note
        (hard, F.lit(0.55), "hard_description_risk"),
        (soft > 0, F.least(F.lit(0.25), 0.06 * soft), "description_or_condition_risk"),
        (c("__state") == "new_unreviewed", F.lit(0.0), "new_unreviewed_seller"),
        (c("__state") == "incomplete", F.lit(0.0), "seller_metrics_incomplete"),
        (c("__seller") < min_seller, F.lit(0.20), "weak_seller_profile"),
        (c("__condition") < 0.35, F.lit(0.20), "poor_condition"),
        (c("margin") < 0.10, F.lit(0.18), "thin_expected_margin"),
        (c("profit") < 8.0, F.lit(0.12), "thin_expected_profit"),
        (c("visual") < 0.42, F.lit(0.0), "visual_low_confidence"),
        (c("visual_penalty") >= 0.12, F.lit(0.0), "visual_risk"),
    )
    penalty = reduce(lambda a, b: a + b, [F.when(rule, p).otherwise(0.0) for rule, p, _ in rules])
    total = reduce(lambda a, b: a + b, [w.get(k, 0.0) * c(f"__{k}") for k in parts])
    notes = F.array_compact(F.array(*[F.when(rule, F.lit(n)) for rule, _, n in rules], F.when(hard, F.concat(F.lit("hard:"), F.array_join("__hard", "|"))), F.when(soft > 0, F.concat(F.lit("soft:"), F.array_join("__soft", "|")))))
    score = clamp(total - penalty - visual_scale * F.coalesce(c("visual_penalty"), F.lit(0.0)), 0.0, 1.0)
    df = df.select("*", score.alias("buy_score"), F.array_join(notes, ";").alias("buy_notes"))
    return df.withColumn("worth_buying", (c("buy_score") >= min_score) & ~hard).drop(*[f"__{k}" for k in parts], "__hard", "__soft", "__state")


def minimum_score(search: Column, title: Column, base: float = 0.55, thresholds: dict[str, float] | None = None) -> Column:
    """The score asked for: that of the search (trimmed, in lower case), else that of the category, else the base."""
    own = F.lower(F.trim(F.coalesce(search, F.lit(""))))
    kind, out = category(search, title), F.lit(float(base))
    for column in (kind, own):
        for name, value in (thresholds or {}).items():
            out = F.when(column == name, float(value)).otherwise(out)
    return out


#: What a photo must have, and what each fault costs: condition on the metrics, penalty, note. Fixed values.
PHOTO_FAULTS = (("least(width, height) < 220", 0.18, "low_resolution"), ("brightness < 0.18 or brightness > 0.92", 0.14, "extreme_brightness"), ("contrast < 0.10", 0.15, "low_contrast"), ("blur_score < 25.0", 0.18, "blurry"))
SCREENSHOT = ("try_divide(width, height) > 1.25 or try_divide(width, height) < 0.60", 0.22, "suspicious_aspect_ratio")


def photo_quality(df: DataFrame) -> DataFrame:
    """Adds quality_score, screenshot_risk and photo_notes from width, height, brightness, contrast and blur_score of each image."""
    rules = [(F.expr(rule), cost, note) for rule, cost, note in (*PHOTO_FAULTS, SCREENSHOT)]
    costs = [F.when(rule, cost).otherwise(0.0) for rule, cost, _ in rules]
    notes = F.array_compact(F.array(*[F.when(rule, F.lit(note)) for rule, _, note in rules]))
    return df.withColumn("screenshot_risk", costs[-1]).withColumn("quality_score", clamp(1.0 - sum(costs[:-1], F.lit(0.0)) - costs[-1], 0.0, 1.0)).withColumn("photo_notes", F.array_join(notes, ";"))


def required_profit(price: Column, search: Column, title: Column, base: float = 8.0, cutoff: float = 30.0, floor: float = 3.0, ratio: float = 0.28) -> Column:
    """The profit asked for: for low prices, or searches of cheap things, relaxed to a share of the price."""
    texts = [F.lower(F.coalesce(x, F.lit(""))) for x in (search, title)]
    cheap = reduce(lambda a, b: a | b, [F.contains(t, F.lit(w)) for t in texts for w in LOW_PRICE_SEARCHES], F.coalesce(price <= cutoff, F.lit(False)))
    return F.when(cheap, F.least(F.lit(base), F.greatest(F.lit(floor), F.coalesce(F.when(price > 0, price * ratio), F.lit(floor))))).otherwise(base)


def photo_scores(missing: Column, low_quality: Column, one_image: Column, duplicates: Column, contrast: Column, sharpness: Column, price: Column, brand: Column, condition: Column, pictures: Column) -> dict[str, Column]:
    """Bad-photo probability, value signal, risk penalty and opportunity."""
    zero = lambda x, d=0.0: F.coalesce(x.cast("double"), F.lit(d))
    flag = lambda x: F.coalesce(x, F.lit(False)).cast("double")
    bad = clamp(0.15 + 0.35 * zero(low_quality, 0.5) + 0.15 * zero(one_image) + 0.10 * clamp(zero(duplicates) / 3.0, 0.0, 1.0) + 0.10 * flag(contrast < 0.10) + 0.10 * flag(sharpness < 25.0) + 0.20 * zero(missing), 0.0, 1.0)
    cheap = F.coalesce(clamp(1.0 - (price - 20.0) / 180.0, 0.0, 1.0), F.lit(0.35))
    value = clamp(0.25 * zero(brand) + 0.35 * cheap + 0.15 * zero(condition) + 0.10 * F.when(zero(pictures) >= 2, 1.0).otherwise(0.25) + 0.15, 0.0, 1.0)
    risk = clamp(0.35 * zero(missing) + 0.10 * (1.0 - zero(brand)) + 0.20 * flag(price > 250), 0.0, 1.0)
    return {"bad_photo": bad, "value_signal": value, "risk_penalty": risk, "opportunity": clamp(0.55 * bad + 0.35 * value - 0.25 * risk, 0.0, 1.0)}


def rule_score(df: DataFrame, price: str, likes: str, page: str) -> DataFrame:
    """Adds rule_score: .62 cheapness between the 10 % and 50 % price quantiles, .23 demand against the 90 % quantile of likes, .15 earliness of the page.

    The quantiles are one row, joined by broadcast.
    """
    prices, demands = quantiles(df, [], F.col(price), [0.1, 0.5], "__p"), quantiles(df, [], F.col(likes), [0.9], "__q")
    q = prices.join(F.broadcast(demands), F.lit(True)).select("__p", F.col("__q")[0].alias("__l"))
    low, mid = F.col("__p")[0], F.col("__p")[1]
    cheap = clamp(1.0 - F.try_divide(F.col(price) - low, F.greatest(mid - low, F.lit(1e-9))), 0.0, 1.0)
    demand = clamp(F.col(likes) / F.greatest(F.col("__l"), F.lit(1.0)), 0.0, 1.0)
    early = clamp(1.0 - (F.col(page) - 1) / 9.0, 0.0, 1.0)
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    return df.join(F.broadcast(q), F.lit(True)).withColumn("rule_score", 0.62 * zero(cheap) + 0.23 * zero(demand) + 0.15 * zero(early)).drop("__p", "__l")


def rule_grid(df: DataFrame, label: str, profit: str, grid: dict[str, list[float]]) -> DataFrame:
    """Every combination of minimum thresholds against all rows: selected, positives, precision and profit of each rule.

    Rows are first counted by how many of each column's thresholds they reach (a partial aggregate whose size is the grid's, not the rows'); only these
    counts meet the rules, in a broadcast of the grid.
    """
    spark = df.sparkSession
    levels = {c: sorted(v) for c, v in grid.items()}
    reached = [F.aggregate(F.array(*[F.coalesce((F.col(c) >= t).cast("int"), F.lit(0)) for t in ts]), F.lit(0), lambda a, x: a + x).alias(f"__l{k}") for k, (c, ts) in enumerate(levels.items())]
    cells = df.select(*reached, F.col(label).cast("long").alias("y"), F.col(profit).alias("p")).groupBy(*[f"__l{k}" for k in range(len(levels))]).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("y"), F.sum("p").alias("p"))
    rules = spark.range(1).select()
    for k, (c, ts) in enumerate(levels.items()):
        one = F.explode(F.array(*[F.struct(F.lit(float(t)).alias(f"min_{c}"), F.lit(j + 1).alias(f"__need{k}")) for j, t in enumerate(ts)]))
        rules = rules.select("*", one.alias(f"__r{k}")).select(*rules.columns, f"__r{k}.*")
    meets = reduce(lambda a, b: a & b, [F.col(f"__l{k}") >= F.col(f"__need{k}") for k in range(len(levels))])
    names = [f"min_{c}" for c in levels]
    out = cells.join(F.broadcast(rules), meets).groupBy(*names).agg(F.sum("n").alias("selected"), F.sum("y").alias("positives"), F.sum("p").alias("profit"))
    return out.withColumn("precision", F.col("positives") / F.col("selected"))


def visual_summary(images: DataFrame, item: str, position: str, search: str, title: str, most: int = 6, main: float = 0.55) -> DataFrame:
    """What the first images of each item say together: scores, risk, counts and notes.

    images: a row for each image, also for those that could not be read (quality_score null): search, title, hash_value (a string of bits),
    quality_score, screenshot_risk, photo_notes. An item without images has a row with a null position. Images alike in all but 4 bits are
    one; arrays hold at most ``most`` images.
    """
    c = F.col
    place = F.row_number().over(Window.partitionBy(item).orderBy(F.asc_nulls_last(position)))
    rows = images.withColumn("__p", place).filter(c("__p") <= most)
    shot = F.struct(c("__p"), "hash_value", "quality_score", "screenshot_risk", "photo_notes")
    per = rows.groupBy(item).agg(F.max(search).alias("search"), F.max(title).alias("title"), F.count(position).alias("n"), F.array_sort(F.collect_list(F.when(c("quality_score").isNotNull(), shot))).alias("s"))
    apart = lambda a, b: F.when(F.length(a) != F.length(b), F.greatest(F.length(a), F.length(b))).otherwise(F.length(F.replace(F.array_join(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when(x == y, F.lit("")).otherwise("1")), ""), F.lit(" "), F.lit(""))))
    kept = F.aggregate("s", F.array().cast("array<string>"), lambda a, s: F.when(F.exists(a, lambda h: apart(h, s["hash_value"]) <= 4), a).otherwise(F.array_append(a, s["hash_value"])))
    mean_of = lambda test: F.try_divide(F.aggregate("s", F.lit(0.0), lambda a, s: a + F.when(test(s), 1.0).otherwise(0.0)), c("seen"))
    per = per.withColumn("seen", F.size("s")).withColumn("unique", F.size(kept)).withColumn("kind", category(c("search"), c("title")))
    per = per.withColumn("dup", F.try_divide(c("seen") - c("unique"), c("seen"))).withColumn("low", mean_of(lambda s: s["quality_score"] < 0.45)).withColumn("shots", mean_of(lambda s: s["screenshot_risk"] > 0))
    rest = (1 - main) / F.greatest(c("seen") - 1, F.lit(1))
    weighted = F.when(c("seen") == 1, F.get("s", F.lit(0))["quality_score"]).otherwise(F.aggregate("s", F.lit(0.0), lambda a, s: a + s["quality_score"] * F.when(s["__p"] == F.get("s", F.lit(0))["__p"], main).otherwise(rest)))
    luxury = c("kind") == "luxury"
    target = F.when(luxury, 4.0).when(c("kind") == "game", 2.0).otherwise(3.0)
    unit = lambda x: clamp(x, 0.0, 1.0)
    per = per.withColumn("target", target).withColumn("quality", unit(weighted - 0.20 * c("dup"))).withColumn("complete", unit(0.65 * unit(c("unique") / target) + 0.35 * (1 - c("dup"))))
    per = per.withColumn("consistent", unit(0.58 + 0.22 * c("quality") + 0.20 * (1 - c("shots"))))
    per = per.withColumn("authentic", F.when(luxury, unit(0.45 * c("complete") + 0.35 * c("quality") + 0.20 * c("consistent"))).otherwise(unit(0.40 + 0.35 * c("complete") + 0.25 * c("consistent"))))
    score = unit(0.36 * c("quality") + 0.24 * c("complete") + 0.20 * c("consistent") + 0.20 * c("authentic"))
    risk = 0.20 * (1 - c("quality")) + 0.12 * (1 - c("complete")) + 0.10 * (1 - c("consistent")) + F.when(luxury, 0.12).otherwise(0.06) * (1 - c("authentic")) + 0.10 * c("dup") + 0.08 * c("shots")
    notes = F.array_compact(F.concat(
        F.filter(F.flatten(F.transform("s", lambda s: F.split(s["photo_notes"], ";"))), lambda x: x != ""),
        F.array(
            F.when(c("n") > c("seen"), F.lit("image_fetch_failed")), F.when(luxury & (c("authentic") < 0.45), F.lit("low_authenticity_evidence")), F.when(c("dup") >= 0.5, F.lit("duplicate_images")),
            F.when(c("unique") < c("target"), F.lit("limited_visual_coverage")), F.when(c("low") >= 0.5, F.lit("mostly_low_quality_images")),
        ),
    ))
    none, failed = c("n") == 0, c("seen") == 0
    pick = lambda value, empty, lost: F.when(none, empty).when(failed, lost).otherwise(value)
    return per.select(
        item, pick(score, 0.45, 0.40).alias("visual"), pick(clamp(risk, 0.0, 0.55), 0.08, 0.10).alias("visual_penalty"), pick(c("quality"), 0.45, 0.40).alias("quality"), pick(c("complete"), 0.35, 0.30).alias("completeness"),
        pick(c("consistent"), 0.55, 0.55).alias("consistency"), pick(c("authentic"), 0.45, 0.40).alias("authenticity"), F.when(failed & ~none, c("n")).otherwise(c("seen")).cast("long").alias("images"), c("unique").cast("long").alias("unique_images"),
        pick(c("low"), 1.0, 1.0).alias("low_quality"), pick(c("shots"), 0.0, 0.0).alias("screenshots"), F.when(none, "no_images").when(failed, "all_images_failed").otherwise(F.array_join(F.array_sort(F.array_distinct(notes)), "|")).alias("visual_notes"),
    )
