"""Clusters of any size, and the whole way from listings to deals: blocks, products, variants, prices, scores.

Average linkage that ends at a distance can only merge rows that a chain of pairs below that distance connects: a mean below it has a member below it. So a large group
is cut into tiles, pairs of tiles meet in cells, each cell gives a spanning forest of its close pairs (fewer links than rows), the forests'
connected components are found by alternating stars, and every component is clustered on its own. Small groups are one component, and so are groups whose vectors
lie on an arc, where only neighbours can merge.

A row may stand for many equal ones, by its weight: they merge at distance 0, before all others.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..sources.scratch import Scratch
from .cluster import average_linkage_of_vectors, average_linkage_on_arc, centroids, cosine, let, numbered, on_arc, silhouette_of_vectors, unit, weighted_mean
from .deals import BATCH_RULES, DealRules, autotune, deal_z, price_stats, scored
from .ordered import ranked

#: Rows of a tile; a group of no more is clustered without looking for components.
TILE = 2000
#: Rows that share one call of Python, in the mean: small groups and components go together.
TOGETHER = 10_000
#: Cosine distances at which products, and variants that are not tuned, end. Share of a product's titles that have a core token. Fixed values.
PRODUCT, VARIANT, CORE, PRICE_WEIGHT, LEAST_PRODUCT = 0.24, 0.33, 0.70, 0.35, 4


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node, component (its smallest node) of every node of the edges (a, b), by alternating large and small stars until nothing changes."""

    def stars(pairs: DataFrame, large: bool) -> DataFrame:
        """Every node's neighbours (all larger ones; or all smaller ones with the node itself) are tied to the least of them."""
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        tied = both.join(least, "a")
        if large:
            return tied.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
        return tied.filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).filter("a != b").distinct()

    def mark(pairs: DataFrame):
        return pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    pairs = scratch.write(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct())
    before = None
    while (now := mark(pairs)) != before:
        before = now
        pairs = scratch.write(stars(scratch.write(stars(pairs, True)), False))
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(pairs.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    """The vectors as rows; those of groups with shorter vectors end in zeros, which change no dot product."""
    lists = vectors.combine_chunks()
    values, length = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False)
    if (length == length[0]).all():
        return values.reshape(len(lists), -1)
    out = np.zeros((len(lists), length.max()))
    out[np.arange(length.max()) < length[:, None]] = values
    return out


def _forest(left: pa.Table, right: pa.Table) -> pa.Table:
    """A spanning forest (a, b) of the pairs of a cell that are closer than the threshold."""
    out = {"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)}
    if left.num_rows and right.num_rows:
        a, b = left["node"].to_numpy(), right["node"].to_numpy()
        close = 1 - _matrix(left["v"]) @ _matrix(right["v"]).T < left["t"][0].as_py()
        la, lb, none = a.copy(), b.copy(), np.iinfo(np.int64).max
        while True:  # the least node of each piece spreads over the cell's pairs
            na = np.minimum(la, np.where(close, lb, none).min(axis=1))
            nb = np.minimum(lb, np.where(close, na[:, None], none).min(axis=0))
            if (na == la).all() and (nb == lb).all():
                break
            la, lb = na, nb
        out = {"a": np.concatenate((a, b)), "b": np.concatenate((la, lb))}
        keep = out["a"] != out["b"]
        out = {k: x[keep] for k, x in out.items()}
    return pa.table(out)


def _linkage(rows: pa.Table) -> pa.Table:
    """Labels and silhouettes of all components in the table, each on its own; a component's rows are those of one number."""
    order = np.lexsort((rows["node"].to_numpy(), rows["component"].to_numpy()))
    node, component, whole, t, w = (rows[k].to_numpy()[order] for k in ("node", "component", "whole", "t", "w"))
    x = _matrix(rows["v"])[order]
    label, s = np.zeros(len(x), np.int64), np.full(len(x), np.nan)
    cuts = np.flatnonzero(np.diff(component, prepend=component[0] - 1, append=component[-1] + 1))
    for a, b in zip(cuts, cuts[1:], strict=False):
        own = x[a:b, x[a:b].any(axis=0)]
        if b - a > 1:
            label[a:b] = average_linkage_on_arc(own, t[a], w[a:b]) if on_arc(own) else average_linkage_of_vectors(own, t[a], weight=w[a:b])
        if whole[a]:
            s[a:b] = silhouette_of_vectors(own, label[a:b], weight=w[a:b])
    return pa.table({"component": component, "local": label, "node": node, "silhouette": s})


def _separation(rows: pa.Table, means: pa.Table) -> pa.Table:
    """own: mean distance to the others of the row's cluster, if it is in this tile of clusters; other: the least mean distance to another one."""
    if not rows.num_rows or not means.num_rows:
        return pa.table({"node": pa.array([], pa.int64()), "own": pa.array([], pa.float64()), "other": pa.array([], pa.float64())})
    label, of, n = rows["label"].to_numpy(), means["label"].to_numpy(), means["n"].to_numpy()
    d = np.maximum(1 - _matrix(rows["v"]) @ _matrix(means["centroid"]).T, 0)
    mine = label[:, None] == of[None]
    size = (mine * n).sum(axis=1)
    own = np.where(size > 0, (np.where(mine, d, 0)).sum(axis=1) * size / np.maximum(size - 1, 1), np.nan)
    other = np.where(mine, np.inf, d).min(axis=1)
    return pa.table({"node": rows["node"].to_numpy(), "own": pa.array(np.where(size == 1, -1.0, own), from_pandas=True), "other": other})


def clusters(df: DataFrame, group: str, item: str, vector: str, threshold: float | Column, tile: int = TILE, weight: str | None = None) -> DataFrame:
    """group, item, label, silhouette: average linkage by cosine distance inside each group, up to the threshold (which may differ by group).

    Labels count from 0 in each group in the order of the clusters' first items. Rows without a group or vector are left out. The largest group of a task is a
    component; its memory is a few copies of its vectors, its time grows with the square of its rows. Groups of vectors of two components, the first above 0, need no cells
    and take time n log n. weight: how many equal rows a row stands for.
    """
    scratch = Scratch(df.sparkSession, "clusters")
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    rows = df.select(F.col(group).alias("g"), F.col(item).alias("item"), unit(F.col(vector)).alias("v"), t.cast("double").alias("t"), (F.col(weight) if weight else F.lit(1)).cast("double").alias("w"), F.col(vector).isNotNull().alias("there"))
    rows = rows.filter("g is not null and there").drop("there")  # no filter on v itself, which would scale all vectors once more
    rows = scratch.write(ranked(rows, [], ["g", "item"], "node", "all").drop("all"))
    arc = F.coalesce((F.max(F.size("v")) <= 2) & (F.min(F.get("v", F.lit(0))) > 0), F.lit(False))
    sizes = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("first"), arc.alias("arc"))
    rows = scratch.write(rows.join(sizes, "g").withColumn("large", (F.col("n") > tile) & ~F.col("arc")).drop("arc"))

    large = rows.filter("large").withColumn("tiles", F.ceil(F.col("n") / tile).cast("int")).withColumn("i", F.pmod(F.xxhash64("node"), "tiles").cast("int"))
    some = bool(large.head(1))
    found = rows.withColumn("component", F.col("first"))
    if some:
        cols = ["g", "node", "v", "t"]
        left = large.select(*cols, F.explode(F.sequence("i", F.col("tiles") - 1)).alias("j"), "i")
        right = large.select(*[F.col(c).alias(f"r_{c}") for c in cols], F.explode(F.sequence(F.lit(0), "i")).alias("k"), F.col("i").alias("l"))
        cell = lambda a, b: _forest(a, b.rename_columns([c.removeprefix("r_") for c in b.column_names]))
        edges = scratch.write(left.groupBy("g", "i", "j").cogroup(right.groupBy("r_g", "k", "l")).applyInArrow(cell, "a long, b long"))
        found = rows.join(components(edges, scratch), "node", "left").withColumn("component", F.when(F.col("large"), F.coalesce("component", "node")).otherwise(F.col("first")))

    # A component is named by its least node, so its name tells its group too.
    bins = max(1, math.ceil(rows.count() / TOGETHER))
    found = found.select("component", "node", "v", "t", "w", (~F.col("large")).alias("whole"), F.pmod(F.xxhash64("component"), F.lit(bins)).alias("bin"))
    local = scratch.write(found.groupBy("bin").applyInArrow(_linkage, "component long, local long, node long, silhouette double"))
    local = local.join(rows.select("node", "first", "large"), "node")
    # In a whole group the linkage's labels are in the order of first members already; those of a large group's components are put in that order.
    small = local.filter("not large").select("node", F.col("local").alias("label"), "silhouette")
    if some:
        parts = local.filter("large")
        firsts = ranked(parts.groupBy("first", "component", "local").agg(F.min("node").alias("least")), ["first"], ["least"], "label", "all")
        firsts = firsts.select(F.col("component").alias("fc"), F.col("local").alias("fl"), (F.col("label") - 1).alias("label"))
        same = (F.col("component") == F.col("fc")) & (F.col("local") == F.col("fl"))
        small = small.unionByName(parts.join(firsts, same).select("node", "label", "silhouette"))
    labelled = scratch.write(small)
    out = rows.join(labelled, "node")
    if some:
        out = out.join(_silhouettes(out.filter("large"), tile, scratch), "node", "left").withColumn("silhouette", F.when(F.col("large"), F.coalesce("s", F.lit(0.0))).otherwise(F.col("silhouette")))
    return out.select(F.col("g").alias(group), F.col("item").alias(item), "label", "silhouette")


def _silhouettes(rows: DataFrame, tile: int, scratch: Scratch) -> DataFrame:
    """node, s of the rows of large groups: tiles of rows meet tiles of the group's clusters."""
    means = scratch.write(centroids(rows, ["g", "label"], "v", "w"))
    of_group = means.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("clusters"))
    tiles = rows.groupBy("g").agg(F.ceil(F.max("n") / tile).cast("int").alias("tiles")).join(of_group, "g")
    left = rows.join(tiles, "g").select("g", "node", "label", "v", F.pmod(F.xxhash64("node"), "tiles").alias("i"), F.explode(F.sequence(F.lit(0), F.col("clusters") - 1)).alias("j"))
    right = means.join(tiles, "g").select(F.col("g").alias("mg"), F.col("label").alias("m_label"), "centroid", "n", F.pmod(F.xxhash64("label"), "clusters").cast("int").alias("l"), F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("k"))
    cell = lambda a, b: _separation(a, b.select(["m_label", "centroid", "n"]).rename_columns(["label", "centroid", "n"]))
    met = left.withColumn("i", F.col("i").cast("int")).groupBy("g", "i", "j").cogroup(right.groupBy("mg", "k", "l")).applyInArrow(cell, "node long, own double, other double")
    both = met.groupBy("node").agg(F.max("own").alias("a"), F.min("other").alias("b"))  # own is -1 in a cluster of one, whose silhouette is 0
    most = F.greatest("a", "b")
    return scratch.write(both.select("node", F.when((F.col("a") >= 0) & (F.col("b") < float("inf")) & (most > 0), (F.col("b") - F.col("a")) / most).otherwise(0.0).alias("s")))


def hashed_vector(words: Column, dims: int = 64) -> Column:
    """A text's words counted in dims cells by their hash: a stand-in for a text encoder's vector. Texts without words are alike: a 1 in the first cell."""
    at = F.when(F.size(words) > 0, F.transform(words, lambda w: F.pmod(F.crc32(w.cast("binary")), F.lit(dims)))).otherwise(F.array(F.lit(0).cast("long")))
    cells = F.sequence(F.lit(0).cast("long"), F.lit(dims - 1).cast("long"))
    return let(at, lambda found: F.transform(cells, lambda i: (F.size(found) - F.size(F.array_remove(found, i))).cast("double")))


def core_words(df: DataFrame, product: str, words: str, weight: str | None = None) -> DataFrame:
    """For each product: n, and counts, a map of each of its words to the rows that have it (of the words in half of the rows at least, so 2 for each word of a title)."""
    m = (F.col(weight) if weight else F.lit(1)).cast("long").alias("m")
    size = df.select(product, m).groupBy(product).agg(F.sum("m").alias("n"))
    each = df.select(product, m, F.explode(F.array_distinct(words)).alias("w")).groupBy(product, "w").agg(F.sum("m").alias("c"))
    frequent = each.join(size, product).filter(F.col("c") >= 0.5 * F.col("n")).groupBy(product).agg(F.map_from_entries(F.collect_list(F.struct("w", "c"))).alias("counts"))
    empty = F.create_map().cast("map<string,bigint>")
    return size.join(frequent, product, "left").withColumn("counts", F.coalesce("counts", empty))


def core_at(counts: Column, n: Column, fraction: Column) -> Column:
    return F.map_keys(F.map_filter(counts, lambda _, c: c / n >= fraction))


def empty_rates(df: DataFrame, product: str, words: str, core: float = CORE, weight: str | None = None) -> DataFrame:
    """product, empty_rate: the share of a product's rows whose words are all core words."""
    counted = core_words(df, product, words, weight).select(product, core_at(F.col("counts"), F.col("n"), F.lit(core)).alias("__core"))
    met = df.select(F.col(product).alias("__k"), F.col(words).alias("__w"), (F.col(weight) if weight else F.lit(1)).alias("__m")).join(counted, F.col("__k") == F.col(product))
    return met.groupBy(product).agg(weighted_mean((F.size(F.array_except("__w", "__core")) == 0).cast("double"), F.col("__m")).alias("empty_rate"))


def uniformity(df: DataFrame, product: str, words: str) -> DataFrame:
    """product, uniformity: the mean Jaccard similarity of the rows' words to the words that 0.7 of the product's rows have; two empty sets are alike."""
    counted = core_words(df, product, words)
    own = df.select(F.col(product).alias("__k"), F.array_distinct(words).alias("__w"))
    met = own.join(counted, F.col("__k") == F.col(product)).withColumn("__core", core_at(F.col("counts"), F.col("n"), F.lit(0.7)))
    return met.groupBy(product).agg(F.avg(text.jaccard(F.col("__w"), F.col("__core"), both_empty=1.0)).alias("uniformity"))


def variants(df: DataFrame, product: str, item: str, words: str, price: str, vector=hashed_vector, image: str | None = None, image_weight: float = 0.0, tune: bool = True, least: int = LEAST_PRODUCT, tile: int = TILE, weight: str | None = None) -> DataFrame:
    """df with variant_text, variant (from 0 in each product), similarity (to its variant's mean), and product_silhouette (null with one variant).

    A title's variant text is its words without the product's core. A row's features are the text's vector, the log price standardised in its product and
    weighted, and if given image_weight times the image's vector (a null one counts as zeros), scaled to length 1. tune sets core share, threshold and weight by product from how often
    the text is empty and how far prices scatter; products of fewer than least rows are one variant. weight: how many equal rows a row stands for.

    Texts are worked on once for each product, and their vectors keep only the cells that some text of the product uses, which changes no dot product.
    """
    c, scratch = F.col, Scratch(df.sparkSession, "variants")
    known = F.when((c(price) > 0) & ~F.isnan(price) & (c(price) < float("inf")), c(price).cast("double"))
    rows = df.withColumn("__p", known).withColumn("__m", (c(weight) if weight else F.lit(1)).cast("long"))
    texts = scratch.write(rows.groupBy(c(product).alias("__g"), c(words).alias("__t")).agg(F.sum("__m").alias("__m")))
    prices = scratch.write(rows.groupBy(c(product).alias("__g"), "__p").agg(F.sum("__m").alias("__m")))
    means = prices.groupBy("__g").agg(weighted_mean(F.log("__p"), c("__m")).alias("__mean"))
    spread = prices.join(means, "__g").groupBy("__g").agg(F.first("__mean").alias("__mean"), F.sqrt(weighted_mean(F.pow(F.log("__p") - c("__mean"), F.lit(2)), c("__m"))).alias("__sd"))
    counted = core_words(texts, "__g", "__t", "__m").join(spread, "__g")
    if tune:
        rates = empty_rates(texts, "__g", "__t", weight="__m").withColumnRenamed("empty_rate", "__rate")
        ratio = price_stats(prices, ["__g"], "__p", "__m").select("__g", F.try_divide("mad", "med").alias("__spread"))
        counted = counted.join(rates, "__g").join(ratio, "__g", "left")
        tuned = autotune(c("__rate"), c("__spread"))
    else:
        tuned = {"core_frac": F.lit(CORE), "price_weight": F.lit(PRICE_WEIGHT), "variant_threshold": F.lit(VARIANT)}
    enough = c("n") >= least
    counted = counted.select("__g", enough.alias("__enough"), "n", "__mean", "__sd", *[F.when(enough, v).otherwise(d).alias(f"__{k}") for (k, v), d in zip(tuned.items(), (CORE, PRICE_WEIGHT, VARIANT), strict=True)], "counts")
    counted = counted.withColumn("__core", core_at(c("counts"), c("n"), c("__core_frac"))).drop("counts", "n")
    texts = texts.drop("__m").join(counted, "__g").withColumn("__left", F.filter("__t", lambda w: ~F.array_contains("__core", w))).drop("__core")
    texts = texts.withColumn("variant_text", F.when(c("__enough"), F.array_join("__left", " ")).otherwise("")).withColumn("__u", F.when(c("__enough"), vector(c("__left")))).drop("__left")
    texts = scratch.write(texts)
    used = F.filter(F.transform("__u", lambda x, i: F.when(x.isNull() | (x != 0), i)), lambda i: i.isNotNull())
    used = texts.select("__g", F.explode(used).alias("__at")).groupBy("__g").agg(F.array_sort(F.collect_set("__at")).alias("__cells"))
    texts = texts.join(used, "__g", "left").withColumn("__u", F.when(c("__enough"), F.transform(F.coalesce("__cells", F.array().cast("array<int>")), lambda i: F.get("__u", i)))).drop("__cells")
    rows = rows.join(scratch.write(texts), (c(product) == c("__g")) & c(words).eqNullSafe(c("__t"))).drop("__g", "__t")
    z = F.coalesce((F.log("__p") - c("__mean")) / (c("__sd") + 1e-6), F.lit(0.0))
    features = F.concat("__u", F.array(c("__price_weight") * z))
    if image and image_weight > 0:
        none = F.array_repeat(F.lit(0.0), int(df.agg(F.max(F.size(image))).first()[0] or 0))
        features = F.concat(features, F.coalesce(F.transform(image, lambda x: image_weight * x.cast("double")), none))
    rows = scratch.write(rows.withColumn("__f", F.when(c("__enough"), unit(features))).drop("__u"))
    found = clusters(rows.filter("__f is not null"), product, item, "__f", c("__variant_threshold"), tile, "__m")
    found = found.select(c(product).alias("__g"), c(item).alias("__i"), "label", "silhouette")
    rows = rows.join(found, (c(product) == c("__g")) & (c(item) == c("__i")), "left").withColumn("variant", F.coalesce("label", F.lit(0).cast("long")))
    rows = scratch.write(rows)
    means = centroids(rows.filter("__f is not null"), [product, "variant"], "__f", "__m").select(c(product).alias("__mk"), c("variant").alias("__mv"), "centroid")
    per = rows.groupBy(c(product).alias("__pk")).agg(F.when(F.min("variant") < F.max("variant"), weighted_mean(c("silhouette"), c("__m"))).alias("product_silhouette"))
    rows = rows.join(means, (c(product) == c("__mk")) & (c("variant") == c("__mv")), "left").join(per, c(product) == c("__pk"))
    return rows.select(*df.columns, "variant_text", "variant", cosine(c("__f"), c("centroid")).alias("similarity"), "product_silhouette")


def variant_clusters(df: DataFrame, product: str, item: str, vector: str, price: str, threshold: float = VARIANT, price_weight: float = PRICE_WEIGHT, tile: int = TILE) -> DataFrame:
    """product, item, variant, similarity, silhouette: the variants of each product by a given vector and the price, for products of any size.

    A row's features are its vector and price_weight times its log price, standardised within the product (0 where the price is missing or not
    positive), scaled to length 1 together. similarity is that of a row's features to their mean in its variant.
    """
    c = F.col
    p = F.when((c(price) > 0) & ~F.isnan(price) & (c(price) < float("inf")), F.log(c(price).cast("double")))
    rows = df.select(c(product).alias("product"), c(item).alias("item"), c(vector).alias("v"), p.alias("p")).filter("product is not null and v is not null")
    spread = rows.groupBy("product").agg(F.avg("p").alias("mean"), F.stddev_pop("p").alias("sd"))
    z = F.coalesce((c("p") - c("mean")) / (c("sd") + 1e-6), F.lit(0.0))
    rows = rows.join(spread, "product").select("product", "item", unit(F.concat(c("v").cast("array<double>"), F.array(price_weight * z))).alias("f"))
    rows = Scratch(df.sparkSession, "variants").write(rows)
    found = clusters(rows, "product", "item", "f", threshold, tile).select(c("product").alias("__p"), c("item").alias("__i"), c("label").alias("variant"), "silhouette")
    rows = Scratch(df.sparkSession, "variants").write(rows.join(found, (c("product") == c("__p")) & (c("item") == c("__i"))).drop("__p", "__i"))
    means = centroids(rows, ["product", "variant"], "f").drop("n")
    return rows.join(means, ["product", "variant"]).select("product", "item", "variant", cosine(c("f"), c("centroid")).alias("similarity"), "silhouette")


def token_similarity(df: DataFrame, keys: list[str], item: str, words: str) -> DataFrame:
    """item, similarity: cosine of each item's set of words to the mean of its group's sets, as 0/1 vectors; items without words have no row."""
    each = df.select(*keys, item, F.explode(F.array_distinct(words)).alias("w"))
    counts = each.groupBy(*keys, "w").agg(F.count(F.lit(1)).alias("c"))
    length = counts.groupBy(*keys).agg(F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("q"))
    met = each.join(counts, [*keys, "w"]).groupBy(*keys, item).agg(F.sum("c").alias("s"), F.count(F.lit(1)).alias("k"))
    return met.join(length, keys).select(item, (F.col("s") / (F.sqrt("k") * F.col("q"))).alias("similarity"))


#: Bytes of the kinds of listings that are broadcast, measured; more are joined by shuffles.
BROADCAST = 64 << 20
#: What tells kinds of listings apart.
KIND = ("price", "snapshots", "title", "brand")


def kinds(rows: DataFrame) -> DataFrame:
    """The kinds of rows (item, title, brand, price, snapshots) that differ by more than the item: item, the least one, and weight, their number. Written."""
    return Scratch(rows.sparkSession, "kinds").write(rows.groupBy(*KIND).agg(F.min("item").alias("item"), F.count(F.lit(1)).alias("weight")))


def kind_deals(found: DataFrame, rules: DealRules = BATCH_RULES, vector=hashed_vector, tile: int = TILE) -> DataFrame:
    """The kinds of listings with all that listing_deals tells of them. Titles are worked on once each; a kind counts with its weight everywhere."""
    c, scratch = F.col, Scratch(found.sparkSession, "products")
    titles = found.groupBy("title", "brand").agg(F.min("item").alias("__i"), F.sum("weight").alias("__m")).withColumn("norm", text.normalise(c("title")))
    titles = titles.withColumn("words", text.tokens(c("norm"))).withColumn("block", text.block_key(c("brand"), c("norm")))
    titles = titles.withColumn("informative", F.size(text.informative_tokens(c("norm"), c("brand")))).withColumn("has_code", F.size(text.model_codes(c("norm"))) > 0)
    titles = scratch.write(titles.withColumn("negative", F.size(text.negative_flags(c("norm"))) > 0).drop("norm").withColumn("v", vector(c("words"))))
    products = clusters(titles, "block", "__i", "v", PRODUCT, tile, "__m").select(c("__i").alias("__item"), c("block").alias("__b"), c("label").alias("__l"))
    titles = scratch.write(titles.join(products, c("__i") == c("__item")).drop("v", "__m", "__item"))
    titles = scratch.write(numbered(titles, "__b", "__l", name="product_id").drop("__i", "__b", "__l").withColumnsRenamed({"title": "__title", "brand": "__brand"}))
    rows = found.join(titles, c("title").eqNullSafe(c("__title")) & c("brand").eqNullSafe(c("__brand"))).drop("__title", "__brand")
    rows = numbered(variants(scratch.write(rows), "product_id", "item", "words", "price", vector, tile=tile, weight="weight"), "product_id", "variant", name="variant_id")
    rows = scratch.write(rows.drop("words"))
    stats = price_stats(rows, ["variant_id"], "price", "weight").withColumnRenamed("n", "priced")
    members = rows.groupBy("variant_id").agg(F.sum("weight").alias("n"))
    rows = rows.join(members, "variant_id").join(stats, "variant_id", "left")
    rows = rows.withColumn("generic", text.is_generic(c("informative"), c("has_code"))).withColumn("z", deal_z(c("price"), c("priced"), c("med"), c("mad")))
    enough = c("priced") >= 3  # with fewer prices there is no estimate
    rows = rows.select(*[k for k in rows.columns if k not in ("med", "q25", "q75")], *[F.when(enough, c(k)).alias(k) for k in ("med", "q25", "q75")], c("similarity").alias("centroid_sim"), c("product_silhouette").alias("silhouette"))
    return scored(rows, rules).withColumnRenamed("n", "variant_count").drop("weight", "centroid_sim", "silhouette")


def of_each(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Each row with what is found of its kind."""
    found = Scratch(rows.sparkSession, "kinds").write(found.drop("item").withColumnsRenamed({k: f"__{k}" for k in KIND}))
    texts = [f.name for f in found.schema.fields if f.dataType.simpleString() == "string"]
    size = found.agg(F.sum(sum((F.coalesce(F.octet_length(k), F.lit(0)) for k in texts), F.lit(16 * len(found.columns))))).first()[0] or 0
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in KIND]
    return rows.join(F.broadcast(found) if size <= BROADCAST else found, same).drop(*[f"__{k}" for k in KIND])


def listings(df: DataFrame, item: str, title: str, brand: str, price: str, snapshots: str) -> DataFrame:
    """item, title, brand, price, snapshots of all listings that have an item, written."""
    c = F.col
    rows = df.select(c(item).alias("item"), c(title).alias("title"), c(brand).alias("brand"), c(price).cast("double").alias("price"), c(snapshots).alias("snapshots"))
    return Scratch(df.sparkSession, "listings").write(rows.filter("item is not null"))


def listing_deals(df: DataFrame, item: str, title: str, brand: str, price: str, snapshots: str, rules: DealRules = BATCH_RULES, vector=hashed_vector, tile: int = TILE) -> DataFrame:
    """From listings to scored deals: item, title, brand, price, snapshots, block, product_id, variant_id, variant_text, similarity, product_silhouette, variant_count,
    and all that deals.scored adds. Listings are compared inside their block (brand and codes or first words); each item is one row.

    Listings that differ by their item alone are one kind, which is worked on once, with its number as weight.
    """
    rows = listings(df, item, title, brand, price, snapshots)
    return of_each(rows, kind_deals(kinds(rows), rules, vector, tile))
