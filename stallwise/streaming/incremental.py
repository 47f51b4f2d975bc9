"""Listings assigned to products and variants as they come, on Spark's arbitrary state.

A block's products, variants and price buffers are entries of their own in the state store (map states), so a batch rewrites only those that it touches.
Products come from a batch run as the stream's initial state. A listing goes to the product with the nearest centroid, or to none (-1) beyond the product's threshold;
there to the nearest variant, or a new one; its price joins the variant's last BUFFER prices before statistics are taken.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import text
from ..operators.deals import DealRules, deal_z, scored

#: Prices that a variant remembers; the distance and the weight of the log price of variants made here. Fixed values.
BUFFER, THRESHOLD, PRICE_WEIGHT = 200, 0.33, 0.35
OUT = "product long, variant long, variant_text string, dist double, similarity double, n long, priced long, med double, q25 double, q75 double, mad double"


def hashed(words: list[str], dims: int = 64) -> np.ndarray:
    """What operators.resolve.hashed_vector gives, scaled to length 1."""
    v = np.zeros(dims)
    for w in words:
        v[zlib.crc32(w.encode()) % dims] += 1
    v[0] += not words
    return v / np.linalg.norm(v)


@dataclass
class Product:
    centroid: np.ndarray
    n: int
    threshold: float
    core: list[str] = field(default_factory=list)


@dataclass
class Variant:
    centroid: np.ndarray
    n: int


def _nearest(centroids: list[np.ndarray], x: np.ndarray) -> tuple[int, float]:
    """(place, cosine distance) of the nearest, the first of equally near ones."""
    m = np.stack(centroids)
    d = 1 - m @ x / np.maximum(np.linalg.norm(m, axis=1) * np.linalg.norm(x), 1e-12)
    return int(d.argmin()), float(d.min())


class Block:
    """One block's products, variants and prices, in memory; changed holds the keys to write back."""

    def __init__(self, embed: Callable[[list[str]], np.ndarray] = hashed):
        self.embed = embed
        self.products: dict[int, Product] = {}
        self.variants: dict[tuple[int, int], Variant] = {}
        self.prices: dict[tuple[int, int], list[float]] = {}
        self.changed: set = set()

    def take(self, v: np.ndarray, words: list[str], price: float) -> tuple:
        """The values of OUT for one listing, after it has changed the state."""
        none = (None,) * 4
        if not self.products or not np.any(v):
            return (-1, -1, "", None, None, 0, 0, *none)
        ids = sorted(self.products)
        at, far = _nearest([self.products[k].centroid for k in ids], v)
        product = self.products[ids[at]]
        if far > product.threshold:
            return (-1, -1, "", far, None, 0, 0, *none)
        product.centroid = product.centroid + (v - product.centroid) / (product.n + 1)
        product.n += 1
        self.changed.add(ids[at])
        left = [w for w in words if w not in set(product.core)]
        good = bool(np.isfinite(price)) and price > 0
        x = np.append(self.embed(left), PRICE_WEIGHT * np.log(price) if good else 0.0)
        own, similarity = sorted(k for k in self.variants if k[0] == ids[at]), None
        place, away = _nearest([self.variants[k].centroid for k in own], x) if own else (0, np.inf)
        if away > THRESHOLD:
            key = (ids[at], len(own))
            self.variants[key], self.prices[key] = Variant(x, 1), []
        else:
            key, similarity = own[place], 1 - away
            variant = self.variants[key]
            variant.centroid = variant.centroid + (x - variant.centroid) / (variant.n + 1)
            variant.n += 1
        if good:
            self.prices[key] = [*self.prices[key], float(price)][-BUFFER:]
        self.changed.add(key)
        kept = np.array(self.prices[key])
        stats = none
        if len(kept):
            q25, med, q75 = np.quantile(kept, (0.25, 0.5, 0.75))
            stats = (float(med), float(q25), float(q75), float(np.median(np.abs(kept - med))))
        return (key[0], key[1], " ".join(left), far, similarity, self.variants[key].n, len(kept), *stats)


class Assigner(StatefulProcessor):
    """Keyed by block. Input: item, v, words, price and further columns, which pass through; order: the column by which a batch's rows are taken."""

    def __init__(self, order: str, embed: Callable[[list[str]], np.ndarray] = hashed):
        self.order, self.embed = order, embed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.products = handle.getMapState("products", "product long", "centroid array<double>, n long, threshold double, core array<string>")
        self.variants = handle.getMapState("variants", "product long, variant long", "centroid array<double>, n long")
        self.prices = handle.getMapState("prices", "product long, variant long", "prices array<double>")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for r in initialState.itertuples(index=False):
            self.products.updateValue((int(r.product),), (list(map(float, r.centroid)), int(r.n), float(r.threshold), list(r.core)))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        block = Block(self.embed)
        block.products = {k[0]: Product(np.array(v[0]), v[1], v[2], list(v[3])) for k, v in self.products.iterator()}
        block.variants = {tuple(k): Variant(np.array(v[0]), v[1]) for k, v in self.variants.iterator()}
        block.prices = {tuple(k): list(v[0]) for k, v in self.prices.iterator()}
        batch = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        out = [block.take(np.asarray(v, float), list(w), float("nan") if p is None else float(p)) for v, w, p in zip(batch["v"], batch["words"], batch["price"], strict=True)]
        for k in block.changed:
            if isinstance(k, tuple):
                self.variants.updateValue(k, (block.variants[k].centroid.tolist(), block.variants[k].n))
                self.prices.updateValue(k, (block.prices[k],))
            else:
                p = block.products[k]
                self.products.updateValue((k,), (p.centroid.tolist(), p.n, p.threshold, p.core))
        names = [c.split(" ")[0] for c in OUT.split(", ")]
        yield pd.concat([batch.reset_index(drop=True), pd.DataFrame(out, columns=names)], axis=1).drop(columns=["v", "words"])

    def close(self) -> None:
        pass


def assigned(stream: DataFrame, products: DataFrame, order: str, embed: Callable[[list[str]], np.ndarray] = hashed) -> DataFrame:
    """The stream's columns but v and words, with those of OUT, for each row as it comes. stream: block, item, v (array<double>), words (array<string>), price (double) and more;
    products: block, product, centroid, n, threshold, core. Needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass)."""
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema.fields if f.name not in ("v", "words")]
    return stream.groupBy("block").transformWithStateInPandas(Assigner(order, embed), ", ".join([*kept, OUT]), "Append", "None", initialState=products.groupBy("block"))


def scored_listings(rows: DataFrame, title: str, brand: str, snapshots: str, rules: DealRules = DealRules()) -> DataFrame:
    """The rows of assigned with deals.scored's columns; a listing without a product, or the first of a variant, has no score."""
    c = F.col
    norm = text.normalise(c(title))
    rows = rows.withColumn("__norm", norm).withColumn("informative", F.size(text.informative_tokens(c("__norm"), c(brand)))).withColumn("has_code", F.size(text.model_codes(c("__norm"))) > 0)
    rows = rows.withColumn("negative", F.size(text.negative_flags(c("__norm"))) > 0).withColumn("generic", text.is_generic(c("informative"), c("has_code")))
    known = (c("product") >= 0) & (c("n") > 1)
    rows = rows.withColumn("z", F.when(known, deal_z(c("price"), c("priced"), c("med"), c("mad")))).withColumn("snapshots", c(snapshots))
    return scored(rows.withColumn("centroid_sim", c("similarity")).withColumn("silhouette", F.lit(None).cast("double")), rules).drop("__norm", "centroid_sim", "silhouette")


def index_of(listings: DataFrame, product: str, block: str, vector: str, words: str, threshold: float) -> DataFrame:
    """The stream's initial state from a batch run: block, product, centroid, n, threshold, core (words in 0.7 of the rows) of each product."""
    from ..operators.cluster import centroids
    from ..operators.resolve import CORE, core_at, core_words

    core = core_words(listings, product, words).select(F.col(product).alias("__k"), core_at(F.col("counts"), F.col("n"), F.lit(CORE)).alias("core"))
    means = centroids(listings, [block, product], vector)
    return means.join(core, F.col(product) == F.col("__k")).select(F.col(block).alias("block"), F.col(product).cast("long").alias("product"), "centroid", "n", F.lit(threshold).alias("threshold"), "core")
