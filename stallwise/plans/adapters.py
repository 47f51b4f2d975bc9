"""Views of the test tables as the engine's concepts, and the same views as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The moment at which outcomes are judged. Fixed value.
NOW = "2024-01-31 00:00:00"
#: A total order of listing rows in time.
ORDER = ["ts", "l_orderkey", "page", "supplier", "price", "likes", "l_discount", "l_tax"]

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) under its name, with the SQL of its result."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r(c: Column, digits: int = 6) -> Column:
    """Computed doubles are compared to so many digits."""
    return F.round(c.cast("double"), digits)


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listing snapshots: many of each part. Equi-join on the part; Spark broadcasts the smaller side only by its own size check."""
    li, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    c = F.col
    return li.join(p, li["l_partkey"] == p["p_partkey"]).select(
        c("l_partkey").alias("item_id"), c("p_type").alias("search"), c("p_brand").alias("brand"), c("p_name").alias("title"), c("p_size").alias("size"), (c("p_retailprice") * (1 - 4 * c("l_discount"))).alias("price"),
        c("l_quantity").cast("int").alias("likes"), c("l_linenumber").alias("page"), c("l_shipdate").alias("ts"), "l_orderkey", c("l_suppkey").alias("supplier"), "l_discount", "l_tax", c("l_returnflag").alias("flag"), c("l_linestatus").alias("state"),
    )


LISTING = """listing as (
  select l_partkey item_id, p_type search, p_brand brand, p_name title, p_size as size, p_retailprice * (1 - 4 * l_discount) price, l_quantity::int likes, l_linenumber page, l_shipdate ts,
    l_orderkey, l_suppkey supplier, l_discount, l_tax, l_returnflag flag, l_linestatus state from lineitem join part on l_partkey = p_partkey)"""
LISTING_ORDER = "ts, l_orderkey, page, supplier, price, likes, l_discount, l_tax"


def scores(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """Scores and labels: documents with a label; the score is a fixed function of the text's length, with ties. more: columns of documents."""
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows = d.join(lab, "doc_id").select("doc_id", F.col("lang").alias("search"), F.col("quality").alias("y"), "toxic", "n_chars", "source", *more)
    return rows.withColumn("s", (F.pmod(F.col("n_chars"), F.lit(1000)).cast("double") / 1000))


SCORES = """scores as (
  select doc_id, lang search, quality y, toxic, n_chars, source, (n_chars % 1000)::double / 1000 s from documents join labels using (doc_id))"""


def model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long scores of three models for each labelled document."""
    rows = scores(spark, sf_dir)
    kinds = F.array(*[F.struct(F.lit(m).alias("model"), (F.pmod(F.col("n_chars") * k + F.col("doc_id"), F.lit(997)).cast("double") / 997).alias("score")) for m, k in (("a", 1), ("b", 7), ("c", 31))])
    return rows.select("doc_id", "search", "y", F.inline(kinds))


MODEL_SCORES = SCORES + """,
model_scores as (
  select doc_id, search, y, model, ((n_chars * k + doc_id) % 997)::double / 997 score from scores, (values ('a', 1), ('b', 7), ('c', 31)) v(model, k))"""


def tracked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracked items: a user's first view is the start, the first later purchase the sale; the search is the user's remainder by 5."""
    e = table(spark, sf_dir, "events")
    first = e.filter("event_type = 'view'").groupBy("user_id").agg(F.min("ts").alias("first_at"))
    sold = e.filter("event_type = 'purchase'").join(first, "user_id").filter("ts > first_at").groupBy("user_id").agg(F.min("ts").alias("sold_at"))
    return first.join(sold, "user_id", "left").withColumn("search", F.concat(F.lit("s"), (F.col("user_id") % 5).cast("string"))).withColumn("passed", F.col("user_id") % 3 != 0)


TRACKED = """firsts as (select user_id, min(ts) first_at from events where event_type = 'view' group by 1),
solds as (select user_id, min(ts) sold_at from events join firsts using (user_id) where event_type = 'purchase' and ts > first_at group by 1),
tracked as (select user_id, first_at, sold_at, 's' || (user_id % 5) search, user_id % 3 <> 0 passed from firsts left join solds using (user_id))"""


def checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rechecks: all later events of a tracked user; a purchase finds the item sold."""
    e = table(spark, sf_dir, "events")
    t = tracked(spark, sf_dir).select("user_id", "first_at", "search", "passed")
    return e.join(t, "user_id").filter("ts > first_at").select("user_id", "search", "passed", "first_at", F.col("ts").alias("at"), (F.col("event_type") == "purchase").alias("is_sold"))


CHECKS = TRACKED + """,
checks as (select user_id, search, passed, first_at, ts at, event_type = 'purchase' is_sold, (epoch_us(ts) - epoch_us(first_at)) / 3.6e9 age from events join tracked using (user_id) where ts > first_at)"""
