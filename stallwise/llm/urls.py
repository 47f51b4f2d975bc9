"""URL filters by a temporal list join, with DataFrame functions only.

A list is a log of dated entries: (kind, pattern, dated, listed), where listed tells whether the pattern is entered or struck. For each pattern the log
becomes validity intervals: an entry holds from its date to the next strike. Every capture (url, fetched_at) has a bounded number of keys, the
patterns that could name it: its URL, its host, its host's parent domains, and its path's prefixes, of those two only at the depths (numbers
of labels, of segments) that the list has; these few numbers come to the driver first. An as-of join, an equi-join on (kind, key) with
the fetch time inside the interval, finds the entries that were active then; Spark splits a hot host's rows and broadcasts the intervals only if they are
small by its own check. A marker row for each capture goes along, so captures without entries come out too, and one aggregation
by capture ends it.

Kinds: "url" (without scheme and fragment), "host", "domain" (the host and all below it), "prefix" (host and leading path segments).

Defined results: null or empty URLs have no keys and are not blocked; a null fetch time meets no interval; entries without
pattern, kind or date are void; of entries of one pattern and date, a strike wins; a repeated entry changes nothing; patterns and hosts are compared in
lower case, paths as they are; repeated captures are given each; an empty list blocks nothing. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import ascii_lower, table


def intervals(entries: DataFrame) -> DataFrame:
    """kind, pattern, since, until (null: still listed), the maximal intervals of each pattern."""
    rows = entries.select("kind", ascii_lower(F.col("pattern")).alias("low"), "pattern", "dated", "listed").filter("kind is not null and pattern is not null and dated is not null and listed is not null")
    # a path is compared as it is: only the host of a prefix or URL is lower-cased
    slash = F.instr("pattern", "/")
    own = F.when(F.col("kind").isin("host", "domain") | (slash == 0), F.col("low")).otherwise(F.concat(F.substr("low", F.lit(1), slash - 1), F.substr("pattern", slash)))
    rows = rows.select("kind", own.alias("pattern"), "dated", "listed").groupBy("kind", "pattern", "dated").agg(F.bool_and("listed").alias("listed"))
    w = Window.partitionBy("kind", "pattern").orderBy("dated")
    turns = rows.withColumn("before", F.lag("listed").over(w)).filter("listed != coalesce(before, false)")
    return turns.withColumn("until", F.lead("dated").over(w)).filter("listed").select("kind", "pattern", F.col("dated").alias("since"), "until")


def parts(url):
    """(host, path with its query) of a URL without scheme, user, port and fragment; the host in lower case."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(url, F.lit(""))), "#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = ascii_lower(F.regexp_replace(F.regexp_replace(F.regexp_extract(bare, r"^([^/?]*)", 1), r"^.*@", ""), r":\d*$", ""))
    return host, F.regexp_extract(bare, r"^[^/?]*(.*)$", 1)


def depths(held: DataFrame) -> dict[str, list[int]]:
    """The numbers of labels and of segments that the intervals' patterns of kind domain and prefix have: at most the length of the longest pattern."""
    depth = F.when(F.col("kind") == "domain", F.size(F.split("pattern", "[.]"))).otherwise(F.size(F.split("pattern", "/")) - 1)
    rows = held.filter(F.col("kind").isin("domain", "prefix")).select("kind", depth.alias("depth")).distinct().collect()
    return {kind: sorted(r["depth"] for r in rows if r["kind"] == kind and r["depth"] > 0) for kind in ("domain", "prefix")}


def keys(url, at: dict[str, list[int]]):
    """array of (kind, key) of a URL; domains and prefixes at the given depths."""
    host, rest = parts(url)
    labels = F.split(host, "[.]")
    segments = F.filter(F.split(F.regexp_extract(rest, r"^([^?]*)", 1), "/"), lambda s: s != "")
    pair = lambda kind, key: F.struct(F.lit(kind).alias("kind"), key.alias("key"))
    there = lambda kind, parts_: F.filter(F.array(*map(F.lit, at[kind])).cast("array<int>"), lambda d: d <= F.size(parts_))
    domains = F.transform(there("domain", labels), lambda d: pair("domain", F.array_join(F.slice(labels, F.size(labels) - d + 1, d), ".")))
    prefixes = F.transform(there("prefix", segments), lambda d: pair("prefix", F.concat(host, F.lit("/"), F.array_join(F.slice(segments, F.lit(1), d), "/"))))
    found = F.array_distinct(F.concat(F.array(pair("url", F.concat(host, rest)), pair("host", host)), domains, prefixes))
    return F.when(host == "", F.array().cast("array<struct<kind:string,key:string>>")).otherwise(found)


def evaluate(captures: DataFrame, entries: DataFrame, key: str) -> DataFrame:
    """key, url, fetched_at, rules (sorted kind:pattern of the entries active at the fetch) and blocked, for each row of captures (key, url, fetched_at)."""
    rows = captures.select(F.col(key).alias("c_key"), F.col("url").alias("c_url"), F.col("fetched_at").alias("c_at"))
    none = F.struct(F.lit("").alias("kind"), F.lit("").alias("key"))
    held = intervals(entries)
    each = rows.select("*", F.explode(F.concat(F.array(none), keys(F.col("c_url"), depths(held)))).alias("k")).select("c_key", "c_url", "c_at", "k.kind", "k.key")
    held = held.select(F.col("kind").alias("i_kind"), F.col("pattern").alias("i_pattern"), "since", "until")
    active = (F.col("kind") == F.col("i_kind")) & (F.col("key") == F.col("i_pattern")) & (F.col("c_at") >= F.col("since")) & (F.col("until").isNull() | (F.col("c_at") < F.col("until")))
    met = each.join(held, active, "left").filter((F.col("kind") == "") | F.col("i_kind").isNotNull())
    rule = F.when(F.col("i_kind").isNotNull(), F.concat_ws(":", "i_kind", "i_pattern"))
    out = met.groupBy("c_key", "c_url", "c_at").agg(F.count_if(F.col("kind") == "").alias("copies"), F.array_sort(F.collect_set(rule)).alias("rules"))
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return out.select(F.col("c_key").alias(key), F.col("c_url").alias("url"), F.col("c_at").alias("fetched_at"), "rules", (F.size("rules") > 0).alias("blocked"))


# The query: the test tables have neither fetch times nor lists, so both are made from pages by fixed rules ---------------

DAY = "2024-01-01"


def captures_of(pages: DataFrame) -> DataFrame:
    """Page n was fetched n minutes into the year, counted round."""
    at = F.timestamp_seconds(F.unix_timestamp(F.lit(DAY).cast("timestamp")) + (F.col("page_id") % 525600) * 60)
    return pages.select("page_id", "url", at.alias("fetched_at"))


def entries_of(pages: DataFrame) -> DataFrame:
    """A list log by a hash of the host: some hosts are listed, struck and listed again, some domains listed, some prefixes; and single URLs."""
    host, rest = parts(F.col("url"))
    hosts = pages.select(host.alias("host")).filter("host != ''").distinct().withColumn("h", F.conv(F.substring(F.md5("host"), 1, 4), 16, 10).cast("int") % 8)
    day = lambda n: F.lit(DAY).cast("timestamp") + F.make_dt_interval(n if hasattr(n, "cast") else F.lit(n))
    entry = lambda k, kind, pattern, n, listed: F.when(F.col("h") == k, F.struct(F.lit(kind).alias("kind"), pattern.alias("pattern"), day(n).alias("dated"), F.lit(listed).alias("listed")))
    below = F.regexp_replace("host", r"^[^.]*[.]", "")
    log = F.array(
        entry(0, "host", F.col("host"), 1, True), entry(0, "host", F.col("host"), 4, False), entry(0, "host", F.col("host"), 8, True), entry(1, "domain", below, 2, True), entry(2, "prefix", F.concat("host", F.lit("/en")), 0, True), entry(2, "prefix", F.concat("host", F.lit("/en")), 6, False)
    )
    single = pages.filter("page_id % 97 = 0 and url is not null").select(F.lit("url").alias("kind"), F.concat(host, rest).alias("pattern"), day((F.col("page_id") % 9).cast("int")).alias("dated"), F.lit(True).alias("listed"))
    return hosts.select(F.inline(F.array_compact(log))).unionByName(single)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    out = evaluate(captures_of(pages), entries_of(pages), "page_id")
    return out.select("page_id", "blocked", F.size("rules").cast("long").alias("n_rules"), F.array_join("rules", ",").alias("rules"))


OP4_SQL = r"""
with p as (
  select page_id, url, timestamp '2024-01-01' + to_minutes(page_id % 525600) fetched,
    regexp_replace(regexp_replace(trim(coalesce(url, '')), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') bare from pages),
q as (select page_id, url, fetched, lower(regexp_replace(regexp_replace(regexp_extract(bare, '^([^/?]*)', 1), '^.*@', ''), ':\d*$', '')) host, regexp_extract(bare, '^[^/?]*(.*)$', 1) rest from p),
hosts as (select host, ('0x' || substr(md5(host), 1, 4))::int % 8 h from (select distinct host from q where host <> '')),
i as (
  select 'host' kind, host pattern, timestamp '2024-01-02' since, timestamp '2024-01-05' until from hosts where h = 0
  union all select 'host', host, timestamp '2024-01-09', null from hosts where h = 0
  union all select distinct 'domain', regexp_replace(host, '^[^.]*[.]', ''), timestamp '2024-01-03', null::timestamp from hosts where h = 1
  union all select 'prefix', host || '/en', timestamp '2024-01-01', timestamp '2024-01-07' from hosts where h = 2
  union all select 'url', host || rest, min(timestamp '2024-01-01' + to_days((page_id % 9)::int)), null from q where page_id % 97 = 0 and url is not null group by 1, 2),
m as (
  select page_id, kind || ':' || pattern rule from q join i on
    case kind when 'host' then host = pattern when 'domain' then host = pattern or ends_with(host, '.' || pattern)
      when 'url' then host || rest = pattern else regexp_extract(rest, '^([^?]*)', 1) = '/en' and host || '/en' = pattern or starts_with(host || regexp_extract(rest, '^([^?]*)', 1), pattern || '/') end
    and fetched >= since and (until is null or fetched < until))
select q.page_id, count(rule) > 0 blocked, count(distinct rule) n_rules, coalesce(string_agg(distinct rule, ',' order by rule), '') rules from q left join m using (page_id) group by 1
"""

QUERIES = {"op4_url_filter": op4_url_filter}
SQL = {"op4_url_filter": OP4_SQL}
