"""Sources and sinks. Readers take schemas, so no job infers them; bad rows are dropped or kept as told, missing paths are empty tables."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType



def _schema(ddl: str) -> StructType:
    """A schema of simple types without a session."""
    out = StructType()
    for field in ddl.split(", "):
        name, kind = field.split(" ")
        out = out.add(name, {"int": "integer"}.get(kind, kind))
    return out


#: A listing snapshot, in the column order of its files. Fixed values.
LISTING = _schema(
    "Title string, Price double, Brand string, Size string, Link string, Likes int, Dataid string, MarketStatus string, SearchDate string, Upload_date string, Images string, "
    "LocalImagePaths string, LocalPrimaryImagePath string, SearchCount int, Page int"
)
DOWNLOAD_EVENT = _schema("timestamp string, kind string, transport string, url string, host string, bytes_downloaded long, status_code int, ok boolean, metadata string")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether any file matches; asked of the path's own file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return bool(found is not None and len(found))


def read_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A headed CSV by column name; quoted newlines allowed; unreadable values are null; a missing path is an empty table."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("mode", "PERMISSIVE").csv(path)
    from ..functions.coerce import ensure_columns

    return ensure_columns(raw, schema)


def _matching(spark: SparkSession, glob: str) -> list[str]:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(glob)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return sorted(str(f.getPath()) for f in found) if found is not None else []


def _header(spark: SparkSession, path: str) -> str:
    """A file's first line; empty of an empty file."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    opened = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(p)
    try:
        jvm = spark.sparkContext._jvm.java
        return jvm.io.BufferedReader(jvm.io.InputStreamReader(opened, "UTF-8")).readLine() or ""
    finally:
        opened.close()


def _each(spark: SparkSession, paths: list[str], schema: StructType, name: str, part: int) -> DataFrame:
    """The files' rows by column name, with a part of the path, counted from its end. Files of one header are one scan, however many they are."""
    from ..functions.coerce import ensure_columns

    of: dict[str, list[str]] = {}
    for path in paths:
        of.setdefault(_header(spark, path), []).append(path)
    out = spark.createDataFrame([], StructType([*schema.fields]).add(name, "string"))
    tag = F.element_at(F.split(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), "/"), -part)
    for alike in of.values():
        raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("mode", "PERMISSIVE").csv(alike)
        rows = raw.select("*", tag.alias("__tag"))
        rows = raw.select(*[F.col(f"`{c}`") for c in raw.columns if c != name], tag.alias(name))
        out = out.unionByName(ensure_columns(rows, StructType([f for f in schema.fields if f.name != name]).add(name, "string")))
    return out


def read_tagged(spark: SparkSession, glob: str, schema: StructType, name: str = "source_file") -> DataFrame:
    """All files of a glob with their file name."""
    return _each(spark, _matching(spark, glob), schema, name, 1)


def read_search_folders(spark: SparkSession, root: str, file: str, schema: StructType, exclude: tuple[str, ...] = ()) -> DataFrame:
    """root/<search>/file of every folder that has one, with the folder's name as SearchName."""
    paths = [p for p in _matching(spark, f"{root.rstrip('/')}/*/{file}") if p.split("/")[-2] not in exclude]
    return _each(spark, paths, schema, "SearchName", 2)


def append_jsonl(df: DataFrame, path: str) -> None:
    """Adds the rows as lines of JSON to the folder at path, under Spark's commit protocol; null fields are left out."""
    df.write.mode("append").json(path)


def read_jsonl(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """One JSON object a line; blank and malformed lines are dropped."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def data_lines(spark: SparkSession, path: str) -> int:
    """Lines of a headed file without parsing them."""
    return max(0, spark.read.text(path).count() - 1) if exists(spark, path) else 0


def latest_run(spark: SparkSession, root: str, file: str, by: str = "name") -> str | None:
    """The folder below root that holds the file and is the last by name, or by "time": whose file was changed last, of equal times the last by name."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/*/{file}")
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p) or []
    order = (lambda f: (f.getModificationTime(), str(f.getPath()))) if by == "time" else (lambda f: str(f.getPath()))
    last = max(found, key=order, default=None)
    return str(last.getPath().getParent()) if last else None


def write_table(df: DataFrame, path: str, *partition_by: str, mode: str = "overwrite") -> None:
    """Parquet under Spark's commit protocol; with partitions, only those that df has are replaced."""
    writer = df.write.mode(mode).option("partitionOverwriteMode", "dynamic")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def append_distinct(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Old and new rows by name, the last of each key."""
    from ..operators.identity import dedupe

    return dedupe(old.unionByName(new, allowMissingColumns=True), keys, order, keep="last", blank="keep")


def upsert(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """table with changes by key: new keys are added, filled values replace old ones, empty ones don't."""
    t, c = table.alias("t"), changes.alias("c")
    joined = t.join(c, F.col(f"t.{key}") == F.col(f"c.{key}"), "full_outer")
    own = [F.coalesce(F.col(f"c.{n}") if n in changes.columns else F.lit(None), F.col(f"t.{n}")).alias(n) for n in table.columns]
    return joined.select(*own, *[F.col(f"c.{n}").alias(n) for n in changes.columns if n not in table.columns])


def delete(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return table.join(keys.select(key), key, "left_anti").select(*table.columns)


def write_json(spark: SparkSession, path: str, value) -> None:
    """A small manifest, through the path's file system, by a temporary name and a rename."""
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    target, part = fs_path(path), fs_path(path + ".part")
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(part, True)
    out.write(bytearray(json.dumps(value, sort_keys=True, indent=2).encode()))
    out.close()
    fs.delete(target, False)
    fs.rename(part, target)


def read_json(spark: SparkSession, path: str, default=None):
    if not exists(spark, path):
        return default
    text = spark.read.text(path, wholetext=True).first()[0]
    try:
        return json.loads(text)
    except ValueError:
        return default


def row_key(*columns: Column) -> Column:
    """A cache key of a row's values: the SHA-256 of their JSON."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def parse_list(c: Column) -> Column:
    """array<string> of a JSON or Python list in a text; a lone value is a list of one; blank is an empty list."""
    text = F.trim(F.coalesce(c, F.lit("")))
    quoted = F.regexp_replace(text, "'", '"')
    parsed = F.coalesce(F.from_json(text, "array<string>"), F.from_json(quoted, "array<string>"))
    return F.when(text.isin("", "nan", "[]", "None"), F.array().cast("array<string>")).when(text.startswith("["), F.coalesce(parsed, F.array(text))).otherwise(F.array(text))


def parse_vector(c: Column) -> Column:
    return F.from_json(c, "array<float>")


def image_source(primary: Column, local: Column, remote: Column) -> Column:
    """The local primary image, else the first local one, else the first remote one."""
    first = lambda x: F.get(parse_list(x), F.lit(0))
    blank = lambda x: F.nullif(F.trim(x), F.lit(""))
    return F.coalesce(blank(primary), blank(first(local)), blank(first(remote)))


def html_attribute(html: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(html, rf'{name}="([^"]*)"', 1), F.lit(""))


def valid_rows(df: DataFrame, *columns: str) -> DataFrame:
    """Rows whose columns are all filled."""
    from ..functions.coerce import blank_to_null

    for c in columns:
        df = df.filter(blank_to_null(F.col(c)).isNotNull())
    return df


def price_change(df: DataFrame, fresh: str, price: str = "Price") -> DataFrame:
    """Price from fresh where it differs by a cent or more, with PreviousPrice and PriceChanged."""
    changed = F.coalesce(F.abs(F.col(fresh) - F.col(price)) >= 0.01, F.lit(False))
    return df.select(*[c for c in df.columns if c not in (price, fresh)], F.when(changed, F.col(price)).alias("PreviousPrice"), changed.alias("PriceChanged"), F.when(changed, F.col(fresh)).otherwise(F.col(price)).alias(price))
