"""Tolerant casts. Nothing here throws on bad input: what can't be read is null, and NaN is null too."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Texts that count as true, by the table they come from. The sets differ on purpose. Fixed values.
TRUE_SETS = {"speed": ("true", "1", "1.0", "yes", "y"), "cascade": ("true", "1", "1.0", "yes"), "sweep": ("true", "1", "yes"), "live": ("true", "1", "1.0", "yes", "sold")}
FALSE_SETS = {"speed": ("false", "0", "0.0", "no", "n")}


def number(c: Column) -> Column:
    """double, or null for anything that is no finite number."""
    x = c.try_cast("double")
    return F.when(~F.isnan(x), x)


def whole(c: Column) -> Column:
    """long of a numeric text such as 12 or 12.0."""
    x = number(c)
    return F.when(x == F.floor(x), x.try_cast("long"))


def first_number(c: Column) -> Column:
    """The first signed number in a text, a comma read as the decimal point."""
    return F.regexp_extract(F.translate(c.cast("string"), ",", "."), r"([-+]?\d+(?:\.\d+)?)", 1).try_cast("double")


def blank_to_null(c: Column) -> Column:
    text = F.trim(c.cast("string"))
    return F.when((text != "") & (F.lower(text) != "nan"), text)


def first_filled(*columns: Column) -> Column:
    """The first of the columns that is neither null nor blank."""
    return F.coalesce(*map(blank_to_null, columns))


def id_text(c: Column) -> Column:
    """Ids as text without a trailing .0; blank for a missing one."""
    return F.coalesce(F.regexp_replace(blank_to_null(c), r"\.0$", ""), F.lit(""))


def truth(c: Column, kind: str = "speed") -> Column:
    """Boolean of a text by one of the accept sets; with a reject set, texts in neither are null, else false."""
    text = F.lower(F.trim(c.cast("string")))
    if kind in FALSE_SETS:
        return F.when(text.isin(*TRUE_SETS[kind]), True).when(text.isin(*FALSE_SETS[kind]), False)
    return F.coalesce(text.isin(*TRUE_SETS[kind]), F.lit(False))


def timestamp(c: Column) -> Column:
    """ISO texts and d/M/y H:m:s texts, told apart value by value; null for others."""
    text = F.trim(c.cast("string"))
    iso = text.rlike(r"^\d{4}-\d{2}-\d{2}")
    return F.when(iso, F.try_to_timestamp(text)).otherwise(F.coalesce(F.try_to_timestamp(text, F.lit("d/M/y H:m:s")), F.try_to_timestamp(text, F.lit("d/M/y"))))


def hours_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / F.lit(3.6e9)


def clamp(x: Column, low, high) -> Column:
    """x held to [low, high]; null stays null."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def tracking_key(search: Column, item: Column) -> Column:
    return F.concat_ws("::", F.lower(F.trim(search)), id_text(item))


def derived_key(search: Column, item: Column) -> Column:
    """As tracking_key with the search's case kept."""
    return F.concat_ws("::", F.trim(search), id_text(item))


def prefixed_key(data_id: Column, link: Column) -> Column:
    """Dataid:… or else Link:…, blank if both are missing."""
    return F.when(id_text(data_id) != "", F.concat(F.lit("Dataid:"), id_text(data_id))).when(blank_to_null(link).isNotNull(), F.concat(F.lit("Link:"), blank_to_null(link))).otherwise("")


def benchmark_key(*parts: Column) -> Column:
    return F.concat_ws("|", *[F.coalesce(F.trim(p.cast("string")), F.lit("")) for p in parts])


def item_identity(item: Column, link: Column, title: Column, price: Column) -> Column:
    """The id, else the link, else title|price."""
    return F.coalesce(blank_to_null(item), blank_to_null(link), F.concat_ws("|", F.coalesce(title, F.lit("")), F.coalesce(price.cast("string"), F.lit(""))))


def id_from_link(link: Column) -> Column:
    """The numeric id in an item's URL."""
    return F.nullif(F.regexp_extract(link, r"/items/(\d+)", 1), F.lit(""))


def ensure_columns(df: DataFrame, schema: StructType) -> DataFrame:
    """df with exactly the schema's columns, cast; missing ones are null."""
    there = set(df.columns)
    return df.select(*[(F.col(f"`{f.name}`").try_cast(f.dataType) if f.name in there else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields])
