"""Relative dates such as "2 giorni fa" or "3 weeks ago". Three readings that differ on purpose, and age bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _amount(text: Column) -> Column:
    return F.translate(F.nullif(F.regexp_extract(text, r"(\d+(?:[.,]\d+)?)", 1), F.lit("")), ",", ".").try_cast("double")


def _has(text: Column, *parts: str) -> Column:
    found = F.contains(text, F.lit(parts[0]))
    for p in parts[1:]:
        found = found | F.contains(text, F.lit(p))
    return found


def upload_days(c: Column) -> Column:
    """Days, to 4 places. Today is 0, yesterday 1; without a number null. Singular units count too."""
    text = F.lower(F.trim(c))
    n = _amount(text)
    unit = (
        F.when(_has(text, "minut"), n / 1440.0).when(_has(text, "ore", "ora", "hour"), n / 24.0).when(_has(text, "settiman", "week"), n * 7.0)
        .when(_has(text, "mese", "mesi", "month"), n * 30.0).when(_has(text, "anno", "anni", "year"), n * 365.0).when(_has(text, "giorn", "day"), n)
    )
    return F.when(text.isin("", "unknown", "none", "nan", "<na>"), None).when(_has(text, "oggi", "today"), 0.0).when(_has(text, "ieri", "yesterday"), 1.0).otherwise(F.bround(unit, 4))


def upload_minutes(c: Column) -> Column:
    """Minutes; without a number 1 of the unit."""
    text = F.lower(F.trim(c))
    n = F.coalesce(_amount(text), F.lit(1.0))
    unit = (
        F.when(_has(text, "min"), n).when(_has(text, "ora", "ore", "hour", "heure", "h "), n * 60.0).when(_has(text, "giorn", "day", "jour", "d "), n * 1440.0)
        .when(_has(text, "sett", "week", "semain"), n * 10080.0).when(_has(text, "mese", "mesi", "month", "mois"), n * 43200.0)
    )
    return F.when(~text.isin("", "nan"), unit)


def upload_age_days(c: Column) -> Column:
    """Days; exactly today is 0 and yesterday 1; without a number 1 of the unit."""
    text = F.lower(F.trim(c))
    n = F.coalesce(_amount(text), F.lit(1.0))
    return (
        F.when(text == "", None).when(text.isin("oggi", "today"), 0.0).when(text.isin("ieri", "yesterday"), 1.0)
        .when(_has(text, "minuto", "minuti", "minute"), n / 1440.0).when(_has(text, "ora", "ore", "hour"), n / 24.0).when(_has(text, "giorno", "giorni", "day"), n)
        .when(_has(text, "settimana", "settimane", "week"), n * 7.0).when(_has(text, "mese", "mesi", "month"), n * 30.0).when(_has(text, "anno", "anni", "year"), n * 365.0)
    )


#: Upper ends (not included) of the age bands, in days. Fixed values.
AGE_BANDS = ((1, "<1d"), (2, "1d"), (7, "2-6d"), (14, "1-2w"), (30, "2-4w"), (90, "1-3m"), (365, "3-12m"))


def age_band(days: Column) -> Column:
    out = F.when(days.isNull() | F.isnan(days), "unknown")
    for end, name in AGE_BANDS:
        out = out.when(days < end, name)
    return out.otherwise("1y+")


def country(c: Column) -> Column:
    """What follows the last comma of a location; a last-visit text is unknown."""
    text = F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), r"\s+", " ")
    tail = F.trim(F.regexp_replace(F.trim(F.element_at(F.split(text, ","), -1)), r"(?i)^ultima visita.*", "unknown"))
    return F.when((text == "") | (F.lower(text) == "nan") | (tail == ""), "unknown").otherwise(tail)


def not_negative(c: Column) -> Column:
    return F.when(c >= 0, c)
