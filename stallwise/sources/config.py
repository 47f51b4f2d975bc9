"""Configuration files: searches (a small YAML) and brand ids (CSV). Control plane: read on the driver, through Spark's file systems."""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession


def _text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def _scalar(text: str):
    text = text.strip()
    if text[:1] in "\"'" and text[-1:] == text[:1] and len(text) > 1:
        return text[1:-1]
    low = text.lower()
    if low in ("", "null", "~"):
        return None
    if low in ("true", "false"):
        return low == "true"
    if text.startswith("[") and text.endswith("]"):
        return [_scalar(x) for x in next(csv.reader([text[1:-1]], skipinitialspace=True), [])]
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def searches(spark: SparkSession, path: str, key: str = "searches") -> list[dict]:
    """The list of flat maps under a key; PyYAML reads it where it is installed, else the plain block form is read here."""
    text = _text(spark, path)
    try:
        import yaml
    except ImportError:
        out, inside = [], False
        for line in text.splitlines():
            bare = line.split(" #")[0].rstrip()
            if not bare.strip() or bare.lstrip().startswith("#"):
                continue
            if not line[:1].isspace() and not bare.startswith("-"):
                inside = bare.rstrip(":").strip() == key
                continue
            if inside:
                item = bare.strip()
                if item.startswith("- "):
                    out.append({})
                    item = item[2:]
                if ":" in item and out:
                    name, value = item.split(":", 1)
                    out[-1][name.strip()] = _scalar(value)
        return out
    return list(yaml.safe_load(text)[key])


def as_frame(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """A small table of the maps' texts; missing keys are null."""
    names = list(dict.fromkeys(k for r in rows for k in r))
    return spark.createDataFrame([tuple(None if r.get(n) is None else str(r[n]) for n in names) for r in rows], ", ".join(f"`{n}` string" for n in names))


def brand_ids(spark: SparkSession, path: str) -> dict[str, str]:
    """Brand names in lower case and their ids, of a headed CSV of two columns."""
    rows = list(csv.reader(_text(spark, path).splitlines()))
    return {r[0].strip().lower(): r[1].strip() for r in rows[1:] if len(r) > 1 and r[0].strip()}
