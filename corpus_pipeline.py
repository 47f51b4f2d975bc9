"""Corpus pipeline: documents to packed training sequences.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and returns a DataFrame; between
stages the rows are written as Parquet and read again, so that no stage depends on an executor's memory. All but the last
return the columns of documents. Rows are only dropped by a stage's own decision: toxic documents, all but the one with the
smallest doc_id of a group of near-duplicates, and contaminated documents; the substring stage only cuts texts (n_chars follows).

Defined results, in every stage: null texts count as empty, and such rows pass all filters; a null doc_id is a document like any other (the last to
be chosen of a group); rows that share a doc_id are told apart by their texts; empty tables (documents, labels, benchmark) give empty or
unfiltered results; columns beyond doc_id and text, whatever their names, pass through all stages but the last, and n_chars, if there, follows a cut text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stallwise.llm import decontaminate, jaccard, packing, substring, toxicity
from stallwise.llm.shared import Workspace, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a score below 0.5; without labels the lexicon alone decides. Empty texts have the classifier's bias as their score."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.with_score(docs, model, "__toxicity").filter(F.col("__toxicity") < 0.5).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every group that links of 0.75 and more connect: the one with the smallest doc_id; repeated rows are one. Texts without words all stay."""
    return jaccard.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows; passages that stand in an earlier document, or earlier in the same one, are cut from the text. Null texts stay null."""
    out = substring.dedup_units(docs)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.size("removed") > 0, F.char_length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of whose words less than one in 20 stands in a window of the benchmark; null and empty texts stay."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows' tokens; a null text is the end token alone, and repeated rows are packed each."""
    return packing.pack(docs, packing.default_tokenizer())


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("substring dedup", cut_repeats),
    ("benchmark decontamination", drop_contaminated),
    ("packing", pack),
]

#: The first stage trains a classifier, the third cuts texts at content-defined places: SQL expresses neither.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, ws = table(spark, sf_dir, "documents"), Workspace(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = ws.write(stage(spark, docs, sf_dir), f"stage{k}")
        if k:
            ws.drop(f"stage{k - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
