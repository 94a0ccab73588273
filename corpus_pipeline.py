"""A cleaning pipeline over ``documents``: every stage reads what the one before kept, from Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm import toxicity
from llm.decontamination import contained
from llm.line_dedup import dedup_lines
from llm.mixing import mix
from llm.near_duplicates import near_duplicates
from llm.queries import held_out
from llm.registry import table
from llm.session import stored


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the tagger finds toxic go.

    Null, empty and blank texts are judged as texts of zero words. Repeated rows share their fate; rows without id are judged like others.
    """
    labels = table(spark, sf_dir, "labels").where(~held_out())
    return toxicity.without_toxic(docs, toxicity.fit(table(spark, sf_dir, "documents"), labels))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; a document that had lines and has none left goes with them. ``n_chars`` follows the text.

    Null, empty and blank texts had no lines and stay. Rows that repeat id and text are one document: they stay or go together.
    """
    out = dedup_lines(docs).where("n_lines = 0 OR n_removed < n_lines")
    n_chars = F.when(F.col("n_removed") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", n_chars).select(docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, 0.8) stays: the one with the smallest id.

    Null, empty and blank texts belong to no group and stay. Rows that repeat an id are one document, whose rows stay or go together; rows
    without id are no documents that could be told apart, and stay.
    """
    gone = near_duplicates(docs).groupBy("doc_id").agg(F.max("kept").alias("kept")).where("NOT kept")
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item (five words, 0.8) go, with all rows that repeat their id; texts without words and rows without id stay."""
    found = contained(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often the words of each document are taken."""
    return mix(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_stage),
    ("minhash_near_dedup", near_duplicate_stage),
    ("decontamination", benchmark_stage),
    ("mixing", mixing_stage),
]

#: A trained tagger and groups of near duplicates can't be expressed in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, over the whole ``documents`` table."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
