"""From raw documents to packed sequences: the stages that make a training corpus."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import linededup, mixing, packing, quality, simhash
from newsloom.llm.common import table
from newsloom.session import stage


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the forest rejects go."""
    judged = quality.judge(docs, table(spark, sf_dir, "labels"))
    return judged.filter("_quality.kept").select(docs.columns)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that match an earlier line go; documents of which no word is left go with them."""
    left = linededup.remove_lines(docs).withColumn("n_chars", F.length("text").cast("long"))
    gone = (F.col("_lines.removed") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return left.filter(~F.coalesce(gone, F.lit(False))).select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: fingerprints of four-word shingles at most four bits apart."""
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in target weights: documents are left out or repeated as their source's target asks."""
    return mixing.mixture(docs).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes: sequences without two documents of a source or two copies."""
    return packing.packed(docs).withColumnRenamed("id", "doc_id")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("line dedup", repeated_lines),
    ("near copies", near_copies),
    ("mix sources", mix_sources),
    ("pack sequences", pack_sequences),
]
# Isolation forests, components and best fit are iterative: no SQL states them.  tests/llm holds brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
