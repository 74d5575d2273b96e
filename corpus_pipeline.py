"""From raw documents to token ids: screen, deduplicate, decontaminate and encode.

Each stage works on all rows that its predecessor kept and is written before the
next one reads it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialloom.llm import decontam, dedup, minhash, pieces, quality
from trialloom.llm.common import table
from trialloom.session import settle

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def screen(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the quality discriminant scores below its threshold."""
    return quality.keep_quality(docs, table(spark, sf_dir, "labels"))


def unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each set of equal texts, that with the largest id."""
    return dedup.exact_dedup(docs, "largest")


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, that with the smallest id."""
    return minhash.near_dedup(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose tiles do not cover a benchmark item."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit), their number, and whether they decode to the text."""
    return pieces.round_trip_documents(docs.select("doc_id", "text")).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids",
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


STAGES: list[tuple[str, Stage]] = [
    ("quality", screen), ("exact_dedup", unique), ("near_dedup", distinct), ("decontamination", clean),
    ("encoding", encode)]

#: The first stage is a trained classifier, which SQL cannot express; the tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
