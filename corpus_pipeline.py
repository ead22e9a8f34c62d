"""A corpus pipeline: five operators, each on what its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wayloom.llm.common import materialize, table, working_tables
from wayloom.llm.exact_dedup import exact_dedup
from wayloom.llm.mixing import mix_documents
from wayloom.llm.near_dedup import near_dedup
from wayloom.llm.packing import pack_documents
from wayloom.llm.quality import keep_quality
from wayloom.llm.queries import tokenizer_path
from wayloom.llm.workers import small_batches, usual_batches


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text the classifier accepts; a null text is judged as an empty one, a null or repeated id by its own text."""
    small_batches(spark)
    return keep_quality(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the largest doc_id) of each group of equal texts; null texts equal empty ones, and a null id stays only among null ids."""
    return exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest doc_id) of each group of near duplicates: five-word shingles, 0.8 or more.

    Documents without words and those with a null id stay.
    """
    small_batches(spark)
    return near_dedup(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; those without words never. A null source is a source."""
    return mix_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences. A document that the mix repeats is packed as often; a null text is one piece."""
    small_batches(spark)
    return pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("exact", exact),
    ("near", near),
    ("mix", mix),
    ("pack", pack),
]

#: A trained model and a tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read again, and what a stage wrote besides is deleted.

    An empty table gives an empty result, and other columns go through all stages but the last.
    """
    docs, new = table(spark, sf_dir, "documents"), small_batches(spark)
    try:
        for name, stage in STAGES:
            with working_tables(spark):
                docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    finally:
        if new:
            usual_batches(spark)
    return docs
