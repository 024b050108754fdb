"""The corpus pipeline: stages over ``documents``, each written as Parquet and reread for the next.

Every stage works on all rows its predecessor kept, and its decisions take effect: dropped rows are gone.
All stages but the last return the columns of ``documents``, unchanged; the last returns the packing.

1. Language ID: rows whose language is rejected go (null texts and texts without a letter among them).
2. Exact dedup: of equal texts one row stays, also among repeated rows.
3. SimHash near-dedup: of each component the document with the smallest id stays.
4. Decontamination: documents that hold a benchmark item go; texts without a word stay.
5. Best-fit packing: one row per piece of a document.

Rows with a null id go through all stages: they are held out of language learning, and a component whose
ids are all null stays whole. An empty table gives an empty packing.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import decontamination, exact, language, packing, simhash
from tidewatch.llm.common import crc_fold, stage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    learn = F.coalesce(crc_fold("doc_id", 4) != 2, F.lit(False))
    return language.accepted(docs, language.fit(docs, learn)).select(*COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact.deduplicate(docs).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicate(docs, shingle=4, radius=4).select(*COLUMNS)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.decontaminate(docs, benchmark).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("simhash_dedup", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("packing", pack),
]

#: Language ID learns centroids by k-means and packing tokenises: SQL cannot express them. Tests use brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
