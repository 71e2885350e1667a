"""The corpus pipeline: quality, language, near-duplicates, repeated passages, packing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame. run()
writes what a stage returns to the shared folder and gives it to the next one as docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import langid, neardup, packing, quality, substrings
from tessera.llm.common import table, written
from tessera.llm.queries import TARGETS, tokenizer_path

#: Some stages look at what no SQL dialect expresses (a chain field, filters, a tokenizer).
ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the base rules and the line field keep."""
    return quality.keep_quality(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that a language is found for."""
    return langid.keep_language(docs, langid.train(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group: its smallest doc_id."""
    return neardup.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring passages taken out of the texts."""
    return substrings.rewrite(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all texts in full sequences, sources in the proportions of TARGETS."""
    packed = packing.pack(docs, tokenizer_path("byte_bpe_50k.json"), targets=TARGETS, others=1.0)
    return packed.select("doc_id", "source", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "sequence_tokens")


STAGES = [
    ("quality_rules", keep_quality),
    ("language_id", keep_language),
    ("near_duplicates", drop_near_duplicates),
    ("substrings", cut_repeats),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
