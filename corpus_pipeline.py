"""A training corpus from ``documents``: language, near duplicates, benchmark
decontamination, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before
kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docreason.llm import decontam, langid, packing, pii, simhash
from docreason.llm.common import read_table, store
from docreason.llm.queries import tokenizer_file


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is accepted stay."""
    return langid.accepted(docs, langid.train(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return simhash.representatives(docs, shingle=4, max_bits=4)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are taken out of the texts."""
    return decontam.decontaminated(docs, read_table(spark, sf_dir, "benchmark"), window=10)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are replaced by their kinds."""
    return pii.redacted(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces with their places in sequences."""
    return packing.pack_documents(docs, tokenizer_file("word_bpe_49k.json"), size=2048)


STAGES = [("language_id", language), ("near_duplicates", near_duplicates), ("decontamination", decontaminate),
          ("pii", redact), ("packing", pack)]

#: The stages are models, fingerprints and a packing that SQL cannot express;
#: tests/llm/test_pipeline.py holds run() against their brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
