"""Helpers shared by the operators: tables in the shared folder, text access."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docreason.session import materialize, ship_package

__all__ = ["documents", "keyed_text", "read_table", "row_key", "store", "with_text", "with_workers"]


def with_text(batch: pa.RecordBatch, texts: list[str | None]) -> pa.RecordBatch:
    """The rows with other texts; ``n_chars``, where there is one, follows."""
    for name, values in (("text", texts), ("n_chars", [None if t is None else len(t) for t in texts])):
        if name in batch.schema.names:
            i = batch.schema.get_field_index(name)
            batch = batch.set_column(i, batch.schema.field(i), pa.array(values, batch.schema.field(i).type))
    return batch


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text`` alone (null text: empty): other columns, whatever
    their names, cannot clash with an operator's own."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))


def row_key() -> Column:
    """With ``doc_id`` this names a row by content: rows that share a doc_id
    but not a text stay apart, repeated rows share every result."""
    return F.xxhash64(F.col("text"))


def keyed_text(docs: DataFrame) -> DataFrame:
    return documents(docs).withColumn("text_key", row_key())


def store(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives the
    loss of any executor, and each table is computed once."""
    return materialize(df, f"llm-{name}")


def with_workers(spark: SparkSession) -> SparkSession:
    """Ship the package to the Python workers."""
    ship_package(spark)
    return spark
