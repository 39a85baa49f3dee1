"""Sinks (K1-K5). Every write goes through Spark's committed file writer, but for
files of one key each in a mounted folder (``write_files``)."""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from functools import partial
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docreason.session import mounted_path, ship_package

# Folders that the files of write_files are dealt over (none holds them all).
FILE_FOLDERS = 256


def _codec(path: str) -> str:
    return "gzip" if path.endswith(".gz") else "none"


def write_json_arrays(df: DataFrame, path: str, by: list[str], order: list[str]) -> None:
    """K1: one JSON array per group (a document's records), ordered, one file
    per group under partition folders of ``by``. Every record is a line of its
    file, so a group is sorted and streamed and never in one row. A ``path`` that
    ends with .gz has compressed files."""
    payload = [c for c in df.columns if c not in by]
    sort = [*[c for c in order if c not in by], *[c for c in payload if c not in order]]
    group = Window.partitionBy(*by).orderBy(*sort)
    first, last = F.row_number().over(group) == 1, F.lead(F.lit(True)).over(group).isNull()
    line = F.concat(F.when(first, "[").otherwise(","), F.to_json(F.struct(*payload)), F.when(last, "]").otherwise(""))
    lines = df.repartition(*by).select(*by, *sort, line.alias("_line"))
    (lines.sortWithinPartitions(*by, *sort).select(*by, F.col("_line").alias("value"))
     .write.mode("overwrite").option("compression", _codec(path)).partitionBy(*by).text(path))


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K2: one object per line, compressed where ``path`` ends with .gz."""
    df.write.mode(mode).option("compression", _codec(path)).json(path)


def write_text(df: DataFrame, path: str, col: str = "value") -> None:
    """K3: raw text as is, compressed where ``path`` ends with .gz."""
    df.select(F.col(col).alias("value")).write.mode("overwrite").option("compression", _codec(path)).text(path)


def _put_files(batches: Iterator[pa.RecordBatch], root: str, key: str) -> Iterator[pa.RecordBatch]:
    """Rows (key, value) in order of the key: a key's values as lines of its file.
    A file gets its name when it is whole, so that an attempt that is cut short or
    runs beside another leaves none in part. Yields the number of files."""
    now, out, hidden, n = None, None, "", 0

    def close() -> None:
        out.close()
        name = quote("__HIVE_DEFAULT_PARTITION__" if now[0] is None else now[0], safe="")
        folder = f"{root}/{zlib.crc32(name.encode()) % FILE_FOLDERS:03d}"
        os.makedirs(folder, exist_ok=True)
        os.replace(hidden, f"{folder}/{key}={name}.txt")

    for b in batches:
        for k, value in zip(b[0].to_pylist(), b[1].to_pylist()):
            if now != (k,):
                if out is not None:
                    close()
                now, n, hidden = (k,), n + 1, f"{root}/.{uuid.uuid4().hex}"
                out = open(hidden, "wb")
            out.write((value or b"") + b"\n")
    if out is not None:
        close()
    yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})


def write_files(df: DataFrame, path: str, key: str, col: str = "value") -> None:
    """K3, a file per key: its rows' texts as lines, found by ``key=<its text>`` in
    the file's path. ``path`` is a new folder.

    In a folder that all machines have mounted the tasks write the files
    themselves: Spark's writer needs a folder for each and, without Hadoop's native
    library, starts two processes a file to set its mode. In any other store it is
    Spark's writer."""
    spark = df.sparkSession
    root = mounted_path(spark, path)
    if root is None:
        df.select(key, F.col(col).alias("value")).repartition(key).write.partitionBy(key).text(path)
        return
    ship_package(spark)
    os.makedirs(root)
    rows = df.select(F.col(key).cast("string").alias(key), F.col(col).cast("binary").alias("value"))
    put = partial(_put_files, root=root, key=key)
    rows.repartition(key).sortWithinPartitions(key).mapInArrow(put, "n long").write.format("noop").mode("overwrite").save()


def write_per_document(df: DataFrame, path: str, doc: str = "document_id", ok: str | None = None,
                       n_buckets: int = 64, fmt: str = "json") -> DataFrame:
    """K4: per-document output plus the manifest of documents that succeeded.

    Documents land in hash buckets (``_bucket=k`` folders) rather than one
    folder each, so millions of documents do not mean millions of folders;
    the manifest maps each document to its bucket folder. ``n_buckets`` is the
    caller's choice for the table's size; rows are dealt by bucket before the
    write, so a bucket is one file."""
    good = df.where(F.col(ok)) if ok else df
    b = good.withColumn("_bucket", F.pmod(F.xxhash64(F.col(doc)), F.lit(n_buckets)).cast("int"))
    b.repartition(n_buckets, "_bucket").write.mode("overwrite").partitionBy("_bucket").format(fmt).save(path)
    return b.select(doc, "_bucket").distinct().select(
        doc, F.concat(F.lit(path + "/_bucket="), F.col("_bucket").cast("string")).alias("path"))


def ledger_append(df: DataFrame, path: str, batch: str) -> None:
    """K5: append call metrics, success as 0/1, partitioned by experiment and
    batch. ``batch`` names this append: running it again (a retried job)
    replaces the rows that the batch wrote for the same experiments, other
    batches stay. Nothing to append writes nothing."""
    out = df.withColumn("success", F.col("success").cast("int")) if "success" in df.columns else df
    (out.withColumn("batch_id", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("experiment_id", "batch_id").parquet(path))
