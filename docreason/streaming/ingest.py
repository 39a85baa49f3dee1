"""Incremental URL ingest.

The state table (paper_id, url, status) is a folder of snapshots
``snapshot=<batch>-<attempt>``. A batch reads the newest complete snapshot of an
earlier batch (complete: Spark's ``_SUCCESS`` marker is there) and writes a new
folder, never over an old one. So a replayed batch starts from the state it
started from before, a crash halfway leaves an incomplete folder that nobody
reads, and readers never see a half-written state.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docreason.functions.scores import py_strip
from docreason.operators.ids import zip_index
from docreason.schemas import URL_STATE
from docreason.session import materialize

SNAPSHOT = re.compile(r"snapshot=(\d+)-(\d+)")


def clean_urls(lines: DataFrame, col: str = "value") -> DataFrame:
    """Strip each line, drop empty ones."""
    return lines.select(py_strip(col).alias("url"), *[c for c in lines.columns if c != col]) \
        .where(F.length("url") > 0)


def file_name(url) -> F.Column:
    """Last path segment, with '.pdf' appended unless it ends with 'pdf'."""
    last = F.element_at(F.split(url, "/"), -1)
    return F.when(last.endswith("pdf"), last).otherwise(F.concat(last, F.lit(".pdf")))


def plan_urls(incoming: DataFrame, state: DataFrame) -> DataFrame:
    """J3 + K6: per distinct incoming URL (first line wins the order): skip
    processed ones; URLs already known keep their id (retried); new URLs get
    ids after the largest known id, densely in input order (``line_no``, any
    type that can be ordered)."""
    inc = (clean_urls(incoming, "url") if "value" not in incoming.columns else clean_urls(incoming))
    first = inc.groupBy("url").agg(F.min("line_no").alias("first_pos"))
    known = state.groupBy("url").agg(F.min("paper_id").alias("known_id"), F.max("status").alias("known_status"))
    j = first.join(known, "url", "left").where(F.coalesce(F.col("known_status"), F.lit("")) != "processed")
    # One scalar: the largest id already handed out.
    max_id = state.agg(F.max("paper_id")).first()[0]
    max_id = -1 if max_id is None else int(max_id)
    new = zip_index(j.where(F.col("known_id").isNull()).select("url", "first_pos"), ["first_pos", "url"])
    new = new.select("url", (F.lit(max_id) + F.col("index") + 1).alias("paper_id"), F.lit(True).alias("is_new"))
    old = j.where(F.col("known_id").isNotNull()).select("url", F.col("known_id").alias("paper_id"),
                                                         F.lit(False).alias("is_new"))
    return new.unionByName(old).withColumn("status", F.lit("pending")).withColumn("file_name", file_name(F.col("url")))


def validate_downloads(planned: DataFrame, downloads: DataFrame | None) -> DataFrame:
    """P18 + status: a downloaded file starting with %PDF is 'processed', other
    bytes 'validation_failed', no bytes 'download_failed' (precedence, not
    overwrite)."""
    from docreason.sources.files import is_pdf
    if downloads is None:
        return planned
    j = planned.join(downloads.select("url", "content"), "url", "left")
    status = (F.when(F.col("content").isNull(), "download_failed")
              .when(is_pdf("content"), "processed").otherwise("validation_failed"))
    return j.withColumn("status", status).drop("content")


def snapshots(spark: SparkSession, state_dir: str) -> list[tuple[int, int, bool]]:
    """(batch, attempt, complete) of every snapshot folder; none if the state
    folder does not exist. Any other failure to list it is an error."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path
    root = jvm_path(state_dir)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    found = []
    for entry in fs.listStatus(root):
        m = SNAPSHOT.fullmatch(entry.getPath().getName())
        if m:
            found.append((int(m[1]), int(m[2]), fs.exists(jvm_path(entry.getPath(), "_SUCCESS"))))
    return sorted(found)


def read_state(spark: SparkSession, state_dir: str, before: int | None = None) -> DataFrame:
    """The newest complete state (of a batch earlier than ``before``); empty
    only when no batch has been written."""
    earlier = [s for s in snapshots(spark, state_dir) if before is None or s[0] < before]
    complete = [s for s in earlier if s[2]]
    if not complete:
        if earlier:
            raise RuntimeError(f"{state_dir}: snapshots without a complete one")
        return spark.createDataFrame([], URL_STATE)
    batch, attempt, _ = complete[-1]
    return spark.read.schema(URL_STATE).parquet(f"{state_dir}/snapshot={batch}-{attempt}")


def apply_batch(spark: SparkSession, lines: DataFrame, batch_id: int, state_dir: str,
                downloads: DataFrame | None = None) -> DataFrame:
    """One ingest batch: S4 -> J3 -> K6 -> P18 -> new state snapshot. ``lines``
    has a column value and may have a column line_no with the input order."""
    state = read_state(spark, state_dir, before=batch_id)
    inc = clean_urls(lines)
    if "line_no" not in inc.columns:
        inc = inc.withColumn("line_no", F.monotonically_increasing_id())
    # Written once: several jobs read the order, which must not change between them.
    inc = materialize(inc.select("url", "line_no"), "ingest-lines")
    planned = materialize(validate_downloads(plan_urls(inc, state), downloads), "ingest-plan")
    updated = planned.select("paper_id", "url", "status")
    keep = state.join(updated.select("url"), "url", "left_anti").select("paper_id", "url", "status")
    attempt = 1 + max([a for b, a, _ in snapshots(spark, state_dir) if b == batch_id], default=-1)
    keep.unionByName(updated).write.parquet(f"{state_dir}/snapshot={batch_id}-{attempt}")
    return planned


def start_ingest_stream(spark: SparkSession, list_dir: str, state_dir: str, checkpoint: str,
                        downloads: DataFrame | None = None):
    """URL list files arriving in ``list_dir`` are ingested batch by
    batch (``foreachBatch``), with a checkpoint so a restart resumes where
    it stopped; ``availableNow`` processes what is there and stops. Lines are
    in order of file, then place in the file."""
    src = spark.readStream.format("text").load(list_dir).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))

    def handle(batch: DataFrame, batch_id: int) -> None:
        place = F.struct("file", "block", F.monotonically_increasing_id().alias("line"))
        apply_batch(batch.sparkSession, batch.select("value", place.alias("line_no")), batch_id, state_dir, downloads)

    return (src.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
