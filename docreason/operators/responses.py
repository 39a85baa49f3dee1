"""Model responses as tables.

A call's responses are rows keyed (request_id, attempt). Parsing is a column
expression; attempt resolution is one aggregate per request; content that
never parses goes to a quarantine table instead of failing the job.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docreason.functions import jsonfn as J
from docreason.functions.scores import coerce_float, py_strip
from docreason.operators.joins import join_on


def parse_list(resp: DataFrame, content: str = "content") -> DataFrame:
    """Adds raw (the list text), is_list, items (ARRAY<VARIANT>) and texts
    (each item's JSON as the model wrote it, keys in their order; a VARIANT
    sorts them)."""
    return (resp.withColumn("raw", J.list_text(content)).withColumn("_v", J.one_value("raw"))
            .withColumn("is_list", F.coalesce(J.vtype("_v").startswith("ARRAY"), F.lit(False)))
            .withColumn("items", F.when(F.col("is_list"), F.try_variant_get("_v", "$", "array<variant>")))
            .withColumn("texts", F.when(F.col("is_list"), F.from_json("raw", "array<string>")))
            .drop("_v"))


def parse_object(resp: DataFrame, content: str = "content") -> DataFrame:
    """The content as one JSON value (NULL when it does not parse, or is
    followed by anything but white space)."""
    return resp.withColumn("value", J.one_value(content))


def parse_text(resp: DataFrame, content: str = "content", strip: bool = True) -> DataFrame:
    """T4: the content as text, trimmed (T4) or as is."""
    return resp.withColumn("text", py_strip(content) if strip else F.col(content))


def parse_score(resp: DataFrame, content: str = "content") -> DataFrame:
    """T3 + P8: float(content); kept when it parses and is > -1 (NaN fails).
    Adds score (NULL unless kept) and status ok / parse_error / rejected."""
    s = coerce_float(content)
    # coerce_float maps NaN to NULL; tell a NaN apart from a parse failure.
    nan = F.lower(py_strip(F.col(content).cast("string"))).isin("nan", "+nan", "-nan")
    status = (F.when(nan, "rejected").when(s.isNull(), "parse_error")
              .when(s > -1, "ok").otherwise("rejected"))
    return resp.withColumn("status", status).withColumn("score", F.when(status == "ok", s))


def resolve_attempts(parsed: DataFrame, key: list[str], ok: str, payload: list[str],
                     attempt: str = "attempt", retries: int = 3, error: str | None = None) -> DataFrame:
    """T5: per request the first attempt (up to ``retries``, at least one)
    that parsed wins; the payload (tokens, latency) is that of this attempt.
    A request without one gets status 'failed' and, with ``error`` naming the
    column of the text, the last attempt's text as ``last_error``. Attempts
    beyond ``retries`` are not looked at; ``ignored_attempts`` counts them."""
    within = F.col(attempt) <= max(1, retries)
    good = F.col(ok) & within
    won = F.min_by(F.struct(F.col(attempt).alias("attempt"), *[F.col(c) for c in payload]),
                   F.when(good, F.col(attempt)))
    last = [] if error is None else [F.max_by(error, F.when(within, F.col(attempt))).alias("_error")]
    g = parsed.groupBy(*key).agg(won.alias("_w"), F.count_if(good).alias("_n_ok"),
                                 F.max(F.when(within, F.col(attempt))).alias("last_attempt"),
                                 F.count_if(~within).alias("ignored_attempts"), *last)
    done = F.col("_n_ok") > 0
    return g.select(*key, F.when(done, "ok").otherwise("failed").alias("status"),
                    *[F.when(done, F.col("_w")[c]).alias(c) for c in ["attempt"] + payload], "last_attempt",
                    *([] if error is None else [F.when(~done, F.col("_error")).alias("last_error")]), "ignored_attempts")


def batch_infer(requests: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """the caller's model function over request batches (``mapInPandas``:
    Arrow batches in, response batches out, partitioned like the requests)."""
    from docreason.session import ship_package
    ship_package(requests.sparkSession)

    def run(batches):
        for pdf in batches:
            yield fn(pdf)
    return requests.mapInPandas(run, schema)


def request_rounds(requests: DataFrame, key: list[str], infer: Callable[[DataFrame], DataFrame], ok: str,
                   path: str, retries: int = 3) -> DataFrame:
    """T5 + F2 as a job: all requests are asked in round 1, and round k asks
    again those that no earlier round answered well, until ``retries`` rounds
    (at least one) are done or nothing is left. Returns the rows of all rounds.

    ``infer`` takes requests with an ``attempt`` column and returns parsed rows
    with ``key``, ``attempt`` and the BOOLEAN ``ok``; a request that it returns no
    row for is asked again (NULL keys are keys). Every round is written to
    ``path``/round=k before the next begins: a job that is run again after a crash
    reads the complete rounds and asks none of their requests anew. What is left
    is an anti join with the stored rounds, so nothing passes the driver."""
    spark = requests.sparkSession
    rounds: list[DataFrame] = []
    left = requests
    for k in range(1, max(1, retries) + 1):
        folder = f"{path}/round={k}"
        if not _complete(spark, folder):
            if k > 1 and left.isEmpty():
                break
            infer(left.withColumn("attempt", F.lit(k))).write.mode("overwrite").parquet(folder)
        stored = spark.read.parquet(folder)
        rounds.append(stored)
        left = join_on(left, stored.where(F.col(ok)).select(*key).distinct(), key, "left_anti")
    return reduce(DataFrame.unionByName, rounds)


def _complete(spark: SparkSession, folder: str) -> bool:
    """Whether a write to the folder was committed."""
    marker = spark._jvm.org.apache.hadoop.fs.Path(folder, "_SUCCESS")
    return marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)


def resolve_rounds(requests: DataFrame, rounds: DataFrame, key: list[str], ok: str, payload: list[str],
                   retries: int = 3, error: str | None = None) -> DataFrame:
    """The outcome of every request of :func:`request_rounds`, as
    :func:`resolve_attempts` gives it; a request that never had a row is failed."""
    found = resolve_attempts(rounds, key, ok, payload, retries=retries, error=error).drop("ignored_attempts")
    return join_on(requests.select(*key).distinct(), found, key, "left").withColumn(
        "status", F.coalesce("status", F.lit("failed")))


def transform(resp: DataFrame, fn, out: str = "value", content: str = "content") -> DataFrame:
    """a transformer on each response: a Column function, or a
    ``pandas_udf``-wrapped function."""
    return resp.withColumn(out, fn(F.col(content)))
