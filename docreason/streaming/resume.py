"""Resume (I2): per document instead of per stage.

Work whose key is already in the output table is skipped with an anti join.
The output table is partitioned by a hash bucket of the key (not one folder
per document). New keys are appended; forced keys are recomputed and only
the buckets that hold them are rewritten (dynamic partition overwrite).

For large tables there is a versioned form that writes only what changed: a run
writes its rows as a new version, readers take the newest version of each key,
and a compaction folds versions into a base from time to time.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docreason.operators.joins import join_on
from docreason.session import materialize

# Default for small tables; forcing a document rewrites its bucket, so callers
# choose more for larger ones (and keep to it for the table's life).
N_BUCKETS = 16


def _bucket(key: str, n: int):
    return F.pmod(F.xxhash64(F.col(key)), F.lit(n)).cast("int")


def pending(todo: DataFrame, done: DataFrame | None, key: str, force: list | None = None) -> DataFrame:
    """Rows of ``todo`` whose key is not in ``done`` (or is forced)."""
    if done is None:
        return todo
    keys = done.select(key).distinct()
    if force:
        keys = keys.where(~F.col(key).isin(list(force)))
    return todo.join(keys, key, "left_anti")


def write_outputs(df: DataFrame, path: str, key: str, n_buckets: int = N_BUCKETS) -> None:
    """Append rows of new keys into their key buckets."""
    dealt = df.withColumn("_bucket", _bucket(key, n_buckets)).repartition(n_buckets, "_bucket")
    dealt.write.mode("append").partitionBy("_bucket").parquet(path)


def replace_keys(spark: SparkSession, recomputed: DataFrame, path: str, key: str,
                 n_buckets: int = N_BUCKETS) -> None:
    """Force: the rows of ``recomputed`` replace the rows of their keys. The
    kept rows of the touched buckets are materialised first (a job must not
    overwrite the folder it reads), then those buckets are overwritten."""
    new = recomputed.withColumn("_bucket", _bucket(key, n_buckets))
    touched = new.select("_bucket").distinct()
    old = spark.read.parquet(path)
    kept = (old.join(touched, "_bucket", "left_semi")
            .join(new.select(key), key, "left_anti"))
    kept = materialize(kept, "resume-kept")
    (kept.unionByName(new.select(*kept.columns)).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(path))


FOLDER = re.compile(r"(base|_version)=(\d+)")


def write_version(df: DataFrame, path: str, version: int) -> None:
    """Write the rows of one run, and nothing else, as ``version`` (a number
    larger than those of earlier runs). Run again, it replaces its own rows."""
    df.write.mode("overwrite").parquet(f"{path}/_version={version}")


def _parts(spark: SparkSession, path: str) -> tuple[int | None, list[int]]:
    """The newest complete base and the complete versions after it."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path
    root = jvm_path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found: dict[str, list[int]] = {"base": [], "_version": []}
    for entry in fs.listStatus(root):
        m = FOLDER.fullmatch(entry.getPath().getName())
        if m and fs.exists(jvm_path(entry.getPath(), "_SUCCESS")):
            found[m[1]].append(int(m[2]))
    base = max(found["base"], default=None)
    return base, sorted(v for v in found["_version"] if base is None or v > base)


def read_newest(spark: SparkSession, path: str, key: str) -> DataFrame:
    """Each key's rows of the newest complete version that has the key (a NULL key
    is a key); a run that found no rows for a key leaves its earlier ones. The base
    is joined with the keys of later versions alone, so it is shuffled only when
    those are many."""
    base, later = _parts(spark, path)
    if base is None and not later:
        raise FileNotFoundError(f"{path}: no complete version")
    old = None if base is None else spark.read.parquet(f"{path}/base={base}")
    if not later:
        return old
    new = spark.read.option("basePath", path).parquet(*[f"{path}/_version={v}" for v in later])
    newest = new.groupBy(key).agg(F.max("_version").alias("_newest"))
    rows = join_on(new, newest, [key]).where("_version = _newest").drop("_version", "_newest")
    return rows if old is None else join_on(old, newest, [key], "left_anti").unionByName(rows)


def compact(spark: SparkSession, path: str, key: str) -> None:
    """Fold all complete versions into a new base. What it replaces is deleted
    after the base is committed, so a crash leaves a readable table; readers of
    the old files must have ended."""
    base, later = _parts(spark, path)
    if not later:
        return
    read_newest(spark, path, key).write.mode("overwrite").parquet(f"{path}/base={later[-1]}")
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = jvm_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for folder in [*(f"_version={v}" for v in later), *([] if base is None else [f"base={base}"])]:
        fs.delete(jvm_path(path, folder), True)
