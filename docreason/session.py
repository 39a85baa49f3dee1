"""Session construction and shared scratch locations."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(cores: int | str = "*", app: str = "docreason",
                  shuffle_partitions: int | None = None,
                  driver_memory: str = "16g") -> SparkSession:
    """A local session configured the way the library expects.

    On a cluster the caller's own session is used instead; every operator only
    relies on ``spark.sql.session.timeZone=UTC`` and AQE being on.
    """
    parts = shuffle_partitions or (os.cpu_count() or 8)
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", driver_memory)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster must name a shared folder there: a machine's own folder would
    hold only what its own executors wrote. One of our own is created only
    for a local master without the setting (tests).
    """
    sc = spark.sparkContext
    path = (spark.conf.get("spark.checkpoint.dir", None)
            or sc.getConf().get("spark.checkpoint.dir", None))
    if not path and sc.getCheckpointDir():
        # An RDD checkpoint folder was set: use its parent (it adds a uuid).
        path = sc.getCheckpointDir().rstrip("/").rsplit("/", 1)[0]
    if not path and not (sc.master == "local" or sc.master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not path:
        path = tempfile.mkdtemp(prefix="docreason-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder, for jobs that
    write and read back files (sinks, ingest state, resume tests)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def mounted_path(spark: SparkSession, path: str) -> str | None:
    """The path by which every machine's own file system knows a shared folder;
    None where the folder is in another store."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toUri()
    return uri.getPath() if uri.getScheme() == "file" else None


def materialize(df, name: str):
    """Write ``df`` as parquet under the shared checkpoint folder and read it
    back: cuts lineage (a lost executor recomputes from this table, not from
    the sources) and lets later branches prune columns."""
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.parquet(path)
    _at_exit(spark, path)
    return spark.read.parquet(path)


_WRITTEN: list[tuple[SparkSession, str]] = []


def _at_exit(spark: SparkSession, path: str) -> None:
    """Delete a table of :func:`materialize` when the program ends (results
    that are read lazily may need it until then)."""
    if not _WRITTEN:
        atexit.register(_delete_written)
    _WRITTEN.append((spark, path))


def _delete_written() -> None:
    for spark, path in _WRITTEN:
        if spark.sparkContext._jsc is None:  # the session has been stopped: nothing can be deleted through it
            continue
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    _WRITTEN.clear()


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``docreason`` importable in Python workers (functions used by
    ``mapInPandas`` and pandas UDFs are pickled by module reference).

    The package is zipped on the driver and handed to ``addPyFile``, which
    distributes it to every executor through Spark itself."""
    import zipfile

    import docreason

    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(docreason.__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="docreason-pkg-"), "docreason.zip")
    with zipfile.ZipFile(out, "w") as z:
        for dirpath, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(out)
    _SHIPPED.add(sc.applicationId)
