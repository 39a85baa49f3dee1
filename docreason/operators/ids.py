"""Dense consecutive ids without a global window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def zip_index(df: DataFrame, order: list[str], out: str = "index", n_parts: int | None = None) -> DataFrame:
    """0-based dense index in ``order`` (which must be unique).

    Rows are range-partitioned and sorted within partitions; each row's
    position in its partition comes from ``monotonically_increasing_id``
    (partition id in the upper bits, position in the lower 33). The rows are
    written once with both numbers: range bounds are sampled anew whenever a
    plan is run, so partition sizes and rows must come from one copy.
    Partition sizes are prefix-summed on a table with one row per partition
    (a bound known before the job) and added back. No task sees more than its
    partition; no window over all rows.
    """
    from docreason.session import materialize

    n = n_parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    s = (df.repartitionByRange(n, *order).sortWithinPartitions(*order)
         .withColumn("_pid", F.spark_partition_id())
         .withColumn("_local", F.monotonically_increasing_id() - F.shiftleft(F.col("_pid").cast("bigint"), 33)))
    s = materialize(s, "dense-ids")
    sizes = s.groupBy("_pid").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_pid", F.coalesce(F.sum("_c").over(w), F.lit(0)).alias("_off"))
    return (s.join(F.broadcast(offsets), "_pid")
            .withColumn(out, F.col("_off") + F.col("_local")).drop("_pid", "_local", "_off"))
