"""Null-safe joins with per-group summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` (a NULL key meets a NULL key, as it does in groupBy)
    and keep the left side's key columns. Whether a side is broadcast is left
    to Spark, which knows the sides' sizes at run time."""
    renamed = right.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    if how in ("left_semi", "left_anti"):
        return left.join(renamed, same, how)
    return left.join(renamed, same, how).drop(*[f"_r_{k}" for k in keys])
