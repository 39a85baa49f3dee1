"""Average ranks and rank statistics without a window over a whole group (W6,
A6, A18, A21, A22).

Ranks are computed on value counts, never on raw rows: a group first
collapses to one row per distinct value (map-side combined), then the running
total of the counts is built in three levels so that no task holds a whole
group, even when one group carries a large share of all rows. A level's ranges
follow from the value alone (equal steps of its logarithm, with its sign), so
they need no look at the data and no pass over it:

1. inside each (group, fine range) a window sums the counts of smaller values;
2. the totals of the earlier fine ranges of the same coarse range, and
3. the totals of the earlier coarse ranges of the group are added.

A fine range spans a factor of 1 + 1/``SCALE``, so it has fewer than five million
doubles; a coarse range has 2 ** ``RADIX`` fine ones, and there are fewer than
three million coarse ones: no window holds more rows, whatever the data. Keys may
be NULL: a group is joined as a struct, in which NULL equals NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docreason.operators.joins import join_on
from docreason.session import materialize

SCALE, RADIX = 1e9, 20
# Above -ln of the least positive double, in steps.
_LOWEST = 746


def _range(value: str, scale: float) -> Column:
    """The number of a value's fine range: monotone in the value, NULL first."""
    v = F.col(value).cast("double")
    size = F.floor(F.ln(F.least(F.abs(v), F.lit(1.7976931348623157e308))) * scale) + F.lit(int(_LOWEST * scale) + 2)
    return F.when(v.isNull(), F.lit(-(1 << 62))).when(v > 0, size).when(v < 0, -size).otherwise(F.lit(0))


def running_below(counts: DataFrame, keys: list[str], value: str, weight: str,
                  scale: float = SCALE, radix: int = RADIX) -> DataFrame:
    """Add ``below``: total ``weight`` of strictly smaller ``value`` in the same
    ``keys`` group. ``counts`` must hold one row per (keys, value). It is read
    three times, so counts of many rows should be a written table."""
    def before(c: str, group: list[str], order: str) -> Column:
        w = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(c).over(w), F.lit(0))

    rows = counts.withColumn("_g", F.struct(F.lit(0), *keys)).withColumn("_fine", _range(value, scale))
    local = rows.withColumn("_local", before(weight, ["_g", "_fine"], value))
    fine = rows.groupBy("_g", "_fine").agg(F.sum(weight).alias("_sum")).withColumn("_coarse", F.shiftright("_fine", radix))
    fine = fine.withColumn("_offset", before("_sum", ["_g", "_coarse"], "_fine"))
    coarse = fine.groupBy("_g", "_coarse").agg(F.sum("_sum").alias("_total")).withColumn("_earlier", before("_total", ["_g"], "_coarse"))
    offsets = fine.join(coarse, ["_g", "_coarse"]).select("_g", "_fine", (F.col("_offset") + F.col("_earlier")).alias("_offset"))
    return (local.join(offsets, ["_g", "_fine"]).withColumn("below", F.col("_offset") + F.col("_local"))
            .drop("_g", "_fine", "_local", "_offset"))


def average_ranks(counts: DataFrame, keys: list[str], value: str, weight: str = "cnt", **limits) -> DataFrame:
    """Average (mid) ranks of each distinct value: ties share below + (w + 1) / 2."""
    return (running_below(counts, keys, value, weight, **limits)
            .withColumn("avg_rank", F.col("below") + (F.col(weight) + 1) / 2.0))


def weighted_pearson(x, y, w) -> Column:
    """Aggregate: Pearson correlation of x and y with integer weights w; NULL
    when either side has no spread or fewer than two rows."""
    x, y, w = (F.col(c) if isinstance(c, str) else c for c in (x, y, w))
    n = F.sum(w)
    sx, sy = F.sum(w * x), F.sum(w * y)
    sxx, syy, sxy = F.sum(w * x * x), F.sum(w * y * y), F.sum(w * x * y)
    vx = sxx - sx * sx / n
    vy = syy - sy * sy / n
    cov = sxy - sx * sy / n
    tiny = 1e-12
    ok = (n >= 2) & (vx > tiny * sxx) & (vy > tiny * syy)
    return F.when(ok, cov / F.sqrt(vx * vy))


def pearson(x, y) -> Column:
    """Aggregate: sample Pearson correlation; NULL for n < 2 or a constant
    column (ANSI ``corr`` would raise a division by zero there)."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    return F.try_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y))


def spearman(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Spearman correlation of x and y per group: Pearson of average ranks.

    Rows first compress to cells (keys, x, y) with multiplicity, which are
    written once, so that the rows are scanned once; ranks come from value
    counts; the correlation is a weighted aggregate over cells.
    Returns keys, n, spearman.
    """
    cells = materialize(df.groupBy(*keys, x, y).agg(F.count(F.lit(1)).alias("_m")), "rank-cells")

    def counted(c: str) -> DataFrame:
        return materialize(cells.groupBy(*keys, c).agg(F.sum("_m").alias("cnt")), "value-counts")

    rx = average_ranks(counted(x), keys, x).select(*keys, x, F.col("avg_rank").alias("_rx"))
    ry = average_ranks(counted(y), keys, y).select(*keys, y, F.col("avg_rank").alias("_ry"))
    joined = join_on(join_on(cells, rx, keys + [x]), ry, keys + [y])
    return joined.groupBy(*keys).agg(
        F.sum("_m").alias("n"), weighted_pearson("_rx", "_ry", "_m").alias("spearman"))


def cliffs_delta(counts: DataFrame, keys: list[str], value: str,
                 na: str = "na", nb: str = "nb") -> DataFrame:
    """Exact Cliff's delta P(a > b) - P(a < b) per group.

    ``counts`` holds one row per (keys, value) with the number of a values
    (``na``) and b values (``nb``) equal to it. Each value of a counts the b
    values below and above it from running sums of the b counts over the
    distinct values: O(distinct values), no pairs and no sampling. Products of
    counts are taken in DOUBLE, which billions of rows a side do not overflow.
    Returns keys, n_a, n_b, cliffs_delta (NULL when a side is empty).
    """
    counts = materialize(counts, "value-counts")
    ranked = running_below(counts, keys, value, nb)
    totals = counts.groupBy(*keys).agg(F.sum(na).alias("n_a"), F.sum(nb).alias("n_b"))
    per_value = join_on(ranked, totals, keys).withColumn(
        "_above", F.col("n_b") - F.col("below") - F.col(nb))
    dominance = F.sum(F.col(na).cast("double") * (F.col("below") - F.col("_above")).cast("double"))
    return per_value.groupBy(*keys).agg(
        F.max("n_a").alias("n_a"), F.max("n_b").alias("n_b"),
        F.try_divide(dominance, F.max("n_a").cast("double") * F.max("n_b").cast("double")).alias("cliffs_delta"))


def exact_quantile(df: DataFrame, keys: list[str], value: str, q: float, out: str = "quantile") -> DataFrame:
    """Exact quantile with linear interpolation (NumPy's default) per group,
    from value counts: the order statistics at floor/ceil of q * (n - 1) are
    found by the running totals of the counts, so no group's values are ever
    buffered in one place (``percentile``/``median`` buffer them all)."""
    counts = materialize(df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c")), "value-counts")
    ranked = running_below(counts, keys, value, "_c")
    n = counts.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    pos = (F.col("_n") - 1) * q
    j = join_on(ranked, n, keys).withColumn("_lo", F.floor(pos)).withColumn("_hi", F.ceil(pos)) \
        .withColumn("_frac", pos - F.floor(pos))
    hit_lo = (F.col("below") <= F.col("_lo")) & (F.col("_lo") < F.col("below") + F.col("_c"))
    hit_hi = (F.col("below") <= F.col("_hi")) & (F.col("_hi") < F.col("below") + F.col("_c"))
    g = j.where(hit_lo | hit_hi).groupBy(*keys).agg(
        F.max(F.when(hit_lo, F.col(value))).alias("_vlo"), F.max(F.when(hit_hi, F.col(value))).alias("_vhi"),
        F.max("_frac").alias("_f"))
    return g.select(*keys, (F.col("_vlo") + (F.col("_vhi") - F.col("_vlo")) * F.col("_f")).alias(out))
