"""Per-group quality and calibration metrics.

Every metric is one ``groupBy().agg()`` (partial aggregation before the
shuffle), so the shuffle carries one row per group and partition, not rows.
Zero-filled grids (bins, buckets) are generated per group with
``explode(sequence())`` on the small grouped result, not by a cross join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docreason.functions.scores import (
    abs_err, bucketize, clip01, coerce_float, correct_bin, linspace, rnd, tri_anchor, with_bin)
from docreason.operators.joins import join_on
from docreason.operators.ranks import exact_quantile, pearson, spearman
from docreason.schemas import ARMS, BUCKETS, N_CAL_BINS, N_HIST_BINS, PRED_CANDIDATES

SCORE_COLS = ["gold", "pred", "trace_sim"]


def normalize(df: DataFrame, cols=SCORE_COLS) -> DataFrame:
    """P11 + P10: coerce to DOUBLE (NaN -> NULL) and clip into [0, 1]."""
    out = df
    for c in cols:
        out = out.withColumn(c, clip01(coerce_float(c)) if dict(df.dtypes)[c] == "string"
                             else clip01(c))
    return out


def clean(df: DataFrame, cols=SCORE_COLS) -> DataFrame:
    """Rows with every score present."""
    return df.na.drop(subset=list(cols))


def cross_domain(df: DataFrame, gold="gold", pred: str | None = None, score="trace_sim") -> DataFrame:
    """Cross-domain preparation (P10 on gold/pred only, P19 derived scores):
    eval_score is left unclipped, errors are NULL when a side is missing,
    correct_bin counts a missing error as 0. Without ``pred`` the prediction is
    the first column of PRED_CANDIDATES (or ``pred``) that is there (P12); if
    none is, the derived scores are all NULL."""
    pred = pred or next((c for c in ["pred", *PRED_CANDIDATES] if c in df.columns), None)
    guess = clip01(pred) if pred else F.lit(None).cast("double")
    return (df.withColumn("gold", clip01(gold)).withColumn("pred", guess)
            .withColumn("eval_score", F.nanvl(F.col(score), F.lit(None).cast("double")))
            .withColumn("abs_err", abs_err("pred", "gold"))
            .withColumn("score_cont", 1.0 - F.col("abs_err"))
            .withColumn("correct_bin", correct_bin("abs_err")))


def arm_metrics(cl: DataFrame, keys: list[str]) -> DataFrame:
    """A2-A4, A9, A10 per group over complete rows."""
    err = F.col("pred") - F.col("gold")
    med = exact_quantile(cl, keys, "trace_sim", 0.5, "_med")
    base = cl.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        rnd(F.avg(F.abs(err))).alias("mae"),
        rnd(F.sqrt(F.avg(err * err))).alias("rmse"),
        rnd(F.avg(err * err)).alias("brier"),
        rnd(F.avg((tri_anchor("gold") == tri_anchor("pred")).cast("double"))).alias("tri_acc"),
        rnd(F.avg("trace_sim")).alias("trace_mean"))
    return join_on(base, med, keys, "left").withColumn("trace_median", rnd("_med")).drop("_med")


def quality_summary(df: DataFrame, keys: list[str], id_col: str = "question_id") -> DataFrame:
    """A1 (+ P9 row count): ids, distinct ids, missing counts, ranges."""
    aggs = [F.count(id_col).alias("n"), F.count_distinct(id_col).alias("n_unique_ids")]
    short = {"gold": "gold", "pred": "pred", "trace_sim": "trace"}
    for c in SCORE_COLS:
        aggs.append(F.count_if(F.col(c).isNull()).alias(f"{short[c]}_na"))
    for c in SCORE_COLS:
        aggs += [F.min(c).alias(f"{short[c]}_min"), F.max(c).alias(f"{short[c]}_max")]
    aggs.append(F.count_if(F.col("gold").isNotNull() & F.col("pred").isNotNull()
                           & F.col("trace_sim").isNotNull()).alias("n_clean"))
    return df.groupBy(*keys).agg(*aggs)


def pearson_by_group(cl: DataFrame, keys: list[str], x: str = "gold", y: str = "pred") -> DataFrame:
    """A5 per group."""
    return cl.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"),
                                 rnd(pearson(x, y)).alias("pearson"))


def spearman_by_group(cl: DataFrame, keys: list[str], x: str = "gold", y: str = "pred") -> DataFrame:
    """A6 per group."""
    s = spearman(cl, keys, x, y)
    return s.select(*keys, "n", rnd("spearman").alias("spearman"))


def joint_correlation(cl: DataFrame, keys: list[str]) -> DataFrame:
    """trace_sim against -|err| (Pearson, Spearman) and mean quality."""
    d = cl.withColumn("neg_err", -F.abs(F.col("pred") - F.col("gold")))
    base = d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        rnd(pearson("trace_sim", "neg_err")).alias("pearson_trace_err"),
        rnd(F.avg(1.0 + F.col("neg_err"))).alias("mean_quality"))
    sp = spearman(d, keys, "trace_sim", "neg_err").select(
        *keys, rnd("spearman").alias("spearman_trace_err"))
    return join_on(base, sp, keys, "left")


def _bin_grid(df: DataFrame, keys: list[str], n_bins: int) -> DataFrame:
    return df.select(*keys).distinct().select(
        *keys, F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))).alias("bin"))


def _curve(cl: DataFrame, keys: list[str], y: str, p: str, n_bins: int,
           close_last: bool) -> DataFrame:
    edges = linspace(0.0, 1.0, n_bins + 1)
    centers = [(edges[b] + edges[b + 1]) / 2.0 for b in range(n_bins)]
    # Out-of-range bins (-1, n_bins) stay in the result; callers drop them by
    # joining to the bin grid or masking. A filter here would be pushed below
    # the projection and inline the whole bin expression into the scan filter.
    binned = (with_bin(cl, "bin", p, edges, close_last=close_last)
              .groupBy(*keys, "bin")
              .agg(F.avg(y).alias("_mean"), F.count(F.lit(1)).alias("n_bin")))
    center = F.element_at(F.array(*[F.lit(c) for c in centers]), F.col("bin") + 1)
    inside = (F.col("bin") >= 0) & (F.col("bin") < n_bins)
    return binned.withColumn("center", F.when(inside, center)).withColumn("_in", inside)


def calibration_curve(cl: DataFrame, keys: list[str], y: str, p: str,
                      n_bins: int = N_CAL_BINS, close_last: bool = False,
                      y_name: str = "emp_gold") -> DataFrame:
    """Per group and bin: bin center, mean of y (NULL when empty) and count.

    Bins are ``digitize(p, edges) - 1`` over literal linspace edges, so p = 1.0
    falls outside the last bin unless ``close_last`` (kept on purpose)."""
    edges = linspace(0.0, 1.0, n_bins + 1)
    centers = [(edges[b] + edges[b + 1]) / 2.0 for b in range(n_bins)]
    center = F.element_at(F.array(*[F.lit(c) for c in centers]), F.col("bin") + 1)
    binned = _curve(cl, keys, y, p, n_bins, close_last).drop("center", "_in")
    return (join_on(_bin_grid(cl, keys, n_bins), binned, keys + ["bin"], "left")
            .select(*keys, "bin", center.alias("center"), rnd("_mean").alias(y_name),
                    F.coalesce("n_bin", F.lit(0)).alias("n_bin")))


def ece(cl: DataFrame, keys: list[str], y: str = "gold", p: str = "pred",
        n_bins: int = N_CAL_BINS, close_last: bool = False) -> DataFrame:
    """Sum over filled bins of (count / binned total) * |mean y - bin
    center|; NULL when no bin is filled."""
    inb = F.when(F.col("_in"), F.col("n_bin"))
    agg = _curve(cl, keys, y, p, n_bins, close_last).groupBy(*keys).agg(
        (F.sum(inb * F.abs(F.col("_mean") - F.col("center"))) / F.sum(inb)).alias("_ece"),
        F.sum(inb).alias("n_binned"))
    return (join_on(cl.select(*keys).distinct(), agg, keys, "left")
            .select(*keys, rnd("_ece").alias("ece"), F.coalesce("n_binned", F.lit(0)).alias("n_binned")))


def trace_reliability(cl: DataFrame, keys: list[str], n_bins: int = N_CAL_BINS) -> DataFrame:
    """Calibration of quality = 1 - |err| against trace_sim."""
    q = cl.withColumn("quality", 1.0 - F.abs(F.col("pred") - F.col("gold")))
    return calibration_curve(q, keys, "quality", "trace_sim", n_bins, y_name="mean_quality")


def misalignment_table(cl: DataFrame, keys: list[str]) -> DataFrame:
    """3 x 3 counts of trace bucket x error bucket, always nine cells,
    as rows per trace bucket and one column per error bucket."""
    d = (cl.withColumn("trace_bucket", bucketize("trace_sim"))
         .withColumn("err_bucket", bucketize(F.abs(F.col("pred") - F.col("gold")))))
    counts = d.groupBy(*keys, "trace_bucket").pivot("err_bucket", BUCKETS).count()
    grid = cl.select(*keys).distinct().select(
        *keys, F.explode(F.array(*[F.lit(b) for b in BUCKETS])).alias("trace_bucket"))
    return join_on(grid, counts, keys + ["trace_bucket"], "left").select(
        *keys, "trace_bucket", *[F.coalesce(F.col(b), F.lit(0)).alias(b) for b in BUCKETS])


def residual_histogram(cl: DataFrame, keys: list[str], n_bins: int = N_HIST_BINS) -> DataFrame:
    """Counts of pred - gold in ``n_bins`` equal bins on [-1, 1], last bin
    closed, zero-filled."""
    edges = linspace(-1.0, 1.0, n_bins + 1)
    binned = (with_bin(cl, "bin", F.col("pred") - F.col("gold"), edges, close_last=True)
              .groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n")))
    arr = lambda xs: F.array(*[F.lit(x) for x in xs])
    return join_on(_bin_grid(cl, keys, n_bins), binned, keys + ["bin"], "left").select(
        *keys, "bin", F.element_at(arr(edges[:-1]), F.col("bin") + 1).alias("lo"),
        F.element_at(arr(edges[1:]), F.col("bin") + 1).alias("hi"),
        F.coalesce("n", F.lit(0)).alias("n"))


def trace_histogram(cl: DataFrame, keys: list[str], x: str = "trace_sim",
                    n_bins: int = N_HIST_BINS) -> DataFrame:
    """``n_bins`` equal bins over each group's own min..max (widened by
    0.5 on each side when min == max), last bin closed, zero-filled."""
    rng = cl.groupBy(*keys).agg(F.min(x).alias("_mn"), F.max(x).alias("_mx")).select(
        *keys,
        F.when(F.col("_mn") == F.col("_mx"), F.col("_mn") - 0.5).otherwise(F.col("_mn")).alias("_lo"),
        F.when(F.col("_mn") == F.col("_mx"), F.col("_mx") + 0.5).otherwise(F.col("_mx")).alias("_hi"))
    rng = rng.withColumn("_step", (F.col("_hi") - F.col("_lo")) / n_bins)

    def edge(i):
        return F.when(i >= n_bins, F.col("_hi")).otherwise(i.cast("double") * F.col("_step") + F.col("_lo"))

    v = F.col(x)
    k0 = F.least(F.greatest(F.floor((v - F.col("_lo")) / F.col("_step")).cast("int"), F.lit(0)),
                 F.lit(n_bins - 1))
    # Aggregate to value counts first: only distinct values meet the
    # per-group range table.
    counts = cl.groupBy(*keys, x).agg(F.count(F.lit(1)).alias("_c"))
    binned = (join_on(counts, rng, keys).withColumn("_k0", k0)
              .withColumn("_k1", F.when(v < edge(F.col("_k0")), F.col("_k0") - 1).otherwise(F.col("_k0")))
              .withColumn("bin", F.when((F.col("_k1") < n_bins - 1) & (v >= edge(F.col("_k1") + 1)),
                                        F.col("_k1") + 1).otherwise(F.col("_k1")))
              .groupBy(*keys, "bin").agg(F.sum("_c").alias("n")))
    grid = join_on(_bin_grid(cl, keys, n_bins), rng, keys)
    return join_on(grid, binned, keys + ["bin"], "left").select(
        *keys, "bin", rnd(edge(F.col("bin"))).alias("lo"), rnd(edge(F.col("bin") + 1)).alias("hi"),
        F.coalesce("n", F.lit(0)).alias("n"))


def group_means(xd: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """A11 (long form): per group and metric, mean over present values, n of
    all rows (missing included) and n_valid."""
    long = xd.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics
    ])).alias("_mv")).select(*keys, "_mv.metric", "_mv.value")
    return long.groupBy(*keys, "metric").agg(
        rnd(F.avg("value")).alias("mean"), F.count(F.lit(1)).alias("n"),
        F.count("value").alias("n_valid"))


def known_arms(df: DataFrame) -> DataFrame:
    """An arm outside the fixed order is missing."""
    return df.withColumn("arm", F.when(F.col("arm").isin(ARMS), F.col("arm")))


def arm_dimension(spark) -> DataFrame:
    """The fixed arm order as a four-row dimension."""
    return spark.createDataFrame([(a, i) for i, a in enumerate(ARMS)], "arm string, arm_ord int")


def known_domains(df: DataFrame, domains: list[str]) -> DataFrame:
    """``df``; a domain outside ``domains`` is an error when the row is read."""
    unknown = F.raise_error(F.concat(F.lit("no column for the domain "), F.coalesce(F.col("domain"), F.lit("null")))).cast("string")
    return df.withColumn("domain", F.when(F.col("domain").isin(domains), F.col("domain")).otherwise(unknown))


def means_wide(xd: DataFrame, metrics: list[str], domains: list[str]) -> DataFrame:
    """Arm x metric rows, one mean and n column per domain, every arm of
    the fixed order present (right join to the arm dimension). A row of
    another domain, or of none, has no column and is an error when it is read."""
    g = known_domains(group_means(known_arms(xd), ["domain", "arm"], metrics), domains)
    wide = (g.groupBy("arm", "metric").pivot("domain", domains)
            .agg(F.first("mean").alias("mean"), F.first("n").alias("n")))
    arms = arm_dimension(xd.sparkSession)
    metric_dim = arms.select("arm", "arm_ord", F.explode(F.array(*[F.lit(m) for m in metrics])).alias("metric"))
    cols = []
    for d in domains:
        cols += [F.col(f"{d}_mean").alias(f"mean_{d}"), F.coalesce(F.col(f"{d}_n"), F.lit(0)).alias(f"n_{d}")]
    return metric_dim.join(wide, ["arm", "metric"], "left").select("arm", "arm_ord", "metric", *cols)
