"""Matched-item comparisons and effect sizes.

* Matched items: one shuffle by (group, item) with an explicit-value pivot.
* Paired tests: adjacent arms of the fixed order among those present, one
  aggregate per comparison; ranks for the signed-rank test come from value
  counts (``ranks.running_below``), never from a sort of the rows.
* Effects against the baseline: per-arm aggregates joined to the baseline
  aggregate of the same domain (small tables), Cliff's delta from value
  counts, the baseline counts replicated once per compared arm after they are
  aggregated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docreason.functions.scores import rnd
from docreason.functions.stats import EXACT_RANKS, norm_sf_udf, signed_rank_sf_udf, t_sf_udf
from docreason.operators.joins import join_on
from docreason.operators.ranks import cliffs_delta, running_below
from docreason.schemas import ARMS
from docreason.session import materialize

COND_ARMS = ARMS[1:]


def present_arms(df: DataFrame, group: list[str], arms=ARMS) -> DataFrame:
    """Arms present per group with their order index (P22 order)."""
    order = F.array_position(F.array(*[F.lit(a) for a in arms]), F.col("arm")) - 1
    return (df.select(*group, "arm").distinct()
            .where(F.col("arm").isin(arms)).withColumn("arm_ord", order.cast("int")))


def matched_pivot(cl: DataFrame, group: list[str], item: str, value: str, arms=ARMS) -> DataFrame:
    """A24 + J6: per (group, item) the mean of ``value`` per arm (one column
    per arm), kept only when every arm present in the group has a value."""
    wide = (cl.groupBy(*group, item).pivot("arm", arms).agg(F.avg(value)))
    # Means of duplicates are rounded to 12 places so that tie and zero tests
    # downstream do not depend on the order the duplicates were summed in.
    for a in arms:
        wide = wide.withColumn(a, F.round(F.col(a), 12))
    n_present = present_arms(cl, group, arms).groupBy(*group).agg(F.count(F.lit(1)).alias("_n_arms"))
    n_values = sum(F.col(a).isNotNull().cast("int") for a in arms)
    return join_on(wide, n_present, group).where(n_values == F.col("_n_arms")).drop("_n_arms")


def adjacent_pairs(cl: DataFrame, group: list[str], arms=ARMS) -> DataFrame:
    """Consecutive arms in the fixed order among those present per group
    (a window over at most len(arms) rows per group)."""
    p = present_arms(cl, group, arms)
    w = Window.partitionBy(*group).orderBy("arm_ord")
    return (p.withColumn("arm_b", F.lead("arm").over(w)).where(F.col("arm_b").isNotNull())
            .select(*group, F.col("arm").alias("arm_a"), "arm_b", F.col("arm_ord").alias("pair_ord")))


def paired_differences(cl: DataFrame, group: list[str], item: str, metrics: dict[str, str],
                       arms=ARMS) -> DataFrame:
    """Rows (group, metric, arm_a, arm_b, item, x_a, x_b, d) over matched items.

    ``metrics`` maps a metric name to its direction: 'a-b' (errors: a worse
    than b means d > 0) or 'b-a' (similarities: b better than a). One pivot
    (one shuffle by item) serves every metric."""
    names = list(metrics)
    wide = cl.groupBy(*group, item).pivot("arm", arms).agg(
        *[F.round(F.avg(m), 12).alias(m) for m in names])
    # Per group the arms present, in order, from the same pivoted rows: an arm
    # is present if any item has a row for it.
    names_of = lambda a, m: f"{a}_{m}" if len(names) > 1 else a
    arms_here = cl.groupBy(*group).agg(F.collect_set("arm").alias("_arms"))
    order = F.filter(F.array(*[F.lit(a) for a in arms]), lambda a: F.array_contains("_arms", a))
    pairs = arms_here.select(*group, order.alias("_order")).select(
        *group, F.size("_order").alias("_n_arms"),
        F.explode(F.zip_with(F.expr("slice(_order, 1, greatest(size(_order) - 1, 0))"),
                             F.expr("slice(_order, 2, greatest(size(_order) - 1, 0))"),
                             lambda a, b: F.struct(a.alias("arm_a"), b.alias("arm_b")))).alias("_pair"))
    j = join_on(wide, pairs.select(*group, "_n_arms", "_pair.arm_a", "_pair.arm_b"), group)
    cases = []
    for metric, direction in metrics.items():
        values = F.create_map(*[x for a in arms for x in (F.lit(a), F.col(names_of(a, metric)))])
        x_a, x_b = values[F.col("arm_a")], values[F.col("arm_b")]
        n_values = sum(F.col(names_of(a, metric)).isNotNull().cast("int") for a in arms)
        cases.append(F.struct(
            F.lit(metric).alias("metric"), x_a.alias("x_a"), x_b.alias("x_b"),
            (x_a - x_b if direction == "a-b" else x_b - x_a).alias("d"), (n_values == F.col("_n_arms")).alias("complete")))
    return (j.select(*group, "arm_a", "arm_b", item, F.explode(F.array(*cases)).alias("_m")).where("_m.complete")
            .select(*group, "_m.metric", "arm_a", "arm_b", item, "_m.x_a", "_m.x_b", "_m.d"))


def paired_t(diffs: DataFrame, group: list[str]) -> DataFrame:
    """A19 statistic + A17: one-sided paired t (H1: mean d > 0) and Cohen's d
    of the differences, per comparison."""
    keys = group + ["metric", "arm_a", "arm_b"]
    sd = F.stddev_samp("d")
    n = F.count(F.lit(1))
    return diffs.groupBy(*keys).agg(
        n.alias("n_matched"),
        rnd(F.avg("x_a")).alias("mean_a"), rnd(F.avg("x_b")).alias("mean_b"),
        rnd(F.avg("d")).alias("delta"),
        rnd(F.try_divide(F.avg("d"), sd / F.sqrt(n))).alias("t_stat"),
        rnd(F.try_divide(F.avg("d"), sd + 1e-12)).alias("cohen_d"))


def wilcoxon(diffs: DataFrame, group: list[str]) -> DataFrame:
    """Signed-rank statistic W+ (zeros dropped, tied |d| share the mean
    rank), its normal z with the tie-corrected variance, and how many non-zero
    differences share their |d| with another."""
    keys = group + ["metric", "arm_a", "arm_b"]
    nz = diffs.where(F.col("d") != 0).withColumn("absd", F.abs("d"))
    counts = nz.groupBy(*keys, "absd").agg(F.count(F.lit(1)).alias("cnt"),
                                            F.count_if(F.col("d") > 0).alias("cnt_pos"))
    ranked = running_below(materialize(counts, "value-counts"), keys, "absd", "cnt").withColumn(
        "avg_rank", F.col("below") + (F.col("cnt") + 1) / 2.0)
    agg = ranked.groupBy(*keys).agg(
        F.sum("cnt").alias("n_nonzero"),
        F.sum(F.when(F.col("cnt") > 1, F.col("cnt")).otherwise(0)).alias("n_tied"),
        F.sum(F.col("cnt_pos") * F.col("avg_rank")).alias("w"),
        # In DOUBLE: the cube of a tie of a few million rows exceeds BIGINT.
        F.sum(F.pow(F.col("cnt").cast("double"), F.lit(3.0)) - F.col("cnt")).alias("_ties"))
    n = F.col("n_nonzero").cast("double")
    mean = n * (n + 1) / 4.0
    var = n * (n + 1) * (2 * n + 1) / 24.0 - F.col("_ties") / 48.0
    return agg.select(*keys, "n_nonzero", "n_tied", rnd("w").alias("w_stat"),
                      rnd(F.try_divide(F.col("w") - mean, F.sqrt(var))).alias("z"))


def paired_pvalues(t_tab: DataFrame, w_tab: DataFrame, group: list[str]) -> DataFrame:
    """p values of both one-sided tests, computed on the few comparison rows.
    The signed-rank p is exact (``exact``) for up to ``EXACT_RANKS`` matched
    items without ties or zero differences, else the normal form."""
    from docreason.session import ship_package
    ship_package(t_tab.sparkSession)
    keys = group + ["metric", "arm_a", "arm_b"]
    j = join_on(t_tab, w_tab, keys, "left")
    exact = F.coalesce((F.col("n_nonzero") <= EXACT_RANKS) & (F.col("n_nonzero") == F.col("n_matched"))
                       & (F.col("n_tied") == 0), F.lit(False))
    return j.select(*keys, "n_matched", "t_stat",
                    t_sf_udf(F.col("t_stat"), (F.col("n_matched") - 1).cast("double")).alias("p_t"),
                    "w_stat", "z", exact.alias("exact"),
                    F.when(exact, signed_rank_sf_udf(F.col("w_stat"), F.col("n_nonzero")))
                    .otherwise(norm_sf_udf(F.col("z"))).alias("p_w"))


def _long_values(xd: DataFrame, metrics: list[str]) -> DataFrame:
    return (xd.select("domain", "arm", F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics
    ])).alias("_mv")).select("domain", "arm", "_mv.metric", "_mv.value")
        .where(F.col("value").isNotNull()))


def effects_vs_baseline(xd: DataFrame, metrics: list[str], cond_arms=COND_ARMS,
                        base_arm: str = ARMS[0]) -> DataFrame:
    """A27 without intervals (J5, A16, A18): per metric, domain and compared
    arm: difference of means to the baseline of the same domain, Cohen's d
    (pooled sd), exact Cliff's delta, n_base, n_cond. A missing side gives
    NULL effects with its count 0."""
    long = _long_values(xd, metrics)
    stats = long.groupBy("metric", "domain", "arm").agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.var_samp("value").alias("var"))
    grid = (xd.select("domain").distinct()
            .select("domain", F.explode(F.array(*[F.lit(m) for m in metrics])).alias("metric"))
            .select("domain", "metric", F.explode(F.array(*[F.lit(a) for a in cond_arms])).alias("arm")))
    base = stats.where(F.col("arm") == base_arm).select(
        "metric", "domain", F.col("n").alias("nb"), F.col("mean").alias("mb"), F.col("var").alias("vb"))
    cur = stats.select("metric", "domain", "arm", F.col("n").alias("na"), F.col("mean").alias("ma"),
                       F.col("var").alias("va"))
    j = join_on(join_on(grid, base, ["metric", "domain"], "left"), cur, ["metric", "domain", "arm"], "left")
    na, nb = F.coalesce("na", F.lit(0)), F.coalesce("nb", F.lit(0))
    pooled = F.sqrt(((F.col("na") - 1) * F.col("va") + (F.col("nb") - 1) * F.col("vb"))
                    / (F.col("na") + F.col("nb") - 2))
    d = F.when((na >= 2) & (nb >= 2) & (pooled != 0), (F.col("ma") - F.col("mb")) / pooled)
    eff = j.select("metric", "domain", "arm",
                   F.when((na > 0) & (nb > 0), F.col("ma") - F.col("mb")).alias("diff_mean"),
                   d.alias("cohens_d"), nb.alias("n_base"), na.alias("n_cond"))
    # Cliff's delta: value counts per side; baseline counts replicated per arm.
    vc = long.groupBy("metric", "domain", "arm", "value").agg(F.count(F.lit(1)).alias("c"))
    a_side = vc.where(F.col("arm").isin(cond_arms)).select(
        "metric", "domain", "arm", "value", F.col("c").alias("na"), F.lit(0).cast("bigint").alias("nb"))
    b_side = vc.where(F.col("arm") == base_arm).select(
        "metric", "domain", F.explode(F.array(*[F.lit(a) for a in cond_arms])).alias("arm"), "value",
        F.lit(0).cast("bigint").alias("na"), F.col("c").alias("nb"))
    counts = (a_side.unionByName(b_side).groupBy("metric", "domain", "arm", "value")
              .agg(F.sum("na").alias("na"), F.sum("nb").alias("nb")))
    cd = cliffs_delta(counts, ["metric", "domain", "arm"], "value").select(
        "metric", "domain", "arm", F.when((F.col("n_a") > 0) & (F.col("n_b") > 0), F.col("cliffs_delta"))
        .alias("cliffs_delta"))
    return join_on(eff, cd, ["metric", "domain", "arm"], "left").select(
        "metric", "domain", "arm", rnd("diff_mean").alias("diff_mean"), rnd("cohens_d").alias("cohens_d"),
        rnd("cliffs_delta").alias("cliffs_delta"), "n_base", "n_cond")


def diff_in_diff(effects: DataFrame) -> DataFrame:
    """J7 point estimate: per metric and arm, effect in the first domain minus
    effect in the second, only when exactly two domains have both sides."""
    ok = effects.where((F.col("n_base") > 0) & (F.col("n_cond") > 0))
    g = ok.groupBy("metric", "arm").agg(
        F.count(F.lit(1)).alias("n_domains"), F.min("domain").alias("_d1"), F.max("domain").alias("_d2"),
        (F.min_by("diff_mean", "domain") - F.max_by("diff_mean", "domain")).alias("_did"))
    two = F.col("n_domains") == 2
    return g.select("metric", "arm", "n_domains", F.when(two, F.col("_d1")).alias("domain_a"),
                    F.when(two, F.col("_d2")).alias("domain_b"), F.when(two, rnd("_did")).alias("did"))
