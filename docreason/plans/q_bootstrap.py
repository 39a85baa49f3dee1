"""Queries: bootstrap intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from docreason.operators import bootstrap as B
from docreason.operators.paired import COND_ARMS, _long_values
from docreason.plans.q_metrics import DOMAINS, _q, clean, xd
from docreason.plans.registry import register
from docreason.schemas import ARMS, N_BOOT, SEED_CROSS_DOMAIN, SEED_PER_DOMAIN

HASH_B = 20
MEAN_METRICS = ["eval_score", "score_cont", "correct_bin"]
EFFECT_METRICS = ["eval_score", "score_cont"]
KEYS = ["metric", "domain", "arm"]


def _reps_ctes(metrics: list[str]) -> tuple[str, ...]:
    long = " union all ".join(
        f"select domain, arm, '{m}' as metric, cast({m} as double) as value from xd where {m} is not null"
        for m in metrics)
    return (
        f"vals AS {long}",
        "sized AS select metric, domain, arm, value, row_number() over (partition by metric, domain, arm order by value) - 1 as idx, "
        "count(*) over (partition by metric, domain, arm) as n from vals",
        "grp AS select distinct metric, domain, arm, n from sized",
        f"draws AS select metric, domain, arm, n, r, unnest(range(n)) as j from grp, range({HASH_B}) t(r)",
        f"hd AS select metric, domain, arm, n, r, ('0x' || substr(md5(concat_ws('-', '{SEED_CROSS_DOMAIN}', metric, domain, arm, r, j)), 1, 15))::BIGINT % n as k from draws",
        "reps AS select h.metric, h.domain, h.arm, h.r, sum(s.value) / max(h.n) as rep_mean "
        "from hd h join sized s on s.metric = h.metric and s.domain = h.domain and s.arm = h.arm and s.idx = h.k "
        "group by h.metric, h.domain, h.arm, h.r",
    )


@register("bootstrap_mean_hash", _q("""
select o.metric, o.domain, o.arm, o.n_valid, round(o.m, 9) as mean, round(q[2], 9) as boot_median,
  round(q[1], 9) as ci_lo, round(q[3], 9) as ci_hi
from (select metric, domain, arm, count(*) as n_valid, avg(value) as m from vals group by metric, domain, arm) o
join (select metric, domain, arm, quantile_cont(rep_mean, [0.025, 0.5, 0.975]) as q from reps group by metric, domain, arm) b
  using (metric, domain, arm)""", *_reps_ctes(MEAN_METRICS)))
def q_boot_mean(spark, sf):
    v = _long_values(xd(spark, sf), MEAN_METRICS)
    return B.mean_ci_hash(v, KEYS, "value", HASH_B, SEED_CROSS_DOMAIN)


@register("bootstrap_diff_hash", _q("""
select c.metric, c.domain, c.arm, round(c.m - b.m, 9) as diff_mean, round(q.q[1], 9) as diff_lo, round(q.q[2], 9) as diff_hi
from (select metric, domain, arm, avg(value) as m from vals group by metric, domain, arm) c
join (select metric, domain, avg(value) as m from vals where arm = 'baseline' group by metric, domain) b using (metric, domain)
join (select x.metric, x.domain, x.arm, quantile_cont(x.rep_mean - y.rep_mean, [0.025, 0.975]) as q
      from reps x join reps y on y.metric = x.metric and y.domain = x.domain and y.arm = 'baseline' and y.r = x.r
      where x.arm <> 'baseline' group by x.metric, x.domain, x.arm) q using (metric, domain, arm)
where c.arm in ('raw_text', 'raw_text_contract', 'contract')""", *_reps_ctes(EFFECT_METRICS)))
def q_boot_diff(spark, sf):
    v = _long_values(xd(spark, sf), EFFECT_METRICS)
    return B.diff_ci_hash(v, ["metric", "domain"], "arm", "value", COND_ARMS, ARMS[0], HASH_B,
                          SEED_CROSS_DOMAIN)


@register("bootstrap_did_hash", _q("""
select w.metric, w.arm, d.da as domain_a, d.db as domain_b,
  round(avg(e1.e - e2.e), 9) as did_mean, round(quantile_cont(e1.e - e2.e, 0.025), 9) as ci_lo,
  round(quantile_cont(e1.e - e2.e, 0.975), 9) as ci_hi
from (select distinct metric, arm from reps where arm <> 'baseline') w
left join doms d on d.metric = w.metric and d.arm = w.arm and d.n_domains = 2
left join eff e1 on e1.metric = w.metric and e1.arm = w.arm and e1.domain = d.da
left join eff e2 on e2.metric = e1.metric and e2.arm = e1.arm and e2.r = e1.r and e2.domain = d.db
group by w.metric, w.arm, d.da, d.db""", *_reps_ctes(EFFECT_METRICS),
    "eff AS select x.metric, x.domain, x.arm, x.r, x.rep_mean - y.rep_mean as e from reps x join reps y "
    "on y.metric = x.metric and y.domain = x.domain and y.arm = 'baseline' and y.r = x.r where x.arm <> 'baseline'",
    "doms AS select metric, arm, count(distinct domain) as n_domains, min(domain) as da, max(domain) as db from eff group by metric, arm"))
def q_boot_did(spark, sf):
    v = _long_values(xd(spark, sf), EFFECT_METRICS)
    return B.did_ci_hash(v, ["metric"], "domain", "arm", "value", COND_ARMS, ARMS[0], HASH_B,
                         SEED_CROSS_DOMAIN)


# Poisson bootstrap with the analysis' replicate count; random draws, so
# checked on rows (and by the statistical tests).
@register("bootstrap_metrics")
def q_boot_metrics(spark, sf):
    return B.bootstrap_metrics(clean(spark, sf), ["domain", "arm"], N_BOOT, SEED_PER_DOMAIN)


# A12 (cross-domain, full B) + A34: per arm and metric, one mean / interval
# column set per domain, every arm of the fixed order present.
@register("means_wide_ci")
def q_means_wide_ci(spark, sf):
    from docreason.operators.metrics import arm_dimension, known_domains
    d = xd(spark, sf)
    ci = B.mean_ci_poisson(_long_values(d, MEAN_METRICS), KEYS, "value", N_BOOT, SEED_CROSS_DOMAIN)
    wide = known_domains(ci, DOMAINS).groupBy("arm", "metric").pivot("domain", DOMAINS).agg(
        F.first("mean").alias("mean"), F.first("ci_lo").alias("ci_lo"), F.first("ci_hi").alias("ci_hi"))
    dim = arm_dimension(spark).select("arm", "arm_ord", F.explode(F.array(*[F.lit(m) for m in MEAN_METRICS])).alias("metric"))
    return dim.join(wide, ["arm", "metric"], "left").orderBy("metric", "arm_ord")


# A27 with intervals at the full replicate count (Poisson replicates).
@register("effects_ci")
def q_effects_ci(spark, sf):
    from docreason.operators.paired import effects_vs_baseline
    d = xd(spark, sf)
    v = _long_values(d, EFFECT_METRICS)
    reps = B.replicate_means_poisson(v, KEYS, "value", N_BOOT, SEED_CROSS_DOMAIN)
    ci = B.diff_ci(v, ["metric", "domain"], "arm", "value", COND_ARMS, ARMS[0], reps).drop("diff_mean")
    return effects_vs_baseline(d, EFFECT_METRICS).join(ci, ["metric", "domain", "arm"], "left")


# A14 at the full replicate count.
@register("diff_in_diff_ci")
def q_did_ci(spark, sf):
    v = _long_values(xd(spark, sf), EFFECT_METRICS)
    reps = B.replicate_means_poisson(v, KEYS, "value", N_BOOT, SEED_CROSS_DOMAIN)
    return B.did_ci(["metric"], "domain", "arm", COND_ARMS, ARMS[0], reps)
