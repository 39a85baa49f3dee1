"""Queries: matched items, paired tests, effect sizes (A16-A20, A24, A27,
J5-J8, W7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from docreason.operators import paired as P
from docreason.plans.q_metrics import _q, clean, xd
from docreason.plans.registry import register
from docreason.schemas import ARMS

G = ["domain"]
PAIR_METRICS = {"abs_err": "a-b", "trace_sim": "b-a"}
EFFECT_METRICS = ["eval_score", "score_cont"]


def _clean_err(spark, sf):
    return clean(spark, sf).withColumn("abs_err", F.abs(F.col("pred") - F.col("gold")))


def diffs(spark, sf):
    return P.paired_differences(_clean_err(spark, sf), G, "question_id", PAIR_METRICS)


def _piv_sql(name: str, value: str) -> str:
    cols = ", ".join(f"round(avg(v) filter (where arm = '{a}'), 12) as {a}" for a in ARMS)
    nn = " + ".join(f"cast({a} is not null as integer)" for a in ARMS)
    return (f"{name} AS select p.* from (select domain, question_id, {cols} from "
            f"(select domain, question_id, arm, {value} as v from clean) group by domain, question_id) p "
            f"join (select domain, count(distinct arm) as n_arms from clean group by domain) r using (domain) "
            f"where {nn} = r.n_arms")


def _pick(side: str) -> str:
    return "case " + side + " " + " ".join(f"when '{a}' then {a}" for a in ARMS) + " end"


PAIRS = ("pairs AS select * from (select domain, arm as arm_a, lead(arm) over (partition by domain order by arm_ord) as arm_b "
         "from (select distinct domain, arm from clean) join arm_dim using (arm)) where arm_b is not null")
DIFFS = ("diffs AS select *, case when metric = 'abs_err' then x_a - x_b else x_b - x_a end as d from ("
         f"select m.domain, 'abs_err' as metric, arm_a, arm_b, m.question_id, {_pick('arm_a')} as x_a, {_pick('arm_b')} as x_b "
         "from m_err m join pairs using (domain) union all "
         f"select m.domain, 'trace_sim' as metric, arm_a, arm_b, m.question_id, {_pick('arm_a')} as x_a, {_pick('arm_b')} as x_b "
         "from m_trace m join pairs using (domain))")
PAIRED_CTES = (_piv_sql("m_err", "abs(pred - gold)"), _piv_sql("m_trace", "trace_sim"), PAIRS, DIFFS)


@register("matched_errors", _q("select * from m_err", _piv_sql("m_err", "abs(pred - gold)")))
def q_matched_errors(spark, sf):
    return P.matched_pivot(_clean_err(spark, sf), G, "question_id", "abs_err")


@register("paired_t", _q("""
select domain, metric, arm_a, arm_b, count(*) as n_matched, round(avg(x_a), 9) as mean_a,
  round(avg(x_b), 9) as mean_b, round(avg(d), 9) as delta,
  round(avg(d) / nullif(stddev_samp(d) / sqrt(count(*)), 0), 9) as t_stat,
  round(avg(d) / (stddev_samp(d) + 1e-12::DOUBLE), 9) as cohen_d
from diffs group by domain, metric, arm_a, arm_b""", *PAIRED_CTES))
def q_paired_t(spark, sf):
    return P.paired_t(diffs(spark, sf), G)


WILCOXON_SQL = """
select domain, metric, arm_a, arm_b, n_nonzero, n_tied, round(w, 9) as w_stat,
  round((w - n * (n + 1) / 4.0) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - ties / 48.0), 9) as z
from (select domain, metric, arm_a, arm_b, cast(sum(cnt) as bigint) as n_nonzero,
             cast(coalesce(sum(cnt) filter (where cnt > 1), 0) as bigint) as n_tied, cast(sum(cnt) as double) as n,
             sum(cnt_pos * avg_rank) as w, cast(sum(cnt * cnt * cnt - cnt) as double) as ties
      from (select *, coalesce(sum(cnt) over (partition by domain, metric, arm_a, arm_b order by absd
                        rows between unbounded preceding and 1 preceding), 0) + (cnt + 1) / 2.0::DOUBLE as avg_rank
            from (select domain, metric, arm_a, arm_b, abs(d) as absd, count(*) as cnt,
                         count(*) filter (where d > 0) as cnt_pos
                  from diffs where d <> 0 group by domain, metric, arm_a, arm_b, abs(d)))
      group by domain, metric, arm_a, arm_b)"""


@register("wilcoxon", _q(WILCOXON_SQL, *PAIRED_CTES))
def q_wilcoxon(spark, sf):
    return P.wilcoxon(diffs(spark, sf), G)


# p values of both tests: Student and normal tails on the comparison rows
# (no tail functions in the oracle engine, so this one is checked on rows).
@register("paired_pvalues")
def q_paired_pvalues(spark, sf):
    d = diffs(spark, sf)
    return P.paired_pvalues(P.paired_t(d, G), P.wilcoxon(d, G), G)


def _long_sql() -> str:
    return " union all ".join(
        f"select domain, arm, '{m}' as metric, cast({m} as double) as value from xd where {m} is not null"
        for m in EFFECT_METRICS)


CONDS = "(values ('raw_text'), ('raw_text_contract'), ('contract')) a(arm)"
EFFECTS_CTES = (
    f"long AS {_long_sql()}",
    "stats AS select metric, domain, arm, count(*) as n, avg(value) as mean, var_samp(value) as var from long group by metric, domain, arm",
    "grid AS select distinct x.domain, m.metric, a.arm from xd x, (values ('eval_score'), ('score_cont')) m(metric), " + CONDS,
    "j AS select g.metric, g.domain, g.arm, b.n as nb, b.mean as mb, b.var as vb, c.n as na, c.mean as ma, c.var as va "
    "from grid g left join stats b on b.metric = g.metric and b.domain = g.domain and b.arm = 'baseline' "
    "left join stats c on c.metric = g.metric and c.domain = g.domain and c.arm = g.arm",
    "vc AS select metric, domain, arm, value, count(*) as c from long group by metric, domain, arm, value",
    "counts AS select metric, domain, arm, value, sum(na) as na, sum(nb) as nb from ("
    "select metric, domain, arm, value, c as na, 0 as nb from vc where arm in ('raw_text', 'raw_text_contract', 'contract') "
    f"union all select v.metric, v.domain, a.arm, v.value, 0 as na, v.c as nb from vc v, {CONDS} where v.arm = 'baseline') "
    "group by metric, domain, arm, value",
    "cr AS select *, coalesce(sum(nb) over (partition by metric, domain, arm order by value rows between unbounded preceding and 1 preceding), 0) as below, "
    "sum(nb) over (partition by metric, domain, arm) as nbt, sum(na) over (partition by metric, domain, arm) as nat from counts",
    "cd AS select metric, domain, arm, cast(sum(na * (below - (nbt - below - nb))) as double) / cast(max(nat) * max(nbt) as double) as cliffs, "
    "max(nat) as nat, max(nbt) as nbt from cr group by metric, domain, arm",
    "eff AS select j.metric, j.domain, j.arm, "
    "round(case when coalesce(na, 0) > 0 and coalesce(nb, 0) > 0 then ma - mb end, 9) as diff_mean, "
    "round(case when coalesce(na, 0) >= 2 and coalesce(nb, 0) >= 2 and sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)) <> 0 "
    "then (ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)) end, 9) as cohens_d, "
    "round(case when cd.nat > 0 and cd.nbt > 0 then cd.cliffs end, 9) as cliffs_delta, "
    "coalesce(nb, 0) as n_base, coalesce(na, 0) as n_cond "
    "from j left join cd using (metric, domain, arm)",
)


@register("effects_vs_baseline", _q("select * from eff", *EFFECTS_CTES))
def q_effects(spark, sf):
    return P.effects_vs_baseline(xd(spark, sf), EFFECT_METRICS)


@register("cliffs_delta", _q("select metric, domain, arm, cliffs_delta, n_base, n_cond from eff", *EFFECTS_CTES))
def q_cliffs(spark, sf):
    return P.effects_vs_baseline(xd(spark, sf), EFFECT_METRICS).select(
        "metric", "domain", "arm", "cliffs_delta", "n_base", "n_cond")


@register("diff_in_diff", _q("""
select metric, arm, count(*) as n_domains,
  case when count(*) = 2 then min(domain) end as domain_a, case when count(*) = 2 then max(domain) end as domain_b,
  case when count(*) = 2 then round(arg_min(diff_mean, domain) - arg_max(diff_mean, domain), 9) end as did
from eff where n_base > 0 and n_cond > 0 group by metric, arm""", *EFFECTS_CTES))
def q_did(spark, sf):
    return P.diff_in_diff(P.effects_vs_baseline(xd(spark, sf), EFFECT_METRICS))
