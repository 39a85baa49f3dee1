"""SQL fragments shared by the oracle queries (DuckDB dialect)."""

from __future__ import annotations

from docreason.functions.scores import linspace


def d(x: float) -> str:
    """A DOUBLE literal that round-trips exactly."""
    return f"{float(x)!r}::DOUBLE"


def strip(x: str) -> str:
    """str.strip() of ASCII white space."""
    return f"trim({x}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


def sql_list(xs) -> str:
    return "[" + ", ".join(d(x) for x in xs) + "]"


def sql_bin_index(expr: str, edges: list[float], close_last: bool = False) -> str:
    n = len(edges)
    parts = [f"CASE WHEN {expr} IS NULL THEN NULL", f"WHEN {expr} < {d(edges[0])} THEN -1"]
    for i in range(1, n):
        parts.append(f"WHEN {expr} < {d(edges[i])} THEN {i - 1}")
    if close_last:
        parts.append(f"WHEN {expr} = {d(edges[-1])} THEN {n - 2} ELSE {n - 1} END")
    else:
        parts.append(f"ELSE {n - 1} END")
    return " ".join(parts)


def tri(x: str) -> str:
    return (f"(CASE WHEN {x} IS NULL THEN NULL WHEN {x} <= 0.25::DOUBLE THEN 0.0::DOUBLE "
            f"WHEN {x} <= 0.75::DOUBLE THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END)")


def bucket(x: str) -> str:
    return f"(CASE WHEN {x} < 0.33::DOUBLE THEN 'Low' WHEN {x} < 0.66::DOUBLE THEN 'Med' ELSE 'High' END)"


def clip(x: str) -> str:
    return f"(CASE WHEN {x} IS NULL OR isnan({x}) THEN NULL ELSE greatest(least({x}, 1.0::DOUBLE), 0.0::DOUBLE) END)"


def pearson(x: str, y: str) -> str:
    return f"covar_samp({x}, {y}) / nullif(stddev_samp({x}) * stddev_samp({y}), 0)"


def avg_rank(part: str, x: str) -> str:
    """Average rank of x within ``part`` (ties share the mean rank)."""
    return (f"(rank() OVER (PARTITION BY {part} ORDER BY {x}) + "
            f"(count(*) OVER (PARTITION BY {part}, {x}) - 1) / 2.0::DOUBLE)")


CAL_EDGES = linspace(0.0, 1.0, 11)
CAL_CENTERS = [(CAL_EDGES[b] + CAL_EDGES[b + 1]) / 2.0 for b in range(10)]
RES_EDGES = linspace(-1.0, 1.0, 31)

# Normalised scored answers (P11/P10) and the complete-case rows.
NORM = ("select question_id, domain, arm, " + clip("gold") + " as gold, " + clip("pred")
        + " as pred, " + clip("trace_sim") + " as trace_sim from qa_eval")
CLEAN = "select * from norm where gold is not null and pred is not null and trace_sim is not null"
# Cross-domain preparation (P10 on gold/pred, P19).
XD = ("select question_id, domain, arm, gold, pred, eval_score, abs(pred - gold) as abs_err, "
      "1 - abs(pred - gold) as score_cont, "
      "coalesce(cast(abs(pred - gold) <= 0.15::DOUBLE as integer), 0) as correct_bin "
      "from (select question_id, domain, arm, " + clip("gold") + " as gold, " + clip("pred")
      + " as pred, case when isnan(trace_sim) then null else trace_sim end as eval_score from qa_eval)")
ARM_DIM = "select * from (values ('baseline', 0), ('raw_text', 1), ('raw_text_contract', 2), ('contract', 3)) as t(arm, arm_ord)"
