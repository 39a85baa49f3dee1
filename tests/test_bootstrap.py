"""Poisson bootstrap: deterministic under any partitioning."""

from pyspark.sql import functions as F

from docreason.operators.bootstrap import bootstrap_metrics
from docreason.plans.q_metrics import clean
from tests.conftest import SF_SMALL


def test_same_result_at_any_partitioning(spark):
    cl = clean(spark, SF_SMALL)
    a = bootstrap_metrics(cl.repartition(1), ["domain", "arm"], n_boot=200).orderBy("domain", "arm").collect()
    b = bootstrap_metrics(cl.repartition(7), ["domain", "arm"], n_boot=200).orderBy("domain", "arm").collect()
    assert a == b
    assert all(r.mae.count("[") == 1 for r in a)


def test_interval_contains_point_estimate(spark):
    cl = clean(spark, SF_SMALL)
    r = bootstrap_metrics(cl, ["domain", "arm"], n_boot=300).collect()
    point = {(x.domain, x.arm): x.m for x in cl.groupBy("domain", "arm").agg(
        F.avg(F.abs(F.col("pred") - F.col("gold"))).alias("m")).collect()}
    for row in r:
        mid, rest = row.mae.split(" [")
        lo, hi = (float(v) for v in rest.rstrip("]").split(", "))
        assert lo - 1e-3 <= point[(row.domain, row.arm)] <= hi + 1e-3


def test_every_replicate_is_there_and_sums_are_right(spark):
    import numpy as np
    from docreason.operators import bootstrap as B
    cells = spark.createDataFrame([("a", 0.5, 1), ("b", 0.25, 3), ("b", 1.0, 2), (None, 0.75, 4)], "g string, v double, m long")
    sums = lambda c: np.column_stack([np.ones(len(c["v"])), c["v"].astype(float)])
    rows = B.replicate_sums(cells, ["g"], ["v"], 200, 3, sums, ["w", "wv"]).collect()
    got = {}
    for r in rows:
        got.setdefault(r.g, {})[r.r] = (r.w, r.wv)
    assert {g: sorted(x) for g, x in got.items()} == {g: list(range(200)) for g in ("a", "b", None)}
    draws = {t: B._draws(3, t[:2], t[2], 200) for t in [("a", 0.5, 1), ("b", 0.25, 3), ("b", 1.0, 2), (None, 0.75, 4)]}
    for g, by in got.items():
        for r, (w, wv) in by.items():
            own = [(t, d[r]) for t, d in draws.items() if t[0] == g]
            assert w == sum(d for _, d in own) and abs(wv - sum(t[1] * d for t, d in own)) < 1e-9
    assert any(w == 0 for w, _ in got["a"].values())  # a one-row group has empty replicates


def test_one_row_group_reports_usable_replicates(spark):
    from docreason.operators.bootstrap import bootstrap_metrics
    df = spark.createDataFrame([("d", 0.5, 0.4, 0.3)], "domain string, gold double, pred double, trace_sim double")
    r = bootstrap_metrics(df, ["domain"], n_boot=400).first()
    assert r.n == 1 and 200 < r.n_usable < 300 and r.mae.startswith("0.100")


def test_spearman_replicates_match_direct_ranks(spark):
    import numpy as np
    import pandas as pd
    from docreason.operators import bootstrap as B
    rng = np.random.default_rng(5)
    cells = [(int(x), int(y), int(m)) for (x, y), m in
             {(x, y): rng.integers(1, 5) for x, y in rng.integers(0, 9, (30, 2)).tolist()}.items()]
    df = spark.createDataFrame([("k", float(x), float(y), m) for x, y, m in cells], "g string, x double, y double, m long")
    got = {r.r: r.spearman for r in B.spearman_replicates(df, ["g"], "x", "y", 30, 9, block=7).collect()}
    px = {v: i for i, v in enumerate(sorted({c[0] for c in cells}))}
    py = {v: i for i, v in enumerate(sorted({c[1] for c in cells}))}
    draws = {c: B._draws(9, ("k", px[c[0]], py[c[1]]), c[2], 30) for c in cells}
    assert sorted(got) == list(range(30))
    for r in range(30):
        rows = pd.DataFrame([(c[0], c[1]) for c in cells for _ in range(draws[c][r])]).rank()
        assert abs(got[r] - rows[0].corr(rows[1])) < 1e-9


def skewed_cells():
    """1 % of the rows on distinct values below 0.01, the others on 20 values."""
    import numpy as np
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.random(300) / 100, rng.integers(1, 21, 29700) / 20])
    y = np.clip(np.round(x * 20) + rng.integers(-3, 4, 30000), 0, 20) / 20
    y[:300] += rng.random(300) / 100
    return x, y


def test_spearman_replicates_of_skewed_scores(spark):
    import numpy as np
    import pandas as pd
    from docreason.operators import bootstrap as B
    x, y = skewed_cells()
    direct = pd.Series(x).rank().corr(pd.Series(y).rank())
    cells = pd.DataFrame({"g": "k", "x": x, "y": y}).groupby(["g", "x", "y"]).size().rename("m").reset_index()
    got = [r.spearman for r in B.spearman_replicates(spark.createDataFrame(cells), ["g"], "x", "y", 60, 9).collect()]
    assert len(got) == 60 and abs(np.median(got) - direct) < 0.003
    pairs = np.random.default_rng(4).integers(0, 30000, (60, 30000))
    resampled = [pd.Series(x[i]).rank().corr(pd.Series(y[i]).rank()) for i in pairs]
    assert 0.6 < np.std(got) / np.std(resampled) < 1.6


def test_rank_grid_cuts_by_rows(spark):
    import pandas as pd
    from docreason.operators import bootstrap as B
    x, _ = skewed_cells()
    few = [float(i) for i in range(64) for _ in range(1 if i else 5000)]
    rows = pd.concat([pd.DataFrame({"g": g, "x": v}) for g, v in (("skewed", x), ("few", few), (None, [0.5, 0.25]))])
    cells = rows.groupby(["g", "x"], dropna=False).size().rename("m").reset_index()
    df = spark.createDataFrame([(g if isinstance(g, str) else None, float(v), int(m)) for g, v, m in cells.itertuples(index=False)],
                               "g string, x double, m long").selectExpr("*", "x as v")
    out = B.rank_grid(df, ["g"], ["x"], 64).toPandas()
    assert out["x"].notna().all() and len(out) == len(cells)
    for g, part in out.groupby(out["g"].fillna("")):
        by = part.sort_values("v")
        assert by["x"].is_monotonic_increasing and by["x"].min() == 0 and by["x"].max() == by["x"].nunique() - 1 < 256
        for _, one in by.groupby("x"):
            assert len(one) == 1 or (g == "skewed" and one["m"].sum() <= part["m"].sum() / 64)


def test_poisson_mean_ci_close_to_normal_theory(spark):
    import math
    from docreason.operators.bootstrap import mean_ci_poisson
    cl = clean(spark, "/root/testdata/sf0.01")
    got = {(r.domain, r.arm): r for r in mean_ci_poisson(cl, ["domain", "arm"], "trace_sim", 1000, 42).collect()}
    ref = cl.groupBy("domain", "arm").agg(F.avg("trace_sim").alias("m"), F.stddev_samp("trace_sim").alias("s"),
                                          F.count(F.lit(1)).alias("n")).collect()
    for r in ref:
        half = 1.96 * r.s / math.sqrt(r.n)
        g = got[(r.domain, r.arm)]
        assert abs(g.mean - r.m) < 1e-9
        assert abs((g.ci_hi - g.ci_lo) / 2 - half) < 0.15 * half
        assert g.ci_lo < r.m < g.ci_hi


def test_md5_draws():
    import hashlib
    from docreason.functions.draws import md5_draws
    for prefix in (b"", b"42-m-F-baseline-3-", "é".encode() * 20, b"x" * 55, b"x" * 200):
        for a, b in ((0, 1100), (99_990, 100_020), (10 ** 11 - 3, 10 ** 11 + 3), (5, 5)):
            assert md5_draws(prefix, a, b).tolist() == [int(hashlib.md5(prefix + b"%d" % j).hexdigest()[:15], 16) for j in range(a, b)]


def test_hash_replicates_match_direct_draws(spark):
    import hashlib
    from docreason.operators import bootstrap as B
    groups = {"tied": [0.1] * 500 + [0.2] * 3 + [0.7] * 400, "spread": [i * i / 7 for i in range(800)], None: [0.25, 0.5], "one": [3.0]}
    df = spark.createDataFrame([(g, x) for g, v in groups.items() for x in [*v, None]], "g string, x double")
    want = {}
    for g, v in groups.items():
        for r in range(3):
            names = [str(x) for x in (42, g, r) if x is not None]
            at = [int(hashlib.md5("-".join([*names, str(j)]).encode()).hexdigest()[:15], 16) % len(v) for j in range(len(v))]
            want[g, r] = sum(v[k] for k in at) / len(v)
    for chunk, few in ((64, 512), (10_000, 512), (64, 0), (300, 3)):
        got = {(x.g, x.r): x.rep_mean for x in B.replicate_means_hash(df, ["g"], "x", 3, 42, chunk=chunk, few=few).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_hash_draws_are_never_broadcast(spark, monkeypatch):
    """Spark takes the draws for as small as the rows they are generated from."""
    import re
    from docreason.operators import bootstrap as B
    plans, write = [], B.materialize

    def run(df):
        assert len(df.collect()) == 20
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    monkeypatch.setattr(B, "materialize", lambda df, name: run(df) if name == "replicate-means" else write(df, name))
    df = spark.createDataFrame([("a", i % 1000 / 8) for i in range(20_000)], "g string, x double")
    got = B.replicate_means_hash(df, ["g"], "x", 20, 42)
    if not plans:
        run(got)
    built = [x for p in plans for x in re.findall(r"BroadcastHashJoin .*", p) if "bucket" in x]
    assert built and all("LeftOuter, BuildRight" in x for x in built)
