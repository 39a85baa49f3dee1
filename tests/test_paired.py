"""Paired t and signed-rank statistics against a direct computation."""

import math
import random

import pytest

from docreason.operators import paired as P


def test_paired_statistics(spark):
    rng = random.Random(8)
    rows = []
    for q in range(400):
        for arm in P.ARMS:
            for _ in range(rng.choice([1, 1, 2])):
                rows.append(("D", q, arm, rng.randint(0, 10) / 10))
    df = spark.createDataFrame(rows, "domain string, question_id long, arm string, abs_err double")
    diffs = P.paired_differences(df, ["domain"], "question_id", {"abs_err": "a-b"})
    t = {(r.arm_a, r.arm_b): r for r in P.paired_t(diffs, ["domain"]).collect()}
    w = {(r.arm_a, r.arm_b): r for r in P.wilcoxon(diffs, ["domain"]).collect()}
    means = {}
    for _, q, arm, v in rows:
        means.setdefault((q, arm), []).append(v)
    for a, b in zip(P.ARMS, P.ARMS[1:]):
        d = [round(sum(means[(q, a)]) / len(means[(q, a)]), 12) - round(sum(means[(q, b)]) / len(means[(q, b)]), 12)
             for q in range(400)]
        n = len(d)
        mean = sum(d) / n
        sd = math.sqrt(sum((x - mean) ** 2 for x in d) / (n - 1))
        assert t[(a, b)].t_stat == pytest.approx(mean / (sd / math.sqrt(n)), abs=1e-6)
        assert t[(a, b)].n_matched == n
        nz = [x for x in d if x != 0]
        absd = sorted(abs(x) for x in nz)
        rank = {v: absd.index(v) + (absd.count(v) + 1) / 2 for v in set(absd)}
        wplus = sum(rank[abs(x)] for x in nz if x > 0)
        assert w[(a, b)].w_stat == pytest.approx(wplus, abs=1e-6)
        assert w[(a, b)].n_nonzero == len(nz)


def test_rows_without_a_domain_have_their_own_baseline(spark):
    from docreason.operators.paired import effects_vs_baseline
    from docreason.schemas import ARMS
    rows = [(d, a, x + k) for d in (None, "F") for k, a in enumerate(ARMS[:2]) for x in (1.0, 3.0)]
    df = spark.createDataFrame(rows, "domain string, arm string, v double")
    got = {(r.domain, r.arm): (r.n_base, r.n_cond, r.diff_mean, r.cliffs_delta) for r in effects_vs_baseline(df, ["v"]).collect()}
    assert got[None, ARMS[1]] == got["F", ARMS[1]] == (2, 2, 1.0, 0.5) and got[None, ARMS[2]][:2] == (2, 0)


def test_wide_means_refuse_an_unknown_domain(spark):
    import pytest
    from docreason.operators.metrics import means_wide
    from docreason.schemas import ARMS
    df = spark.createDataFrame([("F", ARMS[0], 1.0), (None, ARMS[0], 2.0)], "domain string, arm string, v double")
    with pytest.raises(Exception, match="no column for the domain null"):
        means_wide(df, ["v"], ["F"]).collect()
    assert means_wide(df.where("domain = 'F'"), ["v"], ["F"]).where("arm_ord = 0").first().mean_F == 1.0


def test_signed_rank_tail_equals_enumeration():
    from itertools import product

    from docreason.functions.stats import EXACT_RANKS, signed_rank_sf
    for n in range(1, 13):
        sums = [sum(r for r, plus in enumerate(signs, 1) if plus) for signs in product((0, 1), repeat=n)]
        for w in range(-1, n * (n + 1) // 2 + 2):
            assert signed_rank_sf(w, n) == sum(s >= w for s in sums) / 2 ** n
    assert math.isnan(signed_rank_sf(0, 0)) and math.isnan(signed_rank_sf(3, EXACT_RANKS + 1))
    assert signed_rank_sf(0, EXACT_RANKS) == 1.0
    # At the bound: symmetric about the mean, and near the normal form in the middle.
    for w in (0, 300, 638, 900, 1276):
        assert signed_rank_sf(w, 50) + signed_rank_sf(1275 - w + 1, 50) == pytest.approx(1.0, abs=1e-15)
    mean, sd = 50 * 51 / 4, math.sqrt(50 * 51 * 101 / 24)
    assert signed_rank_sf(700, 50) == pytest.approx(0.5 * math.erfc((699.5 - mean) / sd / math.sqrt(2)), abs=2e-3)


def test_small_untied_samples_have_an_exact_p(spark):
    """Exact without ties and zeros up to the bound, the normal form otherwise."""
    from docreason.functions.stats import EXACT_RANKS, norm_sf, signed_rank_sf
    a, b = P.ARMS[:2]
    cases = {"small": [0.5, -0.1, 0.3, 0.2], "tied": [0.5, -0.1, 0.1, 0.2], "zero": [0.0, -0.1, 0.3, 0.2],
             None: [(-1) ** (i % 3) * i / 128 for i in range(1, EXACT_RANKS + 1)],
             "large": [(-1) ** (i % 3) * i / 128 for i in range(1, EXACT_RANKS + 2)]}
    rows = [(k, i, "e", a, b, d, 0.0, d) for k, ds in cases.items() for i, d in enumerate(ds)]
    diffs = spark.createDataFrame(rows, "domain string, item int, metric string, arm_a string, arm_b string, x_a double, x_b double, d double")
    got = {r.domain: r for r in P.paired_pvalues(P.paired_t(diffs, ["domain"]), P.wilcoxon(diffs, ["domain"]), ["domain"]).collect()}
    assert {k: r.exact for k, r in got.items()} == {"small": True, "tied": False, "zero": False, None: True, "large": False}
    assert got["small"].w_stat == 9 and got["small"].p_w == 2 / 16
    assert got[None].p_w == signed_rank_sf(got[None].w_stat, EXACT_RANKS)
    for k in ("tied", "zero", "large"):
        assert got[k].p_w == pytest.approx(norm_sf(got[k].z))
