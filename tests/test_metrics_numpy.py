"""Calibration, ECE and histograms against NumPy on random grid scores."""

import random

import numpy as np
import pytest

from docreason.operators import metrics as M


def _data(seed=1, n=3000):
    rng = random.Random(seed)
    grid = [i / 10 for i in range(11)]
    return [("g", rng.choice(grid), rng.choice(grid), rng.choice(range(1, 51)) / 50) for _ in range(n)]


def test_calibration_and_ece(spark):
    rows = _data()
    df = spark.createDataFrame(rows, "grp string, gold double, pred double, trace_sim double")
    y = np.array([r[1] for r in rows])
    p = np.array([r[2] for r in rows])
    edges = np.linspace(0.0, 1.0, 11)
    idx = np.digitize(p, edges) - 1
    curve = {r.bin: (r.emp_gold, r.n_bin) for r in M.calibration_curve(df, ["grp"], "gold", "pred").collect()}
    total, acc = 0, 0.0
    for b in range(10):
        m = idx == b
        if m.any():
            assert curve[b][1] == int(m.sum())
            assert curve[b][0] == pytest.approx(float(y[m].mean()), abs=1e-9)
            total += int(m.sum())
        else:
            assert curve[b] == (None, 0)
    for b in range(10):
        m = idx == b
        if m.any():
            acc += m.sum() / total * abs(y[m].mean() - (edges[b] + edges[b + 1]) / 2)
    e = M.ece(df, ["grp"]).first()
    assert e.ece == pytest.approx(acc, abs=1e-9) and e.n_binned == total


def test_histograms(spark):
    rows = _data(seed=4)
    df = spark.createDataFrame(rows, "grp string, gold double, pred double, trace_sim double")
    resid = np.array([r[2] - r[1] for r in rows])
    want, _ = np.histogram(resid, bins=np.linspace(-1.0, 1.0, 31))
    got = [r.n for r in M.residual_histogram(df, ["grp"]).orderBy("bin").collect()]
    assert got == want.tolist()
    ts = np.array([r[3] for r in rows])
    want_t, _ = np.histogram(ts, bins=30)
    got_t = [r.n for r in M.trace_histogram(df, ["grp"]).orderBy("bin").collect()]
    assert got_t == want_t.tolist()
