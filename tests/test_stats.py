"""Ranks, Cliff's delta, tails, coercion, bins, JSON lists."""

import math
import random

import pytest
from pyspark.sql import functions as F

from docreason.functions import jsonfn as J
from docreason.functions.scores import coerce_float, linspace, with_bin
from docreason.functions.stats import norm_sf, t_sf
from docreason.operators.ranks import average_ranks, cliffs_delta


def brute_avg_ranks(xs):
    s = sorted(xs)
    out = {}
    for v in set(xs):
        first = s.index(v)
        cnt = s.count(v)
        out[v] = first + (cnt + 1) / 2
    return out


def test_average_ranks_match_brute_force(spark):
    rng = random.Random(3)
    xs = [rng.choice(range(40)) / 4 for _ in range(500)]
    df = spark.createDataFrame([(1, x) for x in xs], "g int, x double")
    counts = df.groupBy("g", "x").agg(F.count(F.lit(1)).alias("cnt"))
    got = {r.x: r.avg_rank for r in average_ranks(counts, ["g"], "x", scale=3.0, radix=1).collect()}
    assert got == pytest.approx(brute_avg_ranks(xs))


def test_cliffs_delta_exact(spark):
    rng = random.Random(5)
    a = [rng.randint(0, 9) / 10 for _ in range(120)]
    b = [rng.randint(0, 9) / 10 for _ in range(90)]
    brute = sum((x > y) - (x < y) for x in a for y in b) / (len(a) * len(b))
    rows = [(1, v, "a") for v in a] + [(1, v, "b") for v in b]
    df = spark.createDataFrame(rows, "g int, v double, side string")
    counts = df.groupBy("g", "v").agg(F.count_if(F.col("side") == "a").alias("na"),
                                      F.count_if(F.col("side") == "b").alias("nb"))
    got = cliffs_delta(counts, ["g"], "v").first()
    assert got.cliffs_delta == pytest.approx(brute)
    assert (got.n_a, got.n_b) == (120, 90)


def test_tails():
    assert t_sf(2.0, 10) == pytest.approx(0.036694, abs=1e-6)
    assert t_sf(-1.0, 5) == pytest.approx(1 - 0.181609, abs=1e-6)
    assert t_sf(0.0, 7) == pytest.approx(0.5)
    assert norm_sf(1.959964) == pytest.approx(0.025, abs=1e-6)
    assert math.isnan(t_sf(float("nan"), 3))


def test_coerce_float_like_python(spark):
    cases = [" 0.25 ", "1_0", "0.5d", "nan", "inf", "-1", "1e-1", "n/a", None, ".5", "5.", "\t2\n"]
    df = spark.createDataFrame([(c,) for c in cases], "s string")
    got = [r[0] for r in df.select(coerce_float("s")).collect()]

    def py(c):
        try:
            v = float(str(c).strip()) if c is not None else float("nan")
        except ValueError:
            return None
        return None if math.isnan(v) else v
    assert got == [py(c) for c in cases]


def test_calibration_edges_keep_float_quirks(spark):
    edges = linspace(0.0, 1.0, 11)
    vals = [0.0, 0.3, 0.6, 0.7, 0.99, 1.0, -0.1]
    df = spark.createDataFrame([(v,) for v in vals], "p double")
    got = [r.bin for r in with_bin(df, "bin", "p", edges).collect()]
    # 0.3, 0.6 and 0.7 sit one bin lower than floor(10p): NumPy edges are a hair above them.
    assert got == [0, 2, 5, 6, 9, 10, -1]
    hist = with_bin(df, "bin", "p", linspace(-1.0, 1.0, 31), close_last=True)
    assert [r.bin for r in hist.collect()][5] == 29


def test_json_list_rules(spark):
    cases = {"[1] and [2]": False, '{"a":1}': False, 'x [ {"a":1} ] y': True, "[1],[2]": False,
             "sorry": False, "[]": True}
    df = spark.createDataFrame([(k,) for k in cases], "c string")
    got = {r.c: r.ok for r in df.select("c", J.is_json_list(J.list_text("c")).alias("ok")).collect()}
    assert got == cases


def test_truthiness(spark):
    vals = ['{"a":0}', '{"a":"0.0"}', '{"a":""}', '{"a":null}', '{}', '{"a":[]}', '{"a":{"b":1}}', '{"a":false}']
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    got = [r.t for r in df.select(J.truthy(J.field(F.try_parse_json("v"), "a")).alias("t")).collect()]
    assert got == [False, True, False, False, False, False, True, False]


def test_two_level_ranks_equal_plain_window(spark):
    from docreason.operators.ranks import running_below
    rng = random.Random(11)
    rows = [(g, rng.randint(-100, 300) / 7.0) for g in range(3) for _ in range(2000)] + [(1, x) for x in (
        None, 0.0, 5e-324, -5e-324, 1e-310, 1e300, -1e300, float("inf"), float("-inf"), 1.0, 1.0 + 2 ** -52, 2.0, 2.0 - 2 ** -52)]
    df = spark.createDataFrame(rows, "g int, x double")
    counts = df.groupBy("g", "x").agg(F.count(F.lit(1)).alias("cnt"))
    plain = {(r.g, r.x): r.below for r in running_below(counts, ["g"], "x", "cnt").collect()}
    for limits in ((0.001, 0), (2.0, 1), (50.0, 3)):  # from one range to many at all three levels
        split = {(r.g, r.x): r.below for r in running_below(counts, ["g"], "x", "cnt", *limits).collect()}
        assert plain == split
    own = [x for g, x in rows if g == 1]
    assert all(below == (0 if x is None else sum(v is None or v < x for v in own)) for (g, x), below in plain.items() if g == 1)


def test_ranks_with_null_keys(spark):
    from docreason.operators.ranks import running_below
    df = spark.createDataFrame([(None, float(x), 1) for x in range(5)] + [("a", 2.0, 3)], "g string, x double, cnt long")
    for limits in ((0.5, 1), (1e9, 20)):
        got = sorted(((r.g, r.x), r.below) for r in running_below(df, ["g"], "x", "cnt", *limits).where("g is null").collect())
        assert got == [((None, float(x)), x) for x in range(5)]


def test_signed_ranks_and_cliffs_delta_of_huge_counts(spark):
    """Three million ties, and four billion rows a side, are counts here."""
    from docreason.operators.paired import wilcoxon
    counts = spark.createDataFrame([(1, 0.5, 4_000_000_000, 0), (1, 0.25, 0, 4_000_000_000)], "g int, v double, na long, nb long")
    assert cliffs_delta(counts, ["g"], "v").first().cliffs_delta == 1.0
    rows = spark.range(3_000_000).select(F.lit("m").alias("metric"), F.lit("a").alias("arm_a"), F.lit("b").alias("arm_b"),
                                         F.lit(1).alias("g"), F.lit(0.5).alias("d"))
    got = wilcoxon(rows, ["g"]).first()
    assert got.n_nonzero == 3_000_000 and got.w_stat == 3_000_000 * 3_000_001 / 2 and got.z is not None


def test_exact_quantile_matches_numpy_linear(spark):
    import numpy as np
    from docreason.operators.ranks import exact_quantile
    rng = random.Random(2)
    rows = [(g, float(rng.randint(0, 50))) for g in range(4) for _ in range(rng.randint(1, 300))]
    df = spark.createDataFrame(rows, "g int, x double")
    for q in (0.025, 0.5, 0.975):
        got = {r.g: r.quantile for r in exact_quantile(df, ["g"], "x", q).collect()}
        for g in range(4):
            xs = [x for gg, x in rows if gg == g]
            assert got[g] == pytest.approx(float(np.percentile(xs, q * 100)))


def test_zip_index_dense_and_ordered(spark):
    from docreason.operators.ids import zip_index
    rng = random.Random(9)
    keys = rng.sample(range(10_000), 3000)
    df = spark.createDataFrame([(k,) for k in keys], "k long").repartition(13)
    got = sorted((r["index"], r["k"]) for r in zip_index(df, ["k"], n_parts=7).collect())
    assert [i for i, _ in got] == list(range(3000))
    assert [k for _, k in got] == sorted(keys)


@pytest.mark.parametrize("parts", [8, 64])
@pytest.mark.parametrize("reuse", ["true", "false"])
@pytest.mark.parametrize("more", [False, True])
def test_zip_index_of_many_shuffled_rows(spark, parts, reuse, more):
    """Ids stay dense whether or not Spark runs the range shuffle twice."""
    from docreason.operators.ids import zip_index
    spark.conf.set("spark.sql.exchange.reuse", reuse)
    try:
        df = spark.range(600_000).select(F.xxhash64("id").alias("k"), *([F.col("id").alias("v")] if more else [])).repartition(13)
        got = zip_index(df, ["k"], n_parts=parts).agg(F.min("index").alias("a"), F.max("index").alias("b"), F.count_distinct("index").alias("n")).first()
        assert tuple(got) == (0, 599_999, 600_000)
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")


def test_t_tail_against_numeric_integration():
    import numpy as np
    for df in (1, 2, 3, 5, 9, 20, 57, 300):
        c = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
        for t in (-2.5, -0.3, 0.0, 0.7, 1.96, 4.0):
            # P(T > t) = 1/2 - integral_0^t density, by Simpson's rule.
            xs = np.linspace(0.0, t, 20001)
            ys = c * (1 + xs * xs / df) ** (-(df + 1) / 2)
            h = (xs[1] - xs[0]) if t != 0 else 0.0
            integral = h / 3 * (ys[0] + ys[-1] + 4 * ys[1:-1:2].sum() + 2 * ys[2:-1:2].sum())
            assert t_sf(t, df) == pytest.approx(0.5 - integral, abs=1e-8)


def test_join_on_null_keys(spark):
    from docreason.operators.joins import join_on
    big = spark.createDataFrame([(None if i % 5 == 0 else i % 5, i) for i in range(100)], "g int, v long")
    small = spark.createDataFrame([(g, w) for g, w in [(None, 9), (1, 10), (2, 20)]], "g int, w int")
    assert join_on(big, small, ["g"]).columns == ["g", "v", "w"]
    assert join_on(big, small, ["g"]).count() == 60
    assert join_on(big, small, ["g"], "left").where("w is null").count() == 40


def test_ranks_scan_their_rows_once(spark):
    """A rank statistic's plan reads written cells and counts, not the rows again."""
    from docreason.operators.ranks import cliffs_delta, exact_quantile, spearman
    rows = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            rows.add(b.num_rows)
            yield b

    def read(schema, data):
        df = spark.createDataFrame(data, schema)
        return df.mapInArrow(seen, df.schema)

    pairs = read("g string, x double, y double", [("a", float(i % 7), float(i % 5)) for i in range(35)] + [(None, 1.0, 2.0), (None, 2.0, 3.0)])
    got = {r.g: (r.n, r.spearman) for r in spearman(pairs, ["g"], "x", "y").collect()}
    assert rows.value == 37 and got[None][0] == 2 and abs(got[None][1] - 1) < 1e-9 and abs(got["a"][1]) < 1e-9
    assert exact_quantile(pairs.where("g = 'a'"), ["g"], "x", 0.5).first().quantile == 3.0 and rows.value == 2 * 37
    counts = read("g string, v double, na long, nb long", [("a", 1.0, 0, 2), ("a", 2.0, 3, 0)])
    assert cliffs_delta(counts, ["g"], "v").first().cliffs_delta == 1.0 and rows.value == 2 * 37 + 2
