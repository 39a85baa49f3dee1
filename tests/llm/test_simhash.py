import itertools
import random

import pytest
import xxhash

from docreason.llm import simhash


def brute_print(text, k=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(prints, most):
    parent = dict.fromkeys(prints)
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(parent, 2):
        if bin(prints[a] ^ prints[b]).count("1") <= most:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: find(i) for i in prints}


@pytest.mark.parametrize("text", ["", "  \n", "One", "a b c", "a b c d", "A b\tC d e f f f f f f f", "é É x y z\x1cw v"])
def test_fingerprint(text):
    assert simhash.simhash(text.encode(), 4) == brute_print(text)


@pytest.mark.parametrize("most", [2, 4])
@pytest.mark.parametrize("small", [False, True])
def test_components_match_brute_force(spark, most, small, monkeypatch):
    """Chains, clusters, exact copies; also with limits so small that prefixes
    are dealt again and split inside a task."""
    if small:
        monkeypatch.setattr(simhash, "VARIANTS", 500)
        monkeypatch.setattr(simhash, "HOT_ROWS", 40)
    rng = random.Random(most)
    prints, i = {}, 0
    for _ in range(12):
        base = rng.getrandbits(64)
        for _ in range(rng.choice([1, 3, 12])):
            prints[i] = base
            base ^= sum(1 << b for b in rng.sample(range(64), rng.randint(0, most + 1)))
            i += 1
    want = brute_components(prints, most)
    rows = [(k, v - (1 << 64) if v >> 63 else v) for k, v in prints.items()]
    df = spark.createDataFrame(rows, "id long, fp long")
    distinct = df.groupBy("fp").agg({"id": "min"}).withColumnRenamed("min(id)", "least")
    comp = {r["node"]: r["root"] for r in simhash.components(simhash.ball_links(distinct, most)).collect()}
    got = {}
    for k, v in rows:
        got.setdefault(comp.get(v, v), []).append(k)
    expect = {}
    for k, c in want.items():
        expect.setdefault(c, []).append(k)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, expect.values()))


def test_rows_nulls_copies_and_clashing_columns(spark):
    long = " ".join(f"w{i}" for i in range(3000))
    rows = [(5, "x y z u v", "a"), (3, "X  y z u V", "b"), (3, "X  y z u V", "b"), (9, None, None), (2, "", "q"),
            (None, "alone in here we are", None), (7, long, "c"), (8, long + " tail", None)]
    df = spark.createDataFrame([(i, t, s, 1.0, "f") for i, t, s in rows],
                               "doc_id long, text string, source string, fp double, least string")
    out = simhash.near_duplicates(df).collect()
    prints = {r["doc_id"]: r["fingerprint"] for r in out}
    assert len(out) == len(rows)
    assert prints[9] == prints[2] == "0" * 16
    for i, t, _ in rows:
        assert prints[i] == f"{brute_print(t):016x}"
    by = {r["doc_id"]: r["component_id"] for r in out}
    assert by[5] == by[3] == 3 and by[9] == by[2] == 2 and by[None] is None and by[7] == by[8] == 7
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_odd_distance_is_refused(spark):
    with pytest.raises(ValueError):
        simhash.ball_links(spark.range(1).withColumnRenamed("id", "fp"), 3)
