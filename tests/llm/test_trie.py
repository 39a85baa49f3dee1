"""Conversation prefix trie against a direct count over every prefix."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from docreason.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows, group=5, heads=9):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    full = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % heads
        full[c] = own.get(c - c % group, [])[:h] + turns[h:]
    members = {}
    for c, turns in full.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = {}
    for p, m in members.items():
        below = [q for q in members if q[:len(p)] == p]
        out[min(m), len(p)] = (
            min(members[p[:-1]]) if p else None, len(m), sum(len(q) == len(p) + 1 for q in below),
            sum(not any(len(r) == len(q) + 1 and r[:len(q)] == q for r in below) for q in below),
            sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in below if q),
            hashlib.sha256(",".join(str(c) for c in sorted(m) if len(full[c]) == len(p)).encode()).hexdigest())
    return out


def run(spark, rows, **limits):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("depth", F.lit("x")).withColumn("k1", F.lit(1)).repartition(3)
    turns = trie.ordered_turns(df)
    return collected(trie.prefix_trie(*trie.rebuilt(turns), **limits))


def collected(df):
    got = [tuple(r) for r in df.collect()]
    out = {(r[0], r[1]): tuple(r[2:]) for r in got}
    assert len(out) == len(got)
    return out


def made(n, seed, texts=("a", "bé", "", None, "long text"), longest=12):
    r = random.Random(seed)
    rows = [(c, r.choice([None, t, t, t]), r.choice(["user", "assistant", None]), r.choice(texts))
            for c in r.sample(range(-5, 3 * n), n) for t in range(r.randint(1, longest))]
    return rows + rows[:3] + [(None, 0, "user", "x")]


@pytest.mark.parametrize("limits", [{}, {"limit": 2, "factor": 2, "top": 3, "queue": 4}])
def test_same_as_counting_every_prefix(spark, limits):
    rows = made(40, 1) + [(c, t, "user", "same") for c in range(200, 230) for t in range(10)]
    assert run(spark, rows, **limits) == brute(rows)


def test_turnless_and_absent_base(spark):
    # 7 has h = 8 turns to take from 5, which is absent, and fewer of its own.
    c = next(i for i in range(1, 200) if i % 5 and zlib.crc32(str(i).encode()) % 9 >= 3)
    rows = [(c, 0, "user", "only"), (c + 1000, 0, None, None)]
    got = run(spark, rows)
    assert got == brute(rows) and got[c, 0][5] != trie.EMPTY


def test_empty(spark):
    assert run(spark, []) == {} and run(spark, [(None, 1, "user", "x")]) == {}


def test_long_conversations_are_summed_by_chunks(spark):
    rows = [(c, t, "user", str(t % 7)) for c in (10, 20, 30) for t in range(50)] + [(20, 60, "user", "more")]
    turns, convs = trie.rebuilt(trie.ordered_turns(spark.createDataFrame(rows, SCHEMA)))
    whole = {tuple(r) for r in trie.prefixes(turns).collect()}
    assert whole == {tuple(r) for r in trie.prefixes(turns, chunk=4).collect()}
    assert len({(r[4], r[5]) for r in whole}) == 51


def test_queue_spills_in_order():
    r = random.Random(3)
    q = trie.SpillingQueue(5)
    records = [tuple(r.randint(-9, 9) for _ in range(6)) for _ in range(200)]
    for x in records:
        q.push(x)
    assert q.runs and [q.pop() for _ in records] == sorted(records) and q.least() is None


def test_many_ends_are_hashed_as_a_stream(spark, monkeypatch):
    ids = list(range(0, 20000, 3))
    df = spark.createDataFrame([(1, 2, 3, c) for c in ids] + [(1, 2, 4, 7), (1, 2, 4, 10)], "depth long, k1 long, k2 long, conv_id long")
    got = {r["k2"]: r["ends"] for r in trie.end_digests(df).collect()}
    assert got == {3: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), 4: hashlib.sha256(b"7,10").hexdigest()}
