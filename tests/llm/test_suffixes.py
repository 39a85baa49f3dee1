import hashlib
import random

import numpy as np
import pytest

from docreason.llm import suffixes


def brute(texts, length):
    count = {}
    raw = [(t or "").encode() for t in texts]
    for t in raw:
        for i in range(len(t) - length + 1):
            count[t[i:i + length]] = count.get(t[i:i + length], 0) + 1
    out = []
    for t in raw:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if count[t[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(t, gone) if not g)
        spans = sum(1 for i in range(len(t)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("text", [b"a", b"banana", b"mississippi", b"aaaaaaa", b"abababab\xff\x00\x00", b"\x00\x00\x01"])
def test_two_stage_small(text):
    assert suffixes.two_stage(text, len(text)).tolist() == sorted(range(len(text)), key=lambda i: text[i:])


def test_two_stage_random():
    rng = random.Random(1)
    for k in (2, 3, 256):
        for n in (50, 700):
            text = bytes(rng.randrange(k) for _ in range(n))
            assert suffixes.two_stage(text, n).tolist() == sorted(range(n), key=lambda i: text[i:])
            got = suffixes.two_stage(text, 3)
            assert [text[i:i + 3] for i in got] == sorted(text[i:i + 3] for i in range(n))


def test_two_stage_of_wanted_suffixes():
    rng = random.Random(6)
    for k in (2, 5):
        for _ in range(20):
            n = rng.randrange(1, 200)
            text = bytes(rng.randrange(k) for _ in range(n))
            wanted = np.array([rng.random() < 0.9 for _ in range(n)]) & np.array([i // 23 % 2 == 0 for i in range(n)])
            got = [i for i in suffixes.two_stage(text, n, wanted).tolist() if wanted[i]]
            assert got == sorted(np.flatnonzero(wanted).tolist(), key=lambda i: text[i:])


@pytest.mark.parametrize("m", [1, 2, 3, 7, 32, 37])
def test_gram_hashes_depend_on_the_gram_alone(m):
    rng = np.random.default_rng(m)
    data = rng.integers(0, 2, 300).astype(np.uint8)
    h = suffixes.gram_hashes(data, m)
    assert len(h) == 300 - m + 1
    by = {}
    for i, x in enumerate(h.tolist()):
        assert by.setdefault(data[i:i + m].tobytes(), x) == x
    assert len(set(by.values())) == len(by)


def test_runs_cover_each_window_once(monkeypatch):
    rng = np.random.default_rng(2)
    data = rng.integers(97, 100, 900).astype(np.uint8)
    offsets = np.array([0, 3, 3, 400, 410, 450, 900])
    for block in (1 << 18, 64):
        monkeypatch.setattr(suffixes, "BLOCK", block)
        seen = []
        for text, start, n, _ in suffixes.runs(data, offsets, 10, 4):
            for t, s, k in zip(text.tolist(), start.tolist(), n.tolist()):
                seen += [(t, s + i) for i in range(k)]
        assert sorted(seen) == [(t, i) for t in range(6) for i in range(offsets[t + 1] - offsets[t] - 9)]


def corpus(rng):
    say = lambda n: "".join(rng.choice("abcdeé ") for _ in range(n))
    passage, long = say(70), say(150)
    texts = [say(rng.randrange(0, 120)) for _ in range(12)]
    texts += [say(20) + passage + say(30) for _ in range(25)]                # one passage, other words around
    texts += [long] * 6 + [long[:90] + "X" + long[90:], "x" + long[5:], long[40:] + say(9)]
    texts += ["ab" * 120, "a" * 200, "a" * 39, "a" * 40, None, "", say(30) + passage[:41] + say(3) + passage[20:]]
    return texts


@pytest.mark.parametrize(("hot", "length", "short", "large"), [(2000, 40, 27, True), (3, 40, 27, False), (2000, 20, 20, False), (3, 20, 12, True)])
def test_matches_brute_force(spark, monkeypatch, hot, length, short, large):
    """Also with 64-bit Arrow offsets."""
    spark.conf.set("spark.sql.execution.arrow.useLargeVarTypes", str(large).lower())
    monkeypatch.setattr(suffixes, "HOT", hot)
    monkeypatch.setattr(suffixes, "GRAM", 8)
    texts = corpus(random.Random(length))
    ids = [*range(len(texts) - 2), 3, None]
    df = spark.createDataFrame([(i, t, "c", 1) for i, t in zip(ids, texts)], "doc_id long, text string, h string, many int")
    try:
        got = [tuple(r) for r in suffixes.remove_repeats(df, length, short=short).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.useLargeVarTypes")
    want = [(i, *x, y[1]) for i, x, y in zip(ids, brute(texts, length), brute(texts, short))]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_crowded_passage_falls_into_few_runs(spark, monkeypatch):
    """One passage in 60 texts with other words around it: dealt again by longer
    grams, equal to brute force, and no step makes a row for each window."""
    monkeypatch.setattr(suffixes, "HOT", 5)
    rng = random.Random(12)
    say = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = say(90)
    texts = [say(60) + passage + say(60) for _ in range(60)] + [say(10) + passage[:50] + say(90)]
    made = {}

    def kept(df, name):
        df = store(df, name)
        made.setdefault(name, []).append(df.count())
        return df

    store = suffixes.store
    monkeypatch.setattr(suffixes, "store", kept)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [tuple(r) for r in suffixes.remove_repeats(df, 80, short=60).collect()]
    want = [(i, *x, y[1]) for i, (x, y) in enumerate(zip(brute(texts, 80), brute(texts, 60)))]
    assert sorted(got) == sorted(want)
    dealt_again = made["suffix-runs"][1:]
    assert dealt_again and max(dealt_again) <= 12 * sum(made["suffix-hot"][:1])


def test_repeated_rows_and_empty_table(spark):
    text = "".join(map(str, range(300)))
    df = spark.createDataFrame([(1, text), (1, text), (2, "short")], "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffixes.remove_repeats(df, with_bytes=True).collect())
    assert got == [(1, len(text), 1, b"")] * 2 + [(2, 0, 0, b"short")]
    assert suffixes.remove_repeats(df.limit(0)).count() == 0
