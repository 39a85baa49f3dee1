import re

import numpy as np
import pytest

from docreason.llm import decontam

PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return PATTERN.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items, window):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        v = words(t)
        for i in range(max(1, len(v) - window + 1) if v else 0):
            p = v[i:i + window]
            for j in range(len(w) - len(p) + 1):
                if w[j:j + len(p)] == p:
                    hit |= set(range(j, j + len(p)))
                    found |= {item} - {None}
    return len(w), sorted(hit), sorted(map(str, found))


def test_suffix_array_and_index_against_brute_force():
    rng = np.random.default_rng(3)
    for n in (1, 2, 30, 400):
        text = rng.integers(0, 4, n)
        text = np.concatenate([[0], text, [0]])
        seps = iter(range(len(text)))
        order = [(0, next(seps)) if c == 0 else (1, c) for c in text.tolist()]
        want = sorted(range(len(text)), key=lambda i: order[i:])
        assert decontam.suffix_array(text).tolist() == want
        index = decontam.FmIndex(text, 3)
        phrases = rng.integers(1, 4, (20, 3))
        which, lo, hi = index.search(phrases)
        got = {}
        for k, a, b in zip(which, lo, hi):
            got.setdefault(tuple(phrases[k]), set()).update(index.locate(np.arange(a, b)).tolist())
        for p in map(tuple, phrases.tolist()):
            assert got.get(p, set()) == {i for i in range(len(text) - 2) if tuple(text[i:i + 3]) == p}


@pytest.mark.parametrize("window,block,shard", [(4, 100_000, 1 << 19), (4, 3, 1 << 19), (4, 100_000, 5), (10, 5, 1)])
def test_hits_match_brute_force(spark, monkeypatch, window, block, shard):
    monkeypatch.setattr(decontam, "SHARD_SYMBOLS", shard)
    rng = np.random.default_rng(window + block)
    vocab = "A b c d É f's x_y 9".split()
    say = lambda n: " ".join(rng.choice(vocab, n))
    items = [(i, say(rng.integers(3, 14))) for i in range(12)] + [(50, "Lone"), (51, None), (52, " .. "), (None, "no id")]
    items.append((60, items[0][1]))
    docs = [(i, say(rng.integers(0, 60))) for i in range(40)] + [(90, None), (91, ""), (92, "x lone, x"), (93, "No-Id")]
    docs += [(94, "zz " * 500 + items[3][1] + " zz" * 5 + " " + items[3][1]), (94, items[2][1]), (94, items[2][1]), (None, items[1][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame([(a, b, 1, "x") for a, b in docs], "doc_id long, text string, starts int, items string")
    got = decontam.contamination(df, bench, window, block).collect()
    norm = lambda rows: sorted(rows, key=repr)
    want = [(i, *brute(t, items, window)) for i, t in docs]
    assert norm(want) == norm([(r["doc_id"], r["n_words"], [w for a, b in zip(r["starts"], r["ends"]) for w in range(a, b)],
                                list(r["items"])) for r in got])
    assert all(b < a for r in got for a, b in zip(r["starts"][1:], r["ends"]))  # merged


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r) for r in decontam.contamination(docs, none).collect()] == [(1, 2, [], [], [])]
    assert decontam.contamination(docs.limit(0), none).count() == 0


def test_rows_without_their_hits(spark):
    bench = spark.createDataFrame([(1, "a b c"), (2, "x y")], "item_id long, text string")
    df = spark.createDataFrame([(1, "k A, b c! d", 11, "s"), (None, None, None, None), (2, "clean", 5, "x y"), (3, "x y a b c", 9, None)],
                               "doc_id long, text string, n_chars long, n_words string")
    want = [(1, "k ! d", 5, "s"), (None, None, None, None), (2, "clean", 5, "x y"), (3, "", 0, None)]
    for block in (100, 1):  # one pass, and a pass for each phrase
        out = decontam.decontaminated(df, bench, 3, block)
        assert out.schema == df.schema
        assert sorted((tuple(r) for r in out.collect()), key=repr) == sorted(want, key=repr)


def test_cut_words():
    assert decontam.cut_words("É one, TWO three. four", [1, 4], [3, 5]) == "É  three. "
