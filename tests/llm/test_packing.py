import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docreason.llm import packing

P = pytest.importorskip("public_tokenizers")
PATH = P.path("word_bpe_49k.json")


def encode(text):
    from tokenizers import Tokenizer
    return Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", [
    "", " ", "Hello, World! it's 42", "a\n\nb\tc\r\nd  e\x1cf\x85g h", "É́ x̱ H̱y ́z ΑΣ ΑΣ.",
    "x<|endoftext|>y <|startoftext|> z", "don't 'll we've 日本語 テスト 👍🏽 ok", "a" * 300, "ẞ İstanbul ﬁ"])
def test_ids_are_those_of_the_whole_text(text):
    pieces = packing.Pieces(PATH)
    want = np.array(encode(text), "<u4").tobytes()
    assert pieces.ids(text) == pieces.ids(text) == want


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("aBé'stmd \n1.,ß<|"), st.characters(max_codepoint=255), st.characters(codec="utf-8")),
               max_size=30))
def test_ids_of_any_text(tokens, text):
    pieces, whole = tokens
    assert pieces.ids(text) == np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@pytest.fixture(scope="module")
def tokens():
    from tokenizers import Tokenizer
    return packing.Pieces(PATH), Tokenizer.from_file(PATH)


def test_ids_of_every_latin_character(tokens):
    pieces, whole = tokens
    for c in map(chr, range(256)):
        for text in (c, "a" + c + "b", "'" + c, c + c + " " + c + "1"):
            assert pieces.ids(text) == np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


def test_ids_with_a_small_cache(monkeypatch):
    monkeypatch.setattr(packing, "CACHE", 3)
    small, texts = packing.Pieces(PATH), ["one two three four", "two 日 本 x 語 y", "one one", "x"]
    for _ in range(2):
        assert [len(small.ids(t)) for t in texts] == [4 * len(encode(t)) for t in texts]


def brute(lengths, size):
    """Best-fit decreasing by looking at every open sequence."""
    room, where = [], {}
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        fit = [r for r in range(len(room)) if room[r] >= lengths[i]]
        if not fit:
            room.append(size)
            fit = [len(room) - 1]
        best = min(room[r] for r in fit)
        where[i] = best
        room[next(r for r in fit if room[r] == best)] -= lengths[i]
    return len(room), sorted(room)


@pytest.mark.parametrize("size", [1, 7, 50, 2048])
def test_best_fit_decreasing(size):
    rng = np.random.default_rng(size)
    for n in (1, 5, 400):
        lengths = rng.integers(1, size + 1, n)
        seq, off = packing.best_fit_decreasing(lengths, size)
        load = np.bincount(seq, lengths).astype(int)
        assert (len(load), sorted((size - load).tolist())) == brute(lengths.tolist(), size)
        for s in set(seq.tolist()):
            own = np.flatnonzero(seq == s)
            own = own[np.argsort(off[own])]
            assert off[own].tolist() == (np.cumsum(lengths[own]) - lengths[own]).tolist()


def check(rows, size, texts):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append(r)
    for own in by.values():
        own.sort(key=lambda r: r["offset"])
        at = 0
        for r in own:
            assert r["offset"] == at
            at += r["length"]
        assert at <= size
    want = []
    for i, t in texts:
        ids = np.array([*encode(t or ""), 0], "<u4")
        want += [(i, k, s, len(ids[s:s + size]), zlib.crc32(ids[s:s + size].tobytes()))
                 for k, s in enumerate(range(0, len(ids), size))]
    got = [(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    return len(by)


@pytest.mark.parametrize("group", [20_000, 9])
def test_documents(spark, group, monkeypatch):
    rng = np.random.default_rng(1)
    texts = [(i, " ".join(rng.choice(["the", "Cat", "sat.", "42"], rng.integers(0, 90)))) for i in range(60)]
    texts += [(70, None), (71, ""), (72, "word " * 700), (72, "word " * 700), (None, "null id"), (2 ** 60 + 1, "big id")]
    df = spark.createDataFrame([(i, t, 3, "x") for i, t in texts], "doc_id long, text string, offset int, length string")
    items = packing.pieces(df, PATH, 64)
    rows = packing.pack(items, 64, group).collect()
    n = check(rows, 64, texts)
    total = sum(r["length"] for r in rows)
    assert n <= 1.12 * total / 64 + 2
    assert packing.pack_documents(df.limit(0), PATH).count() == 0


def test_near_the_lower_bound(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = packing.pack_documents(df, PATH).select("length", "sequence_id").collect()
    total = sum(r["length"] for r in rows)
    assert len({r["sequence_id"] for r in rows}) <= -(-total // 2048) * 1.01 + 1
