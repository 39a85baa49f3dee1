"""Tokenizer alignment against whole-text encoding and counting by hand."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docreason.llm import alignment

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


def byte_characters():
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def brute(texts):
    tok = Tokenizer.from_file(A)
    tok.encode_special_tokens = True
    names, chars = {i: t for t, i in tok.get_vocab().items()}, byte_characters()
    sp = sentencepiece.SentencePieceProcessor(model_file=B)

    def b_bytes(i):
        return bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()

    docs = []
    for t in texts:
        ia, ib = (tok.encode(" " + t, add_special_tokens=False).ids, sp.encode(t)) if t else ([], [])
        ba, bb = [bytes(chars[c] for c in names[i]) for i in ia], [b_bytes(i) for i in ib]
        if not t or b"".join(ba) != (" " + t).encode() or b"".join(bb) != (" " + t).encode():
            docs.append(([], [], []))
            continue
        ea, eb = np.cumsum([len(x) for x in ba]).tolist(), np.cumsum([len(x) for x in bb]).tolist()
        groups, a, b = [], 0, 0
        for cut in sorted(set(ea) & set(eb)):
            na, nb = sum(e <= cut for e in ea), sum(e <= cut for e in eb)
            groups.append((ia[a:na], ib[b:nb]))
            a, b = na, nb
        docs.append((ia, ib, groups))
    links = [Counter((x, y) for ga, gb in g for x in ga for y in gb) for _, _, g in docs]
    count = Counter(p for x in links for p in x)
    highest = {}
    for (x, _), n in count.items():
        highest[x] = max(highest.get(x, 0), n)
    out = []
    for (ia, ib, g), x in zip(docs, links):
        text = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in g)
        out.append((len(ia), len(ib), len(g), sum(x.values()), sum(n for p, n in x.items() if count[p] == highest[p[0]]),
                    sum(n * count[p] for p, n in x.items()), hashlib.sha256(text.encode()).hexdigest() if g else ""))
    return out


ODD = ["", None, " ", "\n", "a", "  two  spaces ", "line\n\n feed \n", "tab\tand\r\nreturn", "▁mark", "no break　wide",
       "<|endoftext|> <s> </s> <unk>", "it's we'll 12,345.67 éüß 日本語 \U0001f600‍\U0001f525", "nul\x00 \x1f mark\x1fed",
       "ﬁ Å ́", "word " * 300, "x" * 500, "� ﻿bom", "\n start", "end\n"]


@pytest.mark.parametrize("small", [False, True])
def test_same_as_whole_texts(spark, small, monkeypatch):
    r = random.Random(5)
    words = ["the", "alignment", "Tokens", "été", "x1", "don't", "(a)", "--", "日本", "overßall"]
    texts = ODD + ["".join(r.choice(words) + r.choice([" ", " ", " ", "\n", "  ", " \n", "\t", ""]) for _ in range(r.randint(1, 60))) for _ in range(60)]
    texts += texts[5:9]
    rows = list(enumerate(texts))
    if small:  # many blocks, bitmaps, a worker that starts anew
        monkeypatch.setattr(alignment, "SLICE", 400)
        voc = alignment.Vocabularies(A, B)
        for i, t in rows:
            n, digest, _, _ = voc.align([t or ""])
            voc.clear()
            assert (*n[0], digest[0]) == tuple(np.array(brute([t])[0], dtype=object)[[0, 1, 2, 3, 6]])
        return
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("pair", F.lit(1)).withColumn("block", F.lit("x")).repartition(4)
    got = {r["doc_id"]: tuple(r)[1:] for r in alignment.align(df, A, B).collect()}
    assert got == dict(enumerate(brute(texts)))


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.align(df, A, B).collect() == []


def test_planes_round_trip(monkeypatch):
    monkeypatch.setattr(alignment, "DENSE", 50)
    r = np.random.default_rng(1)
    pair = np.sort(r.integers(0, 5, 2000))
    key = np.unique(pair << 16 | r.integers(0, 3000, 2000))
    n = r.integers(1, 70, len(key))
    pairs, lists = alignment.planes(key >> 16, key & 0xFFFF, n)
    back = {}
    for p, x in zip(pairs.tolist(), lists.to_pylist()):
        assert alignment.merged(x) == (key >> 16 == p).sum()
        for j, plane in enumerate(x):
            for d in alignment._places(plane).tolist():
                back[p << 16 | d] = back.get(p << 16 | d, 0) + (1 << j)
    assert back == dict(zip(key.tolist(), n.tolist())) and any(len(q) == 8192 for x in lists.to_pylist() for q in x)


def test_scores_add_over_planes(spark):
    pairs, lists = alignment.planes(np.array([1, 1, 2]), np.array([3, 9, 9]), np.array([2, 5, 1]))
    t = pa.table({"block": [0, 0], "pair": pairs, "planes": lists})
    postings = spark.createDataFrame(t.to_pandas(), "block long, pair long, planes array<binary>")
    counts = spark.createDataFrame([(1, 10, True), (2, 100, False)], "pair long, count long, best boolean")
    assert {tuple(r) for r in alignment.scores(postings, counts).collect()} == {(0, 3, 2, 20), (0, 9, 5, 150)}
