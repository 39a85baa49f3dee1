"""Toxicity: the decoder against exhaustive paths, the learned words and the
contract of op12."""

import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from docreason.llm import toxicity as T

SF = "/root/testdata/sf0.01"
WORDS = "idiot moron stupid trash worthless scum clown loser pathetic the and of that thing reason other letter see all".split()


def counts(words):
    out = np.zeros((T.N, T.N, T.N), np.int64)
    for w in words:
        s = [0, 0, *(ord(c) - 96 for c in w), 0]
        for a, b, c in zip(s, s[1:], s[2:]):
            out[a, b, c] += 1
    return out


@pytest.fixture(scope="module")
def model():
    return T.CharacterModel.fit(counts(WORDS * 20))


def test_model_is_a_distribution(model):
    p = np.exp(np.array(model.logp).reshape(T.N, T.N, T.N))
    sums = p.sum(-1)
    sums[0, 0] = sums[0, 0] - p[0, 0, 0] + 1 - p[0, 0, 1:].sum()
    assert np.allclose(sums, 1)


@pytest.mark.parametrize("token", ["1d10t", "m0r0n", "tr@sh", "iidiot", "t.r.a.s.h", "a1", "$ee", "the-and", "w0rthle55", "le+ter"])
def test_viterbi_is_the_best_of_all_paths(model, token):
    segments = T.lattice(token)
    best = None
    for ways in itertools.product(*segments, [((0,), 0.0)]):
        score, to, path = 0.0, 0, []
        for emitted, cost in ways:
            score += cost
            for c in emitted:
                score += model.logp[to * T.N + c]
                to = to % T.N * T.N + c if c else 0
                path.append(c)
        if best is None or score > best[0]:
            best = score, "".join(chr(96 + c) if c else " " for c in path).split()
    assert T.decode(model, segments) == best[1]


def test_disguises(model):
    restorer = T.Restorer(model)
    text = "1d10t M0r0n, stup1d! t.r.a.s.h and w0rthle55 sccuumm cl0wwwn l_o_s_e_r p a t h e t i c ïdïöt the letter"
    got = restorer.texts([text])[0][0]
    assert {"idiot", "moron", "stupid", "trash", "worthless", "scum", "clown", "loser", "pathetic", "the", "letter"} <= got
    assert restorer.texts(["see all that thing", "", "2024 12,5 --- %%%", "日本語 идиот"]) == ([{"see", "all", "that", "thing"}, set(), set(), set()], [4, 0, 4, 2])


def test_long_tokens_are_decoded_whole(model, monkeypatch):
    monkeypatch.setattr(T, "PART", 16)
    assert T.Restorer(model).restore("-".join(["m0r0n"] * 50)) == ["moron"] * 50


def test_character_counts(spark):
    texts = ["Idiot, the ÉTÉ!", None, "", "x9 a-b", "the\nsee"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(2)
    assert (T.character_counts(df).reshape(T.N, T.N, T.N) == counts(["idiot", "the", "ete", "the", "see"])).all()
    assert T.character_counts(df.where("false")).sum() == 0


def made(spark, n=600):
    r = np.random.default_rng(4)
    docs, labels = [], []
    for i in range(n):
        words = list(r.choice(["the", "and", "of", "that", "thing", "reason", "other"], 40))
        toxic = int(i % 4 == 0)
        if toxic:
            for w in r.choice(["idiot", "moron", "trash", "scum"], 3, replace=False):
                words[r.integers(40)] = w
        docs.append((i, " ".join(words)))
        labels.append((i, toxic))
    return (spark.createDataFrame(docs + [(None, "idiot"), (n, None), (n + 1, ""), (n + 2, "1d10t and sccum, m0ron"), (n + 3, "m 0 r 0 n and tr4sh idi0t"), (n + 3, "the")],
                                  "doc_id long, text string").withColumn("score", F.lit("x")).withColumn("label", F.lit(1)),
            spark.createDataFrame(labels + [(0, 1), (None, 1), (2, None)], "doc_id long, toxic int").withColumn("text", F.lit("x")))


def test_learned_words_and_scores(spark):
    docs, labels = made(spark)
    model = T.train(docs, labels)
    assert {"idiot$1", "moron$1", "trash$1", "scum$1", "idi1"} <= set(model.features) and "the$1" not in model.features
    got = [(r["doc_id"], r["score"], r["predicted"]) for r in T.score(docs, model).collect()]
    assert len(got) == docs.count() and all(0 <= s <= 1 and p == (s >= T.THRESHOLD) for _, s, p in got)
    by = {}
    for i, s, p in got:
        by.setdefault(i, []).append(p)
    assert all(by[i] == [int(i % 4 == 0)] for i in range(600))
    assert by[600] == [0] and by[601] == [0] and by[602] == [1] and sorted(by[603]) == [0, 1] and len(by[None]) == 1


def test_without_labels_or_rows(spark):
    docs, labels = made(spark, 60)
    for y in (labels.where("false"), labels.where("toxic = 0")):
        assert {r["predicted"] for r in T.score(docs, T.train(docs, y)).collect()} == {0}
    assert {r["predicted"] for r in T.score(docs, T.train(docs, labels.where("toxic = 1"))).collect()} == {1}
    assert T.score(docs.where("false"), T.train(docs.where("false"), labels)).collect() == []


def test_query(spark):
    got = {r["doc_id"]: r for r in E.queries()["op12_toxicity"](spark, SF).collect()}
    ids = [r["doc_id"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()]
    assert sorted(got) == sorted(ids) and all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = [i for i in labels if got[i]["held_out"]]
    assert sum(got[i]["predicted"] == labels[i] for i in held) / len(held) >= 0.97
