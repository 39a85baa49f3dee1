"""The registered queries over a whole small table against brute force: the
columns of their contracts. (op2, op4, op7, op9 and op11 have SQL and are compared
with it by tests/test_oracle.py.)"""

import hashlib
import zlib

import pytest

import __spark_entry__ as E
from docreason.llm import queries
from tests.llm import test_decontam, test_packing, test_pii, test_simhash, test_suffixes

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def rows(spark, name):
    out = E.queries()[name](spark, SF).collect()
    assert len({r["doc_id"] for r in out}) == len(out) or "piece" in out[0].asDict()
    return {r["doc_id"]: r for r in out}


def test_all_are_registered():
    assert [n.split("_")[0] for n in queries.QUERIES] and {n.split("_")[0] for n in queries.QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert set(queries.QUERIES) | {"pipeline"} <= set(E.queries())
    assert set(queries.ORACLE) == {n for n in queries.QUERIES if n.split("_")[0] in ("op2", "op4", "op7", "op9", "op11")}


def test_op1(spark, docs):
    got = rows(spark, "op1_suffix_dedup")
    ids = sorted(docs)
    texts = [docs[i] for i in ids]
    for i, want, short in zip(ids, test_suffixes.brute(texts, 400), test_suffixes.brute(texts, 240)):
        r = got[i]
        assert r["n_repeated"] == short[1] >= r["n_removed"]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want
    assert any(r["n_removed"] for r in got.values()) and len(got) == len(docs)


def test_op3(spark, docs):
    got = rows(spark, "op3_pii")
    kinds = ["email", "ip", "card", "phone"]
    for i, text in docs.items():
        base = test_pii.brute(text or "")
        r = got[i]
        assert [r[f"n_{k}"] for k in kinds] == [sum(b[0] == n for b in base) for n in range(4)]
        listed = [f"{kinds[k]}:{s}:{e}" for k, s, e in base]
        assert r["base_sha256"] == hashlib.sha256(",".join(listed).encode()).hexdigest()
        spans = r["spans"].split(",") if r["spans"] else []
        assert set(listed) <= set(spans)
        every = [*kinds, "secret", "account", "identity"]  # the field's own kinds follow those of the contract
        order = [(every.index(k), int(s), int(e)) for k, s, e in (x.split(":") for x in spans)]
        assert order == sorted(order)


def test_op5(spark, docs):
    out = E.queries()["op5_best_fit_packing"](spark, SF).collect()
    test_packing.check(out, 2048, list(docs.items()))


def test_op6(spark, docs):
    got = rows(spark, "op6_simhash")
    prints = {i: test_simhash.brute_print(t) for i, t in docs.items()}
    want = test_simhash.brute_components(prints, 4)
    least = {}
    for i, c in want.items():
        least[c] = min(least.get(c, i), i)
    assert {i: (r["fingerprint"], r["component_id"]) for i, r in got.items()} == {
        i: (f"{prints[i]:016x}", least[want[i]]) for i in docs}


def test_op8(spark, docs):
    got = rows(spark, "op8_decontamination")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    windows = {}
    for r in bench:
        w = test_decontam.words(r["text"])
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k:k + 10]), set()).add(str(r["item_id"]))
    sizes = {len(w) for w in windows}
    for i, text in docs.items():
        w, hit, items = test_decontam.words(text), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (found := windows.get(tuple(w[k:k + n]))):
                    hit |= set(range(k, k + n))
                    items |= found
        r = got[i]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (len(w), len(hit), len(items), bool(hit))
        assert r["items_sha256"] == hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
    assert any(r["contaminated"] for r in got.values())


def test_op10(spark, docs):
    got = rows(spark, "op10_language_id")
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    assert {i: r["held_out"] for i, r in got.items()} == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in docs}
    held = [i for i, r in got.items() if r["held_out"]]
    assert sum(got[i]["lang_pred"] == langs[i] for i in held) / len(held) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values())
