import hashlib
import random
import struct
from collections import Counter

import pytest
import zstandard

from docreason.llm import warc


def rows_of(spark, rows):
    return spark.createDataFrame([(i, u, h, 7, "k") for i, u, h in rows],
                                 "page_id long, url string, html string, size int, key string")


def brute(rows, least=1000):
    out, big = [], {}
    for i, _, h in rows:
        p = (h or "").encode()
        if len(p) >= least and i is not None:
            big[p] = max(big.get(p, i), i)
    n = Counter((h or "").encode() for _, _, h in rows)
    for i, _, h in rows:
        p = (h or "").encode()
        ref = big.get(p) if len(p) >= least and n[p] > 1 and big.get(p) != i else None
        out.append((i, len(p), hashlib.sha1(p).hexdigest(), "response" if ref is None else "revisit", ref))
    return out


def test_round_trip(spark, tmp_path):
    rng = random.Random(2)
    page = lambda n: "<p>" + "".join(rng.choice("abc é\r\n\x00<>") for _ in range(n))
    same, edge = page(1500), "x" * 999
    rows = [(i, f"http://h/{i}\r\nq", page(rng.randrange(0, 3000))) for i in range(150)]
    rows += [(200, "u", same), (203, "u", same), (201, None, same), (300, "u", edge), (301, "u", edge), (302, "u", edge + "y"),
             (303, "u", edge + "y"), (400, "", None), (401, "u", ""), (500, "u", "long " * 300_000), (203, "u", same), (None, "n", same),
             (None, "n", "tiny")]
    df = rows_of(spark, rows)
    got = [tuple(r) for r in warc.round_trip(df).collect()]
    assert sorted(got, key=repr) == sorted(brute(rows), key=repr)
    path = str(tmp_path / "a")
    warc.write(df, path, per_archive=100_000)
    back = warc.read(spark, path).collect()
    assert all(r["error"] is None for r in back) and len(back) == len(rows)
    stored = {(r["page_id"], r["payload_digest"]): bytes(r["payload"]) for r in back if r["record_type"] == "response"}
    for i, _, h in rows:
        p = (h or "").encode()
        key = (None if i is None else str(i), hashlib.sha1(p).hexdigest())
        if key in stored:
            assert stored[key] == p
    heads = [f.read_bytes()[:4] for f in (tmp_path / "a").glob("part-*") if f.stat().st_size]
    assert any(h == struct.pack("<I", warc.DICTIONARY) for h in heads)


def test_empty_table(spark):
    assert warc.round_trip(rows_of(spark, [(1, "u", "x")]).limit(0)).count() == 0


def one(payload=b"hello"):
    return warc.record(5, "http://u", payload, len(payload), hashlib.sha1(payload).digest())


def test_frames_with_plain_and_compressed_dictionaries():
    samples = [(f"<html><p class=c{i}>" + "the common text of all pages " * 60 + str(i) * 40).encode() for i in range(200)]
    d = warc.train(samples)
    enc = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d))
    body = b"".join(enc.compress(one(s)) + warc.SEPARATOR for s in samples)
    packed = zstandard.compress(d)
    for head in (warc.dictionary_frame(d), struct.pack("<II", warc.DICTIONARY, len(packed)) + packed):
        got = list(warc.frames(head + body))
        assert [r["payload"] for r in got] == samples
    assert "error" in next(warc.frames(body)) and next(warc.frames(body))["error"]  # the dictionary is missing


@pytest.mark.parametrize("change,what", [
    (lambda r: r.replace(b"WARC/1.1", b"WARC/9"), "version"),
    (lambda r: r.replace(b"WARC-Date", b"WARC-Dote"), "warc-date"),
    (lambda r: r.replace(b"hello", b"hallo"), "digest"),
    (lambda r: r.replace(b"hello", b"hello!"), "Content-Length"),
    (lambda r: r[:-2], "Content-Length"),
    (lambda r: r.replace(b"Content-Length: 5\r\n", b"Content-Length: 6\r\n"), "HTTP|Content-Length"),
    (lambda r: r.replace(b"WARC-Type: response", b"WARC-Type: other"), "record type"),
    (lambda r: r.replace(b"WARC-Type: response", b"WARC-Type: revisit"), "revisit"),
    (lambda r: r.replace(b"sha1:", b"md5:"), "digest"),
    (lambda r: r.replace(b"WARC-Payload-Digest: sha1:", b"WARC-Payload-Digest sha1 "), "malformed"),
    (lambda r: r.replace(b"WARC-Date", b"WARC-Type"), "repeated"),
    (lambda r: b"", "version"),
])
def test_bad_records_are_reported(change, what):
    import re
    c = zstandard.ZstdCompressor()
    got = list(warc.frames(c.compress(one()) + c.compress(change(one())) + c.compress(one())))
    assert [r["error"] is None for r in got] == [True, False, True]
    assert re.search(what, got[1]["error"])


def test_cut_files_are_reported():
    whole = zstandard.compress(one()) + zstandard.compress(one(b"x" * 5000))
    got = list(warc.frames(whole[:-3]))
    assert got[0]["error"] is None and got[-1]["error"]
    assert list(warc.frames(whole + b"abc"))[-1]["error"]
    assert list(warc.frames(b"")) == []
