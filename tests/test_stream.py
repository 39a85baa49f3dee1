"""A second availableNow run over the same lists adds nothing; a failed
URL is retried with its old id."""

import os
import tempfile

import pytest

from docreason.streaming.ingest import read_state, start_ingest_stream


def test_ingest_twice(spark):
    base = tempfile.mkdtemp(prefix="ingest-")
    lists = os.path.join(base, "lists")
    os.makedirs(lists)
    with open(os.path.join(lists, "a.lst"), "w") as f:
        f.write("http://x/a.pdf\n\n  http://x/b  \nhttp://x/a.pdf\n")
    downloads = spark.createDataFrame(
        [("http://x/a.pdf", bytearray(b"%PDF-1.7 body")), ("http://x/b", bytearray(b"<html>"))],
        "url string, content binary")
    state_dir, ckpt = os.path.join(base, "state"), os.path.join(base, "ckpt")
    q = start_ingest_stream(spark, lists, state_dir, ckpt, downloads)
    q.awaitTermination()
    s1 = {r.url: (r.paper_id, r.status) for r in read_state(spark, state_dir).collect()}
    assert s1 == {"http://x/a.pdf": (0, "processed"), "http://x/b": (1, "validation_failed")}
    q = start_ingest_stream(spark, lists, state_dir, ckpt, downloads)
    q.awaitTermination()
    assert {r.url: (r.paper_id, r.status) for r in read_state(spark, state_dir).collect()} == s1
    # A new list repeats the failed URL: same id, retried; a new URL gets the next id.
    with open(os.path.join(lists, "b.lst"), "w") as f:
        f.write("http://x/b\nhttp://x/c\n")
    q = start_ingest_stream(spark, lists, state_dir, ckpt, None)
    q.awaitTermination()
    s3 = {r.url: (r.paper_id, r.status) for r in read_state(spark, state_dir).collect()}
    assert s3["http://x/b"][0] == 1 and s3["http://x/c"][0] == 2 and s3["http://x/a.pdf"] == (0, "processed")


def _lines(spark, *urls):
    return spark.createDataFrame([(u,) for u in urls], "value string")


def test_state_survives_crashes_and_replays(spark, tmp_path):
    from docreason.streaming.ingest import apply_batch
    state = str(tmp_path / "state")
    rows = lambda: {r.url: r.paper_id for r in read_state(spark, state).collect()}
    assert rows() == {}
    apply_batch(spark, _lines(spark, "\thttp://a ", "http://b", "\t"), 0, state)
    assert rows() == {"http://a": 0, "http://b": 1}
    apply_batch(spark, _lines(spark, "http://c"), 1, state)
    assert rows() == {"http://a": 0, "http://b": 1, "http://c": 2}
    # A half-written snapshot of the next batch is not read, and a replay writes beside it.
    (tmp_path / "state" / "snapshot=2-0").mkdir()
    assert rows() == {"http://a": 0, "http://b": 1, "http://c": 2}
    apply_batch(spark, _lines(spark, "http://d"), 2, state)
    assert rows() == {"http://a": 0, "http://b": 1, "http://c": 2, "http://d": 3}
    # Replaying a batch starts from the state before it.
    apply_batch(spark, _lines(spark, "http://d", "http://e"), 2, state)
    assert rows() == {"http://a": 0, "http://b": 1, "http://c": 2, "http://d": 3, "http://e": 4}
    assert (tmp_path / "state" / "snapshot=2-2").exists()


def test_lost_state_is_an_error(spark, tmp_path):
    from docreason.streaming.ingest import apply_batch
    (tmp_path / "state" / "snapshot=0-0").mkdir(parents=True)
    with pytest.raises(RuntimeError):
        apply_batch(spark, _lines(spark, "http://a"), 1, str(tmp_path / "state"))


def test_a_forced_document_writes_one_document(spark, tmp_path):
    """Newest version wins, null keys too; a version without its commit marker is
    not read and can be written again; compaction changes nothing that is read."""
    from docreason.streaming import resume as R
    path = str(tmp_path / "table")
    rows = lambda *r: spark.createDataFrame(r, "doc long, step int, v string")
    read = lambda: sorted(((r.doc, r.step, r.v) for r in R.read_newest(spark, path, "doc").collect()), key=repr)
    R.write_version(rows(*[(i, s, "a") for i in range(50) for s in (1, 2)], (None, 1, "a")), path, 1)
    R.write_version(rows((7, 1, "b")), path, 2)
    assert spark.read.parquet(f"{path}/_version=2").count() == 1
    want = sorted([(i, s, "a") for i in range(50) if i != 7 for s in (1, 2)] + [(7, 1, "b"), (None, 1, "a")], key=repr)
    assert read() == want
    R.write_version(rows((7, 1, "lost"), (8, 1, "lost")), path, 3)
    (tmp_path / "table" / "_version=3" / "_SUCCESS").unlink()
    assert read() == want
    R.compact(spark, path, "doc")
    assert read() == want and not (tmp_path / "table" / "_version=1").exists()
    R.write_version(rows((None, 1, "c"), (7, 1, "c"), (7, 1, "c")), path, 3)
    want = [x for x in want if x[0] not in (7, None)] + [(7, 1, "c")] * 2 + [(None, 1, "c")]
    assert read() == sorted(want, key=repr)
    R.compact(spark, path, "doc")
    R.compact(spark, path, "doc")
    assert read() == sorted(want, key=repr)


def test_a_table_without_versions_is_an_error(spark, tmp_path):
    from docreason.streaming import resume as R
    with pytest.raises(FileNotFoundError):
        R.read_newest(spark, str(tmp_path), "doc")
