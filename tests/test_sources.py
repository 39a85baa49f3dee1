"""Tolerant JSON loader, strict array loader, manifest and CSV sources."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from docreason.sources import files as FS
from docreason.sources import json_sources as JS

SCHEMA = "question_id string, gold_answer string"


def test_any_json_rules(spark):
    d = tempfile.mkdtemp(prefix="src-")
    with open(os.path.join(d, "lines.jsonl"), "w") as f:
        f.write('{"question_id": "a", "gold_answer": "1"}\n\n  {"question_id": "b", "gold_answer": "0.5"},  \n'
                'not json at all\n')
    with open(os.path.join(d, "arr.json"), "w") as f:
        f.write('\n [\n  {"question_id": "c", "gold_answer": "0"},\n  {"question_id": "d"}\n ]\n')
    from pyspark.sql import types as T
    schema = T._parse_datatype_string(SCHEMA)
    rows, bad = JS.read_any_json(spark, d, schema)
    assert sorted(r.question_id for r in rows.collect()) == ["a", "b", "c", "d"]
    assert [r.line for r in bad.collect()] == ["not json at all"]
    with pytest.raises(JS.SourceError):
        JS.read_json_arrays(spark, os.path.join(d, "lines.jsonl"), schema)
    assert JS.read_json_arrays(spark, os.path.join(d, "arr.json"), schema).count() == 2


def test_first_character_decides(spark, tmp_path):
    """A lines file with a line that starts with '[' loses nothing; a pretty
    object with a nested array is no array; a truncated array is an error or
    goes to quarantine."""
    from pyspark.sql import types as T
    schema = T._parse_datatype_string(SCHEMA)
    (tmp_path / "lines.jsonl").write_text('{"question_id": "a"}\n[oops\n{"question_id": "b"}\n\t{"question_id": "c"}\r\n')
    (tmp_path / "object.json").write_text('{"question_id":\n["x",\n"y"]\n}\n')
    (tmp_path / "cut.json").write_text(' \n[{"question_id": "d"},\n{"question_id": "e"')
    rows, bad = JS.read_any_json(spark, str(tmp_path / "lines.jsonl"), schema)
    assert sorted(r.question_id for r in rows.collect()) == ["a", "b", "c"]
    assert [r.line for r in bad.collect()] == ["[oops"]
    with pytest.raises(JS.SourceError):
        JS.read_json_arrays(spark, str(tmp_path / "object.json"), schema)
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST"):
        JS.read_json_arrays(spark, str(tmp_path / "cut.json"), schema).collect()
    rows, bad = JS.read_any_json(spark, str(tmp_path / "cut.json"), schema)
    assert rows.count() == 0 and sorted(r.line for r in bad.collect()) == ['{"question_id": "d"}', '{"question_id": "e"']


def test_label_files(spark):
    df = spark.createDataFrame([("a.json", 1), ("b.json", 2), ("a.json", 3)], "source_file string, v int")
    labels = spark.createDataFrame([("a.json", "x"), ("b.json", "y")], "source_file string, arm string")
    assert sorted(tuple(r) for r in JS.label_files(df, labels).collect()) == [("a.json", 1, "x"), ("a.json", 3, "x"), ("b.json", 2, "y")]
    with pytest.raises(Exception, match="no labels for file b.json"):
        JS.label_files(df, labels.where("arm = 'x'")).collect()


def test_manifest_last_row_wins_and_quoted_csv(spark):
    d = tempfile.mkdtemp(prefix="src-")
    with open(os.path.join(d, "m.json"), "w") as f:
        f.write('{"document_id": "1", "path": "old"}\n{"document_id": "2", "path": "p2"}\n{"document_id": "1", "path": "new"}\n')
    m = {r.document_id: r.path for r in FS.read_manifest(spark, os.path.join(d, "m.json")).collect()}
    assert m == {"1": "new", "2": "p2"}
    with open(os.path.join(d, "design.csv"), "w") as f:
        f.write('"candidate_name","justification","feasibility_score","contract_parts"\n'
                '"A, ""x""","multi\nline","0.7","[""$.rubric[0]"", ""$.predictions[1]""]"\n')
    r = FS.read_design_csv(spark, os.path.join(d, "design.csv")).first()
    assert (r.candidate_name, r.justification, r.feasibility_score) == ('A, "x"', "multi\nline", 0.7)
    assert r.contract_parts == ["$.rubric[0]", "$.predictions[1]"]


def test_json_object_keys_rules(spark):
    df = spark.createDataFrame([('{"b": 1, "a": {"x": 2}}',), ("[1, 2]",), ("not json",), (None,), ("{}",),
                                ('{"a": 1} junk',), ('{"a": 1} {"b": 2}',)], "v string")
    got = [r.k for r in df.select(JS.json_object_keys("v").alias("k")).collect()]
    assert got == [["b", "a"], [], [], [], [], [], []]


def test_one_value(spark):
    """A text after the first value, however it is made, is no single value."""
    from docreason.functions import jsonfn as J
    good = ['{"a": 1}', ' [1, "]"] ', "3", '"x"', "null", "[]", '"a\\"b"']
    bad = ['{"a": 1} junk', "[1] [2]", "1], [2", "1, 2", "", " ", "1]", "[1", "1,", ',1', '1,"x"],["y"', "not json", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(good + bad)], "i int, t string")
    got = dict(df.select("i", F.to_json(J.one_value("t"))).collect())
    assert [json.loads(got[i]) for i in range(len(good))] == [json.loads(t) for t in good]
    assert [got[len(good) + i] for i in range(len(bad))] == [None] * len(bad)


PROBES = {
    "two_arrays.json": ('[{"question_id": "a"}]\n[{"question_id": "b"}]', [], 1),
    "junk_after.json": ('[{"question_id": "a"},{"question_id": "b"}] and more', [], 2),
    "two_objects.jsonl": ('{"question_id": "b"}{"question_id": "c"}\n{"question_id": "d"}', ["d"], 1),
    "broken_element.json": ("[1, 2, {z}]", [], 3),
    "numbers.json": ('[1, {"question_id": "e"}]', ["e"], 1),
    "comma_at_end.json": ('[{"question_id": "f"},]', [], 2),
    "comma_after.json": ('[{"question_id": "g"}],', [], 1),
    "empty.json": (" [ ]\n", [], 0),
    "blank.json": ("\n \n", [], 0),
    "nested.json": ('[{"question_id": "h,]\\"[", "x": [1, [2, {"y": 3}]]},\n {"question_id": "i"}]\n', ['h,]"[', "i"], 0),
    "unclosed.json": ('[{"question_id": "j"}', [], 1),
    "extra_bracket.json": ('[{"question_id": "k"}]]', [], 1),
}


def test_nothing_is_lost_without_a_quarantine_row(spark, tmp_path):
    from pyspark.sql import types as T
    schema = T._parse_datatype_string(SCHEMA)
    for name, (text, _, _) in PROBES.items():
        (tmp_path / name).write_text(text)
    rows, bad = JS.read_any_json(spark, str(tmp_path), schema)
    by, lost = {}, {}
    for r in rows.collect():
        by.setdefault(os.path.basename(r.source_file), []).append(r.question_id)
    for r in bad.collect():
        lost[os.path.basename(r.source_file)] = lost.get(os.path.basename(r.source_file), 0) + 1
    assert {n: (sorted(by.get(n, [])), lost.get(n, 0)) for n in PROBES} == {n: (ids, k) for n, (_, ids, k) in PROBES.items()}
    for name, (_, ids, k) in PROBES.items():
        if name.endswith(".json") and name != "blank.json":
            read = lambda: sorted(r.question_id for r in JS.read_json_arrays(spark, str(tmp_path / name), schema).collect())  # noqa: B023, E731
            if k:
                with pytest.raises(Exception, match="malformed JSON array"):
                    read()
            else:
                assert read() == ids
    lines = JS.read_json_lines(spark, str(tmp_path / "two_objects.jsonl"), schema).collect()
    assert sorted((r.question_id or "", r._corrupt_record is None) for r in lines) == [("", False), ("d", True)]


def test_array_file_is_split_at_any_byte(spark, tmp_path):
    from pyspark.sql import types as T
    schema = T._parse_datatype_string(SCHEMA)
    rows = [{"question_id": f'q{i}, "é" \\ [{{', "gold_answer": "]},[" * (i % 3)} for i in range(9)]
    (tmp_path / "a.json").write_text("\n [" + " ,\n".join(json.dumps(r, ensure_ascii=bool(i % 2)) for i, r in enumerate(rows)) + "\n] ")
    (tmp_path / "b.json").write_text(json.dumps([{"question_id": "x" * 200}]))
    want = sorted([(r["question_id"], r["gold_answer"]) for r in rows] + [("x" * 200, None)])
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (7, 64, 333):
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
            assert sorted(tuple(r) for r in JS.read_json_arrays(spark, str(tmp_path), schema).collect()) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)


def test_shared_folder_is_required_off_a_local_master(spark, monkeypatch):
    from docreason import session

    class Conf:
        def get(self, *_):
            return None

    class Context:
        master, getCheckpointDir = "spark://host:7077", staticmethod(lambda: None)
        getConf = staticmethod(lambda: Conf())

    class Session:
        sparkContext, conf = Context, Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session)


def test_a_repeated_append_leaves_one_copy(spark, tmp_path):
    from docreason.sources.sinks import ledger_append
    path = str(tmp_path / "ledger")
    rows = lambda *r: spark.createDataFrame(r, "experiment_id string, document_id string, success boolean")
    ledger_append(rows(("a", "1", True), ("b", "1", False)), path, "first")
    ledger_append(rows(("a", "2", True), ("a", "2", True)), path, "second")
    ledger_append(rows(("a", "3", None)), path, "second")
    ledger_append(rows().limit(0), path, "third")
    got = sorted((r.experiment_id, r.batch_id, r.document_id, r.success) for r in spark.read.parquet(path).collect())
    assert got == [("a", "first", "1", 1), ("a", "second", "3", None), ("b", "first", "1", 0)]


def test_arrays_are_streamed_and_come_back(spark, tmp_path):
    """Every record of an array file is a line of its own, in order, so that no
    row holds a group; NULL keys are a group."""
    import glob
    from docreason.sources import sinks as K
    rows = [(None if i % 3 == 0 else i % 3, f"{i % 50:03d}", f'x,"]{i} \\') for i in range(300)] + [(1, None, None)] * 2
    df = spark.createDataFrame(rows, "g int, question_id string, gold_answer string")
    K.write_json_arrays(df, str(tmp_path / "a"), by=["g"], order=["question_id"])
    files = glob.glob(str(tmp_path / "a" / "g=*" / "*.txt"))
    assert len(files) == 3
    got = []
    for f in files:
        text = open(f, encoding="utf-8").read()
        items = json.loads(text)
        assert len(text.splitlines()) == len(items)
        ids = [x.get("question_id") for x in items]
        assert ids == sorted(ids, key=lambda x: (x is not None, x or ""))
        got += [(x.get("question_id"), x.get("gold_answer")) for x in items]
    assert sorted(got, key=str) == sorted([r[1:] for r in rows], key=str)
    from pyspark.sql import types as T
    back = JS.read_json_arrays(spark, str(tmp_path / "a"), T._parse_datatype_string(SCHEMA)).collect()
    assert sorted((tuple(r) for r in back), key=str) == sorted(got, key=str)


def test_marks_of_pieces():
    """Quotes and brackets up to each piece's end, as told piece by piece."""
    import random
    import pyarrow as pa
    from docreason.sources.json_arrays import _marks
    rnd = random.Random(3)
    pieces = ["".join(rnd.choice('ab"[]{}\\é ') for _ in range(rnd.randrange(9))) for _ in range(500)] + ["", "\\"]
    for part in (pa.array(pieces), pa.array(pieces).slice(100, 300), pa.array([""])):
        quotes, outer, inner = (x.tolist() for x in _marks(part))
        n, depth = 0, [0, 0]
        for i, text in enumerate(part.to_pylist()):
            skip = False
            for c, after in zip(text, text[1:] + "\0"):
                if skip:
                    skip = False
                elif c == "\\" and after != "\0":
                    skip = True
                elif c == '"':
                    n += 1
                else:
                    depth[n % 2] += (c in "[{") - (c in "]}")
            assert (quotes[i], outer[i], inner[i]) == (n, *depth)


def test_files_of_arrays_do_not_grow_with_the_ids(spark, tmp_path):
    """json_sources writes no more array files for more question ids."""
    from docreason.plans import q_io
    seen = []

    class Sinks:
        def __getattr__(self, name):
            return getattr(K, name)

        def write_json_arrays(self, df, path, by, order):
            seen.append(df.select(*by).distinct().count())
            K.write_json_arrays(df, path, by, order)

    K, q_io.K = q_io.K, Sinks()
    try:
        os.makedirs(tmp_path / "sf")
        spark.range(3000).selectExpr(
            "id as l_orderkey", "id * 64 as l_partkey", "cast(1 as int) as l_linenumber", "'F' as l_linestatus",
            "cast(id % 50 as double) as l_quantity", "0.04d as l_discount").write.parquet(str(tmp_path / "sf" / "lineitem.parquet"))
        out = q_io.q_json_sources(spark, str(tmp_path / "sf"))
        assert out.groupBy("src").count().collect() and out.count() == 9000 and seen[0] <= 4 * 64
    finally:
        q_io.K = K


def test_files_of_keys_without_a_folder_each(spark, tmp_path, monkeypatch):
    """A key's rows are one file, whoever writes it; a mounted folder has no folder
    per key and no part of a file left."""
    from docreason.sources import sinks as K
    rows = [(i % 900, None if i % 50 == 3 else f"é{i}" * (i % 4)) for i in range(1000)]
    df = spark.createDataFrame(rows, "page_id long, html string").repartition(7)

    def files(name):
        b = FS.read_binary(spark, str(tmp_path / name))
        key = F.regexp_extract("path", r"page_id=(\d+)", 1).cast("long")
        return {r[0]: sorted(bytes(r[1]).decode().split("\n")) for r in b.select(key, "content").collect()}, b.count()

    K.write_files(df, str(tmp_path / "own"), "page_id", "html")
    monkeypatch.setattr(K, "mounted_path", lambda *_: None)
    K.write_files(df, str(tmp_path / "spark"), "page_id", "html")
    want = {k: sorted([v or "" for i, v in rows if i == k] + [""]) for k in {k for k, _ in rows}}
    assert files("own") == (want, 900) == files("spark")
    below = [(d, n) for d, _, names in os.walk(tmp_path / "own") for n in names]
    assert len(below) == 900 and len({d for d, _ in below}) <= K.FILE_FOLDERS


def test_a_file_cut_short_is_not_there(tmp_path):
    import pyarrow as pa
    from docreason.sources.sinks import _put_files

    def batches(broken):
        yield pa.RecordBatch.from_pydict({"k": ["a", "a", "b"], "v": [b"1", b"2", b"3"]})
        if broken:
            raise RuntimeError("lost")
        yield pa.RecordBatch.from_pydict({"k": ["b", "c/d", None], "v": [b"4", None, b"5"]})

    seen = lambda: {n: open(os.path.join(d, n), "rb").read() for d, _, names in os.walk(tmp_path) for n in names if n[0] != "."}
    with pytest.raises(RuntimeError, match="lost"):
        list(_put_files(batches(True), str(tmp_path), "k"))
    assert seen() == {"k=a.txt": b"1\n2\n"}
    [done] = _put_files(batches(False), str(tmp_path), "k")
    assert done["n"].to_pylist() == [4]
    assert seen() == {"k=a.txt": b"1\n2\n", "k=b.txt": b"3\n4\n", "k=c%2Fd.txt": b"\n", "k=__HIVE_DEFAULT_PARTITION__.txt": b"5\n"}


def test_pdf_check_needs_no_folder_per_page(spark, tmp_path, monkeypatch):
    from docreason.plans import q_io
    monkeypatch.setattr(q_io, "scratch_dir", lambda _, name: str(tmp_path / name))
    os.makedirs(tmp_path / "sf")
    spark.range(700).selectExpr("id as page_id", "if(id = 4, null, repeat('é', cast(id % 5 as int))) as html").write.parquet(str(tmp_path / "sf" / "pages.parquet"))
    got = {tuple(r) for r in q_io.q_pdf_check(spark, str(tmp_path / "sf")).collect()}
    body = lambda i: ("%PDF-1.4\n" if i % 3 == 0 else "") + "é" * (i % 5 if i != 4 else 0)
    assert got == {(i, i % 3 == 0, len(body(i).encode()) + 1) for i in range(700)}
    assert sum(len(folders) for _, folders, _ in os.walk(tmp_path / "pdf")) <= 256


def test_is_one_value_agrees(spark):
    from docreason.functions import jsonfn as J
    texts = ['{"a": 1}', ' [1, "]"] ', "3", '"x"', "null", "[]", '\n{"a": {}}', "{}", '{"a": 1, "a": 2}', "{'a': 1}", '{"a": NaN}',
             '{"a": 1} junk', "[1] [2]", "1], [2", "1, 2", "", " ", "1]", "[1", "1,", ",1", '1,"x"],["y"', '{"a": 1}, {"b": 2}', '{"a": 1}]', " {}", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    v = J.one_value("t")
    for i, whole, same, obj, also in df.select("i", v.isNotNull(), J.is_one_value("t"), J.is_object(v), J.is_one_value("t") & J.begins_object("t")).collect():
        assert (whole, obj) == (same, also), texts[i]


def test_compressed_files_are_read_alike(spark, tmp_path):
    """Every probe, plain and compressed, gives the same rows and quarantine."""
    import gzip
    from pyspark.sql import types as T
    schema = T._parse_datatype_string(SCHEMA)
    probes = {n: x[0] for n, x in PROBES.items()} | {"no_objects.json": "[1, 2],", "brace_at_end.json": '[{"question_id": "l"}', "space.json": '[{"question_id": "m"}] \n'}
    os.makedirs(tmp_path / "plain")
    os.makedirs(tmp_path / "packed")
    for name, text in probes.items():
        (tmp_path / "plain" / name).write_text(text)
        (tmp_path / "packed" / f"{name}.gz").write_bytes(gzip.compress(text.encode()))

    def read(folder):
        rows, bad = JS.read_any_json(spark, str(tmp_path / folder), schema)
        name = lambda r: os.path.basename(r.source_file).removesuffix(".gz")
        return sorted((name(r), r.question_id) for r in rows.collect()), sorted((name(r), r.line) for r in bad.collect())

    assert read("packed") == read("plain")
    for name in ("comma_after.json", "unclosed.json"):
        with pytest.raises(Exception, match="malformed JSON array"):
            JS.read_json_arrays(spark, str(tmp_path / "packed" / f"{name}.gz"), schema).collect()


def test_array_elements_over_batches(spark, tmp_path):
    """Files of one block and of many, cut in small batches, end alike."""
    from pyspark.sql import types as T
    schema = T._parse_datatype_string(SCHEMA)
    for k, n in enumerate((1, 2, 3, 4, 11)):
        (tmp_path / f"{k}.json").write_text(json.dumps([{"question_id": f"{k}-{i}", "gold_answer": "a,b" * (i % 3)} for i in range(n)]))
    (tmp_path / "open.json").write_text('[{"question_id": "x"},{"question_id": "y"}')
    want = sorted(f"{k}-{i}" for k, n in enumerate((1, 2, 3, 4, 11)) for i in range(n))
    names = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.files.maxPartitionBytes")
    kept = [spark.conf.get(x) for x in names]
    try:
        for batch, size in ((1, "128m"), (2, "128m"), (3, "50"), (1, "9")):
            spark.conf.set(names[0], str(batch))
            spark.conf.set(names[1], size)
            rows, bad = JS.read_any_json(spark, str(tmp_path), schema)
            assert sorted(r.question_id for r in rows.collect()) == want
            assert sorted(r.line for r in bad.collect()) == ['{"question_id": "x"}', '{"question_id": "y"}']
    finally:
        for x, v in zip(names, kept):
            spark.conf.set(x, v)


def test_json_sources_takes_little_disk(spark, tmp_path, monkeypatch):
    """What the query writes is a small part of its records' plain text, and no
    table holds the texts of the arrays' elements."""
    from docreason import session
    from docreason.plans import q_io
    made = []

    def scratch(_, name):
        made.append(f"{tmp_path}/{name}-{len(made)}")
        return made[-1]

    monkeypatch.setattr(q_io, "scratch_dir", scratch)
    monkeypatch.setattr(session, "scratch_dir", scratch)
    os.makedirs(tmp_path / "sf")
    spark.range(40000).selectExpr(
        "id as l_orderkey", "hash(id) % 5000 + 10000 as l_partkey", "cast(id % 7 as int) as l_linenumber", "if(id % 2 = 0, 'F', 'O') as l_linestatus",
        "cast(id % 50 as double) as l_quantity", "id % 11 / 100 as l_discount").write.parquet(str(tmp_path / "sf" / "lineitem.parquet"))
    out = q_io.q_json_sources(spark, str(tmp_path / "sf"))
    assert out.count() == 120000
    size = lambda top: sum(os.path.getsize(os.path.join(d, n)) for d, _, names in os.walk(top) for n in names if not n.endswith(".crc"))
    assert size(made[0]) < 120000 * 90 / 3
    assert sum(size(x) for x in made[1:]) < 300000
