"""W1/W2 against a plain scan of the blocks, on random documents."""

import random


from docreason.operators.blocks import dense_index, merge_split_blocks

SPLITTABLE = ("paragraph", "caption", "equation", "reference_entry")


def scan(blocks):
    """The sequential merge: pairs only, both blocks consumed."""
    def t(b):
        return str(b["type"] if b["type"] is not None else "").lower().strip()

    def flag(v):
        return str(v).lower().strip() == "true"

    out, i = [], 0
    while i < len(blocks):
        cur = blocks[i]
        if t(cur) in SPLITTABLE and flag(cur["split"]) and i + 1 < len(blocks) and t(blocks[i + 1]) == t(cur):
            nb = dict(cur)
            nb["text"] = cur["text"] + " " + blocks[i + 1]["text"]
            nb["split"] = flag(blocks[i + 1]["split"])
            out.append(nb)
            i += 2
            continue
        out.append(cur)
        i += 1
    return out


def random_docs(seed, n_docs=40):
    rng = random.Random(seed)
    types = ["paragraph", "Paragraph ", "caption", "figure", "equation", "reference_entry", "title", None]
    rows = []
    for d in range(n_docs):
        n = rng.randint(0, 30)
        for p in range(n):
            rows.append((d, p // 3 + 1, p,
                         rng.choice(types[:3]) if rng.random() < 0.7 else rng.choice(types),
                         f"t{d}-{p}", rng.choice([True, True, False]), "[1]"))
    return rows


def test_merge_matches_scan(spark):
    for seed in range(4):
        rows = random_docs(seed)
        df = spark.createDataFrame(rows, "doc_id long, page int, pos int, type string, text string, split boolean, ref string")
        got = {}
        for r in merge_split_blocks(df).collect():
            got.setdefault(r.doc_id, []).append((r.page, r.pos, r.text, r.split))
        want = {}
        by_doc = {}
        for r in rows:
            by_doc.setdefault(r[0], []).append(dict(doc_id=r[0], page=r[1], pos=r[2], type=r[3], text=r[4], split=r[5]))
        for d, bl in by_doc.items():
            want[d] = [(b["page"], b["pos"], b["text"], b["split"]) for b in scan(sorted(bl, key=lambda b: (b["page"], b["pos"])))]
        assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_chain_of_four_merges_pairs_only(spark):
    rows = [(1, 1, i, "paragraph", f"p{i}", True, None) for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, page int, pos int, type string, text string, split boolean, ref string")
    texts = [r.text for r in merge_split_blocks(df).orderBy("pos").collect()]
    assert texts == ["p0 p1", "p2 p3"]


def test_chain_across_pages(spark):
    rows = [(1, i + 1, 0, "caption", f"c{i}", True, None) for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, page int, pos int, type string, text string, split boolean, ref string")
    out = merge_split_blocks(df).orderBy("page").collect()
    assert [r.text for r in out] == ["c0 c1", "c2"]
    idx = dense_index(merge_split_blocks(df)).orderBy("idx").select("idx").collect()
    assert [r.idx for r in idx] == [0, 1]


def test_stage_functions_chain(spark):
    from docreason.plans import stages
    from docreason.plans.views import blocks as blocks_view, raw_questions, responses
    sf = "/root/testdata/sf0.001"
    a = stages.analyze({"blocks": blocks_view(spark, sf)})
    assert set(a) == {"records", "references", "labels"}
    assert stages.semantic_requests(a)["requests"].count() > 0
    c = stages.contracts({"contract_responses": responses(spark, sf)})
    assert c["contracts"].count() > 0
    from docreason.operators.qa import questions_from_records
    q, _ = questions_from_records(raw_questions(spark, sf))
    ans = stages.answer({"answer_responses": responses(spark, sf), "questions": q}, experiment_id="e1")
    assert ans["answers"].where("experiment_id = 'e1'").count() > 0


def test_stage_counters_by_observation(spark):
    from pyspark.sql import Observation

    from docreason.operators.qa import questions_from_records
    from docreason.plans import stages
    from docreason.plans.views import raw_questions, responses
    sf = "/root/testdata/sf0.001"
    q, _ = questions_from_records(raw_questions(spark, sf))
    obs = Observation("answer_stage")
    out = stages.answer({"answer_responses": responses(spark, sf), "questions": q}, obs=obs)["answers"]
    out.write.format("noop").mode("overwrite").save()
    assert obs.get["answers"] == out.count() > 0


def test_string_flags_and_type_trimming(spark):
    from docreason.operators.blocks import filter_types
    rows = [(1, 1, 0, " Paragraph", "a", "True ", None), (1, 1, 1, "paragraph", "b", "false", None),
            (1, 1, 2, " Unknown", "c", None, None), (1, 1, 3, "UNKNOWN", "d", None, None),
            (1, 1, 4, None, "e", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, page int, pos int, type string, text string, split string, ref string")
    merged = merge_split_blocks(df).orderBy("pos").collect()
    assert [(r.text, r.split) for r in merged][:1] == [("a b", "false")]
    kept = [r.text for r in filter_types(merge_split_blocks(df)).orderBy("pos").collect()]
    # P1 lower-cases but does not trim: ' Unknown' stays, 'UNKNOWN' goes, a missing type stays.
    assert kept == ["a b", "c", "e"]


def test_rows_without_document_or_page_keep_their_index(spark):
    from docreason.operators.blocks import dense_index
    rows = [("a", 1, 0), ("a", 1, 1), ("a", None, 0), (None, 1, 0), (None, 1, 1), (None, None, 0), (None, None, 1)]
    df = spark.createDataFrame(rows, "doc_id string, page int, pos int")
    got = {(r.doc_id, r.page, r.pos): r.idx for r in dense_index(df).collect()}
    assert got == {("a", None, 0): 0, ("a", 1, 0): 1, ("a", 1, 1): 2,
                   (None, None, 0): 0, (None, None, 1): 1, (None, 1, 0): 2, (None, 1, 1): 3}
