"""Question validity, id numbering with gaps, zero answers, attempt resolution."""

import pytest
from pyspark.sql import functions as F

from docreason.operators.qa import questions_from_records
from docreason.operators.responses import parse_list, resolve_attempts

GOOD = '{"answer":"0.5","explanation":"e","paths":["a -> b"],"notes":"n"}'


def test_question_rules(spark):
    recs = [
        (1, 0, '{"category":"c","contract_id":"1-0","question":"q0","gold_answer":' + GOOD + '}'),
        (1, 1, '{"category":"c","question":"q1","gold_answer":' + GOOD + '}'),                      # no contract_id
        (1, 2, '{"category":"c","contract_id":7,"question":"q2","gold_answer":' + GOOD + '}'),       # numeric id
        (1, 3, '{"category":"c","contract_id":"1-0","question":"","gold_answer":' + GOOD + '}'),     # empty question
        (1, 4, '{"category":"c","contract_id":"1-0","question":"q4","gold_answer":[]}'),             # list answer
        (1, 5, '{"category":"c","contract_id":"1-0","question":"q5","gold_answer":{"answer":"1"}}'),  # valid, no explanation
        (1, 6, '{"category":"c","contract_id":"1-0","question":"q6","gold_answer":{"answer":0,"explanation":"e"}}'),
        (1, 7, 'not json'),
        (1, 8, '{"category":"c","contract_id":"1-0","question":"q8","gold_answer":' + GOOD + '}'),
    ]
    df = spark.createDataFrame(recs, "document_id long, pos int, raw string")
    q, rejected = questions_from_records(df)
    got = {r.question: (r.question_id, r.gold_trace) for r in q.collect()}
    # Valid records are q0, q5, q6, q8 -> ids 1..4; q5 and q6 are dropped later, leaving gaps.
    assert got == {"q0": ("1-1", "e\na -> b"), "q8": ("1-4", "e\na -> b")}
    assert rejected.count() == 5
    q0, _ = questions_from_records(df, keep_zero=True)
    assert {r.question: r.question_id for r in q0.collect()}["q6"] == "1-3"


def test_first_parsing_attempt_wins_within_retries(spark):
    rows = [(1, 1, "no list", 10, 1), (1, 2, "x [1, 2] y", 20, 2), (2, 1, "[3]", 30, 3),
            (3, 1, "bad", 40, 4), (3, 2, "[4]", 50, 5)]
    df = spark.createDataFrame(rows, "document_id long, attempt int, content string, prompt_tokens long, completion_tokens long")
    p = parse_list(df)
    r3 = {r.document_id: (r.status, r.attempt, r.prompt_tokens)
          for r in resolve_attempts(p, ["document_id"], "is_list", ["items", "prompt_tokens"], retries=3).collect()}
    assert r3 == {1: ("ok", 2, 20), 2: ("ok", 1, 30), 3: ("ok", 2, 50)}
    r1 = {r.document_id: r.status
          for r in resolve_attempts(p, ["document_id"], "is_list", ["items"], retries=1).collect()}
    assert r1 == {1: "failed", 2: "ok", 3: "failed"}
    r0 = resolve_attempts(p, ["document_id"], "is_list", ["items"], retries=0).where(F.col("status") == "ok").count()
    assert r0 == 1  # retries=0 still makes one attempt


def test_failed_requests_keep_their_last_error_and_ignored_attempts(spark):
    rows = [(1, 1, "no list"), (1, 2, "still none"), (1, 4, "[1]"), (2, 1, "[3]"), (2, 5, "late"), (3, 9, "[9]")]
    df = spark.createDataFrame(rows, "document_id long, attempt int, content string")
    got = {r.document_id: (r.status, r.attempt, r.last_attempt, r.last_error, r.ignored_attempts)
           for r in resolve_attempts(parse_list(df), ["document_id"], "is_list", ["items"], retries=3, error="content").collect()}
    assert got == {1: ("failed", None, 2, "still none", 1), 2: ("ok", 1, 1, None, 1), 3: ("failed", None, None, None, 1)}


def test_item_texts_keep_key_order(spark):
    df = spark.createDataFrame([(1, 1, 'x [{"b": 1, "a": [2]}, "s", 3, null] y')], "document_id long, attempt int, content string")
    from docreason.operators.qa import contract_ids
    won = resolve_attempts(parse_list(df), ["document_id"], "is_list", ["items", "texts"])
    got = [(r.contract_id, r.contract_json) for r in contract_ids(won).orderBy("i").collect()]
    assert got == [("1-0", '{"b":1,"a":[2]}'), ("1-1", '"s"'), ("1-2", "3"), ("1-3", "null")]


def test_unknown_contract_is_an_error(spark):
    from docreason.plans.stages import design
    c = spark.createDataFrame([(1, 0, "1-0", '{"x":1}')], "document_id long, i int, contract_id string, contract_json string")
    assert '{"x":1}' in design({"contracts": c}, "1-0")["request"].first().prompt
    with pytest.raises(Exception, match="no contract has the id 9-9"):
        design({"contracts": c}, "9-9")["request"].collect()
    with pytest.raises(ValueError):
        design({"contracts": c}, "")


def test_stages_carry_latency_and_tokens(spark):
    from docreason.plans import stages
    q = spark.createDataFrame([(1, 1, '[{"category":"c","contract_id":"1-0","question":"q0","gold_answer":' + GOOD + '}]', 5, 6, 70),
                               (2, 1, "nothing", 1, 1, 1)],
                              "document_id long, attempt int, content string, prompt_tokens long, completion_tokens long, latency long")
    out = stages.questions({"question_responses": q})
    assert [r.question_id for r in out["questions"].collect()] == ["1-1"]
    assert [(r.document_id, r.last_error) for r in out["quarantine"].collect()] == [(2, "nothing")]
    a = q.sparkSession.createDataFrame([(1, 1, '[{"question_id":"1-1","answer":"0.5","explanation":"e"}]', 7, 8, 90)], q.schema)
    ans = stages.answer({"answer_responses": a, "questions": out["questions"]}, experiment_id="x")["answers"]
    r = ans.first()
    assert (r.prompt_tokens, r.completion_tokens, r.latency, r.experiment_id) == (7, 8, 90, "x")
    s = spark.createDataFrame([(1, "1-1", 0, " 0.5 "), (1, "1-1", 1, "-1")], "document_id long, question_id string, item_pos int, content string")
    scored = stages.score({"answers": ans, "score_responses": s})
    assert [x.eval_score for x in scored["scored"].collect()] == [0.5] and scored["quarantine"].count() == 1
    c = stages.contracts({"contract_responses": a})["contracts"].first()
    assert (c.contract_id, c.contract_json) == ("1-0", '{"question_id":"1-1","answer":"0.5","explanation":"e"}')


def test_no_prediction_column_gives_null_scores(spark):
    from docreason.operators.metrics import cross_domain
    df = spark.createDataFrame([(0.5, 0.25, 0.75)], "gold double, trace_sim double, model_pred double")
    assert cross_domain(df).first().abs_err == 0.25
    r = cross_domain(df.drop("model_pred")).first()
    assert (r.pred, r.abs_err, r.score_cont, r.correct_bin, r.eval_score) == (None, None, None, 0, 0.25)


def test_attempt_rounds_ask_only_what_is_left(spark, tmp_path):
    """A stub that succeeds at a given attempt; null keys, requests without any
    row, and a second run after a round was lost."""
    from docreason.operators.responses import request_rounds, resolve_rounds
    rows = [(1, 1, "[1]"), (2, 1, "no"), (2, 2, "[2, 3]"), (3, 1, "no"), (3, 2, "no"), (3, 3, "still no"), (3, 4, "[4]"),
            (None, 1, "no"), (None, 3, "[5]"), (4, 3, "[6]"), (2, 3, "[never asked]")]
    given = parse_list(spark.createDataFrame(rows, "document_id long, attempt int, content string"))
    todo = spark.createDataFrame([(1,), (2,), (3,), (4,), (5,), (None,)], "document_id long")
    asked = []

    def infer(left):
        asked.append(sorted((r.document_id or 0, r.attempt) for r in left.collect()))
        left = left.withColumnsRenamed({"document_id": "d", "attempt": "a"})
        return given.join(left, F.col("document_id").eqNullSafe(F.col("d")) & (F.col("attempt") == F.col("a"))).drop("d", "a")

    def job(path, retries=3):
        rounds = request_rounds(todo, ["document_id"], infer, "is_list", path, retries)
        out = resolve_rounds(todo, rounds, ["document_id"], "is_list", ["items"], retries=retries, error="content")
        return {r.document_id: (r.status, r.attempt, r.last_error) for r in out.collect()}

    want = {1: ("ok", 1, None), 2: ("ok", 2, None), 3: ("failed", None, "still no"), 4: ("ok", 3, None),
            5: ("failed", None, None), None: ("ok", 3, None)}
    path = tmp_path / "rounds"
    assert job(str(path)) == want
    assert asked == [[(i, 1) for i in range(6)], [(0, 2), (2, 2), (3, 2), (4, 2), (5, 2)], [(0, 3), (3, 3), (4, 3), (5, 3)]]
    (path / "round=3" / "_SUCCESS").unlink()  # as if the job had been lost in round 3
    asked.clear()
    assert job(str(path)) == want and asked == [[(0, 3), (3, 3), (4, 3), (5, 3)]]
    asked.clear()
    assert job(str(path)) == want and asked == []
    full = {r.document_id: (r.status, r.attempt) for r in resolve_attempts(given, ["document_id"], "is_list", ["items"]).collect()}
    assert full == {k: v[:2] for k, v in want.items() if k != 5}
    asked.clear()
    assert job(str(tmp_path / "one"), retries=0)[2] == ("failed", None, "no") and len(asked) == 1
