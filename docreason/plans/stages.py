"""Stage functions (F3): ``dict[str, DataFrame] -> dict[str, DataFrame]``.

Each stage chains the operators of one step of the document workflow; the
model call between a request table and its response table stays outside
(a response table, or ``responses.batch_infer`` with the caller's function).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from docreason.operators import blocks as BL
from docreason.operators import qa as QA
from docreason.operators import requests as RQ
from docreason.operators import responses as RS

Tables = dict[str, DataFrame]


def observed(df: DataFrame, obs: Observation | None, name: str) -> DataFrame:
    """Attach a row counter that is filled by whatever action writes the
    table (no extra job); read it with ``obs.get[name]`` afterwards."""
    return df if obs is None else df.observe(obs, F.count(F.lit(1)).alias(name))


def analyze(inputs: Tables) -> Tables:
    """blocks (doc_id, page, pos, type, text, split, ref) + optional pages ->
    records, references, labels, asset copy list."""
    blocks = inputs["blocks"]
    labels = BL.label_pages(blocks)
    recs = BL.records(blocks)
    out = {"records": recs, "references": BL.references(recs), "labels": labels}
    if "pages" in inputs:
        out["assets"] = BL.label_assets(labels, inputs["pages"])
    return out


def semantic_requests(inputs: Tables) -> Tables:
    """records + labels -> semantic requests (R2)."""
    return {"requests": RQ.semantic_requests(inputs["records"], inputs["labels"])}


def _resolved(resp: DataFrame, key: str, retries: int) -> tuple[DataFrame, DataFrame]:
    carried = [c for c in ("prompt_tokens", "completion_tokens", "latency") if c in resp.columns]
    r = RS.resolve_attempts(RS.parse_list(resp), [key], "is_list", ["items", "texts", *carried], retries=retries, error="content")
    return r.where(F.col("status") == "ok"), r.where(F.col("status") != "ok")


def contracts(inputs: Tables, retries: int = 3) -> Tables:
    """contract responses (document_id, attempt, content, tokens) ->
    contracts with ids (W4), quarantine."""
    ok, bad = _resolved(inputs["contract_responses"], "document_id", retries)
    return {"contracts": QA.contract_ids(ok), "quarantine": bad}


def questions(inputs: Tables, retries: int = 3, keep_zero: bool = False,
              obs: Observation | None = None) -> Tables:
    """question responses -> questions (P5, W5, P6), rejected records,
    quarantine of responses that never parsed."""
    ok, bad = _resolved(inputs["question_responses"], "document_id", retries)
    raw = ok.select("document_id", F.posexplode("items").alias("pos", "item")) \
        .select("document_id", "pos", F.to_json("item").alias("raw"))
    q, rejected = QA.questions_from_records(raw, keep_zero=keep_zero)
    return {"questions": observed(q, obs, "questions"), "rejected": rejected, "quarantine": bad}


def answer(inputs: Tables, retries: int = 3, experiment_id: str = "", config_name: str = "",
           keep_zero: bool = False, obs: Observation | None = None) -> Tables:
    """answer responses + questions -> answers."""
    ok, bad = _resolved(inputs["answer_responses"], "document_id", retries)
    ans = QA.join_answers(QA.answer_items(ok, keep_zero=keep_zero), inputs["questions"])
    ans = ans.withColumn("experiment_id", F.lit(experiment_id)).withColumn("config_name", F.lit(config_name))
    return {"answers": observed(ans, obs, "answers"), "quarantine": bad}


def score(inputs: Tables, key: list[str] | None = None, obs: Observation | None = None) -> Tables:
    """score responses (key..., content) joined to answers -> scored answers
    (T3, P8); rejected and unparsable scores to quarantine."""
    key = key or ["document_id", "question_id", "item_pos"]
    s = RS.parse_score(inputs["score_responses"])
    scored = inputs["answers"].join(s.where(F.col("status") == "ok").select(*key, F.col("score").alias("eval_score")), key)
    return {"scored": observed(scored, obs, "scored"), "quarantine": s.where(F.col("status") != "ok")}


def design(inputs: Tables, contract_id: str) -> Tables:
    """contracts -> the design request of one contract."""
    c = QA.first_contract(inputs["contracts"], contract_id, ["document_id", "i"])
    return {"request": RQ.design_request(c)}
