"""Question, answer and contract jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docreason.functions import jsonfn as J
from docreason.schemas import FLAG_CONTRACT, FLAG_RAW_TEXT


def validate_question_records(raw: DataFrame, doc: str = "document_id", pos: str = "pos",
                              text: str = "raw") -> DataFrame:
    """P5: adds ``v`` (VARIANT) and ``valid``: an object with category,
    question, contract_id and gold_answer; question a non-empty string,
    contract_id a string, gold_answer a non-empty object."""
    v = F.try_parse_json(F.col(text))
    df = raw.withColumn("v", v)
    has = [J.field("v", k).isNotNull() for k in ("category", "question", "contract_id", "gold_answer")]
    q, cid, ga = J.field("v", "question"), J.field("v", "contract_id"), J.field("v", "gold_answer")
    # Only an object has fields.
    valid = (has[0] & has[1] & has[2] & has[3]
             & (J.vtype(q) == "STRING") & (J.vstring(q) != "")
             & (J.vtype(cid) == "STRING")
             & J.vtype(ga).startswith("OBJECT") & (J.vtype(ga) != "OBJECT<>"))
    return df.withColumn("valid", F.coalesce(valid, F.lit(False)))


def questions_from_records(raw: DataFrame, doc: str = "document_id", pos: str = "pos",
                           keep_zero: bool = False) -> tuple[DataFrame, DataFrame]:
    """W5 + P6: valid records numbered from 1 per document (ids
    '{doc}-{i}', numbered before P6 drops some, so ids may have gaps); a
    question needs a truthy gold answer and explanation; its trace is the
    explanation and the paths joined by newlines. Returns (questions,
    rejected records)."""
    df = validate_question_records(raw, doc, pos)
    # Number valid records with a running count over the document's records
    # and filter only after the window: a filter below it would be pushed
    # under the parse and repeat try_parse_json once per use of the value.
    w = Window.partitionBy(doc).orderBy(pos)  # one document's records
    valid = df.withColumn("_i", F.sum(F.col("valid").cast("int")).over(w))
    ga = J.field("v", "gold_answer")
    ans = F.try_variant_get(ga, "$.answer", "variant")
    expl = F.try_variant_get(ga, "$.explanation", "variant")
    paths = F.coalesce(F.try_variant_get(ga, "$.paths", "array<string>"), F.array().cast("array<string>"))
    ans_ok = J.truthy(ans) | (F.lit(keep_zero) & (J.vtype(ans).rlike("^(BIGINT|INT|DOUBLE|DECIMAL.*)$")))
    keep = ans_ok & J.truthy(expl)
    q = valid.select(
        doc, pos,
        F.concat(F.col(doc).cast("string"), F.lit("-"), F.col("_i").cast("string")).alias("question_id"),
        J.vstring(J.field("v", "category")).alias("question_type"),
        J.vstring(J.field("v", "question")).alias("question"),
        J.vstring(ans).alias("gold_answer"),
        F.concat_ws("\n", J.vstring(expl), paths).alias("gold_trace"),
        F.try_variant_get(ga, "$.notes", "string").alias("notes"),
        J.vstring(J.field("v", "contract_id")).alias("contract_id"),
        (F.col("valid") & keep).alias("_keep"))
    return q.where("_keep").drop("_keep"), df.where(~F.col("valid"))


def mask(questions: DataFrame) -> DataFrame:
    """What the answering model may see."""
    return questions.select(*[c for c in questions.columns if c in ("document_id",)],
                            "question_id", "question_type", "question")


def pick_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """The listed columns that exist."""
    return df.select(*[c for c in keys if c in df.columns])


def answer_items(resolved_items: DataFrame, doc: str = "document_id", keep_zero: bool = False) -> DataFrame:
    """T1 items -> answers; P7: question_id, answer and explanation truthy
    (a bare number 0 answer is dropped unless ``keep_zero``)."""
    carried = [c for c in ("prompt_tokens", "completion_tokens", "latency") if c in resolved_items.columns]
    it = resolved_items.select(doc, *carried, F.posexplode("items").alias("item_pos", "item"))
    qid, ans, expl = J.field("item", "question_id"), J.field("item", "answer"), J.field("item", "explanation")
    ans_ok = J.truthy(ans) | (F.lit(keep_zero) & J.vtype(ans).rlike("^(BIGINT|INT|DOUBLE|DECIMAL.*)$"))
    ok = J.truthy(qid) & ans_ok & J.truthy(expl)
    return it.where(ok).select(doc, "item_pos", J.vstring(qid).alias("question_id"),
                               J.vstring(ans).alias("pred_answer"), J.vstring(expl).alias("pred_trace"), *carried)


def join_answers(answers: DataFrame, questions: DataFrame, doc: str = "document_id") -> DataFrame:
    """Answers to the questions of the same document; unknown ids
    dropped; several answers to one question all kept; the question side
    de-duplicated, the last by position winning."""
    qcols = ["question", "question_type", "gold_answer", "gold_trace", "notes"]
    q = questions.groupBy(doc, "question_id").agg(
        *[F.max_by(c, "pos").alias(c) for c in qcols])
    return answers.join(q, [doc, "question_id"], "inner")


def item_texts(resolved_items: DataFrame, doc: str = "document_id") -> DataFrame:
    """doc, i (from 0, response order) and item_json of every item of a list:
    objects and lists as the model wrote them, other values as JSON."""
    both = resolved_items.select(doc, F.posexplode(F.arrays_zip("items", "texts")).alias("i", "_both"))
    kind = J.vtype(F.col("_both.items"))
    text = F.when(kind.startswith("OBJECT") | kind.startswith("ARRAY"), F.col("_both.texts")).otherwise(F.to_json(F.col("_both.items")))
    return both.select(doc, "i", text.alias("item_json"))


def contract_ids(resolved_items: DataFrame, doc: str = "document_id") -> DataFrame:
    """W4: '{doc}-{i}' from 0 in response order, one row per contract."""
    return item_texts(resolved_items, doc).select(
        doc, F.concat(F.col(doc).cast("string"), F.lit("-"), F.col("i").cast("string")).alias("contract_id"),
        "i", F.col("item_json").alias("contract_json"))


def context_parts(flags: str, contract_text, raw_text):
    """P16: 'CC' adds the contract, 'RAW_TEXT' the record text, in that
    order; no part gives ['-']."""
    parts = []
    if FLAG_CONTRACT in flags:
        parts.append(F.concat(F.lit("\n[CONTRACT]\n "), contract_text))
    if FLAG_RAW_TEXT in flags:
        parts.append(F.concat(F.lit("\n[RAW_TEXT]\n "), raw_text))
    return F.array(*parts) if parts else F.array(F.lit("-"))


def first_contract(contracts: DataFrame, contract_id: str, order: list[str]) -> DataFrame:
    """P15 + L3: the first contract with the id (an aggregate, no sort). That
    there is none is an error when the row is read."""
    if not contract_id:
        raise ValueError("missing argument: contract_id")
    m = contracts.where(F.col("contract_id") == contract_id)
    found = m.agg(F.min_by("contract_json", F.struct(*order)).alias("contract_json"))
    none = F.raise_error(F.lit(f"no contract has the id {contract_id}")).cast("string")
    return found.select(F.lit(contract_id).alias("contract_id"),
                        F.when(F.col("contract_json").isNull(), none).otherwise(F.col("contract_json")).alias("contract_json"))
