"""Request tables for an outside model.

One row per request; the text is a template filled by column expressions.
Per-document texts aggregate that document's rows only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docreason.functions import prompts
from docreason.operators import blocks as BL
from docreason.operators.qa import context_parts


def image_data_url(path: str = "path", content: str = "content"):
    """R1 payload: data URL with the MIME type from the file suffix (png when
    there is none)."""
    name = F.element_at(F.split(F.col(path), "/"), -1)
    suffix = F.lower(F.when(name.contains("."), F.element_at(F.split(name, r"\."), -1)).otherwise(F.lit("")))
    suffix = F.when(suffix == "", "png").otherwise(suffix)
    mime = F.when(suffix == "png", "image/png").otherwise(F.concat(F.lit("image/"), suffix))
    # base64() may wrap lines (MIME chunks); a data URL is one line.
    b64 = F.regexp_replace(F.base64(F.col(content)), "[\r\n]", "")
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), b64)


def page_requests(pages: DataFrame, system: str = prompts.PAGE_SYSTEM) -> DataFrame:
    """One request per page image: system text + image data URL."""
    return pages.select("*", F.lit(system).alias("system"), image_data_url().alias("image_url"))


def semantic_requests(recs: DataFrame, labels: DataFrame, template: str = prompts.SEMANTIC_USER,
                      doc: str = "doc_id") -> DataFrame:
    """R2: per document, P1 -> P2 -> JSON lines of the claims, with the
    figure and table labels in first-appearance order."""
    kept, _ = BL.prune_validate(BL.filter_types(recs))
    claims = kept.groupBy(doc).agg(F.count(F.lit(1)).alias("n_claims"),
                                   BL.ordered_join(BL.jsonl_line(), "idx", "\n").alias("claims"))
    lists = BL.label_lists(labels, doc)
    j = claims.join(lists, doc, "left")
    figs = F.coalesce(F.to_json("figures"), F.lit("[]"))
    tabs = F.coalesce(F.to_json("tables"), F.lit("[]"))
    return j.select(doc, "n_claims", "claims", figs.alias("figures"), tabs.alias("tables"),
                    prompts.render(template, figures=figs, tables=tabs, claims="claims").alias("prompt"))


def contract_requests(steps: DataFrame, template: str = prompts.CONTRACT_USER,
                      doc: str = "document_id") -> DataFrame:
    """Per document its reasoning steps (JSON) in step order."""
    s = steps.groupBy(doc).agg(F.concat(F.lit("["), BL.ordered_join(F.col("step_json"), "step", ","),
                                        F.lit("]")).alias("steps"))
    return s.select(doc, prompts.render(template, steps="steps").alias("prompt"))


def records_json(recs: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Per document, its records as one JSON array in index order."""
    line = F.to_json(F.struct("idx", "page", "type", "text"))
    return recs.groupBy(doc).agg(F.concat(F.lit("["), BL.ordered_join(line, "idx", ","), F.lit("]"))
                                 .alias("records_json"))


def contracts_json(contracts: DataFrame, doc: str = "document_id") -> DataFrame:
    return contracts.groupBy(doc).agg(F.count(F.lit(1)).alias("n_contracts"), F.concat(
        F.lit("["), BL.ordered_join(F.col("contract_json"), "i", ","), F.lit("]")).alias("contracts"))


def question_requests(records: DataFrame, contracts: DataFrame, template: str = prompts.QUESTIONS_USER,
                      doc: str = "document_id") -> tuple[DataFrame, DataFrame]:
    """R4 + J2: per document with contracts: its records and contracts.
    Returns (requests, documents without records)."""
    j = contracts.join(records, doc, "left")
    ok = j.where(F.col("records_json").isNotNull())
    return (ok.select(doc, "n_contracts", prompts.render(template, raw_text="records_json",
                                                          contracts="contracts").alias("prompt")),
            j.where(F.col("records_json").isNull()).select(doc))


def answer_requests(questions: DataFrame, records_text: DataFrame, contracts: DataFrame, flags: str,
                    template: str = prompts.ANSWER_USER, doc: str = "document_id") -> tuple[DataFrame, DataFrame]:
    """R5 + P3 + P16 + J2: per document with questions: the masked questions
    and the context chosen by ``flags``. A document without a contract is
    quarantined (whatever the flags), as the stage requires its contract."""
    masked = F.to_json(F.struct("question_id", "question_type", "question"))
    qs = questions.groupBy(doc).agg(F.count(F.lit(1)).alias("n_questions"), F.concat(
        F.lit("["), BL.ordered_join(masked, "pos", ","), F.lit("]")).alias("questions"))
    j = qs.join(contracts, doc, "left").join(records_text, doc, "left")
    ok = j.where(F.col("contracts").isNotNull())
    ctx = F.array_join(context_parts(flags, F.col("contracts"), F.coalesce(F.col("records_text"), F.lit(""))), "\n")
    return (ok.select(doc, "n_questions", ctx.alias("context"),
                      prompts.render(template, questions="questions", context=ctx).alias("prompt")),
            j.where(F.col("contracts").isNull()).select(doc, F.lit("missing_contract").alias("reason")))


def score_requests(answers: DataFrame, fields: list[str], template: str = prompts.SCORE_USER) -> DataFrame:
    """One request per answer: the answer object as JSON."""
    obj = F.to_json(F.struct(*fields))
    return answers.select("*", prompts.render(template, answer=obj).alias("prompt"))


def design_request(contract: DataFrame, template: str = prompts.DESIGN_USER) -> DataFrame:
    """The chosen contract as JSON in the design prompt."""
    return contract.select("contract_id", prompts.render(template, contract="contract_json").alias("prompt"))
