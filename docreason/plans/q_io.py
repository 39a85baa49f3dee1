"""Queries over files the query itself writes under the shared checkpoint
folder (S1-S3, S5-S7, S9, P18, K1-K5, I2) and reads back."""

from __future__ import annotations

from pyspark.sql import functions as F

from docreason.plans import sqlfrag as S
from docreason.plans.oracle_views import with_views
from docreason.plans.registry import register
from docreason.plans.views import qa_eval, responses, table
from docreason.schemas import LEDGER, SCORED_ANSWER_JSON
from docreason.session import scratch_dir
from docreason.sources import files as FS
from docreason.sources import json_sources as JS
from docreason.sources import sinks as K
from docreason.streaming import resume as RES


@register("pdf_check", with_views("""
select page_id, page_id % 3 = 0 as is_pdf,
  octet_length(encode(case when page_id % 3 = 0 then '%PDF-1.4' || chr(10) || html else html end)) + 1 as n_bytes
from pages"""))
def q_pdf_check(spark, sf):
    """Page bodies written as files (some behind a %PDF header), scanned
    back as bytes and checked by their magic number."""
    out = scratch_dir(spark, "pdf")
    p = table(spark, sf, "pages")
    body = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("%PDF-1.4\n"), F.col("html"))).otherwise(F.col("html"))
    K.write_files(p.select("page_id", body.alias("value")), out, "page_id")
    b = FS.read_binary(spark, out)
    pid = F.regexp_extract("path", r"page_id=(\d+)", 1).cast("bigint")
    return b.select(pid.alias("page_id"), FS.is_pdf().alias("is_pdf"), F.col("length").alias("n_bytes"))


@register("csv_design", with_views("""
select p_name as candidate_name, 'type "' || p_type || '", size ' || p_size as justification,
  cast(format('{:.3f}', p_retailprice / 2000) as double) as feasibility_score, cast(2 as integer) as n_parts
from part"""))
def q_csv_design(spark, sf):
    """S9 + K3: design rows with quotes, commas and a JSON list cell, written
    fully quoted and read back."""
    out = scratch_dir(spark, "design")
    part = table(spark, sf, "part")
    rows = part.select(
        F.col("p_name").alias("candidate_name"),
        F.concat(F.lit('type "'), F.col("p_type"), F.lit('", size '), F.col("p_size").cast("string")).alias("justification"),
        F.format_number(F.col("p_retailprice") / 2000, 3).alias("feasibility_score"),
        F.to_json(F.array(F.lit("$.rubric[0]"), F.concat(F.lit("$.cause_effect["),
                                                         (F.col("p_size") % 5).cast("string"), F.lit("]")))).alias("contract_parts"))
    rows.write.option("header", True).option("quoteAll", True).option("escape", '"').csv(out)
    d = FS.read_design_csv(spark, out)
    return d.select("candidate_name", "justification", "feasibility_score", F.size("contract_parts").alias("n_parts"))


def _json_sources_sql() -> str:
    one = ("select cast(question_id as varchar) as question_id, cast(gold as varchar) as gold_answer, "
           "cast(pred as varchar) as pred_answer, cast(trace_sim as varchar) as eval_score, '{src}' as src from qa_eval")
    every = " union all ".join(one.format(src=x) for x in ("lines", "arrays", "loose"))
    # Every seventh question's loose line is followed by a second object or by text.
    return with_views(f"""
select question_id, case when lost then null else gold_answer end as gold_answer, case when lost then null else pred_answer end as pred_answer,
  case when lost then null else eval_score end as eval_score, case when lost then 'quarantine' else src end as src
from (select *, src = 'loose' and cast(question_id as bigint) % 7 = 0 as lost from ({every}))""", "qa_eval")


def loose_line(q):
    """A row's JSON text, some with a comma after it."""
    return F.concat(F.to_json(F.struct(*q.columns)),
                    F.when(F.xxhash64("question_id", "arm", "domain") % 2 == 0, F.lit(",")).otherwise(F.lit("")))


@register("json_sources", _json_sources_sql())
def q_json_sources(spark, sf):
    """S1/S2/S3 + K1/K2: scored answers written as JSON lines, as arrays, and
    as loose lines (trailing commas; some followed by a second object or by
    text, which belong in quarantine), then read back by the matching loader."""
    q = qa_eval(spark, sf).select(
        F.col("question_id").cast("string").alias("question_id"), "arm", "domain",
        F.col("gold").cast("string").alias("gold_answer"), F.col("pred").cast("string").alias("pred_answer"),
        F.col("trace_sim").cast("string").alias("eval_score"))
    base = scratch_dir(spark, "json")
    # Compressed: the three forms as plain text are many times the table they come from.
    K.write_jsonl(q, f"{base}/lines.gz")
    # One array per arm and 64th of the question ids: files stay few as the data
    # grows, and are written and read as streams whatever their size.
    qb = q.withColumn("qblock", F.pmod(F.col("question_id").cast("bigint"), F.lit(64)))
    K.write_json_arrays(qb, f"{base}/arrays.gz", by=["arm", "qblock"], order=["question_id", "domain", "gold_answer"])
    junk = F.when(F.col("question_id").cast("bigint") % 14 == 0, F.lit('{"question_id":"none"}')).otherwise(F.lit(" and more"))
    loose = q.select(F.concat(loose_line(q), F.when(F.col("question_id").cast("bigint") % 7 == 0, junk).otherwise(F.lit(""))).alias("value"))
    K.write_text(loose, f"{base}/loose.gz")
    schema = SCORED_ANSWER_JSON
    s2 = JS.read_json_lines(spark, f"{base}/lines.gz", schema).drop("_corrupt_record").withColumn("src", F.lit("lines"))
    s1 = JS.read_json_arrays(spark, f"{base}/arrays.gz", schema).withColumn("src", F.lit("arrays"))
    s3, bad = JS.read_any_json(spark, f"{base}/loose.gz", schema)
    none = F.lit(None).cast("string")
    bad = bad.select(F.regexp_extract("line", r'"question_id":"([0-9]+)"', 1).alias("question_id"), none.alias("gold_answer"),
                     none.alias("pred_answer"), none.alias("eval_score"), F.lit("quarantine").alias("src"))
    s3 = s3.drop("source_file").withColumn("src", F.lit("loose"))
    cols = ["question_id", "gold_answer", "pred_answer", "eval_score", "src"]
    return s2.select(*cols).unionByName(s1.select(*cols)).unionByName(s3.select(*cols)).unionByName(bad)


@register("resume", with_views(
    "select doc_id, lang, cast(length(text) as integer) as n_chars from documents"))
def q_resume(spark, sf):
    """An earlier run wrote the English documents; the rerun skips them
    and writes the rest; the result is everything written."""
    out = scratch_dir(spark, "resume")
    docs = table(spark, sf, "documents").select("doc_id", "lang", F.length("text").alias("n_chars"))
    RES.write_outputs(docs.where(F.col("lang") == "en"), out, "doc_id")
    done = spark.read.parquet(out)
    todo = RES.pending(docs, done, "doc_id")
    RES.write_outputs(todo, out, "doc_id")
    # A forced document is recomputed and replaces its old rows.
    forced = docs.where(F.col("lang") == "en").groupBy().agg(F.min("doc_id")).first()[0]
    if forced is not None:
        RES.replace_keys(spark, docs.where(F.col("doc_id") == forced), out, "doc_id")
    return spark.read.parquet(out).select("doc_id", "lang", "n_chars")


@register("resume_versions", with_views(
    "select doc_id, lang, cast(length(text) as integer) as n_chars from documents"))
def q_resume_versions(spark, sf):
    """I2, merge on read: version 1 wrote the English documents with wrong sizes,
    version 2 the rest, version 3 the English ones anew; the versions are folded
    into a base after the second. The result is the newest of each document."""
    out = scratch_dir(spark, "versions")
    docs = table(spark, sf, "documents").select("doc_id", "lang", F.length("text").alias("n_chars"))
    english = docs.where(F.col("lang") == "en")
    RES.write_version(english.withColumn("n_chars", F.lit(-1)), out, 1)
    RES.write_version(RES.pending(docs, RES.read_newest(spark, out, "doc_id"), "doc_id"), out, 2)
    RES.compact(spark, out, "doc_id")
    RES.write_version(english, out, 3)
    return RES.read_newest(spark, out, "doc_id").select("doc_id", "lang", "n_chars")


@register("ledger_append", with_views("""
select '2025-01-01T00:00:00Z' as timestamp_utc, e.experiment_id, cast(r.document_id as varchar) as document_id,
  'answer' as agent_name, 'call' as event_name, cast(not starts_with(r.content, 'sorry') as integer) as success,
  cast(r.prompt_tokens as bigint) as prompt_tokens, cast(r.completion_tokens as bigint) as completion_tokens,
  cast(r.prompt_tokens + r.completion_tokens as bigint) as total_tokens, cast(r.latency as double) as latency_ms,
  'stub' as model_name
from responses r, (values ('exp-a'), ('exp-b')) e(experiment_id)""", "responses"))
def q_ledger_append(spark, sf):
    """K5: one ledger row per model call (response attempt), appended for two
    experiments (the second batch is run again and leaves one copy), read back."""
    out = scratch_dir(spark, "ledger")
    r = responses(spark, sf)
    rows = r.select(
        F.lit("2025-01-01T00:00:00Z").alias("timestamp_utc"), F.col("document_id").cast("string").alias("document_id"),
        F.lit("answer").alias("agent_name"), F.lit("call").alias("event_name"),
        (~F.col("content").startswith("sorry")).alias("success"),
        F.col("prompt_tokens").cast("bigint").alias("prompt_tokens"),
        F.col("completion_tokens").cast("bigint").alias("completion_tokens"),
        (F.col("prompt_tokens") + F.col("completion_tokens")).cast("bigint").alias("total_tokens"),
        F.col("latency").cast("double").alias("latency_ms"), F.lit("stub").alias("model_name"))
    for batch, exp in (("1", "exp-a"), ("2", "exp-b"), ("2", "exp-b")):
        K.ledger_append(rows.withColumn("experiment_id", F.lit(exp)), out, batch)
    return spark.read.schema(LEDGER).parquet(out).select(*[f.name for f in LEDGER.fields])


def _questions_sql() -> str:
    from docreason.plans.q_responses import _q as rq
    return rq("select * from questions", "questions")


@register("document_outputs", _questions_sql())
def q_document_outputs(spark, sf):
    """K4 + S5: questions written per document with a manifest; the manifest
    is appended twice (a rerun) and read back with later rows winning; the
    questions of each listed document are read through it."""
    from docreason.plans.q_responses import questions
    out = scratch_dir(spark, "docs")
    q = questions(spark, sf)
    manifest = K.write_per_document(q, f"{out}/questions")
    K.write_jsonl(manifest, f"{out}/manifest", mode="append")
    K.write_jsonl(manifest, f"{out}/manifest", mode="append")
    m = FS.read_manifest(spark, f"{out}/manifest")
    back = spark.read.schema(q.schema).json(f"{out}/questions").select(*q.columns)
    return back.join(m.withColumn("document_id", F.col("document_id").cast("bigint")), "document_id", "left_semi")


@register("url_ingest_stream", with_views(f"""
with u as (select distinct {S.strip('url')} as url from pages where length({S.strip('url')}) > 0)
select 'url' as field, url as value, 'pending' as status from u
union all select 'paper_id', cast(i as varchar), null from (select unnest(range((select count(*) from u))) as i)"""))
def q_url_ingest_stream(spark, sf):
    """URL lists (the pages' URLs, some repeated and padded) arrive as
    files; an availableNow stream ingests them batch by batch into the
    snapshot state, then a second run over the same folder adds nothing.
    Returns the state's URLs with their status, and its ids (which URL has
    which id follows the order of the files)."""
    from docreason.streaming.ingest import read_state, start_ingest_stream
    base = scratch_dir(spark, "ingest")
    p = table(spark, sf, "pages")
    lines = p.select(F.when(F.col("page_id") % 7 == 0, F.concat(F.lit(" \t"), F.col("url"), F.lit(" \t")))
                     .otherwise(F.col("url")).alias("value"))
    lines.write.text(f"{base}/lists")
    for _ in range(2):
        start_ingest_stream(spark, f"{base}/lists", f"{base}/state", f"{base}/ckpt").awaitTermination()
    state = read_state(spark, f"{base}/state")
    return state.select(F.lit("url").alias("field"), F.col("url").alias("value"), "status").unionByName(
        state.select(F.lit("paper_id").alias("field"), F.col("paper_id").cast("string").alias("value"), F.lit(None).cast("string").alias("status")))
