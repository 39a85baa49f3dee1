"""Queries: model responses, questions, answers, contracts, requests (T1-T5,
P3-P8, P10-P13, P15, P16, P19-P21, P23, W4, W5, J1-J3, K6, A32, A33, R1,
R4-R7, F1, F2, S4)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from docreason.functions import jsonfn as J
from docreason.functions import prompts
from docreason.functions.scores import (PY_FLOAT_RE, bucketize, clip01, coerce_float, correct_bin,
                                        id_fallback, run_id, tri_anchor)
from docreason.operators import blocks as BL
from docreason.operators import qa as QA
from docreason.operators import requests as RQ
from docreason.operators import responses as RS
from docreason.plans import sqlfrag as S
from docreason.plans.oracle_views import with_views
from docreason.plans.q_blocks import INDEXED, MERGED
from docreason.plans.q_blocks import blocks as blocks_table
from docreason.plans.registry import register
from docreason.session import scratch_dir
from docreason.plans.views import qa_eval, raw_questions, raw_scores, responses, table, url_state

RETRIES = 3
DOC = "document_id"
FLAG_SETS = ["", "CC", "RAW_TEXT", "CC,RAW_TEXT"]


# ------------------------------------------------------------------ SQL side
def truthy(j: str, path: str) -> str:
    return (f"(CASE json_type({j}, '{path}') WHEN 'VARCHAR' THEN json_extract_string({j}, '{path}') <> '' "
            f"WHEN 'BOOLEAN' THEN json_extract({j}, '{path}')::BOOLEAN "
            f"WHEN 'BIGINT' THEN json_extract({j}, '{path}')::DOUBLE <> 0 WHEN 'UBIGINT' THEN json_extract({j}, '{path}')::DOUBLE <> 0 "
            f"WHEN 'DOUBLE' THEN json_extract({j}, '{path}')::DOUBLE <> 0 WHEN 'HUGEINT' THEN json_extract({j}, '{path}')::DOUBLE <> 0 "
            f"WHEN 'OBJECT' THEN json_extract({j}, '{path}')::VARCHAR <> '{{}}' "
            f"WHEN 'ARRAY' THEN json_array_length({j}, '{path}') > 0 ELSE false END)")


def _w(raw: str) -> str:
    return f"'[' || {raw} || ']'"


CTE = {
    "rl": ("select *, case when json_valid(" + _w("raw") + ") then json_array_length(" + _w("raw") + ") = 1 and json_type("
           + _w("raw") + ", '$[0]') = 'ARRAY' else false end as is_list from (select *, "
           "coalesce(nullif(regexp_extract(content, '(?s)\\[.*\\]', 0), ''), content) as raw from responses)"),
    "res": (f"select document_id, case when count(*) filter (where is_list and attempt <= {RETRIES}) > 0 then 'ok' else 'failed' end as status, "
            f"min(attempt) filter (where is_list and attempt <= {RETRIES}) as attempt, "
            f"max(attempt) filter (where attempt <= {RETRIES}) as last_attempt, "
            f"case when count(*) filter (where is_list and attempt <= {RETRIES}) = 0 then arg_max(content, attempt) filter (where attempt <= {RETRIES}) end as last_error, "
            f"count(*) filter (where attempt > {RETRIES}) as ignored_attempts "
            "from rl group by document_id"),
    "won": ("select r.document_id, r.attempt, l.raw, l.prompt_tokens, l.completion_tokens, l.latency from res r "
            "join rl l on l.document_id = r.document_id and l.attempt = r.attempt where r.status = 'ok'"),
    "items": ("select document_id, prompt_tokens, completion_tokens, latency, cast(i as integer) as item_pos, "
              "json_extract(raw, '$[' || i || ']') as item from (select *, unnest(range(cast(json_array_length(raw) as bigint))) as i from won)"),
    "ans": ("select document_id, item_pos, json_extract_string(item, '$.question_id') as question_id, "
            "json_extract_string(item, '$.answer') as pred_answer, json_extract_string(item, '$.explanation') as pred_trace, "
            "prompt_tokens, completion_tokens, latency from items where " + truthy("item", "$.question_id") + " and "
            + truthy("item", "$.answer") + " and " + truthy("item", "$.explanation")),
    "vq": ("select document_id, pos, raw from raw_questions where case when json_valid(raw) then "
           "json_type(raw) = 'OBJECT' and json_exists(raw, '$.category') and json_exists(raw, '$.question') "
           "and json_exists(raw, '$.contract_id') and json_exists(raw, '$.gold_answer') "
           "and coalesce(json_type(raw, '$.question') = 'VARCHAR' and json_extract_string(raw, '$.question') <> '', false) "
           "and coalesce(json_type(raw, '$.contract_id') = 'VARCHAR', false) "
           "and coalesce(json_type(raw, '$.gold_answer') = 'OBJECT' and json_extract(raw, '$.gold_answer')::VARCHAR <> '{}', false) "
           "else false end"),
    "questions": ("select document_id, pos, cast(document_id as varchar) || '-' || cast(i as varchar) as question_id, "
                  "json_extract_string(raw, '$.category') as question_type, json_extract_string(raw, '$.question') as question, "
                  "json_extract_string(raw, '$.gold_answer.answer') as gold_answer, "
                  "json_extract_string(raw, '$.gold_answer.explanation') || case when len(paths) > 0 then chr(10) || array_to_string(paths, chr(10)) else '' end as gold_trace, "
                  "json_extract_string(raw, '$.gold_answer.notes') as notes, json_extract_string(raw, '$.contract_id') as contract_id "
                  "from (select *, row_number() over (partition by document_id order by pos) as i, "
                  "coalesce(json_extract_string(raw, '$.gold_answer.paths[*]'), []::VARCHAR[]) as paths from vq) "
                  "where " + truthy("raw", "$.gold_answer.answer") + " and " + truthy("raw", "$.gold_answer.explanation")),
    "answer_join": ("select a.*, q.question, q.question_type, q.gold_answer, q.gold_trace, q.notes "
                    "from ans a join questions q on q.document_id = a.document_id and q.question_id = a.question_id"),
    "contracts": ("select document_id, cast(document_id as varchar) || '-' || cast(item_pos as varchar) as contract_id, "
                  "item_pos as i, item::VARCHAR as contract_json from items"),
    "contracts_doc": ("select document_id, count(*) as n_contracts, '[' || string_agg(contract_json, ',' order by i) || ']' as contracts "
                      "from contracts group by document_id"),
    "merged": MERGED,
    "indexed": INDEXED,
    "rec_text": ("select doc_id as document_id, string_agg(chr(10) || ' type: ' || type || chr(10) || ' ' || text, chr(10) order by idx) as records_text "
                 "from indexed group by doc_id"),
}
ORDER = ["rl", "res", "won", "items", "ans", "vq", "questions", "answer_join", "contracts", "contracts_doc",
         "merged", "indexed", "rec_text", "rec_json"]


def _q(body: str, *needs: str, views=("responses", "raw_questions")) -> str:
    want = set(needs)
    deps = {"res": {"rl"}, "won": {"res", "rl"}, "items": {"won"}, "ans": {"items"}, "questions": {"vq"},
            "answer_join": {"ans", "questions"}, "contracts": {"items"}, "contracts_doc": {"contracts"},
            "indexed": {"merged"}, "rec_text": {"indexed"}, "rec_json": {"indexed"}}
    changed = True
    while changed:
        changed = False
        for n in list(want):
            for d in deps.get(n, ()):
                if d not in want:
                    want.add(d)
                    changed = True
    extra = [(n, CTE[n]) for n in ORDER if n in want]
    vs = list(views) + (["blocks"] if "merged" in want else [])
    return with_views(body, *vs, extra=extra)


# ---------------------------------------------------------------- Spark side
def parsed_responses(spark, sf):
    return RS.parse_list(responses(spark, sf))


def resolved(spark, sf):
    return RS.resolve_attempts(parsed_responses(spark, sf), [DOC], "is_list",
                               ["items", "prompt_tokens", "completion_tokens", "latency"], retries=RETRIES, error="content")


def won_items(spark, sf):
    return resolved(spark, sf).where(F.col("status") == "ok")


def won_texts(spark, sf):
    """The winning attempts with their items and the items' texts."""
    r = RS.resolve_attempts(parsed_responses(spark, sf), [DOC], "is_list", ["items", "texts"], retries=RETRIES)
    return r.where(F.col("status") == "ok")


def questions(spark, sf):
    q, _ = QA.questions_from_records(raw_questions(spark, sf))
    return q


def answers(spark, sf):
    return QA.join_answers(QA.answer_items(won_items(spark, sf)), questions(spark, sf))


def contracts(spark, sf):
    return QA.contract_ids(won_texts(spark, sf))


def contracts_doc(spark, sf):
    return RQ.contracts_json(contracts(spark, sf))


def records_text(spark, sf):
    r = BL.records(blocks_table(spark, sf))
    return r.groupBy(F.col("doc_id").alias(DOC)).agg(
        BL.ordered_join(BL.record_line(), "idx", "\n").alias("records_text"))


@register("parse_list_responses", _q(
    "select document_id, attempt, is_list, case when is_list then cast(json_array_length(raw) as integer) end as n_items from rl", "rl"))
def q_parse_list(spark, sf):
    p = parsed_responses(spark, sf)
    return p.select(DOC, "attempt", "is_list", F.when(F.col("is_list"), F.size("items")).alias("n_items"))


@register("resolve_attempts", _q("""
select r.document_id, r.status, r.attempt, cast(json_array_length(l.raw) as integer) as n_items,
  l.prompt_tokens, l.completion_tokens, l.latency, r.last_attempt, r.last_error, r.ignored_attempts
from res r left join rl l on l.document_id = r.document_id and l.attempt = r.attempt""", "res", "rl"))
def q_resolve(spark, sf):
    return resolved(spark, sf).select(DOC, "status", "attempt", F.size("items").alias("n_items"),
                                      "prompt_tokens", "completion_tokens", "latency", "last_attempt", "last_error",
                                      "ignored_attempts")


SCORE_STATUS = ("case when content is null then 'parse_error' "
                "when lower(s) in ('nan', '+nan', '-nan') then 'rejected' "
                f"when not regexp_matches(s, '{PY_FLOAT_RE}') or v is null then 'parse_error' "
                "when v > -1 then 'ok' else 'rejected' end")
SCORE_BASE = ("select id, content, s, case when regexp_matches(s, '" + PY_FLOAT_RE + "') then try_cast(replace(s, '_', '') as double) end as v "
              "from (select id, content, regexp_replace(content, '^\\s+|\\s+$', '', 'g') as s from raw_scores)")


@register("parse_scores", with_views(f"""
select id, status, case when status = 'ok' then v end as score from (select id, v, {SCORE_STATUS} as status from sb)""",
                                      "raw_scores", extra=[("sb", SCORE_BASE)]))
def q_parse_scores(spark, sf):
    return RS.parse_score(raw_scores(spark, sf)).select("id", "status", "score")


@register("coerce_scores", with_views(f"""
select id_key, value, clipped, gold, abs(clipped - gold) as abs_err, 1 - abs(clipped - gold) as score_cont,
  coalesce(cast(abs(clipped - gold) <= 0.15::DOUBLE as integer), 0) as correct_bin, clipped - gold as residual,
  {S.tri('clipped')} as tri, {S.bucket('clipped')} as bucket
from (select coalesce(cast(case when id % 9 <> 0 then id end as varchar), substr(coalesce(content, ''), 1, 64)) as id_key, nv as value,
             {S.clip('nv')} as clipped, cast(id % 11 as double) / 10 as gold
      from (select *, case when isnan(v) then null else v end as nv from sb))""",
                                       "raw_scores", extra=[("sb", SCORE_BASE)]))
def q_coerce_scores(spark, sf):
    r = raw_scores(spark, sf)
    known = F.when(F.col("id") % 9 != 0, F.col("id"))  # some records come without an id
    d = (r.select(id_fallback(known, "content").alias("id_key"), coerce_float("content").alias("value"),
                  ((F.col("id") % 11).cast("double") / 10).alias("gold"))
         .withColumn("clipped", clip01("value")))
    err = F.abs(F.col("clipped") - F.col("gold"))
    return d.select("id_key", "value", "clipped", "gold", err.alias("abs_err"), (1 - err).alias("score_cont"),
                    correct_bin(err).alias("correct_bin"), (F.col("clipped") - F.col("gold")).alias("residual"),
                    tri_anchor("clipped").alias("tri"), bucketize("clipped").alias("bucket"))


@register("run_ids", with_views("select event_id, strftime(ts, '%Y%m%d-%H%M%S') as run_id from events"))
def q_run_ids(spark, sf):
    """The run id format, of the events' times."""
    return table(spark, sf, "events").select("event_id", run_id(F.col("ts")).alias("run_id"))


@register("valid_questions", _q("select * from questions", "questions"))
def q_valid_questions(spark, sf):
    return questions(spark, sf)


@register("answer_join", _q("select * from answer_join", "answer_join"))
def q_answer_join(spark, sf):
    return answers(spark, sf)


@register("contract_ids", _q("select document_id, contract_id, i, md5(contract_json) as contract_md5 from contracts", "contracts"))
def q_contract_ids(spark, sf):
    return contracts(spark, sf).select(DOC, "contract_id", "i", F.md5("contract_json").alias("contract_md5"))


def _ctx_sql(flags: str) -> str:
    parts = []
    if "CC" in flags:
        parts.append("chr(10) || '[CONTRACT]' || chr(10) || ' ' || c.contracts")
    if "RAW_TEXT" in flags:
        parts.append("chr(10) || '[RAW_TEXT]' || chr(10) || ' ' || coalesce(t.records_text, '')")
    return " || chr(10) || ".join(parts) if parts else "'-'"


def _answer_ctx_sql() -> str:
    sel = " union all ".join(
        f"select d.document_id, '{f}' as flags, case when c.contracts is null then 'missing_contract' else 'ok' end as status, "
        f"md5(case when c.contracts is not null then {_ctx_sql(f)} end) as context_md5 "
        f"from (select distinct document_id from questions) d left join contracts_doc c using (document_id) "
        f"left join rec_text t using (document_id)" for f in FLAG_SETS)
    return _q(sel, "questions", "contracts_doc", "rec_text")


@register("answer_context", _answer_ctx_sql())
def q_answer_context(spark, sf):
    docs = questions(spark, sf).select(DOC).distinct()
    j = docs.join(contracts_doc(spark, sf), DOC, "left").join(records_text(spark, sf), DOC, "left")
    text = F.coalesce(F.col("records_text"), F.lit(""))
    cases = F.array(*[F.struct(F.lit(f).alias("flags"), F.md5(F.when(
        F.col("contracts").isNotNull(), F.array_join(QA.context_parts(f, F.col("contracts"), text), "\n"))).alias("context_md5"))
        for f in FLAG_SETS])
    return j.select(DOC, F.when(F.col("contracts").isNull(), "missing_contract").otherwise("ok").alias("status"),
                    F.explode(cases).alias("c")).select(DOC, "c.flags", "status", "c.context_md5")


@register("answer_requests", _q(f"""
select q.document_id, q.n_questions, md5({prompts.sql_render(prompts.ANSWER_USER, questions='q.qs', context=_ctx_sql('CC,RAW_TEXT'))}) as prompt_md5
from (select document_id, count(*) as n_questions,
        '[' || string_agg(json_object('question_id', question_id, 'question_type', question_type, 'question', question)::VARCHAR, ',' order by pos) || ']' as qs
      from questions group by document_id) q
join contracts_doc c using (document_id) left join rec_text t using (document_id)""", "questions", "contracts_doc", "rec_text"))
def q_answer_requests(spark, sf):
    req, _ = RQ.answer_requests(questions(spark, sf), records_text(spark, sf), contracts_doc(spark, sf), "CC,RAW_TEXT")
    return req.select(DOC, "n_questions", F.md5("prompt").alias("prompt_md5"))


SCORE_FIELDS = ["question_id", "question", "gold_answer", "gold_trace", "pred_answer", "pred_trace"]


@register("score_requests", _q(f"""
select document_id, question_id, item_pos,
  md5({prompts.sql_render(prompts.SCORE_USER, answer="json_object(" + ", ".join(f"'{c}', {c}" for c in SCORE_FIELDS) + ")::VARCHAR")}) as prompt_md5
from answer_join""", "answer_join"))
def q_score_requests(spark, sf):
    r = RQ.score_requests(answers(spark, sf), SCORE_FIELDS)
    return r.select(DOC, "question_id", "item_pos", F.md5("prompt").alias("prompt_md5"))


CTE["rec_json"] = ("select doc_id as document_id, '[' || string_agg(json_object('idx', idx, 'page', page, 'type', type, 'text', text)::VARCHAR, ',' order by idx) || ']' as records_json "
            "from indexed group by doc_id")


@register("question_requests", _q(f"""
select c.document_id, c.n_contracts,
  md5({prompts.sql_render(prompts.QUESTIONS_USER, raw_text='r.records_json', contracts='c.contracts')}) as prompt_md5
from contracts_doc c join rec_json r using (document_id)""", "contracts_doc", "rec_json"))
def q_question_requests(spark, sf):
    recs = BL.records(blocks_table(spark, sf)).withColumnRenamed("doc_id", DOC)
    req, _ = RQ.question_requests(RQ.records_json(recs, DOC), contracts_doc(spark, sf))
    return req.select(DOC, "n_contracts", F.md5("prompt").alias("prompt_md5"))


DESIGN_ID = "1-0"


@register("design_request", _q(f"""
select contract_id, md5({prompts.sql_render(prompts.DESIGN_USER, contract='contract_json')}) as prompt_md5
from (select contract_id, arg_min(contract_json, document_id * 1000000 + i) as contract_json
      from contracts where contract_id = '{DESIGN_ID}' group by contract_id)""", "contracts"))
def q_design_request(spark, sf):
    c = QA.first_contract(contracts(spark, sf), DESIGN_ID, [DOC, "i"])
    return RQ.design_request(c).select("contract_id", F.md5("prompt").alias("prompt_md5"))


@register("page_requests", with_views("""
select page_id, 'data:' || mime || ';base64,' || base64(encode(html)) as image_url from (
  select page_id, html, case when sfx = 'png' then 'image/png' else 'image/' || sfx end as mime from (
    select page_id, html, case when sfx0 = '' then 'png' else sfx0 end as sfx from (
      select page_id, html, lower(case when contains(nm, '.') then string_split(nm, '.')[-1] else '' end) as sfx0 from (
        select page_id, html, string_split(url, '/')[-1] as nm from pages))))"""))
def q_page_requests(spark, sf):
    p = table(spark, sf, "pages").select("page_id", F.col("url").alias("path"),
                                        F.col("html").cast("binary").alias("content"))
    return RQ.page_requests(p).select("page_id", "image_url")


@register("object_responses", with_views("""
select event_id, event_id % 5 > 1 and json_valid(props) and json_type(props) = 'OBJECT' as is_object,
  case when event_id % 5 > 1 and json_valid(props) then json_extract(props, '$.k')::BIGINT end as k,
  cast(length(trim(props)) + case event_id % 5 when 0 then 5 when 1 then 3 else 0 end as integer) as text_len
from events"""))
def q_object_responses(spark, sf):
    """T2 + T4: events' properties as responses; some are followed by text, some
    by a second value, and neither is an object."""
    after = F.when(F.col("event_id") % 5 == 0, F.lit(" junk")).when(F.col("event_id") % 5 == 1, F.lit(" {}")).otherwise(F.lit(""))
    e = table(spark, sf, "events").select("event_id", F.concat("props", after).alias("content"))
    o = QA.pick_keys(RS.parse_text(RS.parse_object(e)), ["event_id", "value", "text", "missing_key"])
    return o.select("event_id", F.coalesce(J.vtype("value").startswith("OBJECT"), F.lit(False)).alias("is_object"),
                    F.try_variant_get("value", "$.k", "bigint").alias("k"), F.length("text").alias("text_len"))


@register("upper_titles", with_views(
    "select p_partkey as id, p_name as original_title, upper(coalesce(p_name, '')) as processed_title from part"))
def q_upper_titles(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("original_title"),
                                          F.upper(F.coalesce("p_name", F.lit(""))).alias("processed_title"))


@register("stage_counts", _q(f"""
select 'documents_in' as counter, count(distinct document_id) as value from raw_questions
union all select 'valid_records', count(*) from vq
union all select 'questions', count(*) from questions
union all select 'responses_ok', count(*) filter (where status = 'ok') from res
union all select 'responses_failed', count(*) filter (where status = 'failed') from res
union all select 'answers', count(*) from answer_join
union all select 'scores_ok', count(*) from (select {SCORE_STATUS} as status from sb) where status = 'ok'
union all select 'domains', count(distinct domain) from qa_eval
union all select 'arms', count(distinct arm) from qa_eval""", "answer_join", "res",
    views=("responses", "raw_questions", "raw_scores", "qa_eval")).replace(
    "\nselect 'documents_in'", f",\nsb AS ({SCORE_BASE})\nselect 'documents_in'", 1))
def q_stage_counts(spark, sf):
    def counts(df, **values):
        """One pass over a table: a row for each of its counters."""
        return df.agg(*[v.alias(k) for k, v in values.items()]).select(F.explode(F.array(*[
            F.struct(F.lit(k).alias("counter"), F.col(k).alias("value")) for k in values])).alias("c")).select("c.counter", "c.value")
    status = F.col("status")
    parts = [
        counts(QA.validate_question_records(raw_questions(spark, sf)), documents_in=F.count_distinct(DOC), valid_records=F.count_if("valid")),
        counts(questions(spark, sf), questions=F.count(F.lit(1))),
        counts(resolved(spark, sf), responses_ok=F.count_if(status == "ok"), responses_failed=F.count_if(status == "failed")),
        counts(answers(spark, sf), answers=F.count(F.lit(1))),
        counts(RS.parse_score(raw_scores(spark, sf)), scores_ok=F.count_if(status == "ok")),
        counts(qa_eval(spark, sf), domains=F.count_distinct("domain"), arms=F.count_distinct("arm")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("url_ingest", with_views(f"""
select i.url, coalesce(s.page_id, (select max(page_id) from url_state where known_status is not null)
         + row_number() over (partition by s.page_id is null order by i.first_pos)) as paper_id,
  s.page_id is null as is_new, 'pending' as status,
  case when suffix(string_split(i.url, '/')[-1], 'pdf') then string_split(i.url, '/')[-1]
       else string_split(i.url, '/')[-1] || '.pdf' end as file_name
from (select {S.strip('url')} as url, min(page_id) as first_pos from url_state where length({S.strip('url')}) > 0 group by {S.strip('url')}) i
left join (select url, min(page_id) as page_id, max(known_status) as known_status from url_state
           where known_status is not null group by url) s on s.url = i.url
where coalesce(s.known_status, '') <> 'processed'""", "url_state"))
def q_url_ingest(spark, sf):
    from docreason.streaming.ingest import plan_urls
    u = url_state(spark, sf)
    incoming = u.select(F.col("url").alias("url"), F.col("page_id").alias("line_no"))
    state = u.where(F.col("known_status").isNotNull()).select(
        F.col("page_id").alias("paper_id"), "url", F.col("known_status").alias("status"))
    return plan_urls(incoming, state).select("url", "paper_id", "is_new", "status", "file_name")


def _stub_model(pdf: pd.DataFrame) -> pd.DataFrame:
    """Deterministic stand-in for a model: echoes a short JSON answer."""
    n = pdf["prompt"].fillna("").str.len()
    return pd.DataFrame({DOC: pdf[DOC], "attempt": pdf["attempt"],
                         "content": '{"n_chars": ' + n.astype(str) + "}"})


@register("batch_infer", with_views("""
select document_id, attempt, '{"n_chars": ' || length(content) || '}' as content, cast(length(content) as bigint) as n_chars from responses""", "responses"))
def q_batch_infer(spark, sf):
    req = responses(spark, sf).select(DOC, "attempt", F.col("content").alias("prompt"))
    out = RS.batch_infer(req, _stub_model, f"{DOC} bigint, attempt int, content string")
    return RS.transform(out, lambda c: F.try_variant_get(F.try_parse_json(c), "$.n_chars", "bigint"), "n_chars")


@register("attempt_rounds", _q("""
select r.document_id, r.status, r.attempt, cast(json_array_length(l.raw) as integer) as n_items, l.prompt_tokens, l.completion_tokens, r.last_error,
  (select count(*) from rl a where a.document_id = r.document_id and a.attempt <= coalesce(r.attempt, """ + str(RETRIES) + """)) as n_rows
from res r left join rl l on l.document_id = r.document_id and l.attempt = r.attempt""", "res", "rl"))
def q_attempt_rounds(spark, sf):
    """T5 + F2: every document is asked in rounds; the given table of attempts
    stands for the model. Equal to the outcome on all attempts, and no row of
    an attempt after the winning one was asked for."""
    given = parsed_responses(spark, sf)
    todo = given.select(DOC).distinct()
    rounds = RS.request_rounds(todo, [DOC], lambda left: left.join(given, [DOC, "attempt"]), "is_list",
                               scratch_dir(spark, "rounds"), retries=RETRIES)
    asked = rounds.groupBy(DOC).agg(F.count(F.lit(1)).alias("n_rows"))
    out = RS.resolve_rounds(todo, rounds, [DOC], "is_list", ["items", "prompt_tokens", "completion_tokens"], retries=RETRIES, error="content")
    return out.join(asked, DOC, "left").select(
        DOC, "status", "attempt", F.size("items").alias("n_items"), "prompt_tokens", "completion_tokens", "last_error",
        F.coalesce("n_rows", F.lit(0)).alias("n_rows"))


# The winning response items stand for a document's reasoning steps.
@register("contract_requests", _q(f"""
select document_id, md5({prompts.sql_render(prompts.CONTRACT_USER, steps="'[' || string_agg(item::VARCHAR, ',' order by item_pos) || ']'")}) as prompt_md5
from items group by document_id""", "items"))
def q_contract_requests(spark, sf):
    steps = QA.item_texts(won_texts(spark, sf)).select(DOC, F.col("i").alias("step"), F.col("item_json").alias("step_json"))
    return RQ.contract_requests(steps).select(DOC, F.md5("prompt").alias("prompt_md5"))
