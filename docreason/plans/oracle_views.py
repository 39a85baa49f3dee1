"""The derived views in DuckDB's dialect, used as CTEs of the oracle SQL."""

QA_EVAL = """select l_partkey as question_id, l_linestatus as domain,
  case l_linenumber % 4 when 1 then 'baseline' when 2 then 'raw_text'
       when 3 then 'raw_text_contract' else 'contract' end as arm,
  round(l_discount * 10, 1) as gold,
  case when l_orderkey % 13 = 0 then null
       else cast(cast(l_quantity as int) % 11 as double) / 10 end as pred,
  case when l_orderkey % 17 = 0 then null else l_quantity / 50 end as trace_sim
from lineitem"""

BLOCKS = """select doc_id, pos, pos // 4 + 1 as page,
  case when (doc_id + pos) % 13 = 1 then chr(9) else '' end ||
  (['title','abstract','section_header','paragraph','paragraph','caption',
    'figure','table','equation','reference_entry','unknown'])[(doc_id * 31 + (pos // 4) * 7) % 11 + 1]
  || case when (doc_id + pos) % 13 = 0 then chr(10) else '' end as type,
  line as text, (doc_id + pos) % 5 <> 0 as split, '[' || (pos % 5) || ']' as ref
from (select doc_id, unnest(string_split(text, chr(10))) as line,
             unnest(range(len(string_split(text, chr(10))))) as pos from documents)"""

RAW_SCORES = """select event_id as id,
  case event_id % 10 when 0 then '1.0' when 1 then ' 0.25 ' when 2 then 'n/a' when 3 then null
       when 4 then '1.7' when 5 then '-0.2' when 6 then '1e-1' when 7 then 'nan' when 8 then '-1'
       else concat('0.', lpad(cast(event_id % 1000 as varchar(10)), 3, '0')) end as content
from events"""

RAW_QUESTIONS = """select event_id // 10 as document_id, event_id % 10 as pos,
  concat('{"category":"', event_type, '"',
    case event_id % 12 when 0 then '' when 2 then ',"contract_id":7' else ',"contract_id":"1-0"' end,
    ',"question":"', case event_id % 12 when 1 then '' else concat('q', cast(event_id as varchar)) end, '"',
    ',"gold_answer":',
    case event_id % 12 when 3 then '[]'
      when 4 then '{"answer":"0.5","paths":["a -> b"]}'
      when 5 then '{"answer":0,"explanation":"e","paths":[]}'
      else '{"answer":"0.5","explanation":"e","paths":["a -> b","b -> c"],"notes":"n"}' end, '}') as raw
from events"""

RESPONSES = """select document_id, attempt,
  case when attempt = 1 and document_id % 3 = 0 then 'sorry, no list'
       when document_id % 7 = 0 then '{"question_id":"x","answer":"1"}'
       else concat('Here it is: [', objs, '] done') end as content,
  100 + document_id % 50 as prompt_tokens, 10 * attempt as completion_tokens,
  cast(200 + 7 * attempt + document_id % 13 as bigint) as latency
from (select event_id // 10 as document_id,
        string_agg(concat('{"question_id":"',
          case when event_id % 10 = 9 then 'unknown' else concat(cast(event_id // 10 as varchar), '-', cast(greatest(event_id % 10, 1) as varchar)) end,
          '","answer":"', case when event_id % 11 = 0 then '' else concat('0.', cast(event_id % 10 as varchar)) end,
          '","explanation":"e', cast(event_id as varchar), '"}'), ',' order by event_id) as objs
      from events group by event_id // 10) cross join (values (1), (2)) as a(attempt)"""

URL_STATE = """select page_id, url,
  case page_id % 4 when 0 then 'processed' when 1 then 'validation_failed' else null end as known_status
from pages"""

VIEWS = {
    "qa_eval": QA_EVAL,
    "blocks": BLOCKS,
    "raw_scores": RAW_SCORES,
    "raw_questions": RAW_QUESTIONS,
    "responses": RESPONSES,
    "url_state": URL_STATE,
}


def with_views(body: str, *views: str, extra: list[tuple[str, str]] | None = None) -> str:
    """Prefix ``body`` with the named views (and extra CTEs) as a WITH clause."""
    ctes = [f"{v} AS ({VIEWS[v]})" for v in views]
    ctes += [f"{name} AS ({sql})" for name, sql in (extra or [])]
    if not ctes:
        return body
    return "WITH " + ",\n".join(ctes) + "\n" + body
