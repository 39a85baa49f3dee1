"""Queries: page blocks to records, references, labels, record texts (W1-W3,
P1, P2, P17, A28-A31, J4, K7, S6, U2, R2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from docreason.functions import prompts
from docreason.operators import blocks as BL
from docreason.plans import sqlfrag as S
from docreason.plans.oracle_views import with_views
from docreason.plans.registry import register
from docreason.plans.views import blocks as blocks_view, table


def blocks(spark, sf):
    """The derived block table: lazy, so each query reads the columns it needs."""
    return blocks_view(spark, sf)

TYPES_SPLIT = "('paragraph', 'caption', 'equation', 'reference_entry')"
MERGED = f"""select doc_id, pos, page, type,
  case when taken then text || ' ' || ntext else text end as text,
  case when taken then coalesce(lower({S.strip('cast(nsplit as varchar)')}) = 'true', false) else split end as split, ref
from (select *, coalesce(lag(taken) over (partition by doc_id order by page, pos), false) as consumed
      from (select *, edge and off % 2 = 0 as taken
            from (select *, sum(case when edge then 1 else 0 end) over (partition by doc_id, grp order by page, pos rows unbounded preceding) - 1 as off
                  from (select *, sum(case when edge then 0 else 1 end) over (partition by doc_id order by page, pos rows unbounded preceding) as grp
                        from (select *, coalesce(t in {TYPES_SPLIT} and flag and nt = t, false) as edge
                              from (select *, lead(t) over w as nt, lead(text) over w as ntext, lead(split) over w as nsplit
                                    from (select *, lower({S.strip("coalesce(cast(type as varchar), '')")}) as t,
                                                 coalesce(lower({S.strip('cast(split as varchar)')}) = 'true', false) as flag from blocks)
                                    window w as (partition by doc_id order by page, pos)))))))
where not consumed"""
INDEXED = "select *, cast(row_number() over (partition by doc_id order by page, pos) - 1 as integer) as idx from merged"
_KIND = f"lower({S.strip('type')})"
LABELS = (f"select doc_id, {_KIND} as kind, text as label, max(page) as page, min(page * 1000000 + pos) as first_seen "
          f"from blocks where {_KIND} in ('figure', 'table') and text is not null group by doc_id, {_KIND}, text")
PAGE_FILES = ("select distinct doc_id, page, 'docs/' || cast(doc_id as varchar) || '/pages/page-' || lpad(cast(page as varchar), 4, '0') || '.png' as path "
              "from blocks")


def _q(body: str, *extra: tuple[str, str]) -> str:
    ctes = [("merged", MERGED), ("indexed", INDEXED), ("labels", LABELS), ("page_files", PAGE_FILES)]
    return with_views(body, "blocks", extra=ctes + list(extra))


def recs(spark, sf):
    return BL.records(blocks(spark, sf))


@register("merge_blocks", _q("select * from merged"))
def q_merge(spark, sf):
    return BL.merge_split_blocks(blocks(spark, sf))


@register("block_index", _q("select * from indexed"))
def q_index(spark, sf):
    return recs(spark, sf)


@register("references", _q(f"""
select doc_id, ref, arg_max(coalesce(text, ''), idx) as text from indexed
where {_KIND} = 'reference_entry' and coalesce(ref, '') <> '' group by doc_id, ref"""))
def q_references(spark, sf):
    return BL.references(recs(spark, sf))


@register("labels", _q("select doc_id, kind, label, page from labels"))
def q_labels(spark, sf):
    return BL.label_pages(blocks(spark, sf)).select("doc_id", "kind", "label", "page")


@register("label_assets", _q("""
select l.doc_id, l.kind, l.label, l.page, p.path as src,
  'docs/' || cast(l.doc_id as varchar) || '/assets/' || l.label || '.png' as dst
from labels l join page_files p on p.doc_id = l.doc_id and p.page = l.page"""))
def q_label_assets(spark, sf):
    b = blocks(spark, sf)
    return BL.label_assets(BL.label_pages(b), BL.page_files(b))


PAGE_PATHS = ("select page_id // 10 as doc_id, cast(page_id // 10 as varchar) || '/pages/' || substr(md5(url), 1, 8) || "
              "case page_id % 5 when 0 then '.PNG' when 1 then '.txt' else '.png' end as path from pages")


@register("page_numbers", with_views("""
select doc_id, path, row_number() over (partition by doc_id order by path) as page
from page_paths where lower(path) like '%.png'""", extra=[("page_paths", PAGE_PATHS)]))
def q_page_numbers(spark, sf):
    p = table(spark, sf, "pages")
    doc = F.floor(F.col("page_id") / 10)
    suffix = F.when(F.col("page_id") % 5 == 0, ".PNG").when(F.col("page_id") % 5 == 1, ".txt").otherwise(".png")
    files = p.select(doc.alias("doc_id"), F.concat(doc.cast("string"), F.lit("/pages/"),
                                                   F.substring(F.md5("url"), 1, 8), suffix).alias("path"))
    return BL.number_pages(files).select("doc_id", "path", F.col("page").cast("bigint").alias("page"))


@register("format_records", _q("""
select doc_id, n_records, cast(length(s) as integer) as text_len, md5(s) as text_md5 from (
  select doc_id, count(*) as n_records,
    string_agg(chr(10) || ' type: ' || type || chr(10) || ' ' || text, chr(10) order by idx) as s
  from indexed group by doc_id)"""))
def q_format_records(spark, sf):
    r = recs(spark, sf)
    g = r.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_records"),
                                BL.ordered_join(BL.record_line(), "idx", "\n").alias("s"))
    return g.select("doc_id", "n_records", F.length("s").alias("text_len"), F.md5("s").alias("text_md5"))


def _json_str(x: str) -> str:
    return f"to_json({x}::VARCHAR)"


SEM_CLAIMS = ("claims AS select doc_id, count(*) as n_claims, string_agg('{\"idx\": ' || cast(idx as varchar) || ', \"type\": ' || "
              + _json_str("type") + " || ', \"text\": ' || " + _json_str("text") + " || '}', chr(10) order by idx) as claims "
              "from indexed where lower(coalesce(type, '')) not in ('unknown', 'reference_entry') group by doc_id")
SEM_LISTS = ("lists AS select doc_id, "
             "coalesce(to_json(list(label order by first_seen) filter (where kind = 'figure')), '[]') as figures, "
             "coalesce(to_json(list(label order by first_seen) filter (where kind = 'table')), '[]') as tables "
             "from labels group by doc_id")


@register("semantic_requests", _q(f"""
select c.doc_id, c.n_claims, md5(c.claims) as claims_md5,
  md5({prompts.sql_render(prompts.SEMANTIC_USER, figures="coalesce(l.figures, '[]')", tables="coalesce(l.tables, '[]')", claims="c.claims")}) as prompt_md5
from claims c left join lists l using (doc_id)""", tuple(SEM_CLAIMS.split(" AS ", 1)), tuple(SEM_LISTS.split(" AS ", 1))))
def q_semantic_requests(spark, sf):
    from docreason.operators.requests import semantic_requests
    b = blocks(spark, sf)
    return semantic_requests(BL.records(b), BL.label_pages(b)).select(
        "doc_id", "n_claims", F.md5("claims").alias("claims_md5"), F.md5("prompt").alias("prompt_md5"))


@register("label_keys", _q("""
select doc_id, kind, cast(case when doc_id % 5 = 0 then 0 else count(*) end as integer) as n_keys,
  case when doc_id % 5 <> 0 then arg_min(label, first_seen) end as first_key,
  case when doc_id % 5 <> 0 then arg_max(label, first_seen) end as last_key
from labels group by doc_id, kind"""))
def q_label_keys(spark, sf):
    """Each document's label map (label -> page, first-appearance order)
    as JSON object text, read back as its ordered keys; every fifth document's
    text is followed by more text, and has no keys."""
    from docreason.sources.json_sources import json_object_keys
    lab = BL.label_pages(blocks(spark, sf))
    entries = F.transform(F.array_sort(F.collect_list(F.struct(
        F.col("first_seen").alias("o"), F.struct(F.col("label").alias("key"), F.col("page").alias("value")).alias("e")))),
        lambda x: x["e"])
    maps = lab.groupBy("doc_id", "kind").agg(F.to_json(F.map_from_entries(entries)).alias("obj"))
    text = F.when(F.col("doc_id") % 5 == 0, F.concat("obj", F.lit(" junk"))).otherwise(F.col("obj"))
    keys = maps.select("doc_id", "kind", json_object_keys(text).alias("keys"))
    return keys.select("doc_id", "kind", F.size("keys").alias("n_keys"), F.try_element_at("keys", F.lit(1)).alias("first_key"),
                       F.try_element_at("keys", F.lit(-1)).alias("last_key"))
