"""The registered queries of the package and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docreason.llm import alignment, decontam, langid, licenses, packing, pii, rules, simhash, suffixes, toxicity, trie, url_filters, warc
from docreason.llm.common import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return deco


@query("op10_language_id")
def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return (langid.identify(docs, langid.train(docs))
            .select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "rejected"))


@query("op6_simhash")
def simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"), shingle=4, max_bits=4)


@query("op8_decontamination")
def benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), window=10)
    width = F.zip_with("starts", "ends", lambda a, b: b - a)
    n_hit = F.aggregate(width, F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


@query("op3_pii")
def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(read_table(spark, sf_dir, "documents"))
    spans = F.arrays_zip("kinds", "starts", "ends", "base")
    base = F.filter(spans, lambda x: x["base"])

    def listed(s):
        return F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kinds"], x["starts"], x["ends"])), ",")

    def count(kind):
        return F.size(F.filter(base, lambda x: x["kinds"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(spans).alias("spans"))


def tokenizer_file(name: str) -> str:
    """The public tokenizer file; its folder is a parameter of the machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op5_best_fit_packing")
def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), size=2048)


@query("op1_suffix_dedup")
def suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(read_table(spark, sf_dir, "documents"), length=400)


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


@query("op9_quality_rules", rf"""
with w as (
  select row_number() over () as rid, doc_id, coalesce(text, '') as text, {_WORDS} as words from documents),
g as (
  select rid, i, array_to_string(words[i:i + 4], ' ') as win
  from (select rid, words, unnest(range(1, len(words) - 3)) as i from w where len(words) >= 5)),
r as (select rid, i from (select rid, i, count(*) over (partition by rid, win) as n from g) where n > 1),
rep as (select rid, count(distinct p) as n_repeat_words from (select rid, unnest(range(i, i + 5)) as p from r) group by rid),
l as (
  select rid, count(*) as n_lines, count(*) - count(distinct x) as n_dup_lines
  from (select rid, unnest(string_split(text, chr(10))) as x from w) where regexp_matches(x, '[^\x20\x09-\x0D]') group by rid),
m as (
  select w.doc_id, len(words)::bigint as n_words, length(array_to_string(words, ''))::bigint as word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::bigint as n_symbols,
    coalesce(n_lines, 0)::bigint as n_lines, coalesce(n_dup_lines, 0)::bigint as n_dup_lines,
    coalesce(n_repeat_words, 0)::bigint as n_repeat_words
  from w left join l using (rid) left join rep using (rid)),
b as (
  select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
    ({' + '.join(f'case when {test} then {rules.BIT[name]} else 0 end' for name, test in rules.RULES)})::bigint as failure_bits
  from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and (failure_bits & {rules.POLICIES[rules.CURRENT]}) = 0 as kept, n_lines, failure_bits
from b""")
def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = rules.ledger(read_table(spark, sf_dir, "documents"))
    base_failed = ~rules.passes(F.col("failure_bits"), "base")
    return entries.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"),
        (~base_failed & rules.passes(F.col("failure_bits"))).alias("kept"), "n_lines", "failure_bits")


def _license_sql() -> str:
    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    def words(text: str) -> str:
        return (f"regexp_extract_all(translate({text}, '{licenses.UPPER}', '{licenses.LOWER}'), "
                r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")

    templates = ", ".join(f"({i}, {quoted(label)}, {quoted(t)})" for i, (label, t) in enumerate(licenses.TEMPLATES))
    phrases = ", ".join(f"({quoted(p)}, {len(p.split())}, {quoted(label)})" for p, label in licenses.PHRASES)
    return f"""
with d as (select row_number() over () as rid, doc_id, {words("coalesce(text, '')")} as words from documents),
t as (select template, label, {words("text")} as words from (values {templates}) x(template, label, text)),
tw as (select template, label, len(words) - 2 as n, q, array_to_string(words[q:q + 2], ' ') as win
       from (select *, unnest(range(1, len(words) - 1)) as q from t)),
dw as (select rid, pos, array_to_string(words[pos:pos + 2], ' ') as win
       from (select rid, words, unnest(range(1, len(words) - 1)) as pos from d where len(words) >= 3)),
diag as (select rid, template, label, n, pos - q as diagonal from dw join tw using (win) group by all),
grp as (select *, sum(fresh) over (partition by rid, template order by diagonal) as span
        from (select *, case when diagonal - lag(diagonal) over (partition by rid, template order by diagonal) <= {licenses.SHIFT}
                        then 0 else 1 end as fresh from diag)),
cov as (select g.rid, g.label, count(distinct tw.q) / any_value(g.n) as cover
        from grp g join dw using (rid) join tw on tw.win = dw.win and tw.template = g.template and dw.pos - tw.q = g.diagonal
        group by g.rid, g.template, g.label, g.span),
good as (select rid, label, cover from cov where cover >= {licenses.COVER}),
place as (select rid, i - 1 as q, label
          from (select rid, words, unnest(range(1, len(words) + 1)) as i from d) w
          join (values {phrases}) p(phrase, size, label) on array_to_string(words[i:i + size - 1], ' ') = phrase),
base as (select rid, count(*) as n_base, min(q) as first_word, max(q) as last_word,
                string_agg(distinct label, ',' order by label) as base_labels from place group by rid),
labels as (select rid, string_agg(distinct label, ',' order by label) as labels
           from (select rid, label from place union all select rid, label from good) group by rid),
best as (select rid, max(cover) as cover from good group by rid)
select doc_id, len(words)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word, last_word,
  coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels,
  case when n_base > 0 then 1.0::double else coalesce(cover, 0)::double end as score
from d left join base using (rid) left join labels using (rid) left join best using (rid)"""


@query("op7_license_scan", _license_sql())
def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read_table(spark, sf_dir, "documents"))


@query("op2_warc", """
with p as (select page_id, coalesce(html, '') as html from pages),
s as (select page_id, strlen(html)::bigint as payload_bytes, sha1(html) as payload_digest from p),
f as (select payload_digest, max(page_id) as first_id from s where payload_bytes >= 1000 group by all having count(*) > 1)
select page_id, payload_bytes, s.payload_digest,
  case when first_id is not null and page_id is distinct from first_id then 'revisit' else 'response' end as record_type,
  case when page_id is distinct from first_id then first_id end as refers_to
from s left join f on s.payload_digest = f.payload_digest and payload_bytes >= 1000""")
def warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read_table(spark, sf_dir, "pages"), revisit_from=1000)


#: Captures and a dated list derived from ``pages``: fetch times spread over a
#: year from START; of the hosts and their domains about half are listed.
START, YEAR = 1704067200, 31536000


def page_captures(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url", (F.lit(START) + F.pmod(F.col("page_id") * 48271, F.lit(YEAR))).alias("fetched_at"))


def dated_list(pages: DataFrame) -> DataFrame:
    host = pages.select(url_filters.host_of(F.col("url")).alias("host")).where("host is not null").distinct()
    pattern = host.select(F.explode(F.array("host", F.substring_index("host", ".", -2))).alias("pattern")).distinct()
    v = F.conv(F.substring(F.md5("pattern"), 1, 6), 16, 10).cast("long")
    added = F.lit(START) + (F.col("v") * 37) % YEAR
    dates = F.array_compact(F.array(
        F.when(F.col("v") % 4 < 2, F.struct(F.lit("add").alias("action"), added.alias("dated"))),
        F.when((F.col("v") % 8).isin(0, 4, 5), F.struct(F.lit("remove").alias("action"), (added + 1728000 * (1 + F.col("v") % 5)).alias("dated"))),
        F.when(F.col("v") % 16 == 0, F.struct(F.lit("add").alias("action"), (added + 17280000).alias("dated")))))
    return (pattern.withColumn("v", v)
            .select("pattern", F.element_at(F.array(F.lit("adult"), F.lit("malware"), F.lit("spam")), (F.col("v") % 3 + 1).cast("int")).alias("list"),
                    F.explode(dates).alias("e")).select("list", "pattern", "e.action", "e.dated"))


@query("op4_url_filters", rf"""
with c as (
  select page_id, nullif(rtrim(lower(case when starts_with(place, '[') then regexp_extract(place, '^\[[^\]]*\]') else split_part(place, ':', 1) end), '.'), '') as host,
    {START} + (((page_id * 48271) % {YEAR}) + {YEAR}) % {YEAR} as fetched_at
  from (select page_id, string_split(case when regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://')
          then regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*') else '' end, '@')[-1] as place from pages)),
h as (select distinct host from c where host is not null),
p as (select host as pattern from h union select array_to_string(string_split(host, '.')[-2:], '.') from h),
v as (select pattern, ('0x' || substr(md5(pattern), 1, 6))::bigint as v from p),
a as (select pattern, v, case v % 3 when 0 then 'adult' when 1 then 'malware' else 'spam' end as list, {START} + (v * 37) % {YEAR} as added from v),
e as (
  select list, pattern, true as is_add, added as dated from a where v % 4 < 2
  union all select list, pattern, false, added + 1728000 * (1 + v % 5) from a where v % 8 in (0, 4, 5)
  union all select list, pattern, true, added + 17280000 from a where v % 16 = 0),
d as (select list, pattern, dated, bool_and(is_add) as is_add from e group by all),
x as (select *, lag(is_add) over (partition by list, pattern order by dated) as prior from d),
i as (select list, pattern, is_add, dated as valid_from, lead(dated) over (partition by list, pattern order by dated) as valid_to
      from x where prior is null or prior <> is_add),
m as (
  select c.page_id, c.host, c.fetched_at, string_agg(distinct list, ',' order by list) as lists, max(valid_from) as active_since, count(*) as n_active
  from (select distinct * from c) c join i on i.is_add and (c.host = i.pattern or ends_with(c.host, '.' || i.pattern))
    and i.valid_from <= c.fetched_at and (i.valid_to is null or i.valid_to > c.fetched_at)
  group by all)
select c.page_id, c.host, c.fetched_at, coalesce(lists, '') as lists, active_since, coalesce(n_active, 0) as n_active, n_active is not null as blocked
from c left join m on c.page_id = m.page_id and c.host = m.host and c.fetched_at = m.fetched_at""")
def temporal_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    return url_filters.evaluate(page_captures(pages), dated_list(pages))


def _crc32_sql(c: str) -> str:
    """Unsigned CRC-32 of an integer's decimal text: its bytes, each followed by
    eight shifts, in one fold."""
    steps = f"flatten(list_transform(string_split({c}::varchar, ''), lambda x: [ascii(x), -1, -1, -1, -1, -1, -1, -1, -1]))"
    return (f"xor(list_reduce(list_prepend(4294967295::bigint, {steps}::bigint[]), lambda x, y: "
            "case when y >= 0 then xor(x, y) when x & 1 = 1 then xor(x >> 1, 3988292384::bigint) else x >> 1 end), 4294967295::bigint)")


@query("op11_prefix_trie", f"""
with o as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
    row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as pos
  from conversations where conv_id is not null),
c as (select conv_id, count(*) as n, ((conv_id % 5) + 5) % 5 as rest, {_crc32_sql("conv_id")} % 9 as h from o group by conv_id),
x as (select c.conv_id, case when rest = 0 then 0 else h end as h, least(case when rest = 0 then 0 else h end, coalesce(b.n, 0)) as taken, c.n, c.conv_id - rest as base
      from c left join (select conv_id, n from c) b on b.conv_id = c.conv_id - rest),
m as (
  select o.conv_id, pos - h + taken as depth, role, text from o join x using (conv_id) where pos > h
  union all select x.conv_id, pos, role, text from x join o on o.conv_id = x.base and x.base <> x.conv_id and pos <= h),
p as (select conv_id, depth, text, list(struct_pack(role := role, text := text)) over (partition by conv_id order by depth) as path from m
      union all select conv_id, 0, '', [] from x),
e as (select *, depth = x.taken + greatest(x.n - x.h, 0) as is_end from p join x using (conv_id)),
nodes as (
  select path, depth, min(conv_id) as conv_id, count(*) as n_convs, any_value(text) as text,
    sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where is_end), '')) as ends_sha256
  from e group by path, depth),
kids as (select path[:depth - 1] as path, depth - 1 as depth, count(*) as n_children from nodes where depth > 0 group by all),
own as (select n.*, coalesce(n_children, 0) as n_children, coalesce(n_children, 0) = 0 as leaf,
          case when n.depth = 0 then 0 else (n_convs - 1) * strlen(text) end as saved
        from nodes n left join kids k on n.path = k.path and n.depth = k.depth),
up as (select path[:d] as path, d as depth, sum(case when leaf then 1 else 0 end) as n_leaves, sum(saved) as saved_tokens
       from (select path, leaf, saved, unnest(range(0, depth + 1)) as d from own) group by all)
select o.conv_id::bigint as conv_id, o.depth::bigint as depth, q.conv_id::bigint as parent_conv_id, o.n_convs::bigint as n_convs,
  o.n_children::bigint as n_children, n_leaves::bigint as n_leaves, saved_tokens::bigint as saved_tokens, o.ends_sha256
from own o join up using (path, depth) left join own q on q.depth = o.depth - 1 and q.path = o.path[:o.depth - 1]""")
def conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = trie.ordered_turns(read_table(spark, sf_dir, "conversations"))
    return trie.prefix_trie(*trie.rebuilt(turns, group=5, heads=9))


@query("op13_token_alignment")
def token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(read_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"))


@query("op12_toxicity")
def toxic_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.train(docs, read_table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")
