"""Page blocks to indexed records.

Ordered work (merging split blocks, numbering) never windows over a whole
document. Windows run per (document, page), ordered by position; what must
cross a page boundary (the next block, the running count of merge edges, the
position of the last non-edge, whether the last block of the page merged)
travels through per-page summaries, whose windows hold one row per page.
The block table is shuffled once, by (document, page); every later join is
with a per-page table on the same key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docreason.functions.scores import bool_flag, norm_type
from docreason.operators.joins import join_on
from docreason.schemas import EXCLUDED_TYPES, SPLITTABLE_TYPES

_UNB = Window.unboundedPreceding


def _page_windows(doc: str, page: str, pos: str):
    w_in = Window.partitionBy(doc, page).orderBy(pos)
    w_pg = Window.partitionBy(doc).orderBy(page)
    return w_in, w_pg


def merge_split_blocks(blocks: DataFrame, doc: str = "doc_id", page: str = "page",
                       pos: str = "pos") -> DataFrame:
    """Scan each document in (page, pos) order; a block of a splittable
    type flagged split whose next block has the same type is merged with it
    (text joined by a space, split flag of the next block) and both are
    consumed. Pairs only: a merged block is not merged again. In a run of
    consecutive merge edges the 1st, 3rd, ... edge is taken; a block after a
    taken edge disappears.

    Plan: one window pass per (document, page); a per-page summary resolves
    what crosses page boundaries (the last block's edge against the next
    page's first block, edges before the page, the last non-edge, whether
    the page's last block merged); one join back; one more window pass on
    the same partitioning.
    """
    w_in, w_pg = _page_windows(doc, page, pos)
    cols = blocks.columns
    split_is_bool = dict(blocks.dtypes)["split"] == "boolean"
    b = (blocks.withColumn("_t", norm_type("type")).withColumn("_flag", bool_flag("split"))
         .withColumn("_sp", F.col("_t").isin(SPLITTABLE_TYPES) & F.col("_flag"))
         .withColumn("_rn", F.row_number().over(w_in))
         .withColumn("_nt", F.lead("_t").over(w_in))
         .withColumn("_ntext", F.lead("text").over(w_in))
         .withColumn("_nflag", F.lead("_flag").over(w_in))
         .withColumn("_last", F.lead(pos).over(w_in).isNull()))
    # Edges known inside the page (the last block's edge needs the next page).
    b = b.withColumn("_ein", (~F.col("_last") & F.col("_sp") & (F.col("_nt") == F.col("_t"))).cast("int"))
    b = b.withColumn("_eloc", F.coalesce(F.sum("_ein").over(w_in.rowsBetween(_UNB, -1)), F.lit(0)))
    last_of = lambda c: F.max_by(c, pos)
    pg = b.groupBy(doc, page).agg(
        F.min_by(F.struct(F.col("_t").alias("t"), F.col("text").alias("text"), F.col("_flag").alias("flag")),
                 pos).alias("_head"),
        last_of("_t").alias("_lt"), last_of("_sp").alias("_lsp"), last_of("_eloc").alias("_leloc"),
        F.sum("_ein").alias("_pein"),
        F.max(F.when(~F.col("_last") & (F.col("_ein") == 0), F.col("_eloc"))).alias("_ne_in"))
    nh = F.lead("_head").over(w_pg)
    pg = (pg.withColumn("_nh", nh)
          .withColumn("_ledge", F.coalesce(F.col("_lsp") & (F.col("_nh.t") == F.col("_lt")), F.lit(False)))
          .withColumn("_pe", F.col("_pein") + F.col("_ledge").cast("int"))
          .withColumn("_eoff", F.coalesce(F.sum("_pe").over(w_pg.rowsBetween(_UNB, -1)), F.lit(0)))
          # last non-edge of the page, absolute edge count at it
          .withColumn("_ne_loc", F.when(~F.col("_ledge"), F.col("_leloc")).otherwise(F.col("_ne_in")))
          .withColumn("_carry", F.max(F.col("_eoff") + F.col("_ne_loc")).over(w_pg.rowsBetween(_UNB, -1))))
    # Whether the page's last block is a taken edge, then passed to the next page.
    l_start = F.coalesce(F.col("_eoff") + F.col("_ne_in"), F.col("_carry"), F.lit(0))
    pg = (pg.withColumn("_ltaken", F.col("_ledge") & (((F.col("_eoff") + F.col("_leloc")) - l_start) % 2 == 0))
          .withColumn("_prev_taken", F.coalesce(F.lag("_ltaken").over(w_pg), F.lit(False)))
          .select(doc, page, "_eoff", "_carry", "_ledge", "_prev_taken",
                  F.col("_nh.text").alias("_htext"), F.col("_nh.flag").alias("_hflag")))
    b = join_on(b, pg, [doc, page], "left")
    last = F.col("_last")
    edge = F.when(last, F.col("_ledge")).otherwise(F.col("_ein") == 1)
    b = (b.withColumn("_edge", edge)
         .withColumn("_e", F.col("_eoff") + F.col("_eloc"))
         .withColumn("_ntext", F.when(last, F.col("_htext")).otherwise(F.col("_ntext")))
         .withColumn("_nflag", F.when(last, F.col("_hflag")).otherwise(F.col("_nflag"))))
    local_ne = F.max(F.when(~F.col("_edge"), F.col("_e"))).over(w_in.rowsBetween(_UNB, 0))
    b = (b.withColumn("_estart", F.coalesce(local_ne, F.col("_carry"), F.lit(0)))
         .withColumn("_taken", F.col("_edge") & ((F.col("_e") - F.col("_estart")) % 2 == 0)))
    consumed = F.when(F.col("_rn") == 1, F.col("_prev_taken")).otherwise(
        F.coalesce(F.lag("_taken").over(w_in), F.lit(False)))
    b = b.withColumn("_consumed", consumed).where(~F.col("_consumed"))
    taken = F.col("_taken")
    out = []
    for c in cols:
        if c == "text":
            out.append(F.when(taken, F.concat(F.col("text"), F.lit(" "), F.col("_ntext")))
                       .otherwise(F.col("text")).alias("text"))
        elif c == "split":
            merged = F.coalesce(F.col("_nflag"), F.lit(False))
            out.append(F.when(taken, merged if split_is_bool else merged.cast("string"))
                       .otherwise(F.col("split")).alias("split"))
        else:
            out.append(F.col(c))
    return b.select(*out)


def dense_index(df: DataFrame, doc: str = "doc_id", page: str = "page", pos: str = "pos",
                out: str = "idx") -> DataFrame:
    """0-based index in (page, pos) order per document, from per-page
    row numbers plus the block counts of the earlier pages."""
    w_in, w_pg = _page_windows(doc, page, pos)
    b = df.withColumn("_rn", F.row_number().over(w_in) - 1)
    pages = (b.groupBy(doc, page).agg(F.count(F.lit(1)).alias("_pc"))
             .withColumn("_poff", F.coalesce(F.sum("_pc").over(w_pg.rowsBetween(_UNB, -1)), F.lit(0)))
             .select(doc, page, "_poff"))
    return join_on(b, pages, [doc, page]).withColumn(out, (F.col("_poff") + F.col("_rn")).cast("int")) \
        .drop("_rn", "_poff")


def records(blocks: DataFrame) -> DataFrame:
    """Blocks -> merged, indexed records (W1 then W2)."""
    return dense_index(merge_split_blocks(blocks))


def references(recs: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Ref key -> text over reference entries with a non-empty key; the
    last entry of a key wins; a missing text becomes ''."""
    return (recs.where((norm_type("type") == "reference_entry") & (F.coalesce(F.col("ref"), F.lit("")) != ""))
            .groupBy(doc, "ref").agg(F.max_by(F.coalesce(F.col("text"), F.lit("")), "idx").alias("text")))


def label_pages(blocks: DataFrame, doc: str = "doc_id") -> DataFrame:
    """figure/table label -> page from the raw blocks (before merging);
    the last occurrence wins; ``first_seen`` keeps the key order of first
    appearance."""
    t = norm_type("type")
    order = F.struct("page", "pos")
    return (blocks.where(t.isin("figure", "table") & F.col("text").isNotNull())
            .withColumn("kind", t)
            .groupBy(doc, "kind", F.col("text").alias("label"))
            .agg(F.max_by("page", order).alias("page"), F.min(order).alias("first_seen")))


def label_lists(labels: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Per document the figure and table labels in order of first appearance
    (the key order of the label maps, S6)."""
    def lst(kind):
        return F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct(
            F.col("first_seen").alias("o"), F.col("label").alias("l"))))), lambda x: x["l"])
    return labels.groupBy(doc).agg(lst("figure").alias("figures"), lst("table").alias("tables"))


def page_files(blocks: DataFrame, doc: str = "doc_id", root: str = "docs") -> DataFrame:
    """The page image of each (document, page) of the blocks: doc_id, page, path."""
    return blocks.select(doc, "page").distinct().withColumn(
        "path", F.concat(F.lit(root + "/"), F.col(doc).cast("string"), F.lit("/pages/page-"),
                         F.lpad(F.col("page").cast("string"), 4, "0"), F.lit(".png")))


def label_assets(labels: DataFrame, pages: DataFrame, doc: str = "doc_id", root: str = "docs") -> DataFrame:
    """J4 + K7: copy list label -> page image -> assets/{label}.png; labels whose
    page has no image are left out (the copy is skipped)."""
    return labels.join(pages, [doc, "page"]).select(
        doc, "kind", "label", "page", F.col("path").alias("src"),
        F.concat(F.lit(root + "/"), F.col(doc).cast("string"), F.lit("/assets/"), F.col("label"),
                 F.lit(".png")).alias("dst"))


def number_pages(files: DataFrame, doc: str = "doc_id", path: str = "path") -> DataFrame:
    """W3 + S7: page images (.png, any case) numbered from 1 in path order
    per document (a window over one document's pages)."""
    w = Window.partitionBy(doc).orderBy(path)
    return (files.where(F.lower(F.col(path)).endswith(".png"))
            .withColumn("page", F.row_number().over(w)))


def filter_types(recs: DataFrame, excluded=EXCLUDED_TYPES) -> DataFrame:
    """Drop records whose lower-cased type (not trimmed) is excluded; a
    missing type is kept."""
    return recs.where(~F.lower(F.coalesce(F.col("type"), F.lit(""))).isin(list(excluded)))


def prune_validate(recs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Keep records having idx, type and text; returns (kept, quarantine).
    A missing text is quarantined instead of turned into the text 'None'."""
    ok = F.col("idx").isNotNull() & F.col("type").isNotNull() & F.col("text").isNotNull()
    return recs.where(ok), recs.where(~ok)


def json_string(c) -> Column:
    """A JSON string literal of a text column (quotes and escapes)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_extract(F.to_json(F.array(c)), r"^\[(.*)\]$", 1)


def jsonl_line(idx="idx", type_="type", text="text") -> Column:
    """A31 line: {"idx": i, "type": "...", "text": "..."} with the spacing of
    a default json.dumps."""
    return F.concat(F.lit('{"idx": '), F.col(idx).cast("string"), F.lit(', "type": '), json_string(type_),
                    F.lit(', "text": '), json_string(text), F.lit("}"))


def record_line(type_="type", text="text") -> Column:
    """A30 entry: '\\n type: {type}\\n {text}'."""
    return F.concat(F.lit("\n type: "), F.col(type_), F.lit("\n "), F.col(text))


def ordered_join(line: Column, order: str, sep: str) -> Column:
    """Aggregate: lines joined by ``sep`` in ``order`` (listagg within group)."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"),
                                                                           line.alias("l")))),
                                    lambda x: x["l"]), sep)
