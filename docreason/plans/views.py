"""Derived views over the driver tables.

The driver ships TPC-H-like tables; these views give them the shapes of the
analysed system's data (scored answers, page blocks, model responses, URL
state). Each is a lazy DataFrame, so filters and projections of the queries
that use them are pushed into the parquet scans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]

# Block type slots of the ``blocks`` view (fixed, 11 entries).
BLOCK_TYPE_SLOTS = ["title", "abstract", "section_header", "paragraph", "paragraph",
                    "caption", "figure", "table", "equation", "reference_entry", "unknown"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def qa_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored answers: question_id, domain, arm, gold, pred, trace_sim."""
    li = table(spark, sf_dir, "lineitem")
    arm = (F.when(F.col("l_linenumber") % 4 == 1, "baseline")
           .when(F.col("l_linenumber") % 4 == 2, "raw_text")
           .when(F.col("l_linenumber") % 4 == 3, "raw_text_contract")
           .otherwise("contract"))
    pred = F.when(F.col("l_orderkey") % 13 == 0, F.lit(None).cast("double")).otherwise(
        (F.col("l_quantity").cast("int") % 11).cast("double") / 10)
    trace = F.when(F.col("l_orderkey") % 17 == 0, F.lit(None).cast("double")).otherwise(
        F.col("l_quantity") / 50)
    return li.select(F.col("l_partkey").alias("question_id"),
                     F.col("l_linestatus").alias("domain"),
                     arm.alias("arm"),
                     F.round(F.col("l_discount") * 10, 1).alias("gold"),
                     pred.alias("pred"),
                     trace.alias("trace_sim"))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of ``documents`` as page blocks: doc_id, pos, page, type, text, split, ref."""
    # Outer, then without the row of a missing text: for an inner explode Spark
    # infers a filter that splits every text a second time.
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.posexplode_outer(F.split("text", "\n")).alias("pos", "text")).where("pos is not null")
    slot = ((F.col("doc_id") * 31 + F.floor(F.col("pos") / 4) * 7) % 11 + 1).cast("int")
    types = F.array(*[F.lit(t) for t in BLOCK_TYPE_SLOTS])
    # Some types come with white space around them, as models write them.
    odd = (F.col("doc_id") + F.col("pos")) % 13
    around = F.when(odd == 0, F.concat(F.element_at(types, slot), F.lit("\n"))).when(
        odd == 1, F.concat(F.lit("\t"), F.element_at(types, slot))).otherwise(F.element_at(types, slot))
    return docs.select(
        "doc_id", F.col("pos").cast("bigint").alias("pos"),
        (F.floor(F.col("pos") / 4) + 1).cast("bigint").alias("page"),
        around.alias("type"),
        "text",
        ((F.col("doc_id") + F.col("pos")) % 5 != 0).alias("split"),
        F.concat(F.lit("["), (F.col("pos") % 5).cast("string"), F.lit("]")).alias("ref"))


def raw_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score texts as a model returns them: id, content."""
    e = F.col("event_id")
    content = (F.when(e % 10 == 0, "1.0").when(e % 10 == 1, " 0.25 ").when(e % 10 == 2, "n/a")
               .when(e % 10 == 3, F.lit(None).cast("string")).when(e % 10 == 4, "1.7")
               .when(e % 10 == 5, "-0.2").when(e % 10 == 6, "1e-1").when(e % 10 == 7, "nan")
               .when(e % 10 == 8, "-1")
               .otherwise(F.concat(F.lit("0."), F.lpad((e % 1000).cast("string"), 3, "0"))))
    return table(spark, sf_dir, "events").select(e.alias("id"), content.alias("content"))


def raw_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question records as a model returns them: document_id, pos, raw (JSON text)."""
    e = F.col("event_id")
    k = e % 12
    contract = F.when(k == 0, "").when(k == 2, ',"contract_id":7').otherwise(',"contract_id":"1-0"')
    question = F.when(k == 1, "").otherwise(F.concat(F.lit("q"), e.cast("string")))
    gold = (F.when(k == 3, "[]")
            .when(k == 4, '{"answer":"0.5","paths":["a -> b"]}')
            .when(k == 5, '{"answer":0,"explanation":"e","paths":[]}')
            .otherwise('{"answer":"0.5","explanation":"e","paths":["a -> b","b -> c"],"notes":"n"}'))
    raw = F.concat(F.lit('{"category":"'), F.col("event_type"), F.lit('"'), contract,
                   F.lit(',"question":"'), question, F.lit('"'), F.lit(',"gold_answer":'), gold,
                   F.lit("}"))
    return table(spark, sf_dir, "events").select(
        F.floor(e / 10).alias("document_id"), (e % 10).alias("pos"), raw.alias("raw"))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two model responses (attempts) per document: document_id, attempt, content,
    prompt_tokens, completion_tokens, latency (milliseconds)."""
    e = F.col("event_id")
    qid = F.when(e % 10 == 9, "unknown").otherwise(
        F.concat(F.floor(e / 10).cast("string"), F.lit("-"), F.greatest(e % 10, F.lit(1)).cast("string")))
    ans = F.when(e % 11 == 0, "").otherwise(F.concat(F.lit("0."), (e % 10).cast("string")))
    obj = F.concat(F.lit('{"question_id":"'), qid, F.lit('","answer":"'), ans,
                   F.lit('","explanation":"e'), e.cast("string"), F.lit('"}'))
    per_doc = (table(spark, sf_dir, "events")
               .select(F.floor(e / 10).alias("document_id"), e.alias("event_id"), obj.alias("obj"))
               .groupBy("document_id")
               .agg(F.expr("listagg(obj, ',') within group (order by event_id)").alias("objs")))
    # Two attempts per document: a two-element literal array, exploded (no join).
    with_attempts = per_doc.select("document_id", "objs",
                                   F.explode(F.array(F.lit(1), F.lit(2))).alias("attempt"))
    d, a = F.col("document_id"), F.col("attempt")
    content = (F.when((a == 1) & (d % 3 == 0), "sorry, no list")
               .when(d % 7 == 0, '{"question_id":"x","answer":"1"}')
               .otherwise(F.concat(F.lit("Here it is: ["), F.col("objs"), F.lit("] done"))))
    return with_attempts.select(
        "document_id", a.cast("int").alias("attempt"), content.alias("content"),
        (100 + d % 50).alias("prompt_tokens"), (10 * a).cast("int").alias("completion_tokens"),
        (200 + 7 * a + d % 13).cast("bigint").alias("latency"))


def url_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incoming URLs with the status the state table already holds: page_id, url, known_status."""
    p = F.col("page_id")
    status = F.when(p % 4 == 0, "processed").when(p % 4 == 1, "validation_failed").otherwise(
        F.lit(None).cast("string"))
    return table(spark, sf_dir, "pages").select("page_id", "url", status.alias("known_status"))
