"""File sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docreason.schemas import DESIGN_CSV

# The bytes a PDF file begins with (fixed by the format).
PDF_MAGIC = b"%PDF"


def read_url_list(spark: SparkSession, paths) -> DataFrame:
    """One URL per line, trimmed, empty lines dropped; keeps the file and
    line order key for 'first line wins'."""
    from docreason.streaming.ingest import clean_urls
    lines = spark.read.text(paths).select("value", F.input_file_name().alias("file"),
                                          F.monotonically_increasing_id().alias("line_no"))
    return clean_urls(lines)


def read_binary(spark: SparkSession, path: str, glob: str | None = None, recursive: bool = True) -> DataFrame:
    """binaryFile scan: path, modificationTime, length, content."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.load(path)


def is_pdf(content: str = "content") -> F.Column:
    """The first four bytes are %PDF."""
    return F.coalesce(F.substring(F.col(content), 1, 4) == F.lit(PDF_MAGIC), F.lit(False))


def read_pages(spark: SparkSession, root: str, doc_from_path) -> DataFrame:
    """S7 + W3: page images (.png in any case) under ``root``, numbered from
    1 in path order per document; ``doc_from_path`` maps the path column to
    the document id."""
    files = read_binary(spark, root).select("path", "content").where(F.lower("path").endswith(".png"))
    w = Window.partitionBy("doc_id").orderBy("path")
    return files.withColumn("doc_id", doc_from_path(F.col("path"))).withColumn("page", F.row_number().over(w))


def read_manifest(spark: SparkSession, paths, fmt: str = "json") -> DataFrame:
    """{document_id, path} rows; a later row of the same id wins."""
    m = spark.read.schema("document_id string, path string").format(fmt).load(paths) \
        .withColumn("_o", F.monotonically_increasing_id())
    return m.groupBy("document_id").agg(F.max_by("path", "_o").alias("path"))


def read_design_csv(spark: SparkSession, paths) -> DataFrame:
    """Fully quoted CSV with doubled quotes and a JSON list cell."""
    d = (spark.read.schema(DESIGN_CSV).option("header", True).option("quote", '"').option("escape", '"')
         .option("multiLine", True).csv(paths))
    return d.select("candidate_name", "justification",
                    F.col("feasibility_score").try_cast("double").alias("feasibility_score"),
                    F.from_json("contract_parts", "array<string>").alias("contract_parts"))
