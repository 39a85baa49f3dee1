"""JSON sources (S1-S3, S6, S8) and the column helpers of the loaders (P12,
P14, U1).

Scans declare their schema; the model decides the JSON type of scores and
answers, so those fields are read as STRING and cast on purpose later.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docreason.functions import jsonfn as J
from docreason.functions.scores import py_strip
from docreason.session import materialize
from docreason.sources import json_arrays


class SourceError(ValueError):
    pass


def _as_list(paths) -> list[str]:
    return [paths] if isinstance(paths, str) else list(paths)


def file_kinds(spark: SparkSession, paths) -> DataFrame:
    """One row per file with any text: path and whether it holds a JSON array
    (the first character that is not white space decides)."""
    return json_arrays.kinds(spark, _as_list(paths)).select("path", "is_array")


def read_json_arrays(spark: SparkSession, paths, schema: T.StructType,
                     strict: bool = True) -> DataFrame:
    """Files holding one top-level JSON array each; every element a row.

    With ``strict`` a file whose text is not an array is an error (raised here,
    naming a few); an element that is no JSON object, text after the array and an
    array that is not closed are errors when they are read. Without, such
    elements have all-NULL columns and other files no rows."""
    paths = _as_list(paths)
    states = materialize(json_arrays.block_states(spark, paths), "json-blocks")
    if strict:
        bad = [r.path for r in states.where(~F.col("is_array")).select("path").distinct().limit(5).collect()]
        if bad:
            raise SourceError(f"not a JSON array at the top level, among others: {bad}")
    found = json_arrays.elements(spark, paths, states)
    obj = F.when(F.col("ok") & F.col("is_object"), F.from_json("text", schema))
    if strict:
        broken = F.raise_error(F.concat(F.lit("malformed JSON array in "), "path", F.lit(", element "), F.col("no").cast("string")))
        obj = obj.otherwise(broken.cast(schema))
    return found.select(obj.alias("_obj")).select(*[F.col("_obj")[f.name].alias(f.name) for f in schema.fields])


def read_json_lines(spark: SparkSession, paths, schema: T.StructType) -> DataFrame:
    """One object per line; a line that is anything else (also a blank one,
    or a second object after the first) lands in ``_corrupt_record``."""
    found = F.when(J.begins_object("value") & J.is_one_value("value"), F.from_json("value", schema))
    lines = spark.read.text(_as_list(paths)).withColumn("_obj", found)
    return lines.select(*[F.col("_obj")[f.name].alias(f.name) for f in schema.fields],
                        F.when(F.col("_obj").isNull(), F.col("value")).alias("_corrupt_record"))


def read_any_json(spark: SparkSession, paths, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """S3: tolerant scan. A file whose first character is '[' is one array;
    any other is read line by line: blank lines skipped, one trailing comma
    stripped where the line does not parse without. Returns (rows, quarantine):
    quarantine (source_file, line) holds the lines that are not one JSON object,
    all elements of an array file that does not parse (such a file gives no
    rows), and elements of other array files that are no objects. Every line or
    element that is not blank is in one of the two.

    No path comes to the driver, and no row holds more than a line or an element."""
    paths, fields = _as_list(paths), [f.name for f in schema.fields]
    states = materialize(json_arrays.block_states(spark, paths), "json-blocks")
    found = materialize(json_arrays.elements(spark, paths, states).select("path", "text", "ok", "is_object"), "json-elements")
    sound = found.groupBy("path").agg(F.bool_and("ok").alias("_sound"))
    arrays = found.join(sound, "path").select(
        F.col("path").alias("source_file"), py_strip("text").alias("line"), F.col("text").alias("_text"),
        (F.col("_sound") & F.col("is_object")).alias("_ok"))

    others = states.where(~F.col("is_array")).select(F.col("path").alias("kind_path")).distinct()
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("path"))
    lines = lines.join(others, F.col("path") == F.col("kind_path"))
    # Exploded, so that the filters after it do not strip every line again for each use.
    lines = lines.select(F.col("path").alias("source_file"), F.explode_outer(F.array(py_strip("value"))).alias("line"))
    cut = F.when(F.col("line").endswith(","), F.expr("substring(line, 1, length(line) - 1)")).otherwise(F.col("line"))
    lines = (lines.where("line <> ''").withColumn("_text", cut)
             .withColumn("_ok", J.begins_object("_text") & J.is_one_value("_text")))
    # Only the rows kept are parsed into columns: a filter on the parsed object would parse it twice.
    every = arrays.unionByName(lines)
    rows = every.where("_ok").select(F.from_json("_text", schema).alias("_obj"), "source_file")
    return rows.select(*[F.col("_obj")[c].alias(c) for c in fields], "source_file"), every.where("not _ok").select("source_file", "line")


def json_object_keys(c) -> Column:
    """Keys of a JSON object in order; a non-object, broken text or text
    after the object gives []."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.when(J.is_object(J.one_value(c)), F.json_object_keys(c)), F.array().cast("array<string>"))


def union_tagged(frames: list[tuple[DataFrame, dict]]) -> DataFrame:
    """S8 + U1: tag each input with literal columns (source_file, domain, arm,
    ...) and union all by name, filling absent columns with NULL."""
    if not frames:
        raise SourceError("no inputs to load")
    out = None
    for df, tags in frames:
        tagged = df.select("*", *[F.lit(v).alias(k) for k, v in tags.items()])
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def label_files(df: DataFrame, labels: DataFrame, file: str = "source_file") -> DataFrame:
    """The rows of many files, read in one scan and labelled by their file:
    ``labels`` has one row per file, ``file`` and the label columns. A file
    without labels is an error when its rows are read."""
    tags = [c for c in labels.columns if c != file]
    known = labels.select(F.col(file).alias("_file"), *tags)
    sound = F.when(F.col("_file").isNull(), F.raise_error(F.concat(F.lit("no labels for file "), F.coalesce(F.col(file), F.lit("null")))).cast("string"))
    return (df.join(known, F.col(file) == F.col("_file"), "left")
            .withColumn(file, sound.otherwise(F.col(file))).drop("_file"))


def find_column(df: DataFrame, candidates: list[str]) -> str | None:
    """The first candidate present in the schema (a plan-time choice)."""
    for c in candidates:
        if c in df.columns:
            return c
    return None


def require_columns(df: DataFrame, required: list[str]) -> None:
    """Fail listing the missing required columns."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise SourceError(f"the table lacks these columns: {', '.join(missing)}")
