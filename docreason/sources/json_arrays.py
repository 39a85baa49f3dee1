"""JSON array files as rows of element texts, whatever a file's size.

A file is read by Spark's text source as the pieces between its commas, so that
it is split like any text and no row holds more than an element's part. Which
commas separate elements depends on strings and brackets before them, and that
state is carried over as a prefix:

0. the first character of every file tells the array files, the only ones walked;
1. every block (split) of a file with more than one is summed up in one row: for a
   start inside and outside a string, how its brackets balance and whether it ends
   in a string;
2. a fold over a file's blocks (as many as the file has splits) gives the state
   that each block starts in;
3. these blocks are walked from their state, cut at the commas of depth 1 and
   counted; of their texts only those of elements that reach over a block's end, two
   a block at most, are kept and put together;
4. every block is cut when the elements are read, so that no table holds their texts.

A file of one block (also a compressed one, which is read as a whole) needs 0 and 4.

A file is an array when its first character that is not white space is ``[``. An
element is sound when it is exactly one JSON value and, for the last, followed by
the closing bracket and white space alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docreason.functions import jsonfn as J
from docreason.session import materialize, ship_package

ESCAPE = re.compile(rb"\\.", re.S)
# Names of files that Hadoop's text readers decompress.
PACKED = r"(?i)\.(gz|bz2|deflate|lz4|snappy|zst|zstd)$"
# 1 a quote, 2 an opening and 3 a closing bracket, 4 a backslash.
CODES = np.zeros(256, np.uint8)
for _code, _chars in enumerate((b'"', b"[{", b"]}", b"\\"), 1):
    CODES[list(_chars)] = _code


def _pieces(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, size, block, line, value: the texts between commas, in order."""
    return spark.read.option("lineSep", ",").text(paths).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"), "value")


def kinds(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One row per file with any text: path, size, is_array (the first character
    that is not white space decides), n_bytes (of its pieces, a comma after each),
    n_blocks with any piece and end, the last of these."""
    text = F.substring(F.ltrim("value", F.lit(" \t\n\r")), 1, 1)
    # Of a block the first piece with any text, its number doubled and one more if it begins otherwise.
    first = F.when(F.col("_c") != "", F.col("line") * 2 + F.when(F.col("_c") == "[", 0).otherwise(1))
    blocks = _pieces(spark, paths).withColumn("_c", text).groupBy("path", "block").agg(
        F.min(first).alias("_first"), F.max("size").alias("size"), F.sum(F.octet_length("value") + 1).alias("n_bytes"))
    start = F.min(F.when(F.col("_first").isNotNull(), F.struct("block", "_first")))["_first"]
    return blocks.groupBy("path").agg(
        F.max("size").alias("size"), (start % 2 == 0).alias("is_array"), F.sum("n_bytes").alias("n_bytes"),
        F.count(F.lit(1)).alias("n_blocks"), F.max("block").alias("end")).where("is_array is not null")


def _comma_ends(spark: SparkSession, paths: list[str], arrays: DataFrame) -> DataFrame:
    """``arrays`` with comma_ends: whether the file's text ends with a comma.

    Every piece counts its comma; the last one has none unless the file ends with
    it. A compressed file's size does not tell its text's length: that is then told
    from its pieces between closing braces, which count one more in all only if the
    file ends with a comma (and one less only if it ends with a brace)."""
    packed = F.col("path").rlike(PACKED) | ~(F.col("size") - F.col("n_bytes")).isin(0, -1)
    arrays = arrays.withColumn("packed", packed)
    plain = arrays.where("not packed").withColumn("comma_ends", F.col("n_bytes") == F.col("size"))
    if arrays.where("packed").isEmpty():
        return plain.drop("packed")
    others = spark.read.option("lineSep", "}").text(paths).select("value", F.col("_metadata.file_path").alias("path"))
    others = others.join(F.broadcast(arrays.where("packed").select("path")), "path").groupBy("path").agg(
        F.sum(F.octet_length("value") + 1).alias("n_other"))
    return plain.unionByName(arrays.where("packed").join(others, "path").withColumn(
        "comma_ends", F.col("n_other") == F.col("n_bytes") + 1).drop("n_other")).drop("packed")


def _marks(values: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Over the pieces one after the other, from 0: how many quotes there are
    before each piece's end, and how brackets balance there for a start outside
    and inside a string."""
    values = values.cast(pa.large_binary())
    _, at, data = values.buffers()
    ends = np.frombuffer(at, np.int64)[values.offset:values.offset + len(values) + 1]
    text = np.frombuffer(data, np.uint8)[ends[0]:ends[-1]] if data else np.zeros(0, np.uint8)
    ends = ends[1:] - ends[0]
    codes = CODES[text]
    if (codes == 4).any():
        codes = codes.copy()
        for i in np.unique(np.searchsorted(ends, np.flatnonzero(codes == 4), side="right")):
            start = int(ends[i - 1]) if i else 0
            for found in ESCAPE.finditer(text[start:ends[i]].tobytes()):
                codes[start + found.start():start + found.end()] = 0
    where = np.flatnonzero(codes)
    code = codes[where]
    quotes = np.concatenate([[0], np.cumsum(code == 1)])
    turn = (code == 2).astype(np.int64) - (code == 3)
    inside = quotes[1:] % 2 == 1
    upto = np.searchsorted(where, ends)
    outer, inner = (np.concatenate([[0], np.cumsum(np.where(x, turn, 0))])[upto] for x in (~inside, inside))
    return quotes[upto], outer, inner


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """((id, block), rows) of each batch's stretches of one block."""
    for b in batches:
        if b.num_rows:
            ids, blocks = b["id"].to_numpy(), b["block"].to_numpy()
            cuts = np.flatnonzero((ids[1:] != ids[:-1]) | (blocks[1:] != blocks[:-1])) + 1
            for i, j in zip([0, *cuts], [*cuts, b.num_rows]):
                yield (int(ids[i]), int(blocks[i])), b.slice(i, j - i)


def _summarize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fields = pa.schema([("id", pa.int64()), ("block", pa.int64()),
                        ("out_string", pa.bool_()), ("out_depth", pa.int64()), ("in_string", pa.bool_()), ("in_depth", pa.int64())])
    row = None
    for key, rows in _by_block(batches):
        if row is None or tuple(row[:2]) != key:
            if row is not None:
                yield pa.RecordBatch.from_pylist([dict(zip(fields.names, row))], fields)
            row = [*key, False, 0, True, 0]
        quotes, outer, inner = _marks(rows["value"])
        for i in (2, 4):
            row[i + 1] += int((inner if row[i] else outer)[-1])
            row[i] ^= bool(quotes[-1] % 2)
    if row is not None:
        yield pa.RecordBatch.from_pylist([dict(zip(fields.names, row))], fields)


def block_states(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One row per block of an array file: path, block, is_array, in_string and
    depth at its start, ``last`` (the file's last block), ``alone`` (its only one)
    and whether the file ends with a comma. Any other file with text has one row,
    without a block; only array files of several blocks are walked."""
    ship_package(spark)
    files = materialize(kinds(spark, paths).withColumn("id", F.monotonically_increasing_id()), "json-files")
    arrays = _comma_ends(spark, paths, files.where("is_array"))
    # One row per file, which the listing of the files brings to the driver as well.
    wanted = F.broadcast(files.where("is_array and n_blocks > 1").select("path", "id"))
    sums = _pieces(spark, paths).join(wanted, "path").select("id", "block", "value").mapInArrow(
        _summarize, "id long, block long, out_string boolean, out_depth long, in_string boolean, in_depth long")
    blocks = F.array_sort(F.collect_list(F.struct("block", "out_string", "out_depth", "in_string", "in_depth")))
    start = F.struct(F.lit(False).alias("s"), F.lit(0).cast("long").alias("d"),
                     F.array().cast("array<struct<block:bigint,in_string:boolean,depth:bigint>>").alias("all"))

    def step(acc, x):
        return F.struct(
            F.when(acc["s"], x["in_string"]).otherwise(x["out_string"]).alias("s"),
            (acc["d"] + F.when(acc["s"], x["in_depth"]).otherwise(x["out_depth"])).alias("d"),
            F.concat(acc["all"], F.array(F.struct(x["block"].alias("block"), acc["s"].alias("in_string"), acc["d"].alias("depth")))).alias("all"))

    walked = sums.groupBy("id").agg(blocks.alias("blocks"))
    several = arrays.join(walked, "id").select(
        "path", "is_array", "comma_ends", "end", F.explode(F.aggregate("blocks", start, step)["all"]).alias("b")).select(
        "path", "is_array", "comma_ends", F.col("b.block").alias("block"), (F.col("b.block") == F.col("end")).alias("last"),
        F.col("b.in_string").alias("in_string"), F.col("b.depth").alias("depth"), F.lit(False).alias("alone"))
    single = arrays.where("n_blocks = 1").select(
        "path", "is_array", "comma_ends", F.col("end").alias("block"), F.lit(True).alias("last"), F.lit(False).alias("in_string"),
        F.lit(0).cast("long").alias("depth"), F.lit(True).alias("alone"))
    return several.unionByName(single).unionByName(files.where("not is_array").select("path", "is_array"), allowMissingColumns=True)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A block's elements: number within the block, text, and whether more of it
    lies after the block (``tail``)."""
    names = ["id", "no", "text", "tail"]
    key, no, parts, in_string, depth, ends = None, 0, [], False, 0, False

    def batch(texts: pa.Array, tail: bool) -> pa.RecordBatch:
        n = len(texts)
        return pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(key[0], pa.int64()), n), pa.array(np.arange(no, no + n)),
                                           texts, pa.repeat(tail, n)], names=names)

    def joined(pieces: pa.Array, stops: np.ndarray) -> pa.Array:
        of = pa.array(np.concatenate([[0], stops]), pa.int32())
        return pc.binary_join(pa.ListArray.from_arrays(of, pieces), ",")

    def left() -> Iterator[pa.RecordBatch]:
        """What follows the block's last separator; it goes on in the next block."""
        if parts:
            pieces = pa.concat_arrays(parts)
            text = joined(pieces, np.array([len(pieces)]))
            yield batch(text if ends else pc.binary_join_element_wise(text, "", ","), True)

    for k, rows in _by_block(batches):
        if k != key:
            if key is not None:
                yield from left()
            in_string, depth, last, comma_ends = (rows[c][0].as_py() for c in ("in_string", "depth", "last", "comma_ends"))
            # The file's last piece is followed by no comma.
            key, no, parts, ends = k, 0, [], last and not comma_ends
        quotes, outer, inner = _marks(rows["value"])
        depths = depth + (inner if in_string else outer)
        open_ = (quotes % 2 == 1) ^ in_string
        stops = np.flatnonzero(~open_ & (depths == 1)) + 1
        in_string, depth = bool(open_[-1]), int(depths[-1])
        value, done = rows["value"], 0
        if len(stops):
            before = pa.concat_arrays(parts) if parts else value.slice(0, 0)
            done = int(stops[-1])
            texts = joined(pa.concat_arrays([before, value.slice(0, done)]), stops + len(before))
            yield batch(texts, False)
            no, parts = no + len(texts), []
        if done < len(value):
            parts.append(value.slice(done))
    if key is not None:
        yield from left()


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a block's elements (``_cut``) the first, the one that goes on after it,
    and the number of the last, without its text."""
    names, held = ["id", "no", "text", "tail"], None
    for b in _cut(batches):
        if held is not None and held["id"][0] != b["id"][0].as_py():
            yield pa.RecordBatch.from_pydict(held, b.schema)
            held = None
        kept = b.filter(pc.or_(b["tail"], pc.equal(b["no"], 0)))
        if kept.num_rows:
            yield kept
        held = {x: [b[x][-1].as_py()] for x in names}
        held["text"] = [None]
    if held is not None:
        yield pa.RecordBatch.from_pydict(held, b.schema)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The elements that lie in one block: number, text, and whether it is the last
    of a file of one block; of a file with several the number is the block's."""
    alone, held = {}, None

    def noted() -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                ids, one = b["id"].to_numpy(), b["alone"]
                for i in np.concatenate([[0], np.flatnonzero(ids[1:] != ids[:-1]) + 1]):
                    alone[int(ids[i])] = one[int(i)].as_py()
            yield b

    def out(b: pa.RecordBatch, last: bool) -> pa.RecordBatch:
        marks = np.zeros(b.num_rows, bool)
        marks[-1:] = last
        return pa.RecordBatch.from_arrays([b["id"], b["no"], b["text"], pa.array(marks)], names=["id", "no", "text", "last"])

    for b in _cut(noted()):
        # The last element so far waits until the next one shows whether it is the file's last.
        if held is not None:
            yield out(held, held["id"][0] != b["id"][0])
            held = None
        if alone[b["id"][0].as_py()]:
            if b.num_rows > 1:
                yield out(b.slice(0, b.num_rows - 1), False)
            held = b.slice(b.num_rows - 1)
        else:
            yield out(b.filter(pc.and_(pc.greater(b["no"], 0), pc.invert(b["tail"]))), False)
    if held is not None:
        yield out(held, True)


def elements(spark: SparkSession, paths: list[str], states: DataFrame) -> DataFrame:
    """path, no (from 0 in file order), text, ok, is_object of every element of the
    array files; ``states`` is the written table of their blocks. A file without
    elements has no row; ``ok`` is false where the text is not one JSON value or the
    array is not closed as it must be."""
    blocks = materialize(states.where("is_array").drop("is_array").withColumn("id", F.monotonically_increasing_id()), "json-block-ids")

    def pieces(of: DataFrame) -> DataFrame:
        # A broadcast join (one row per block) keeps the pieces in the order of the scan.
        return _pieces(spark, paths).join(F.broadcast(of), ["path", "block"]).select(
            "id", "block", "value", "in_string", "depth", "last", "comma_ends", "alone")

    ends = materialize(pieces(blocks.where("not alone")).mapInArrow(_ends, "id long, no long, text string, tail boolean"), "json-ends")
    # A block that ends within an element hands that on: its number counts with
    # the elements that end before, so all parts of one element agree.
    n = F.max("no") + F.when(F.bool_or("tail"), 0).otherwise(1)
    ended = ends.groupBy("id").agg(n.alias("n"), F.max("no").alias("m")).join(blocks.select("id", "path", "block"), "id")
    past = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offset = ended.select("id", "path", "block", "m", F.coalesce(F.sum("n").over(past), F.lit(0)).alias("offset"))
    places = materialize(offset.select("id", "path", "block", "offset", F.max(F.col("offset") + F.col("m")).over(Window.partitionBy("path")).alias("last_no")), "json-places")
    # Only a block's first element can have begun before, only its last goes on.
    known = blocks.select("id", "path").join(places.select("id", "offset", "last_no"), "id", "left")
    no = F.col("no") + F.coalesce("offset", F.lit(0))
    whole = pieces(blocks).mapInArrow(_whole, "id long, no long, text string, last boolean").join(F.broadcast(known), "id").select(
        "path", no.alias("no"), "text", F.coalesce(no == F.col("last_no"), "last").alias("last"))
    parts = ends.where("(no = 0 or tail) and text is not null").join(F.broadcast(places), "id").select(
        "path", "block", no.alias("no"), "text", "last_no").groupBy("path", "no").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda x: x["text"]), "").alias("text"),
        (F.col("no") == F.max("last_no")).alias("last"))
    return _checked(whole.unionByName(parts.select("path", "no", "text", "last")))


def _checked(every: DataFrame) -> DataFrame:
    """Takes the array's brackets off the first and the last element."""
    space = r"[ \t\n\r]*"
    first, last = F.col("no") == 0, F.col("last")
    text = F.when(first, F.regexp_replace("text", rf"\A{space}\[", "")).otherwise(F.col("text"))
    closed = F.when(last, text.rlike(rf"\]{space}\z")).otherwise(F.lit(True))
    text = F.when(last & closed, F.regexp_replace(text, rf"\]{space}\z", "")).otherwise(text)
    none = first & last & F.col("text").rlike(rf"\A{space}\z") & F.col("closed")
    return (every.withColumn("closed", closed).withColumn("text", text).where(~none)
            .select("path", "no", "text", (F.col("closed") & J.is_one_value("text")).alias("ok"), J.begins_object("text").alias("is_object")))
