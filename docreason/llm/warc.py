"""Zstandard WARC archives with a dictionary: writer and reader.

An archive is one file. Its first frame is a skippable frame (number
``DICTIONARY``) that holds the archive's dictionary; every record is one
Zstandard frame of its own, compressed with that dictionary. The dictionary is
trained on the archive's first payloads (``TRAIN_ROWS`` and ``TRAIN_BYTES`` at
most); an archive whose payloads are too few to train on has none.

Files are written by Spark's text sink, so tasks that are run again or lost
commit like any other Spark output and any file system will do: a task's frames
are the lines of its file, and the line separator is an empty skippable frame,
which readers of Zstandard pass over. One file is one task; ``per_archive`` bytes
of payload decide how many there are.

The reader takes whole files (Spark's ``binaryFile``), loads the dictionary from
the leading skippable frame (plain or itself compressed), then decodes frame by
frame and validates: version line, required headers, Content-Length against the
block, the closing blank lines, the HTTP length against the payload and the
payload digest of responses. A record that fails is a row with ``error``; a frame
that cannot be decoded ends its file with such a row.

Equal payloads of ``revisit_from`` bytes at least are stored once: the row with
the largest page_id is the response, the others are revisit records (identical
payload digest) that refer to it. Rows that repeat that page_id and payload are
responses too. A null page_id counts as smaller than any other; if all are null
each is a response. Null html is an empty payload, null url an empty one. Empty
tables give no archive and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docreason.llm.common import store, with_workers
from docreason.session import scratch_dir

#: Magic number of the skippable frame with the dictionary, and of a Zstandard frame.
DICTIONARY, FRAME = 0x184D2A5D, 0xFD2FB528
#: An empty skippable frame of another number: the separator, all ASCII.
SEPARATOR = struct.pack("<II", 0x184D2A50, 0)
REVISIT_FROM = 1000
PER_ARCHIVE = 32 << 20
TRAIN_ROWS, TRAIN_BYTES, DICTIONARY_BYTES = 200, 4 << 20, 32 << 10
LEVEL = 3
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")


# ---------------------------------------------------------------- records
def record(page_id, url: str, payload: bytes, size: int, sha1: bytes, refers_to=None) -> bytes:
    """A response record, or a revisit record (with no payload) if it refers."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    digest = base64.b32encode(sha1).decode()
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
             f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}",
             f"WARC-Target-URI: {' '.join(url.split())}", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class Bad(ValueError):
    """A record that fails validation."""


def _headers(raw: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in raw.decode("utf-8").split("\r\n"):
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            raise Bad(f"malformed header {line[:60]!r}")
        if name.lower() in out:
            raise Bad(f"repeated header {name}")
        out[name.lower()] = value.strip()
    return out


def _length(headers: dict[str, str]) -> int:
    value = headers.get("content-length", "")
    if not (value.isascii() and value.isdigit()):
        raise Bad("bad Content-Length")
    return int(value)


def _page(value: str) -> str | None:
    if not (value.startswith("<urn:page:") and value.endswith(">")):
        raise Bad(f"unknown record id {value[:60]!r}")
    return value[10:-1] or None


def parse(raw: bytes) -> dict:
    """A validated record: page_id, url, record_type, refers_to, payload_bytes,
    payload_digest (hex), payload (None for a revisit)."""
    head, blank, rest = raw.partition(b"\r\n\r\n")
    first, _, lines = head.partition(b"\r\n")
    if not blank or first not in (b"WARC/1.0", b"WARC/1.1"):
        raise Bad("no WARC version line")
    try:
        headers = _headers(lines)
    except UnicodeDecodeError:
        raise Bad("headers are not UTF-8") from None
    for name in REQUIRED:
        if name not in headers:
            raise Bad(f"no {name}")
    length = _length(headers)
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise Bad("Content-Length does not fit the record")
    kind = headers["warc-type"]
    if kind not in ("response", "revisit"):
        raise Bad(f"record type {kind[:40]!r}")
    status, blank, payload = rest[:length].partition(b"\r\n\r\n")
    line, _, http = status.partition(b"\r\n")
    if not blank or not line.startswith(b"HTTP/"):
        raise Bad("no HTTP headers")
    size = _length(_headers(http))
    name, _, value = headers.get("warc-payload-digest", "").partition(":")
    try:
        sha1 = base64.b32decode(value)
    except ValueError:
        raise Bad("bad payload digest") from None
    if name != "sha1" or len(sha1) != 20:
        raise Bad("bad payload digest")
    refers = None
    if kind == "response":
        if len(payload) != size:
            raise Bad("HTTP length does not fit the payload")
        if hashlib.sha1(payload).digest() != sha1:
            raise Bad("payload digest does not fit")
    else:
        if payload:
            raise Bad("a revisit with a payload")
        refers = _page(headers.get("warc-refers-to", ""))
    return {"page_id": _page(headers["warc-record-id"]), "url": headers.get("warc-target-uri", ""), "record_type": kind,
            "refers_to": refers, "payload_bytes": size, "payload_digest": sha1.hex(),
            "payload": payload if kind == "response" else None}


# ---------------------------------------------------------------- frames
def train(samples: list[bytes]) -> bytes | None:
    import zstandard

    samples = [s for s in samples if s]
    if len(samples) < 8 or sum(map(len, samples)) < 4 * DICTIONARY_BYTES:
        return None
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:  # samples too alike or too short
        return None


def dictionary_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", DICTIONARY, len(dictionary)) + dictionary


def frames(data: bytes) -> Iterator[dict]:
    """The records of an archive, parsed; failures as {"error": ...}."""
    import zstandard

    view, at, dictionary = memoryview(data), 0, None
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == DICTIONARY:
        size = struct.unpack_from("<I", data, 4)[0]
        raw, at = bytes(view[8: 8 + size]), 8 + size
        if len(raw) < size:
            yield {"error": "the dictionary is cut off"}
            return
        if raw[:4] == struct.pack("<I", FRAME):
            raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
        dictionary = zstandard.ZstdCompressionDict(raw)
    decoder = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    while at < len(data):
        if len(data) - at < 8:
            yield {"error": f"cut off at {at}"}
            return
        magic, size = struct.unpack_from("<II", data, at)
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            at += 8 + size
            continue
        one = decoder.decompressobj()
        try:
            raw = one.decompress(view[at:])
            if not one.eof:
                raise zstandard.ZstdError("the frame is cut off")
        except zstandard.ZstdError as e:
            yield {"error": f"at {at}: {e}"}
            return
        at = len(data) - len(one.unused_data)
        try:
            yield parse(raw) | {"error": None}
        except Bad as e:
            yield {"error": str(e)}


# ---------------------------------------------------------------- Spark jobs
def plan(pages: DataFrame, revisit_from: int = REVISIT_FROM) -> DataFrame:
    """page_id, url, payload, size, sha1 (hex), refers_to of every row."""
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"),
                        F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("size", F.length("payload").cast("long")).withColumn("sha1", F.sha1("payload"))
    first = rows.where(F.col("size") >= revisit_from).groupBy("sha1").agg(
        F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    # Only payloads that occur twice are looked up; the others keep to their tasks' keys.
    first = store(first.select(F.col("sha1").alias("key"), "first"), "warc-first")
    key = F.when(F.col("size") >= revisit_from, F.col("sha1")).otherwise(F.xxhash64("page_id", "url").cast("string"))
    return rows.withColumn("key", key).join(first, "key", "left").select(
        "page_id", "url", "payload", "size", "sha1",
        F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def write(pages: DataFrame, path: str, revisit_from: int = REVISIT_FROM, per_archive: int = PER_ARCHIVE) -> None:
    """Write the rows of ``pages`` as archives under ``path``."""
    with_workers(pages.sparkSession)
    planned = plan(pages, revisit_from)
    total = pages.agg(F.sum(F.octet_length("html"))).first()[0] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        def lines(out: list[bytes]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["frame"])

        encoder = None
        held: list[tuple] = []
        for whole in batches:
            for i in range(0, whole.num_rows, TRAIN_ROWS):
                held += zip(*(c.to_pylist() for c in whole.slice(i, TRAIN_ROWS).columns))
                if encoder is None:
                    samples, size = [], 0
                    for r in held:
                        if r[5] is None and size + len(r[2]) <= TRAIN_BYTES:
                            samples.append(r[2])
                            size += len(r[2])
                    d = train(samples)
                    encoder = zstandard.ZstdCompressor(LEVEL, dict_data=zstandard.ZstdCompressionDict(d)) if d else zstandard.ZstdCompressor(LEVEL)
                    if d:
                        yield lines([dictionary_frame(d)])
                out = [encoder.compress(record(p, u, x, n, bytes.fromhex(s), r)) for p, u, x, n, s, r in held]
                held = []
                yield lines(out)

    archives = planned.repartition(max(1, -(-total // per_archive)))
    (archives.mapInArrow(run, "frame binary").select(F.col("frame").cast("string").alias("value"))
     .write.option("lineSep", SEPARATOR.decode("ascii")).text(path))


FIELDS = "page_id string, url string, record_type string, refers_to string, payload_bytes long, payload_digest string, payload binary, error string"


def read(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """The records of all archives under ``path`` (see FIELDS)."""
    with_workers(spark)
    names = [f.split()[0] for f in FIELDS.split(", ") if with_payload or f[:8] != "payload "]
    kinds = {"payload_bytes": pa.int64(), "payload": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], kinds.get(n, pa.string())) for n in names], names=names)

        for b in batches:
            for data in b["content"]:
                rows = []
                for r in frames(data.as_py()):
                    rows.append(r)
                    if len(rows) >= 500:
                        yield out(rows)
                        rows = []
                yield out(rows)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, ", ".join(f for f in FIELDS.split(", ") if f.split()[0] in names))


def round_trip(pages: DataFrame, revisit_from: int = REVISIT_FROM) -> DataFrame:
    """Write ``pages`` and read the archives back: page_id, payload_bytes,
    payload_digest, record_type, refers_to of every record. A record that cannot
    be read raises an error."""
    spark = pages.sparkSession
    kind = pages.schema["page_id"].dataType
    path = scratch_dir(spark, "llm-warc")
    write(pages, path, revisit_from)
    got = read(spark, path, with_payload=False)
    sound = F.when(F.col("error").isNotNull(), F.raise_error(F.col("error")).cast("string")).otherwise(F.col("record_type"))
    return got.select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest",
                      sound.alias("record_type"), F.col("refers_to").cast(kind).alias("refers_to"))
