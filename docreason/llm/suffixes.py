"""Removal of byte strings that occur twice, with suffix arrays.

Every byte covered by a string of ``length`` bytes that also starts anywhere
else (same text or another) is marked. The corpus is cut so that equal strings
meet in one task, and there a suffix array decides:

1. Each string of ``length`` bytes (window) is named by its minimizer, the
   least-hashed gram of ``GRAM`` bytes in it (the leftmost of equals). Windows in
   a row with one minimizer place form a run. Equal windows have equal minimizer
   hashes, so a window can repeat only if its run's hash is that of two runs.
2. Runs with such a hash are cut out of the texts as pieces (at most
   2 * length - GRAM bytes each). Equal pieces of a task are sent once, with how
   often they occur, and the pieces are shuffled by their hash.
   Windows are named at the shorter length ``SHORT``, and pieces reach ``length``
   bytes beyond, so that the same suffix arrays decide both lengths.
3. A task builds the suffix array of its pieces by two-stage sorting: only the
   suffixes smaller than their successors are sorted directly (to ``length``
   bytes), the others are induced by a scan of the buckets. Suffixes that begin
   no window, and that none is induced from, are left out. Neighbours whose
   common prefix reaches ``length`` are equal windows; a window whose equals,
   counted with their pieces' occurrences, are two or more is marked.
4. A hash with more than ``HOT`` distinct pieces (a passage common to very many
   texts, with other words around it) is dealt again: its pieces go through
   steps 1-3 as texts, a length at a time, with grams that close three quarters
   of the way to the window, so that a window meets those that share more of it
   and a piece falls into a few runs. What is still crowded goes on with longer
   grams; with grams as long as the window only equal windows meet.
5. Marks go back to the places where their pieces occur.

Bytes under a repeated string of ``SHORT`` bytes are counted beside (passages of
some fifty words, most of which are shorter than ``length``); only strings of
``length`` bytes are removed.

Hashes only bring candidates together; equality is always decided on bytes.

Edge cases: null text is empty; texts shorter than ``length`` keep all bytes;
repeated rows count as other texts with the same bytes; null doc_ids are rows
like others. Texts of any length are scanned in blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docreason.llm.common import keyed_text, store, with_workers

LENGTH, SHORT = 400, 240
GRAM = 32
#: Windows scanned at a time; bytes of pieces that share a suffix array at least.
BLOCK, SORTED = 1 << 18, 1 << 18
#: Distinct pieces of a hash beyond which it is dealt again.
HOT = 2000
#: Pieces whose occurrences a task counts before it hands the counts on.
SEEN = 300_000

_MIX = np.uint64(0x9E3779B97F4A7C15)


# ---------------------------------------------------------------- minimizers
def gram_hashes(data: np.ndarray, m: int) -> np.ndarray:
    """A 64-bit hash of the m bytes at each position."""
    power, width, part = 0x100000001B3, 1, (data.astype(np.uint64) + np.uint64(1)) * _MIX
    out, size = None, 0
    while True:
        if m & width:  # the part of this width follows what is there
            if out is None:
                out = part
            else:
                n = len(data) - size - width + 1
                out = out[:n] * np.uint64(power) + part[size: size + n]
            size += width
        if size == m:
            break
        part = part[: len(part) - width] * np.uint64(power) + part[width:]
        power = power * power & (1 << 64) - 1
        width *= 2
    out = out[: len(data) - m + 1].copy()
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return out


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    size, cur = 1, x
    while 2 * size <= w:
        cur = np.minimum(cur[: len(cur) - size], cur[size:])
        size *= 2
    n = len(x) - w + 1
    return np.minimum(cur[:n], cur[w - size: w - size + n])


def runs(data: np.ndarray, offsets: np.ndarray, length: int, m: int
         ) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(text number, start in it, windows, hash) of the runs of all texts
    data[offsets[i]:offsets[i + 1]]."""
    begins, ends = offsets[:-1].astype(np.int64), offsets[1:].astype(np.int64)
    own = np.flatnonzero(ends - begins >= length)
    if not len(own):
        return
    begins, last = begins[own], ends[own] - length  # windows start at begins..last
    for a in range(int(begins[0]), int(last[-1]) + 1, BLOCK):
        b = min(a + BLOCK, int(last[-1]) + 1)
        h = gram_hashes(data[a: b + length - 1], m)
        place = np.arange(len(h), dtype=np.uint64)
        low = np.uint64((1 << 24) - 1)
        least = (sliding_min((h & ~low) | place, length - m + 1) & low).astype(np.int64)
        lo, hi = np.searchsorted(last, a), np.searchsorted(begins, b)
        step = np.zeros(b - a + 1, np.int64)
        np.add.at(step, np.maximum(begins[lo:hi], a) - a, 1)
        np.add.at(step, np.minimum(last[lo:hi] + 1, b) - a, -1)
        real = np.cumsum(step)[:-1] > 0
        new = real.copy()
        new[1:] &= (least[1:] != least[:-1]) | ~real[:-1]
        start = np.flatnonzero(new)
        if not len(start):
            continue
        total = np.concatenate([[0], np.cumsum(real)])
        n = total[np.append(start[1:], b - a)] - total[start]
        text = np.searchsorted(begins, start + a, side="right") - 1
        yield own[text], start + a - begins[text], n, h[least[start]]


# ---------------------------------------------------------------- suffix array
def two_stage(text: bytes, depth: int, wanted: np.ndarray | None = None) -> np.ndarray:
    """Suffix array of the text, ordered by the first ``depth`` bytes at least.

    With a mask ``wanted`` only those suffixes are sorted, and after the last of
    a stretch those that its order is induced from, up to the next that is
    smaller than its successor."""
    n = len(text)
    t = np.frombuffer(text, np.uint8)
    # A suffix is smaller than its successor if its first differing neighbour is larger.
    sign = np.sign(np.diff(t.astype(np.int16), append=-1)).astype(np.int8)
    where = np.where(sign != 0, np.arange(n), n)
    small = sign[np.minimum.accumulate(where[::-1])[::-1]] > 0
    need = np.ones(n, bool)
    if wanted is not None:
        after = np.minimum.accumulate(np.where(small, np.arange(n), n - 1)[::-1])[::-1]
        last = np.flatnonzero(wanted & ~np.append(wanted[1:], False))
        step = np.zeros(n + 1, np.int64)
        np.add.at(step, last, 1)
        np.add.at(step, after[last] + 1, -1)
        need = wanted | (np.cumsum(step)[:-1] > 0)
    letters = text.decode("latin-1")
    direct = np.array(sorted(np.flatnonzero(small & need).tolist(), key=lambda i: letters[i:i + depth]), np.int64)
    first = t[direct] if len(direct) else np.zeros(0, np.uint8)
    bounds = np.searchsorted(first, np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    if need[-1]:
        induced[t[-1]].append(np.array([n - 1]))
    out = []
    for c in range(256):
        wave = np.concatenate(induced[c]) if induced[c] else np.zeros(0, np.int64)
        large = [wave]
        while len(wave):  # c before c: the bucket induces itself
            wave = wave[wave > 0] - 1
            wave = wave[(t[wave] == c) & need[wave]]
            large.append(wave)
        bucket = np.concatenate([*large, direct[bounds[c]: bounds[c + 1]]])
        if not len(bucket):
            continue
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        ch = t[before]
        more = (ch > c) & need[before]
        before, ch = before[more], ch[more]
        order = np.argsort(ch, kind="stable")
        before, ch = before[order], ch[order]
        cuts = np.flatnonzero(np.diff(ch)) + 1
        for part in np.split(before, cuts) if len(before) else []:
            induced[t[part[0]]].append(part)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def equal_windows(pieces: list[bytes], runs: np.ndarray, many: np.ndarray, length: int, short: int) -> list[list[np.ndarray]]:
    """For each piece (each at least ``short`` bytes): which of its first ``runs``
    windows of ``length`` and of ``short`` bytes occur twice or more, a piece
    standing for ``many`` of its kind. (What follows is in other pieces.)"""
    text = b"".join(pieces)
    size = np.array([len(p) for p in pieces])
    begin = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(pieces)), size)
    left = (begin + size)[owner] - np.arange(len(text))
    t = np.frombuffer(text, np.uint8)
    own = np.arange(len(text)) - begin[owner] < runs[owner]
    every = two_stage(text, length, own & (left >= short))
    every = every[own[every]]
    out = []
    for width in dict.fromkeys((length, short)):
        order = every[left[every] >= width]  # windows within a piece
        a, b = order[:-1], order[1:]
        # Common prefixes of neighbours: by their outer bytes first, then in full.
        reach = (t[a] == t[b]) & (t[a + width - 1] == t[b + width - 1]) & (t[a + width // 2] == t[b + width // 2])
        some = np.flatnonzero(reach)
        reach[some] = [text[i:i + width] == text[j:j + width] for i, j in zip(a[some].tolist(), b[some].tolist())]
        group = np.concatenate([[0], np.cumsum(~reach)])[:len(order)]
        total = np.bincount(group, many[owner[order]])
        marked = np.zeros(len(text), bool)
        marked[order[total[group] >= 2]] = True
        out.append([marked[s: s + k] for s, k in zip(begin.tolist(), np.clip(size - width + 1, 0, runs).tolist())])
    return [out[0], out[-1]]


def ranges(mask: np.ndarray) -> tuple[list[int], list[int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
    return edge[::2].tolist(), (edge[1::2] - edge[::2]).tolist()


# ---------------------------------------------------------------- Spark jobs
def _binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.binary())  # 32-bit offsets, whatever Spark's Arrow settings
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset: column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


MARKS = ["starts", "sizes", "short_starts", "short_sizes"]


def repeats(texts: DataFrame, length: int, m: int, short: int) -> DataFrame:
    """Windows that repeat: id1, id2, starts, sizes (runs of marked windows), and
    short_starts, short_sizes of those of ``short`` bytes.

    texts: id1, id2, text (binary), many (how often the text occurs)."""
    kind = texts.schema["id1"].dataType.simpleString()
    scale = m < short  # with grams as long as windows nothing is left to deal again

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = _binary(b["text"])
            many = b["many"].to_numpy()
            for text, start, n, h in runs(data, offsets, short, m):
                at = pa.array(text)
                yield pa.RecordBatch.from_arrays(
                    [b["id1"].take(at), b["id2"].take(at), pa.array(start), pa.array(n), pa.array(h.view(np.int64)),
                     pa.array(many[text])], names=["id1", "id2", "start", "n", "h", "many"])

    found = store(texts.mapInArrow(scan, f"id1 {kind}, id2 long, start long, n long, h long, many long"), "suffix-runs")
    # Stored, so that both sides of the join are plain shuffles, whose hot keys Spark can split.
    twice = store(found.groupBy("h").agg(F.sum("many").alias("total")).where("total >= 2").select("h"), "suffix-twice")
    wanted = (found.join(twice, "h", "left_semi").groupBy("id1", "id2")
              .agg(F.collect_set(F.struct("start", "n", "h")).alias("runs"))
              .withColumnsRenamed({"id1": "w1", "id2": "w2"}))
    held = texts.join(wanted, F.col("id1").eqNullSafe(F.col("w1")) & (F.col("id2") == F.col("w2"))).select(
        "id1", "id2", "text", "many", F.col("runs.start").alias("start"), F.col("runs.n").alias("n"), F.col("runs.h").alias("h"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each run (its text, place and piece), and rows for the
        pieces themselves: bytes when first seen, further occurrences later."""
        from xxhash import xxh3_128_digest

        seen: dict[bytes, list[int]] = {}

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows)) or [[]] * 10
            kinds = [id_type, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                              names=["id1", "id2", "start", "n", "h", "s1", "s2", "piece", "many", "placed"])

        def counts() -> Iterator[pa.RecordBatch]:
            more = [(None, None, None, None, h, *np.frombuffer(k, np.int64).tolist(), None, n, False) for k, (h, n) in seen.items() if n]
            seen.clear()
            for i in range(0, len(more), 10_000):
                yield batch(more[i:i + 10_000])

        id_type = pa.int64()
        for whole in batches:
            id_type = whole["id1"].type
            rows, size = [], 0
            for k in range(whole.num_rows):
                text, many = whole["text"][k].as_buffer().to_pybytes(), whole["many"][k].as_py()
                id1, id2 = whole["id1"][k].as_py(), whole["id2"][k].as_py()
                for start, n, h in zip(*(whole[c][k].values.to_pylist() for c in ("start", "n", "h"))):
                    piece = text[start: start + n - 1 + length]
                    key = xxh3_128_digest(n.to_bytes(8, "little") + piece)
                    s1, s2 = np.frombuffer(key, np.int64).tolist()
                    rows.append((id1, id2, start, None, h, s1, s2, None, many, True))
                    if key in seen:
                        seen[key][1] += many
                    else:
                        seen[key] = [h, 0]
                        rows.append((None, None, None, n, h, s1, s2, piece, many, False))
                        size += len(piece)
                if size > 8 << 20 or len(rows) > 20_000:
                    yield batch(rows)
                    rows, size = [], 0
                if len(seen) > SEEN:
                    yield from counts()
            yield batch(rows)
        yield from counts()

    pieces = store(held.mapInArrow(
        cut, f"id1 {kind}, id2 long, start long, n long, h long, s1 long, s2 long, piece binary, many long, placed boolean"), "suffix-pieces")
    kinds = pieces.where("not placed").select("h", "n", "s1", "s2", "piece", "many")

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}
        size, now = 0, None

        def done() -> pa.RecordBatch:
            text = [(k, v) for k, v in held.items()]
            n, many = (np.array([v[i] for _, v in text], np.int64) for i in (2, 1))
            marks = equal_windows([v[0] for _, v in text], n, many, length, short) if text else [[], []]
            rows = [(*k, *ranges(mask), *ranges(other)) for (k, _), mask, other in zip(text, *marks) if other.any()]
            cols = list(zip(*rows)) if rows else [[]] * 6
            return pa.RecordBatch.from_arrays([pa.array(c, pa.list_(pa.int64()) if i > 1 else pa.int64()) for i, c in enumerate(cols)],
                                              names=["s1", "s2", *MARKS])

        for b in batches:
            for h, n, s1, s2, piece, many in zip(*(b[c].to_pylist() for c in ("h", "n", "s1", "s2", "piece", "many"))):
                if h != now and size >= SORTED:
                    yield done()
                    held, size = {}, 0
                now = h
                own = held.setdefault((s1, s2), [None, 0, 0])
                own[1] += many
                if own[0] is None and piece is not None:
                    own[0], own[2] = piece, n
                    size += len(piece)
        yield done()

    crowded = kinds.where("piece is not null").groupBy("h").count().where(F.col("count") > HOT).select("h")
    hot = store(crowded, "suffix-crowded") if scale else None
    again = hot is not None and not hot.isEmpty()
    calm = kinds.join(hot, "h", "left_anti") if again else kinds
    marked = (calm.repartition("h").sortWithinPartitions("h").select("h", "n", "s1", "s2", "piece", "many")
              .mapInArrow(decide, "s1 long, s2 long, " + ", ".join(f"{c} array<long>" for c in MARKS)))
    if again:
        whole = (kinds.join(hot, "h", "left_semi").groupBy("s1", "s2")
                 .agg(F.max("piece").alias("text"), F.max("n").alias("n"), F.sum("many").alias("many")))
        whole = store(whole.select(F.col("s1").alias("id1"), F.col("s2").alias("id2"), "text", "n", "many"), "suffix-hot")
        none = F.array().cast("array<long>")
        for width in dict.fromkeys((length, short)):
            # Marks of one length: the other's columns stay empty.
            own = [F.col(c) if width == (length if i < 2 else short) else none.alias(c) for i, c in enumerate(MARKS)]
            texts = whole.withColumn("text", F.substring("text", F.lit(1), (F.col("n") - 1 + width).cast("int")))
            marked = marked.unionAll(repeats(texts, width, width - (width - m) // 4, width).select(
                F.col("id1").alias("s1"), F.col("id2").alias("s2"), *own))
    marked = store(marked, "suffix-marked")
    places = pieces.where("placed").select("id1", "id2", "start", "s1", "s2")
    return (places.join(marked, ["s1", "s2"])
            .select("id1", "id2", *[F.transform(c, lambda x: x + F.col("start")).alias(c) if "starts" in c else c for c in MARKS])
            .groupBy("id1", "id2").agg(F.collect_set(F.struct(*MARKS)).alias("marks"))
            .select("id1", "id2", *[F.flatten(f"marks.{c}").alias(c) for c in MARKS]))


def covered(starts: np.ndarray, sizes: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal byte runs [start, end) under the marked windows."""
    if not len(starts):
        return []
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate((starts + sizes - 1 + length)[order])
    new = np.flatnonzero(np.concatenate([[True], s[1:] > e[:-1]]))
    return list(zip(s[new].tolist(), e[np.append(new[1:] - 1, len(e) - 1)].tolist()))


def remove_repeats(docs: DataFrame, length: int = LENGTH, with_bytes: bool = False, short: int = SHORT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row, and
    n_repeated: bytes under strings of ``short`` bytes (``length`` at most) that
    also start anywhere else; with ``with_bytes`` also span_starts, span_ends
    (bytes removed) and kept."""
    with_workers(docs.sparkSession)
    short = min(short, length)
    rows = keyed_text(docs).select(F.col("doc_id").alias("id1"), F.col("text_key").alias("id2"), F.col("text").cast("binary").alias("text"))
    marks = repeats(rows.withColumn("many", F.lit(1).cast("long")), length, min(GRAM, short), short).withColumnsRenamed({"id1": "m1", "id2": "m2"})
    joined = rows.join(marks, F.col("id1").eqNullSafe(F.col("m1")) & (F.col("id2") == F.col("m2")), "left").select(
        "id1", "text", *MARKS)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 500):
                b = whole.slice(i, 500)
                out: dict[str, list] = {c: [] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "n_repeated", "span_starts", "span_ends", "kept")}
                for k in range(b.num_rows):
                    text = b["text"][k].as_buffer().to_pybytes()
                    spans, others = ([covered(*(b[c][k].values.to_numpy() for c in pair), width) for pair, width in
                                      ((MARKS[:2], length), (MARKS[2:], short))] if b["starts"][k].is_valid else [[], []])
                    kept, at = [], 0
                    for s, e in spans:
                        kept.append(text[at:s])
                        at = e
                    left = b"".join([*kept, text[at:]]) if spans else text
                    out["n_bytes"].append(len(text))
                    out["n_removed"].append(len(text) - len(left))
                    out["n_spans"].append(len(spans))
                    out["kept_sha256"].append(hashlib.sha256(left).hexdigest())
                    out["n_repeated"].append(sum(e - s for s, e in others))
                    if with_bytes:
                        out["span_starts"].append([s for s, _ in spans])
                        out["span_ends"].append([e for _, e in spans])
                        out["kept"].append(left)
                kinds = [pa.int64()] * 3 + [pa.string(), pa.int64()] + [pa.list_(pa.int64())] * 2 + [pa.binary()]
                cols = {c: pa.array(v, t) for (c, v), t in zip(out.items(), kinds) if with_bytes or c[:4] != "span" and c != "kept"}
                yield pa.RecordBatch.from_pydict({"doc_id": b["id1"], **cols})

    kind = docs.schema["doc_id"].dataType.simpleString()
    more = ", span_starts array<long>, span_ends array<long>, kept binary" if with_bytes else ""
    return joined.mapInArrow(apply, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_repeated long{more}")
