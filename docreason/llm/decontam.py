"""Benchmark decontamination with an FM-index per training shard.

Test phrases are windows of ``window`` consecutive words of a benchmark item
(an item of fewer words, but not none, is one phrase). A shard is a run of rows
of one Spark partition. Its words become symbols; words of no phrase, and
document borders, are separators, and stretches between separators that are
shorter than every phrase cannot hold one and are left out. Over the rest the
task builds an FM-index: suffix array by prefix doubling, Burrows-Wheeler
transform, a wavelet matrix whose bit-vector ranks answer rank(symbol, i), and
suffix positions sampled every ``SAMPLE`` symbols and at each stretch's start.
Phrases are searched backwards, all of one length at once; occurrences are
located by LF steps to the next sampled position; the spans they cover are
merged for each document.

Phrases go to the tasks in blocks of at most ``BLOCK`` (a stated query set
against all rows, in blocks), so no broadcast grows with the benchmark.

Words: A-Z lower-cased, then ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``, found on
the UTF-8 bytes. Null text has no words. Items with the same text share phrases;
a null item_id is searched but not listed among the items. Repeated rows get a
row each. An empty benchmark hits nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docreason.llm.common import with_text, with_workers

WINDOW = 10
BLOCK = 100_000
#: Symbols of a shard's index, and bytes of text after which a shard ends.
SHARD_SYMBOLS, SHARD_BYTES = 1 << 19, 16 << 20
SAMPLE = 16

#: Bytes of words to themselves (A-Z lower-cased), all others to a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


@dataclass
class Phrases:
    """A block of distinct phrases: vocabulary, phrases by length, items."""
    vocab: dict[bytes, int]
    by_length: dict[int, tuple[np.ndarray, np.ndarray]]  # length -> (symbols [q, length], phrase numbers)
    items: list[list[str]]                               # by phrase number

    @property
    def shortest(self) -> int:
        return min(self.by_length)


def phrase_blocks(benchmark: DataFrame, window: int, block: int) -> Iterator[Phrases]:
    """The benchmark's phrases, read partition by partition."""
    found: dict[tuple[bytes, ...], set[str]] = {}

    def pack() -> Phrases:
        vocab: dict[bytes, int] = {}
        by: dict[int, tuple[list, list]] = {}
        for k, phrase in enumerate(found):
            rows, numbers = by.setdefault(len(phrase), ([], []))
            rows.append([vocab.setdefault(w, len(vocab) + 1) for w in phrase])
            numbers.append(k)
        return Phrases(vocab, {n: (np.array(r, np.int64), np.array(k)) for n, (r, k) in by.items()},
                       [sorted(x) for x in found.values()])

    for row in benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("binary").alias("text")
                                ).toLocalIterator():
        w = words_of(bytes(row["text"] or b""))
        for i in range(max(1, len(w) - window + 1) if w else 0):
            found.setdefault(tuple(w[i:i + window]), set()).update([row["item"]] if row["item"] is not None else [])
            if len(found) >= block:
                yield pack()
                found.clear()
    if found:
        yield pack()


# ---------------------------------------------------------------- FM-index
def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling. Symbol 0 is a separator; every
    separator counts as a symbol of its own, so no comparison goes past one."""
    n = len(text)
    seps = text == 0
    rank = np.where(seps, np.cumsum(seps) - 1, seps.sum() + text)
    step = 1
    order = np.argsort(rank, kind="stable")
    r = rank[order]
    rank[order] = np.cumsum(np.concatenate([[0], r[1:] != r[:-1]]))
    while n and rank[order[-1]] < n - 1:
        nxt = np.zeros(n, np.int64)
        nxt[: n - step] = rank[step:] + 1
        key = rank * np.int64(n + 1) + nxt
        order = np.argsort(key, kind="stable")
        k = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], k[1:] != k[:-1]]))
        step *= 2
    return order


class Bits:
    """A bit vector with rank."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(n // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def rank(self, i: np.ndarray) -> np.ndarray:
        w = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & mask)


class FmIndex:
    def __init__(self, text: np.ndarray, symbols: int):
        """text: symbols 1..symbols, 0 for separators; begins with one."""
        n = len(text)
        sa = suffix_array(text)
        before = text[sa - 1]  # text[-1] stands before the first suffix; both are separators
        before[sa == 0] = 0
        self.n, self.bwt = n, before
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols + 1))])
        marked = (sa % SAMPLE == 0) | (before == 0)
        self.marked, self.sampled = Bits(marked), sa[marked]
        self.is_marked = marked
        self.levels, self.zeros = [], []
        width, x = max(1, int(symbols).bit_length()), before
        for b in range(width - 1, -1, -1):
            bit = (x >> b & 1).astype(bool)
            self.levels.append((b, Bits(bit)))
            self.zeros.append(int(n - bit.sum()))
            x = np.concatenate([x[~bit], x[bit]])
        everything = np.arange(symbols + 1)
        self.start = self._descend(everything, np.zeros(symbols + 1, np.int64))

    def _descend(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for (b, bits), zeros in zip(self.levels, self.zeros):
            ones = bits.rank(i)
            i = np.where(symbol >> b & 1, zeros + ones, i - ones)
        return i

    def step(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """first[symbol] + rank(symbol, i)."""
        return self.first[symbol] + self._descend(symbol, i) - self.start[symbol]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows [lo, hi) of the phrases (of one length) that occur, and which."""
        which = np.arange(len(phrases))
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n)
        for j in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[which, j]
            lo, hi = self.step(c, lo), self.step(c, hi)
            on = lo < hi
            which, lo, hi = which[on], lo[on], hi[on]
        return which, lo, hi

    def locate(self, row: np.ndarray) -> np.ndarray:
        """Text positions of rows."""
        row = row.copy()
        pos, todo, steps = np.zeros(len(row), np.int64), np.arange(len(row)), 0
        while len(todo):
            r = row[todo]
            done = self.is_marked[r]
            pos[todo[done]] = self.sampled[self.marked.rank(r[done])] + steps
            todo = todo[~done]
            r = r[~done]
            row[todo] = self.step(self.bwt[r], r)
            steps += 1
        return pos


# ---------------------------------------------------------------- shards
class Shard:
    """Rows of a shard: their stretches of symbols, then their hits."""

    def __init__(self, phrases: Phrases):
        self.p = phrases
        self.rows, self.parts, self.size, self.bytes = 0, [], 0, 0

    def add(self, texts: list[bytes]) -> list[int]:
        """Takes texts in; returns how many words each has."""
        get, counts, ids = self.p.vocab.get, [], []
        for t in texts:
            w = words_of(t)
            counts.append(len(w))
            ids.append(np.fromiter((get(x, 0) for x in w), np.int64, len(w)))
            ids.append(np.zeros(1, np.int64))
            self.bytes += len(t)
        width = np.array(counts) + 1
        flat = np.concatenate([np.zeros(1, np.int64), *ids])
        edge = np.flatnonzero(np.diff((flat > 0).astype(np.int8)))
        a, b = edge[::2] + 1, edge[1::2] + 1  # stretches [a, b)
        keep = b - a >= self.p.shortest
        a, b = a[keep], b[keep]
        starts = np.cumsum(width) - width + 1
        doc = np.searchsorted(starts, a, side="right") - 1
        n = b - a
        at = np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())
        self.parts.append((flat[at], n, doc + self.rows, a - starts[doc] if len(a) else a))
        self.size += int(n.sum()) + len(n)
        self.rows += len(texts)
        return counts

    def full(self) -> bool:
        return self.size >= SHARD_SYMBOLS or self.bytes >= SHARD_BYTES

    def hits(self) -> list[tuple[list[int], list[int], list[str]]]:
        """By row: merged spans of hit words (starts, ends), items."""
        out: list[tuple[list[int], list[int], list[str]]] = [([], [], []) for _ in range(self.rows)]
        n = np.concatenate([p[1] for p in self.parts])
        if not len(n):
            return out
        doc, word = (np.concatenate([p[k] for p in self.parts]) for k in (2, 3))
        begin = np.cumsum(n + 1) - n  # each stretch follows its separator
        text = np.zeros(int((n + 1).sum()) + 1, np.int64)
        at = np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum())
        text[at] = np.concatenate([p[0] for p in self.parts])
        index = FmIndex(text, len(self.p.vocab))
        cover = np.zeros(len(text) + 1, np.int64)
        for length, (phrases, numbers) in self.p.by_length.items():
            which, lo, hi = index.search(phrases)
            if not len(which):
                continue
            many = hi - lo
            for a, b in _blocks(many, 1 << 20):
                k = many[a:b]
                rows = np.repeat(lo[a:b] - np.cumsum(k) + k, k) + np.arange(k.sum())
                pos = index.locate(rows)
                np.add.at(cover, pos, 1)
                np.add.at(cover, pos + length, -1)
                at_doc = doc[np.searchsorted(begin, pos, side="right") - 1]
                number = np.repeat(numbers[which[a:b]], k)
                for code in np.unique(at_doc * len(self.p.items) + number).tolist():
                    d, q = divmod(code, len(self.p.items))
                    out[d][2].extend(self.p.items[q])
        hit = np.diff((np.cumsum(cover) > 0).astype(np.int8), prepend=0)
        starts, ends = np.flatnonzero(hit == 1), np.flatnonzero(hit == -1)
        own = np.searchsorted(begin, starts, side="right") - 1
        shift = word[own] - begin[own]
        for d, s, e in zip(doc[own].tolist(), (starts + shift).tolist(), (ends + shift).tolist()):
            out[d][0].append(s)
            out[d][1].append(e)
        return out


def _blocks(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    total, a = np.cumsum(sizes), 0
    while a < len(sizes):
        base = total[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(total, base + most, side="right")))
        yield a, b
        a = b


def merge(starts: list[int], ends: list[int]) -> tuple[list[int], list[int]]:
    s, e = [], []
    for a, b in sorted(zip(starts, ends)):
        if s and a <= e[-1]:
            e[-1] = max(e[-1], b)
        else:
            s.append(a)
            e.append(b)
    return s, e


FOUND = "n_words long, starts array<long>, ends array<long>, items array<string>"


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block: int = BLOCK,
                  cut: bool = False) -> DataFrame:
    """doc_id, n_words, merged spans of hit words (starts, ends; words from 0)
    and items (distinct item_ids with occurring phrases) for every row. With
    ``cut`` instead the rows of ``docs`` without their hit words, found and
    taken out in one pass."""
    spark = with_workers(docs.sparkSession)
    name = "row" if cut else "doc_id"
    rows = docs.select(F.struct(*docs.columns).alias("row") if cut else F.col("doc_id"),
                       F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    kind = rows.schema[name].dataType.simpleString()
    blocks = list(phrase_blocks(benchmark, window, block)) or [Phrases({}, {window: (np.zeros((0, window), np.int64), np.zeros(0, np.int64))}, [])]

    def scan(shared, first: bool, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, shard = [], Shard(shared.value)

            def done() -> Iterator[pa.RecordBatch]:
                hits, at = shard.hits(), 0
                for batch, counts in held:
                    own = hits[at: at + batch.num_rows]
                    at += batch.num_rows
                    if not first:
                        old = zip(*(batch[c].to_pylist() for c in ("starts", "ends", "items")))
                        own = [(*merge(a[0] + b[0], a[1] + b[1]), a[2] + b[2]) for a, b in zip(own, old)]
                    if cut and last:
                        whole = pa.RecordBatch.from_struct_array(batch["row"])
                        texts = whole["text"].to_pylist()
                        yield with_text(whole, [cut_words(t, s, e) if s else t for t, (s, e, _) in zip(texts, own)])
                        continue
                    cols = {name: batch[name]} | ({} if last else {"text": batch["text"]})
                    cols |= {"n_words": pa.array(counts, pa.int64()),
                             "starts": pa.array([x[0] for x in own], pa.list_(pa.int64())),
                             "ends": pa.array([x[1] for x in own], pa.list_(pa.int64())),
                             "items": pa.array([sorted(set(x[2])) for x in own], pa.list_(pa.string()))}
                    yield pa.RecordBatch.from_pydict(cols)

            for whole in batches:
                for i in range(0, whole.num_rows, 500):
                    batch = whole.slice(i, 500)
                    counts = shard.add([t.as_buffer().to_pybytes() for t in batch["text"]])
                    held.append((batch.drop_columns(["text"]) if last else batch, counts))
                    if shard.full():
                        yield from done()
                        held, shard = [], Shard(shared.value)
            if held:
                yield from done()
        return run

    for k, phrases in enumerate(blocks):
        last = k == len(blocks) - 1
        found = f"{name} {kind}, " + ("" if last else "text binary, ") + FOUND
        rows = rows.mapInArrow(scan(spark.sparkContext.broadcast(phrases), k == 0, last), docs.schema if cut and last else found)
    return rows


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` with the hit words taken out of their texts."""
    return contamination(docs, benchmark, window, block, cut=True)


def cut_words(text: str, starts: list[int], ends: list[int]) -> str:
    """The text without the words of the spans (and what stands between them)."""
    raw = text.encode()
    at = [m.span() for m in WORD.finditer(raw)]
    out, done = [], 0
    for s, e in zip(starts, ends):
        out.append(raw[done: at[s][0]])
        done = at[e - 1][1]
    return b"".join([*out, raw[done:]]).decode()
