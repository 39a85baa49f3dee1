"""Alignment of two tokenizers' tokens by byte ranges, with corpus-wide counts
of linked id pairs from an inverted index of bitmaps.

Every text (a space before it) is encoded by a byte-level tokenizer A and a
sentence-piece tokenizer B. Byte offsets at which tokens of both end cut the
tokens into groups; every A token of a group is linked with every B token of it.

Index: documents are dealt into blocks of at most 65,536 with a place in each.
For every id pair and block there is one posting: bit planes of the number of
links, plane j holding the documents whose number has bit j set. A plane is a
sorted array of 16-bit places, or a bitmap of 8192 bytes from 4096 documents on.
Planes OR-merged and popcounted give the pair's document count, popcounts times
2^j its link count. Counts are summed by pair over the blocks, joined back to the
postings, and the postings return every document's sums to its block.

Encoding: between a character that is not white space and a following space or
line feed no token of either vocabulary reaches across (checked when the files
are loaded), so a text's tokens are those of its units, " word" or "\\nword", and
a worker encodes each distinct unit once (``CACHE`` units at most; then it starts
anew). Texts with other white space are one unit.

Edge cases: a text that is null or empty, or whose joined token bytes of A or B
differ from the space and the text, has no tokens (zeros, empty digest).
Repeated rows are documents of their own. Extra columns are not looked at. An
empty table gives no rows. Ties for an A id's highest count all count as best.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docreason.llm.common import documents, store, with_workers
from docreason.llm.packing import _byte_characters

#: Documents and postings of a block at most, units kept by a worker and
#: characters taken at a time.
BLOCK, POSTINGS, CACHE, SLICE = 1 << 16, 3_000_000, 300_000, 1 << 21
#: Places in an array from which on a plane is a bitmap.
DENSE = 4096
MARK = "\x1f"
OTHER_SPACE = re.compile("[^\\S \\n]|[\\x1c-\\x1f\\x85\\u180e\\ufeff]")
UNIT = re.compile(r"[ \n]+[^ \n]*")


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... (sizes[i] of them) for every i."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes - starts, sizes)


class Vocabularies:
    def __init__(self, byte_level: str, pieces: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_level)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        byte_of = {c: i for i, c in enumerate(_byte_characters())}
        vocab = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.a_bytes[i] = bytes(map(byte_of.__getitem__, token)) if all(c in byte_of for c in token) else token.encode()
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        self.a_size, self.b_size = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))
        own = [p for i, p in enumerate(names) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))]
        probe = self.b.encode("\n ")
        #: A line feed is a piece of its own, and a space only begins pieces.
        self.splits = (len(probe) == 3 and self.b.is_byte(probe[1])
                       and not any("\n" in p or re.search("[^▁]▁", p) for p in own))
        #: Every id with the sign that follows it in a listing.
        self.signs = [f"{i}{c}" for names, signs in ((self.a_bytes, ",|"), (self.b_bytes, ",;")) for c in signs for i in range(len(names))]
        self.sign_size = np.array(list(map(len, self.signs)), np.int64)
        self.clear()

    def clear(self) -> None:
        self.seen: dict[str, int] = {}
        self.groups: list[str] = []  # of each unit, with a last ";"
        self.valid = np.zeros(0, bool)
        self.counts = np.zeros((0, 4), np.int64)  # n_a, n_b, n_groups, n_links
        self.at, self.pairs = np.zeros(1, np.int64), np.zeros(0, np.int64)
        self.bytes = 0

    def units(self, text: str) -> list[str]:
        s = " " + text
        if not self.splits:
            return [s]
        if MARK not in text:
            units = s.replace("\n", MARK + "\n").replace(" ", MARK + " ").split(MARK)[1:]
            words = text.split()
            # One white space before each word and no other anywhere.
            if len(units) == len(words) and sum(map(len, words)) + len(units) == len(s):
                return units
        return [s] if OTHER_SPACE.search(text) else UNIT.findall(s)

    def encode(self, units: list[str], joined: int) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of A and B of strings of ``joined`` units each."""
        parts = ["".join(units[i:i + joined]) for i in range(0, len(units), joined)]
        a = [e.ids for e in self.a.encode_batch_fast(parts, add_special_tokens=False)]
        if self.splits:  # "\n" keeps the added space apart: two pieces that are dropped
            return a, [x[2:] for x in self.b.encode(["\n" + u for u in parts], num_threads=1)]
        return a, self.b.encode([u[1:] for u in parts], num_threads=1)

    def learn(self, units: list[str]) -> None:
        """Encode new units and keep their groups and links."""
        raw = [u.encode() for u in units]
        whole = b"".join(raw)
        ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))
        # Units that end in a character may be encoded together.
        a, b = self.encode(units, 64 if self.splits and not any(u[-1].isspace() for u in units) else 1)
        fa, fb = (np.fromiter(chain.from_iterable(x), np.int64) for x in (a, b))
        ok = np.ones(len(units), bool)
        same = all(b"".join(map(names.__getitem__, ids.tolist())) == whole for names, ids in ((self.a_bytes, fa), (self.b_bytes, fb)))
        if not same:
            # Each by itself; the bytes of invalid ones are left out of the line.
            a, b = self.encode(units, 1)
            ok = np.array([r == b"".join(map(self.a_bytes.__getitem__, x)) == b"".join(map(self.b_bytes.__getitem__, y))
                           for r, x, y in zip(raw, a, b)])
            fa, fb = (np.fromiter(chain.from_iterable(x for x, good in zip(y, ok) if good), np.int64) for y in (a, b))
            ends = np.cumsum(np.where(ok, np.fromiter(map(len, raw), np.int64, len(raw)), 0))
        # Ends of tokens on one line of all units' bytes.
        ea, eb = np.cumsum(self.a_size[fa]), np.cumsum(self.b_size[fb])
        at = np.searchsorted(eb, ea)
        cuts = ea[eb[at] == ea] if len(ea) else ea
        ga, gb = np.searchsorted(cuts, ea), np.searchsorted(cuts, eb)
        ca, cb = np.bincount(ga, minlength=len(cuts)), np.bincount(gb, minlength=len(cuts))
        links = cb[ga]  # of each A token
        pairs = np.repeat(fa, links) * len(self.b_bytes) + fb[_ragged((np.cumsum(cb) - cb)[ga], links)]

        def per_unit(x, weights=None):
            return np.bincount(np.searchsorted(ends, x), weights, len(units)).astype(np.int64)
        per = np.stack([per_unit(ea), per_unit(eb), per_unit(cuts), per_unit(ea, links)], 1)
        per[~ok] = 0
        # The listing: of each group its A ids, then its B ids, each with the sign after it.
        order = np.empty(len(fa) + len(fb), np.int64)
        order[np.arange(len(fa)) + (np.cumsum(cb) - cb)[ga]] = np.where(np.append(ga[1:], -1) == ga, 0, len(self.a_bytes)) + fa
        order[np.arange(len(fb)) + np.cumsum(ca)[gb]] = 2 * len(self.a_bytes) + np.where(np.append(gb[1:], -1) == gb, 0, len(self.b_bytes)) + fb
        listing = "".join(map(self.signs.__getitem__, order.tolist()))
        run = np.concatenate([[0], np.cumsum(self.sign_size[order])])
        last = run[np.cumsum(per[:, 0] + per[:, 1])].tolist()
        at = 0
        for unit, end in zip(units, last):
            self.seen[unit] = len(self.groups)
            self.groups.append(listing[at:end])
            self.bytes += len(unit) + end - at
            at = end
        self.valid = np.concatenate([self.valid, ok])
        self.counts = np.concatenate([self.counts, per])
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(per[:, 3])])
        self.pairs = np.concatenate([self.pairs, pairs])

    def align(self, texts: list[str]):
        """Per text: (n_a, n_b, n_groups, n_links), digest; and of all links
        (text number, pair)."""
        units = [self.units(t) if t else [] for t in texts]
        if len(self.seen) > CACHE or self.bytes > 1 << 26:
            self.clear()
        new = list(set().union(*units) - self.seen.keys())
        # White space at the end, and whole texts, apart from those that can be joined.
        new.sort(key=lambda u: u[-1].isspace() or len(u) > 1000)
        for i in range(0, len(new), 20_000):
            self.learn(new[i:i + 20_000])
        n = np.fromiter(map(len, units), np.int64, len(units))
        flat = np.fromiter(map(self.seen.__getitem__, chain.from_iterable(units)), np.int64, n.sum())
        owner = np.repeat(np.arange(len(texts)), n)
        bad = np.bincount(owner, ~self.valid[flat], len(texts)) > 0
        flat, owner = flat[~bad[owner]], owner[~bad[owner]]
        n[bad] = 0
        run = np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(self.counts[flat], axis=0)])
        ends = np.cumsum(n)
        digests, listed = [], flat.tolist()
        for a, b in zip((ends - n).tolist(), ends.tolist()):
            text = "".join(map(self.groups.__getitem__, listed[a:b]))
            digests.append(hashlib.sha256(text[:-1].encode()).hexdigest() if text else "")
        sizes = self.at[flat + 1] - self.at[flat]
        return run[ends] - run[ends - n], digests, np.repeat(owner, sizes), self.pairs[_ragged(self.at[flat], sizes)]


def _counted(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and how often each occurs."""
    key = np.sort(key)
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[starts], np.diff(np.append(starts, len(key)))


_LOADED: dict[tuple[str, str], Vocabularies] = {}


def planes(pair: np.ndarray, place: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Distinct pairs and the planes of each, from entries sorted by (pair, place)."""
    starts = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
    row = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(pair))))
    n_planes = np.frexp(np.maximum.reduceat(n, starts))[1]
    first = np.cumsum(n_planes) - n_planes
    slot, docs = [], []
    for j in range(int(n_planes.max())):
        has = (n >> j) & 1 == 1
        slot.append(first[row[has]] + j)
        docs.append(place[has])
    slot, docs = np.concatenate(slot), np.concatenate(docs).astype("<u2")
    docs = docs[np.argsort(slot, kind="stable")]
    size = np.bincount(slot, minlength=n_planes.sum())
    if (size < DENSE).all():
        data, width = docs.tobytes(), 2 * size
    else:
        parts, at = [], 0
        for k in size.tolist():
            parts.append(_bitmap(docs[at:at + k]) if k >= DENSE else docs[at:at + k].tobytes())
            at += k
        data, width = b"".join(parts), np.where(size >= DENSE, BLOCK // 8, 2 * size)
    offsets = np.concatenate([[0], np.cumsum(width)]).astype(np.int32)
    binary = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)])
    return pair[starts], pa.ListArray.from_arrays(pa.array(np.append(first, n_planes.sum()), pa.int32()), binary)


def _bitmap(places: np.ndarray) -> bytes:
    bits = np.zeros(BLOCK, bool)
    bits[places] = True
    return np.packbits(bits).tobytes()


def _places(plane: bytes) -> np.ndarray:
    if len(plane) == BLOCK // 8:
        return np.flatnonzero(np.unpackbits(np.frombuffer(plane, np.uint8)))
    return np.frombuffer(plane, "<u2")


def merged(planes: list[bytes]) -> int:
    """Documents in any plane: OR of bitmaps and arrays, popcounted."""
    if len(planes) == 1:
        return len(planes[0]) // 2 if len(planes[0]) < BLOCK // 8 else int(np.bitwise_count(np.frombuffer(planes[0], np.uint8)).sum())
    if any(len(p) == BLOCK // 8 for p in planes):
        bits = np.zeros(BLOCK // 8, np.uint8)
        for p in planes:
            bits |= np.frombuffer(p if len(p) == BLOCK // 8 else _bitmap(np.frombuffer(p, "<u2")), np.uint8)
        return int(np.bitwise_count(bits).sum())
    return len(np.unique(np.concatenate([np.frombuffer(p, "<u2") for p in planes])))


def index(docs: DataFrame, byte_level: str, pieces: str) -> DataFrame:
    """One row per document (block, place, doc_id, counts, digest) and one per
    posting (block, pair, planes), told apart by ``pair``."""
    with_workers(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    counts = ["n_a", "n_b", "n_groups", "n_links"]
    schema = f"block long, place int, doc_id {kind}, {', '.join(f'{c} long' for c in counts)}, groups_sha256 string, pair long, planes array<binary>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (byte_level, pieces) not in _LOADED:
            _LOADED[byte_level, pieces] = Vocabularies(byte_level, pieces)
        voc = _LOADED[byte_level, pieces]
        block = TaskContext.get().partitionId() << 32
        used, held, keys, ns = 0, 0, [], []
        names = ["block", "place", "doc_id", *counts, "groups_sha256", "pair", "planes"]
        types, none = None, lambda t, n: pa.nulls(n, t)

        def flush():
            key, n = np.concatenate(keys), np.concatenate(ns)
            o = np.argsort(key)
            key, n = key[o], n[o]
            pair, lists = planes(key >> 16, key & 0xFFFF, n)
            for i in range(0, len(pair), 20_000):
                p = pair[i:i + 20_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(p), block)), none(pa.int32(), len(p)), none(types, len(p)), *[none(pa.int64(), len(p))] * 4,
                     none(pa.string(), len(p)), pa.array(p), lists.slice(i, len(p))], names=names)

        for whole in batches:
            types = whole.schema.field("doc_id").type
            at = 0
            while at < whole.num_rows:
                texts, chars = [], 0
                for t in whole["text"].slice(at, 2000).to_pylist():
                    if texts and chars + len(t) > SLICE:
                        break
                    texts.append(t)
                    chars += len(t)
                if used + len(texts) > BLOCK or held > POSTINGS:
                    if keys:
                        yield from flush()
                    block, used, held, keys, ns = block + 1, 0, 0, [], []
                totals, digests, doc, pair = voc.align(texts)
                key, n = _counted(pair << 16 | (doc + used))
                if len(key):
                    keys.append(key)
                    ns.append(n)
                    held += len(key)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(texts), block)), pa.array(np.arange(used, used + len(texts)), pa.int32()),
                     whole["doc_id"].slice(at, len(texts)), *[pa.array(totals[:, j]) for j in range(4)], pa.array(digests, pa.string()),
                     none(pa.int64(), len(texts)), none(pa.list_(pa.binary()), len(texts))], names=names)
                used += len(texts)
                at += len(texts)
        if keys:
            yield from flush()

    return documents(docs).mapInArrow(run, schema)


def pair_counts(postings: DataFrame, b_size: int) -> DataFrame:
    """pair, count (documents), links and whether the count is its A id's highest."""
    def popcount(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b["planes"].to_pylist()
            links = [sum(len(_places(p)) << j for j, p in enumerate(x)) for x in rows]
            yield pa.RecordBatch.from_arrays([b["pair"], pa.array(list(map(merged, rows)), pa.int64()), pa.array(links, pa.int64())],
                                             names=["pair", "n", "links"])

    counts = store(postings.select("pair", "planes").mapInArrow(popcount, "pair long, n long, links long")
                   .groupBy("pair").agg(F.sum("n").alias("count"), F.sum("links").alias("links")), "alignment-counts")
    a = F.floor(F.col("pair") / b_size).alias("a")
    highest = counts.groupBy(a).agg(F.max("count").alias("highest"))
    return counts.withColumn("a", a).join(highest, "a").select("pair", "count", "links", (F.col("count") == F.col("highest")).alias("best"))


def scores(postings: DataFrame, counts: DataFrame) -> DataFrame:
    """block, place, n_best, count_sum of every document with links."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, best, total = None, np.zeros(BLOCK, np.int64), np.zeros(BLOCK, np.int64)

        def out():
            at = np.flatnonzero(total)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(at), block)), pa.array(at, pa.int32()), pa.array(best[at]), pa.array(total[at])],
                                              names=["block", "place", "n_best", "count_sum"])
        for b in batches:
            blocks = b["block"].to_numpy()
            cuts = np.flatnonzero(np.concatenate([[True], blocks[1:] != blocks[:-1]]))
            for i, j in zip(cuts, np.append(cuts[1:], len(blocks))):
                if block is not None and blocks[i] != block:
                    yield out()
                    best[:], total[:] = 0, 0
                block = blocks[i]
                part = b.slice(i, j - i)
                lists = part["planes"]
                count, top = part["count"].to_numpy(), part["best"].to_numpy(zero_copy_only=False).astype(np.int64)
                where, weight, row = [], [], []
                for r, x in enumerate(lists.to_pylist()):
                    for k, plane in enumerate(x):
                        p = _places(plane)
                        where.append(p)
                        weight.append(1 << k)
                        row.append(r)
                size = np.fromiter(map(len, where), np.int64, len(where))
                where = np.concatenate(where)
                weight, row = np.array(weight, np.int64), np.array(row)
                np.add.at(total, where, np.repeat(weight * count[row], size))
                np.add.at(best, where, np.repeat(weight * top[row], size))
        if block is not None:
            yield out()

    n = int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (postings.join(counts, "pair").select("block", "planes", "count", "best")
            .repartition(n, "block").sortWithinPartitions("block")
            .mapInArrow(add, "block long, place int, n_best long, count_sum long"))


def align(docs: DataFrame, byte_level: str, pieces: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    both = store(index(docs, byte_level, pieces), "alignment-index")
    postings = both.where("pair is not null").select("block", "pair", "planes")
    counts = pair_counts(postings, b_size(pieces))
    sums = scores(postings, counts)

    def sum_of(c):
        return F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return (both.where("pair is null").join(sums, ["block", "place"], "left")
            .select("doc_id", "n_a", "n_b", "n_groups", "n_links", sum_of("n_best"), sum_of("count_sum"), "groups_sha256"))


def b_size(pieces: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=pieces).get_piece_size()
