"""Best-fit-decreasing packing of tokenized documents into sequences.

A document's ids are those of a public tokenizer, then ``END``. Only documents
longer than a sequence are cut, into full pieces and a shorter last one; full
pieces are sequences of their own. All other pieces are dealt by a hash into
groups of about ``GROUP`` pieces, and every group is packed by best-fit
decreasing: pieces from long to short, each into the open sequence with the
least room that still holds it. A segment tree over the room 0..size, whose
leaves list the open sequences with that room, finds it in log2(size) steps.

At most one sequence of a group can be half empty (two such would have been
one). These light sequences, one a group at most, are packed again as whole
blocks, for ``BLOCKS`` groups at a time, so the cost over one global packing is a
fraction of a sequence for each group. Group and block numbers follow the number
of pieces, so no task grows with the input.

Tokenizing: the vocabulary's normalizer and splitter never join what a space or
line feed separates, so the ids of a text are those of its pieces, one after
another. A worker tokenizes each distinct piece once and keeps the ids (``CACHE``
pieces at most; then it starts anew). ``Pieces`` is written for vocabularies with
the splitter of ``word_bpe_49k``.

Edge cases: null and empty texts are the one id ``END``. Repeated rows are packed
one by one. Empty tables give no rows.
"""

from __future__ import annotations

import re
import sys
import unicodedata
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docreason.llm.common import documents, store, with_workers

SIZE = 2048
END = bytes(4)
GROUP = 20_000
BLOCKS = 1000
CACHE = 200_000


def _byte_characters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary:
    printable ones for themselves, the others from U+0100 on in order."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in own else next(others)) for b in range(256)]


def _latin_words() -> re.Pattern[str]:
    """The vocabulary's splitting pattern over lower-cased Latin-1 texts."""
    by = {"L": "", "N": "", "S": "\t\n\x0b\x0c\r \x85\xa0"}
    for c in map(chr, range(256)):
        kind = unicodedata.category(c)[0]
        if kind in "LN":
            by[kind] += c
    letters, numbers, spaces = (re.escape(by[k]) for k in "LNS")
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{spaces}{letters}{numbers}]+")


def _is_latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Seen(dict):
    """Ids by piece; a new piece is tokenized."""

    def __init__(self, ids: Callable[[str], bytes]):
        self.ids = ids

    def __missing__(self, piece: str) -> bytes:
        self[piece] = out = self.ids(piece)
        return out


class Pieces:
    """A worker's tokenizer with the ids of pieces that it has seen.

    Latin-1 texts are their own normal form and lower-case letter by letter, so
    they are split here and only their distinct words go to the tokenizer's
    model. All other texts, and texts with ``<|``, are split at spaces and line
    feeds and the distinct parts go through the whole tokenizer."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.words = _latin_words()
        self.characters = dict(enumerate(_byte_characters()))
        self.seen = Seen(self._latin), Seen(self._other)

    def _latin(self, word: str) -> bytes:
        if not (word.isascii() and word.isprintable()):
            word = word.encode().decode("latin-1").translate(self.characters)
        return array("I", [t.id for t in self.model.tokenize(word)]).tobytes()

    def _other(self, part: str) -> bytes:
        return array("I", self.tokenizer.encode(part, add_special_tokens=False).ids).tobytes()

    def ids(self, text: str) -> bytes:
        """Unsigned 32-bit ids of a text, in the machine's byte order."""
        if (text.isascii() or _is_latin(text)) and "<|" not in text:
            seen, parts = self.seen[0], self.words.findall(text.lower())
        else:
            seen, parts = self.seen[1], text.replace("\n", " ").split(" ")
        if len(seen) > CACHE:
            seen.clear()
        return b"".join(map(seen.__getitem__, parts))


_PIECES: dict[str, Pieces] = {}


def pieces(docs: DataFrame, tokenizer: str, size: int = SIZE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece."""
    with_workers(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _PIECES:
            _PIECES[tokenizer] = Pieces(tokenizer)
        tok = _PIECES[tokenizer]
        for whole in batches:
            for i in range(0, whole.num_rows, 500):
                b = whole.slice(i, 500)
                row, piece, start, length, crc = [], [], [], [], []
                for k, text in enumerate(b["text"].to_pylist()):
                    ids = tok.ids(text) + END
                    n = len(ids) // 4
                    for j, s in enumerate(range(0, n, size)):
                        own = ids[4 * s: 4 * (s + size)]
                        row.append(k)
                        piece.append(j)
                        start.append(s)
                        length.append(len(own) // 4)
                        crc.append(zlib.crc32(own if sys.byteorder == "little" else np.frombuffer(own, "u4").astype("<u4")))
                yield pa.RecordBatch.from_arrays(
                    [b["doc_id"].take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                     pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return documents(docs).mapInArrow(
        run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


class Room:
    """Segment tree over room 0..size: which rooms have an open sequence."""

    def __init__(self, size: int):
        self.leaves = 1 << (size + 1).bit_length()
        self.tree = [0] * (2 * self.leaves)  # open sequences below each node
        self.open: list[list[int]] = [[] for _ in range(size + 1)]

    def _add(self, room: int, n: int) -> None:
        i = room + self.leaves
        while i:
            self.tree[i] += n
            i >>= 1

    def put(self, room: int, sequence: int) -> None:
        self.open[room].append(sequence)
        self._add(room, 1)

    def take(self, least: int) -> tuple[int, int] | None:
        """A sequence with the least room of at least ``least``, taken out."""
        tree, i = self.tree, least + self.leaves
        if not tree[i]:
            while i > 1 and (i & 1 or not tree[i + 1]):  # up to the first right neighbour with any
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if tree[2 * i] else 2 * i + 1
        room = i - self.leaves
        self._add(room, -1)
        return room, self.open[room].pop()


def best_fit_decreasing(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset in it of each length (1..size)."""
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    rooms, n = Room(size), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[i])
        got = rooms.take(length)
        if got is None:
            room, own, n = size, n, n + 1
        else:
            room, own = got
        sequence[i], offset[i] = own, size - room
        if room > length:
            rooms.put(room - length, own)
    return sequence, offset


def pack(items: DataFrame, size: int = SIZE, group: int = GROUP) -> DataFrame:
    """The rows of ``items`` (with a column length, 1..size) with the columns
    sequence_id and offset."""
    with_workers(items.sparkSession)
    items = store(items, "packing-items")
    n = items.count()
    groups = max(1, -(-n // group))
    own = [c for c in items.columns]
    # The stored table is read alike each time, so its row numbers are stable;
    # they deal repeated rows apart.
    dealt = items.withColumn("_pack_group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))

    def fill(table: pa.Table) -> pa.Table:
        # In an order of their own, so that a task run again gives the same places.
        table = table.sort_by([(c, "ascending") for c in own])
        lengths = table["length"].to_numpy()
        seq, off = best_fit_decreasing(lengths, size)
        load = np.bincount(seq, lengths).astype(np.int64)
        for name, values in (("_pack_sequence", seq), ("_pack_load", load[seq]), ("offset", off)):
            table = table.append_column(name, pa.array(values))
        return table

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema)
    packed = store(dealt.groupBy("_pack_group").applyInArrow(
        fill, f"{kinds}, _pack_group long, _pack_sequence long, _pack_load long, offset long"), "packing-groups")

    light = (packed.where(2 * F.col("_pack_load") <= size)
             .select("_pack_group", "_pack_sequence", F.col("_pack_load").alias("length")).distinct()
             .withColumn("_pack_block", F.floor(F.col("_pack_group") / BLOCKS)))

    def join(table: pa.Table) -> pa.Table:
        table = table.sort_by("_pack_group")
        groups_, sequences = (table[c].to_numpy() for c in ("_pack_group", "_pack_sequence"))
        seq, off = best_fit_decreasing(table["length"].to_numpy(), size)
        host = np.zeros(len(seq), np.int64)
        host[seq[off == 0]] = np.flatnonzero(off == 0)
        return pa.table({"_pack_group": groups_, "_pack_sequence": sequences, "host_group": groups_[host[seq]],
                         "host_sequence": sequences[host[seq]], "shift": off})

    moved = light.groupBy("_pack_block").applyInArrow(
        join, "_pack_group long, _pack_sequence long, host_group long, host_sequence long, shift long")
    out = packed.join(moved, ["_pack_group", "_pack_sequence"], "left")
    place = F.shiftleft(F.coalesce("host_group", "_pack_group"), 32) + F.coalesce("host_sequence", "_pack_sequence")
    return out.select(*own, place.alias("sequence_id"),
                      (F.col("offset") + F.coalesce("shift", F.lit(0).cast("long"))).alias("offset"))


def pack_documents(docs: DataFrame, tokenizer: str, size: int = SIZE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every
    piece of every row."""
    return pack(pieces(docs, tokenizer, size), size)
