"""Prefix trie of conversations by time-forward processing.

Every distinct sequence of first d turns is a node. A turn's content is two
64-bit hashes; a prefix is the exclusive-or of the hashes of its (position,
content) pairs, 128 bits, so that prefixes are running sums that Spark takes in
two levels (within a chunk of a conversation, then over chunks).

Subtree totals go from children to parents by time-forward processing: Spark
sorts a shard's nodes externally by reverse level order, and a task walks over
them once; every node takes the messages addressed to it from a priority queue
that spills sorted runs to disk, and sends its own totals to its parent through
the same queue. Shards are whole subtrees: those below the nodes with more than
``limit`` members ("heavy"). The totals of shard roots are added up by parent
before they are shuffled, and the heavy nodes are the tree of the next round,
with a larger limit, until the rest is small enough for one task.

A node with one member heads a path: one leaf, nothing saved. Paths enter the
queue by their top node alone, so a conversation of any length is dealt out by
its turns and never walked in one task. What one task does walk is at most
``limit`` conversations' shared turns, in bounded memory.

Edge cases: rows without conv_id belong to no conversation; null role or text
is empty; turns are ordered with null first, equal ones by role, then text
(rows equal in all of these are all kept); extra columns are not looked at; an
empty table has no nodes. ``conv_id - conv_id % 5`` is taken with the remainder
of the divisor's sign (negative ids).
"""

from __future__ import annotations

import hashlib
import heapq
import struct
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docreason.llm.common import store, with_workers

#: Turns of a conversation summed in one window.
CHUNK = 4096
KEY = ["depth", "k1", "k2"]
EMPTY = hashlib.sha256(b"").hexdigest()


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def ordered_turns(conv: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), a, b (content), n_bytes of every turn.

    Rows are dealt by ranges of their whole order, so that one conversation may
    lie in many partitions; positions are those within the partition plus the
    conversation's rows in earlier ones (a table of at most one row for each
    partition)."""
    rows = conv.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"),
                       F.coalesce("text", F.lit("")).alias("text")).where("conv_id is not null")
    order = ["conv_id", "turn", "role", "text"]
    dealt = store(
        rows.repartitionByRange(_parts(conv), *order).sortWithinPartitions(*order).select(
            "conv_id", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place"),
            F.xxhash64("role", "text").alias("a"), F.xxhash64(F.lit("second"), "text", "role").alias("b"),
            F.octet_length("text").cast("long").alias("n_bytes")), "trie-turns")
    runs = dealt.groupBy("conv_id").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi")
    sizes = (dealt.join(F.broadcast(runs.select("conv_id")), "conv_id", "left_semi")
             .groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n")))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("conv_id", "part", F.coalesce(before, F.lit(0)).alias("offset"))
    local = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy("place"))
    return dealt.withColumn("local", local).join(F.broadcast(offsets), ["conv_id", "part"], "left").select(
        "conv_id", (F.col("local") + F.coalesce("offset", F.lit(0))).alias("pos"), "a", "b", "n_bytes")


def rebuilt(turns: DataFrame, group: int = 5, heads: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations that share their first turns with the first of their group.

    Every conversation c takes the first h = crc32(c) % ``heads`` turns of
    conversation c - c % ``group``, then its own after its first h. Returns
    (turns: conv_id, depth, a, b, n_bytes, length; conversations: conv_id, length)."""
    rest = F.pmod("conv_id", F.lit(group))
    n = turns.groupBy("conv_id").agg(F.max("pos").alias("n"))
    base = n.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base")).where(F.pmod("base", F.lit(group)) == 0)
    h = F.when(rest == 0, F.lit(0)).otherwise(F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads)
    taken = F.least("h", F.coalesce("n_base", F.lit(0)))
    convs = store(n.withColumn("h", h).withColumn("base", F.col("conv_id") - rest).join(base, "base", "left").select(
        "conv_id", "h", taken.alias("taken"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "trie-convs")
    own = turns.join(convs, "conv_id").where("pos > h").select(
        "conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("depth"), "a", "b", "n_bytes", "length")
    first = turns.where((rest == 0) & (F.col("pos") < heads)).withColumn(
        "conv_id", F.explode(F.transform(F.sequence(F.lit(1), F.lit(group - 1)), lambda j: F.col("conv_id") + j)))
    first = first.join(convs, "conv_id").where("pos <= h").select(
        "conv_id", F.col("pos").alias("depth"), "a", "b", "n_bytes", "length")
    return own.unionByName(first), convs.select("conv_id", "length")


def prefixes(turns: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Adds k1, k2 (the prefix that ends at the turn) and p1, p2 (the one before)."""
    t1 = F.xxhash64("depth", "a", "b")
    t2 = F.xxhash64(F.lit("second"), "b", "a", "depth")
    rows = turns.select("conv_id", "depth", "n_bytes", "length", t1.alias("t1"), t2.alias("t2"),
                        F.floor((F.col("depth") - 1) / chunk).alias("chunk"))
    sums = rows.where(F.col("length") > chunk).groupBy("conv_id", "chunk").agg(F.bit_xor("t1").alias("x1"), F.bit_xor("t2").alias("x2"))
    past = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("conv_id", "chunk", F.bit_xor("x1").over(past).alias("o1"), F.bit_xor("x2").over(past).alias("o2")).where("chunk > 0")
    here = Window.partitionBy("conv_id", "chunk").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    run = rows.withColumn("r1", F.bit_xor("t1").over(here)).withColumn("r2", F.bit_xor("t2").over(here))
    k = run.join(offsets, ["conv_id", "chunk"], "left").select(
        "conv_id", "depth", "n_bytes", (F.col("depth") == F.col("length")).alias("is_end"), "t1", "t2",
        F.col("r1").bitwiseXOR(F.coalesce("o1", F.lit(0))).alias("k1"), F.col("r2").bitwiseXOR(F.coalesce("o2", F.lit(0))).alias("k2"))
    return k.select("conv_id", "depth", "n_bytes", "is_end", "k1", "k2",
                    F.col("k1").bitwiseXOR(F.col("t1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("t2")).alias("p2"))


class SpillingQueue:
    """Least record first, at most ``limit`` records in memory; more go to
    sorted runs in unnamed temporary files, which end with the task."""

    RECORD = struct.Struct("<6q")

    def __init__(self, limit: int):
        self.limit, self.heap, self.runs = limit, [], []

    def push(self, record: tuple[int, ...]) -> None:
        heapq.heappush(self.heap, record)
        if len(self.heap) > self.limit:
            f = tempfile.TemporaryFile()
            for r in sorted(self.heap):
                f.write(self.RECORD.pack(*r))
            f.seek(0)
            self.heap = []
            self._next(self._read(f))

    def _read(self, f) -> Iterator[tuple[int, ...]]:
        while block := f.read(self.RECORD.size * 4096):
            yield from self.RECORD.iter_unpack(block)
        f.close()

    def _next(self, run: Iterator[tuple[int, ...]]) -> None:
        if (head := next(run, None)) is not None:
            heapq.heappush(self.runs, (head, id(run), run))

    def least(self) -> tuple[int, ...] | None:
        if self.runs and (not self.heap or self.runs[0][0] < self.heap[0]):
            return self.runs[0][0]
        return self.heap[0] if self.heap else None

    def pop(self) -> tuple[int, ...]:
        if self.runs and (not self.heap or self.runs[0][0] < self.heap[0]):
            head, _, run = heapq.heappop(self.runs)
            self._next(run)
            return head
        return heapq.heappop(self.heap)


def forward(limit: int):
    """The walk over nodes in reverse level order: adds n_children, n_leaves and
    saved_tokens of the whole subtree to each node's own."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue = SpillingQueue(limit)
        for b in batches:
            cols = [b[c].to_pylist() for c in ("depth", "k1", "k2", "p1", "p2", "is_root", "n_children", "n_leaves", "saved_tokens")]
            children, leaves, saved = cols[6:]
            for i, (depth, k1, k2, p1, p2, is_root) in enumerate(zip(*cols[:6])):
                key = (-depth, k1, k2)
                while (head := queue.least()) is not None and head[:3] == key:
                    _, _, _, c, n, s = queue.pop()
                    children[i] += c
                    leaves[i] += n
                    saved[i] += s
                if not is_root:
                    queue.push((1 - depth, p1, p2, 1, leaves[i], saved[i]))
            for name, values in zip(("n_children", "n_leaves", "saved_tokens"), cols[6:]):
                b = b.set_column(b.schema.get_field_index(name), name, pa.array(values, pa.int64()))
            yield b
    return run


def _blocks(size: int = 4096):
    """Conversation ids of one node, joined, in rows of at most ``size`` ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids = None, []

        def out():
            return pa.RecordBatch.from_pylist(
                [dict(zip(KEY, key), first=ids[0], ids=",".join(map(str, ids)))],
                pa.schema([(c, pa.int64()) for c in [*KEY, "first"]] + [("ids", pa.string())]))
        for b in batches:
            for *k, conv in zip(*(b[c].to_pylist() for c in [*KEY, "conv_id"])):
                if ids and (k != key or len(ids) >= size):
                    yield out()
                    ids = []
                key = k
                ids.append(conv)
        if ids:
            yield out()
    return run


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, sha = None, None

    def out():
        return pa.RecordBatch.from_pylist([dict(zip(KEY, key), ends=sha.hexdigest())],
                                          pa.schema([(c, pa.int64()) for c in KEY] + [("ends", pa.string())]))
    for b in batches:
        for *k, ids in zip(*(b[c].to_pylist() for c in [*KEY, "ids"])):
            if k != key:
                if sha is not None:
                    yield out()
                key, sha = k, hashlib.sha256()
            else:
                sha.update(b",")
            sha.update(ids.encode())
    if sha is not None:
        yield out()


def end_digests(ends: DataFrame) -> DataFrame:
    """SHA-256 of each node's conversation ids in order, comma-joined.

    Ids are sorted by ranges over all tasks and joined there to blocks; only
    blocks of one node meet in a task, which reads them as a stream."""
    n = _parts(ends)
    blocks = (ends.select(*KEY, "conv_id").repartitionByRange(n, *KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id")
              .mapInArrow(_blocks(), "depth long, k1 long, k2 long, first long, ids string"))
    return (blocks.repartition(n, *KEY).sortWithinPartitions(*KEY, "first")
            .mapInArrow(_digests, "depth long, k1 long, k2 long, ends string"))


def _key_eq(a: str, b: str, parent: bool) -> Column:
    if parent:
        return F.expr(f"{a}.depth - 1 = {b}.depth and {a}.p1 = {b}.k1 and {a}.p2 = {b}.k2")
    return F.expr(f"{a}.depth = {b}.depth and {a}.k1 = {b}.k1 and {a}.k2 = {b}.k2")


def subtree_totals(nodes: DataFrame, paths: DataFrame, limit: int = 256, factor: int = 64, top: int = 20_000,
                   queue: int = 1_000_000) -> DataFrame:
    """Time-forward processing, within shards, then across their roots.

    nodes: KEY, p1, p2, conv_id, n_convs and the nodes' own n_children, n_leaves,
    saved_tokens; paths: conv_id and KEY of every node that a conversation
    passes, for conversations that are the smallest member of some node."""
    n = _parts(nodes)
    schema = nodes.withColumn("is_root", F.lit(True)).schema
    done = None
    while True:
        heavy = store(nodes.where((F.col("n_convs") > limit) | (F.col("depth") == 0)), "trie-heavy")
        light = nodes.where((F.col("n_convs") <= limit) & (F.col("depth") > 0))
        marks = paths.alias("x").join(heavy.select(*KEY).alias("y"), _key_eq("x", "y", False), "left_anti")
        shard = marks.groupBy("conv_id").agg(F.min(F.struct(*KEY)).alias("shard"))
        dealt = light.join(shard, "conv_id").withColumn("is_root", F.struct(*KEY) == F.col("shard"))
        walked = store(dealt.repartition(n, "shard").sortWithinPartitions(F.desc("depth"), "k1", "k2").drop("shard")
                       .select(*[f.name for f in schema]).mapInArrow(forward(queue), schema), "trie-shards")
        done = walked if done is None else done.unionByName(walked)
        # Shard roots' totals, added up by parent.
        sent = walked.where("is_root").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(
            F.count(F.lit(1)).alias("c"), F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s"))

        def more(a: str, b: str) -> Column:
            return (F.col(a) + F.coalesce(b, F.lit(0))).alias(a)
        kept = [c for c in nodes.columns if c not in ("n_children", "n_leaves", "saved_tokens")]
        nodes = store(heavy.join(sent, KEY, "left").select(
            *kept, more("n_children", "c"), more("n_leaves", "l"), more("saved_tokens", "s")).select(*nodes.columns), "trie-heavy-sums")
        if nodes.count() <= top:
            last = (nodes.withColumn("is_root", F.col("depth") == 0).coalesce(1).sortWithinPartitions(F.desc("depth"), "k1", "k2")
                    .select(*[f.name for f in schema]).mapInArrow(forward(queue), schema))
            return done.unionByName(last).drop("is_root")
        paths = store(paths.alias("x").join(nodes.select(*KEY).alias("y"), _key_eq("x", "y", False), "left_semi")
                      .join(nodes.select("conv_id"), "conv_id", "left_semi"), "trie-paths")
        limit *= factor


def prefix_trie(turns: DataFrame, convs: DataFrame, **limits) -> DataFrame:
    """One row a node: conv_id (smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256.

    turns: conv_id, depth (1, 2, ... without gaps), a, b, n_bytes, length;
    convs: conv_id, length."""
    with_workers(turns.sparkSession)
    rows = store(prefixes(turns), "trie-rows")
    one = F.col("is_end").cast("long")
    aggs = [F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.sum(one).alias("n_ends"),
            F.min(F.when(F.col("is_end"), F.col("conv_id"))).alias("first_end"), F.max("n_bytes").alias("n_bytes")]
    inner = rows.groupBy(*KEY).agg(F.min("p1").alias("p1"), F.min("p2").alias("p2"), *aggs)
    zero = F.lit(0).cast("long")
    root = (convs.select("conv_id", zero.alias("n_bytes"), (F.col("length") == 0).alias("is_end")).agg(*aggs).where("n_convs > 0")
            .select(*[zero.alias(c) for c in [*KEY, "p1", "p2"]], *[c for c in inner.columns if c not in [*KEY, "p1", "p2"]]))
    nodes = store(inner.unionByName(root), "trie-nodes")

    # Nodes with two members or more, the root, and the tops of paths.
    shared = nodes.where("n_convs > 1 or depth = 0")
    parents = shared.select(*KEY, F.col("conv_id").alias("parent_conv_id"))
    known = store(nodes.alias("x").join(parents.alias("y"), _key_eq("x", "y", True), "left").select("x.*", "y.parent_conv_id"), "trie-known")
    walk = known.where("n_convs > 1 or depth = 0 or parent_conv_id is not null")
    own = walk.select(
        *KEY, "p1", "p2", "conv_id", "parent_conv_id", "n_convs", "n_ends", "first_end",
        zero.alias("n_children"), F.when((F.col("n_convs") == 1) | (F.col("n_convs") == F.col("n_ends")), 1).otherwise(0).cast("long").alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved_tokens"))
    paths = rows.select("conv_id", *KEY).join(own.select("conv_id"), "conv_id", "left_semi")
    totals = subtree_totals(own, paths, **limits)
    goes_on = (F.col("n_convs") == 1) & (F.col("n_ends") == 0) & (F.col("depth") > 0)
    totals = totals.withColumn("n_children", F.when(goes_on, F.lit(1)).otherwise(F.col("n_children")).cast("long"))
    # The rest of each path: its one member's, with one leaf and nothing saved.
    rest = known.where("n_convs = 1 and depth > 0 and parent_conv_id is null").select(
        *KEY, "p1", "p2", "conv_id", F.col("conv_id").alias("parent_conv_id"), "n_convs", "n_ends", "first_end",
        (1 - F.col("n_ends")).alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), zero.alias("saved_tokens"))
    every = totals.unionByName(rest)

    several = nodes.where("n_ends > 1").select(*KEY)
    ends = rows.where("is_end").select(*KEY, "conv_id").unionByName(
        convs.where("length = 0").select(*[zero.alias(c) for c in KEY], "conv_id"))
    digests = end_digests(ends.join(several, KEY, "left_semi"))
    ends_sha256 = (F.when(F.col("n_ends") == 0, F.lit(EMPTY)).when(F.col("n_ends") == 1, F.sha2(F.col("first_end").cast("string"), 256))
                   .otherwise(F.col("ends")))
    return every.join(digests, KEY, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", ends_sha256.alias("ends_sha256"))
