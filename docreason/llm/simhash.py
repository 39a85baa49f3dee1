"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two 64-bit fingerprints differ in at most 2r bits exactly if some 64-bit value
lies within r bits of both. So every distinct fingerprint emits all variants
within ``r = max_bits // 2`` (``max_bits`` must be even), and fingerprints that share a
variant collide.

The shuffle on variants goes by their leading ``b`` bits: a fingerprint is sent
once to each prefix that any of its variants has (1 + b + b(b-1)/2 rows of 16
bytes for r = 2 in place of 2081), and the receiving task writes out the
variants with that prefix. ``b`` follows the number of distinct fingerprints, so
the variants of a prefix stay few at any size; a prefix that holds too many is
dealt again by more bits. Within a task the variants are sorted, neighbours with
the same variant collide, each colliding pair is made once and verified by its
bit distance. All fingerprints of one variant are within 2r bits of each other,
so linking neighbours keeps every component without pairing up a whole group.

Components: large-star/small-star rounds over the verified links, each round
written to the shared folder.

Edge cases: null or wordless text has fingerprint 0 and links like any other;
fewer words than a shingle give one shingle of all words. Exact copies share one
fingerprint and enter the search once. Null doc_ids are rows like others but
never name a component unless nothing else is in it. Empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docreason.llm.common import keyed_text, store, with_workers

BITS = 64
SEED = 42
#: Variants that a task holds at a time, and that a prefix has on average.
VARIANTS = 1 << 20
#: Rows of a prefix beyond which it is dealt again by EXTRA more bits.
HOT_ROWS = 60_000
EXTRA = 6


# ---------------------------------------------------------------- fingerprints
def simhash(text: bytes, shingle: int) -> int:
    """The 64-bit fingerprint of one UTF-8 text."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # bytes: lower() is A-Z, split() is [\x20\x09-\x0D]
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxh64_intdigest(joined, SEED)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts = (ends - size)[: len(words) - shingle + 1].tolist()
    stops = ends[shingle - 1:].tolist()
    n, ones = len(starts), np.zeros(BITS, np.int64)
    for a in range(0, n, 1 << 15):
        h = np.array([xxh64_intdigest(joined[s:e], SEED) for s, e in
                      zip(starts[a:a + (1 << 15)], stops[a:a + (1 << 15)])], ">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, text_key, fp (the fingerprint as a signed long) for every row."""
    with_workers(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((simhash(t.as_buffer().to_pybytes(), shingle) for t in b["text"].cast(pa.binary())),
                             np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["text_key"], pa.array(fp.view(np.int64))], names=["doc_id", "text_key", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return keyed_text(docs).mapInArrow(run, f"doc_id {kind}, text_key long, fp long")


# ---------------------------------------------------------------- ball hashing
def flips(lo: int, hi: int, most: int) -> list[np.ndarray]:
    """By number of flips 0..most: masks that flip so many of bits lo..hi-1,
    counted from the top."""
    single = np.array([1 << (BITS - 1 - i) for i in range(lo, hi)], np.uint64)
    out, index = [np.zeros(1, np.uint64)], [np.full(1, -1)]
    for _ in range(most):
        masks, last = [], []
        for m, i in zip(out[-1].tolist(), index[-1].tolist()):
            masks.append(np.uint64(m) | single[i + 1:])
            last.append(np.arange(i + 1, len(single)))
        out.append(np.concatenate(masks) if masks else np.zeros(0, np.uint64))
        index.append(np.concatenate(last) if last else np.zeros(0, np.int64))
    return out


def top(b: int) -> np.uint64:
    return np.uint64(((1 << b) - 1) << (BITS - b))


def used(fp: np.ndarray, prefix: np.ndarray, b: int) -> np.ndarray:
    """Flips that the prefix has already taken from the fingerprint."""
    return np.bitwise_count((fp ^ prefix) & top(b))


def extend(fp: np.ndarray, prefix: np.ndarray, b0: int, b1: int, r: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows for the prefixes of b1 bits under those of b0 bits."""
    fps, prefixes, by = [], [], flips(b0, b1, r)
    took = used(fp, prefix, b0) if b0 else np.zeros(len(fp), np.int64)
    for j in range(r + 1):
        own = np.flatnonzero(took == j)
        masks = np.concatenate(by[: r - j + 1])
        base = prefix[own] | (fp[own] & (top(b1) ^ top(b0)))
        prefixes.append((base[:, None] ^ masks[None, :]).ravel())
        fps.append(np.repeat(fp[own], len(masks)))
    return np.concatenate(fps), np.concatenate(prefixes)


def _collide(fp: np.ndarray, prefix: np.ndarray, b: int, r: int) -> np.ndarray:
    """Codes a * n + b of the pairs of rows that share a variant."""
    by = flips(b, BITS, r)
    variants, owners = [], []
    took = used(fp, prefix, b)
    for j in range(r + 1):
        own = np.flatnonzero(took == j)
        masks = np.concatenate(by[: r - j + 1])
        base = prefix[own] | (fp[own] & ~top(b))
        variants.append((base[:, None] ^ masks[None, :]).ravel())
        owners.append(np.repeat(own, len(masks)))
    v, o = np.concatenate(variants), np.concatenate(owners)
    order = np.argsort(v)
    v, o = v[order], o[order]
    same = np.flatnonzero(v[1:] == v[:-1])
    x, y = o[same], o[same + 1]
    return np.unique(np.minimum(x, y) * len(fp) + np.maximum(x, y))


def cost(fp: np.ndarray, prefix: np.ndarray, b: int, r: int) -> np.ndarray:
    sizes = np.cumsum([math.comb(BITS - b, j) for j in range(r + 1)])
    return sizes[np.clip(r - used(fp, prefix, b), 0, r)]


def _links(fp: np.ndarray, prefix: np.ndarray, b: int, r: int, max_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Verified links of rows sorted by prefix, in pieces of bounded memory."""
    weight = cost(fp, prefix, b, r)
    if weight.sum() <= VARIANTS or b >= BITS - EXTRA:
        codes = _collide(fp, prefix, b, r)
        x, y = fp[codes // max(len(fp), 1)], fp[codes % max(len(fp), 1)]
        near = np.bitwise_count(x ^ y) <= max_bits
        yield x[near], y[near]
        return
    cuts = np.flatnonzero(np.diff(prefix, prepend=prefix[:1])) if len(prefix) else np.zeros(0, np.int64)
    if len(cuts):  # whole prefixes at a time
        total, bounds, begin = np.cumsum(weight), np.append(cuts, len(fp)), 0
        while begin < len(fp):
            base = total[begin - 1] if begin else 0
            fits = bounds[(bounds > begin) & (total[bounds - 1] - base <= VARIANTS)]
            end = int(fits[-1]) if len(fits) else int(bounds[bounds > begin][0])
            yield from _links(fp[begin:end], prefix[begin:end], b, r, max_bits)
            begin = end
    else:  # one large prefix: by more bits, one longer prefix after the other
        took = used(fp, prefix, b)
        by = flips(b, b + 1, 1)
        step = by[1][0]
        for bit in (np.uint64(0), step):
            longer = prefix | bit
            keep = took + (((fp ^ longer) & step) != 0) <= r
            if keep.sum() > 1:
                yield from _links(fp[keep], longer[keep], b + 1, r, max_bits)


def forest(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) for the nodes of a task's links that are not roots."""
    nodes, at = np.unique(np.concatenate([x, y]), return_inverse=True)
    parent = list(range(len(nodes)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in zip(at[: len(x)].tolist(), at[len(x):].tolist()):
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    root = np.array([find(i) for i in range(len(nodes))], np.int64)
    own = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[own], nodes[root[own]]


def ball_links(fps: DataFrame, max_bits: int) -> DataFrame:
    """Links (u, v) between distinct fingerprints ``fp`` that hold together
    exactly those that ``max_bits`` or fewer differing bits connect."""
    if max_bits < 0 or max_bits % 2:
        raise ValueError("max_bits must be an even number of bits")
    r = max_bits // 2
    n = fps.count()
    ball = sum(math.comb(BITS, j) for j in range(r + 1))
    b = min(40, max(4, math.ceil(math.log2(max(1, n * ball / VARIANTS)))))

    def emit(b0: int, b1: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in (batch.slice(i, 4096) for i in range(0, batch.num_rows, 4096)):
                    fp = part["fp"].to_numpy().view(np.uint64)
                    prefix = part["prefix"].to_numpy().view(np.uint64) if b0 else np.zeros(len(fp), np.uint64)
                    f, p = extend(fp, prefix, b0, b1, r)
                    yield pa.RecordBatch.from_arrays([pa.array(f.view(np.int64)), pa.array(p.view(np.int64))],
                                                     names=["fp", "prefix"])
        return run

    def link(bits: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def done(rows: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
                fp, prefix = (np.concatenate(x) for x in zip(*rows))
                found = list(_links(fp, prefix, bits, r, max_bits))
                u, v = forest(*(np.concatenate(x) for x in zip(*found)))
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))],
                                                     names=["u", "v"])

            held: list[tuple[np.ndarray, np.ndarray]] = []
            size = 0
            for batch in batches:
                fp = batch["fp"].to_numpy().view(np.uint64)
                prefix = batch["prefix"].to_numpy().view(np.uint64)
                held.append((fp, prefix))
                size += len(fp)
                if size >= HOT_ROWS:  # hand on all prefixes but the last, which may go on
                    fp, prefix = (np.concatenate(x) for x in zip(*held))
                    cut = int(np.flatnonzero(prefix != prefix[-1])[-1]) + 1 if (prefix != prefix[-1]).any() else 0
                    if cut:
                        yield from done([(fp[:cut], prefix[:cut])])
                    held, size = [(fp[cut:], prefix[cut:])], len(fp) - cut
            if size:
                yield from done(held)
        return run

    parts, b0, rows = [], 0, fps.select("fp", F.lit(0).cast("long").alias("prefix"))
    while True:
        rows = store(rows.mapInArrow(emit(b0, b), "fp long, prefix long"), "simhash-variants")
        crowded = rows.groupBy("prefix").count().where(F.col("count") > HOT_ROWS).select("prefix")
        hot = store(crowded, "simhash-crowded") if b < BITS - 2 * EXTRA else None
        again = hot is not None and not hot.isEmpty()
        calm = rows.join(hot, "prefix", "left_anti") if again else rows
        parts.append(calm.repartition("prefix").sortWithinPartitions("prefix").select("fp", "prefix")
                     .mapInArrow(link(b), "u long, v long"))
        if not again:
            break
        rows, b0, b = rows.join(hot, "prefix", "left_semi").select("fp", "prefix"), b, b + EXTRA
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out.distinct()


# ---------------------------------------------------------------- components
def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (u, v): large-star/small-star."""
    edges = store(links, "simhash-links")
    while True:
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = store(large, "simhash-large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionAll(low.select("u", F.col("m").alias("v"))).distinct())
        edges = store(small, "simhash-small")
        roots = edges.select(F.col("v").alias("u")).distinct()
        chained = edges.join(roots, "u", "left_semi")
        if chained.isEmpty() and edges.groupBy("u").count().where("count > 1").isEmpty():
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def members(docs: DataFrame, shingle: int, max_bits: int) -> DataFrame:
    """doc_id, text_key, fp, group (a fingerprint that names the component) and
    component_id for every row."""
    prints = store(fingerprints(docs, shingle), "simhash-fingerprints")
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    distinct = store(least, "simhash-distinct")
    joined = store(components(ball_links(distinct.select("fp"), max_bits)), "simhash-components")
    member = joined.join(distinct, joined["node"] == distinct["fp"]).select("node", "root", "least")
    owner = member.groupBy("root").agg(F.min("least").alias("joint"))
    named = member.join(owner, "root").select(F.col("node").alias("fp"), "root", "joint")
    # Stored, so that both sides of the last join are plain shuffles, whose hot keys Spark can split.
    ids = store(distinct.join(named, "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("group"), F.coalesce("joint", "least").alias("component_id")), "simhash-ids")
    return prints.join(ids, "fp", "left")


def near_duplicates(docs: DataFrame, shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row."""
    return members(docs, shingle, max_bits).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """One row of each component, with all its columns: that of the smallest
    doc_id (of rows with one doc_id, that of the smallest text hash)."""
    own = docs.columns
    best = members(docs, shingle, max_bits).groupBy("group").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("_near_best"))
    best = store(best.select("_near_best.doc_id", "_near_best.text_key").toDF("_near_id", "_near_key"), "simhash-best")
    rows = docs.withColumn("_near_text", F.xxhash64(F.coalesce("text", F.lit(""))))
    kept = rows.join(best, F.col("doc_id").eqNullSafe(F.col("_near_id")) & (F.col("_near_text") == F.col("_near_key")), "left_semi")
    return kept.dropDuplicates(["doc_id", "_near_text"]).select(*own)  # a row that is repeated stays once
