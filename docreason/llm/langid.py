"""Language identification with interpolated Kneser-Ney character models.

Method: every language gets an interpolated Kneser-Ney model over characters
(order 4, continuation counts below the top order, one absolute discount per
order). A language's model is sorted arrays of its n-gram keys with their
log-probabilities, searched once for each distinct n-gram of a block of text. A
document's language is that of the lowest cross-entropy per
character; a document whose entropy is above the calibrated bar of that language
and the document's length is marked ``rejected``.

Text is seen as letters: upper case folds to lower, every run of other
characters is one space.

Fitting uses a bounded sample of labelled rows (``docs_per_lang`` rows and
``chars_per_lang`` characters a language in expectation, chosen by a hash of
doc_id, and one row at least) with all its n-grams, and learns every language
that has a labelled text with a letter among the rows that are not held out;
prediction reads every whole text.

Edge cases: null text, or text without a letter, is ``und`` with score 0 and
rejected; without any labelled row every document is ``und``. Repeated rows are
predicted one by one. Ties go to the language first in the alphabet.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docreason.llm.common import with_workers

ORDER = 4
UND = "und"
SPACE = 32
#: Characters scored at a time.
BLOCK = 1 << 18
LETTER = re.compile(r"[^\W\d_]")
#: Rejection is calibrated at 1, 2, 4, ... symbols, up to 2 ** (CLASSES - 1), on
#: at most PIECES pieces of each calibration text at each length.
CLASSES = 18
PIECES = 8
#: Share of a language's calibration pieces of a length that lies below the bar.
KEEP = 0.99


def fold_table() -> np.ndarray:
    """UTF-16 unit -> symbol: lower-cased letter, or space. Surrogates stay."""
    t = np.full(1 << 16, SPACE, np.uint16)
    for c in range(1 << 16):
        if 0xD800 <= c < 0xE000:
            t[c] = c
        elif chr(c).isalpha():
            low = chr(c).lower()
            t[c] = ord(low) if len(low) == 1 and ord(low) < 1 << 16 else c
    return t


_FOLD: list[np.ndarray] = []


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Folded symbols of all texts, each after ORDER-1 pad spaces and with
    runs of spaces collapsed, and the number of symbols of each text (pads
    not counted)."""
    if not _FOLD:
        _FOLD.append(fold_table())
    pad = " " * (ORDER - 1)
    parts = [(pad + t).encode("utf-16-le", "surrogatepass") for t in texts]
    sizes = np.fromiter((len(p) // 2 for p in parts), np.int64, len(parts))
    s = _FOLD[0][np.frombuffer(b"".join(parts), np.uint16)]
    starts = np.cumsum(sizes) - sizes
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != SPACE) | (s[:-1] != SPACE)
    for i in range(ORDER - 1):
        keep[starts + i] = True
    first = np.minimum(starts + ORDER - 1, len(s) - 1)
    # The pad already stands for a leading run of spaces.
    lead = (sizes > ORDER - 1) & (s[first] == SPACE)
    keep[first[lead]] = False
    kept = np.concatenate([[0], np.cumsum(keep)])
    return s[keep], kept[starts + sizes] - kept[starts] - (ORDER - 1)


def grams(s: np.ndarray) -> np.ndarray:
    """Key of the ORDER symbols that end at each position from ORDER-1 on."""
    x = s.astype(np.uint64)
    out = x[ORDER - 1:].copy()
    for j in range(1, ORDER):
        out |= x[ORDER - 1 - j: len(x) - j] << np.uint64(16 * j)
    return out


def _low(keys: np.ndarray, n: int) -> np.ndarray:
    return keys & np.uint64((1 << (16 * n)) - 1) if n < 4 else keys


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(table, keys), max(len(table) - 1, 0))
    return at, (table[at] == keys) if len(table) else np.zeros(len(keys), bool)


@dataclass
class Table:
    """The model of one language."""
    keys: list[np.ndarray]      # by order: sorted n-gram keys
    logp: list[np.ndarray]      # by order: of each key
    contexts: list[np.ndarray]  # by order: sorted keys of the n-1 symbols before
    logback: list[np.ndarray]   # by order: of each context
    floor: np.float32           # unseen symbol

    def log_prob(self, gram: np.ndarray, n: int = ORDER) -> np.ndarray:
        if n == 0:
            return np.full(len(gram), self.floor)
        key = _low(gram, n)
        at, hit = _find(self.keys[n - 1], key)
        out = np.empty(len(key), np.float32)
        out[hit] = self.logp[n - 1][at[hit]]
        miss = ~hit
        if miss.any():
            rest = self.log_prob(gram[miss], n - 1)
            if n > 1:
                c, seen = _find(self.contexts[n - 1], key[miss] >> np.uint64(16))
                rest[seen] += self.logback[n - 1][c[seen]]
            out[miss] = rest
        return out


@dataclass
class Model:
    langs: list[str]
    tables: list[Table]  # by language
    bars: np.ndarray | None = None  # [language, class]: highest accepted cross-entropy

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per symbol [text, language] and symbol counts."""
        s, n = symbols(texts)
        total = np.zeros((len(texts), len(self.langs)))
        width = n + ORDER - 1
        starts = np.cumsum(width) - width
        ends = starts + width
        g = grams(s) if len(s) >= ORDER else np.zeros(0, np.uint64)
        # Gram j ends at symbol j + ORDER - 1, so text i owns [starts, ends - ORDER + 1).
        for a in range(0, len(g), BLOCK):
            b = min(a + BLOCK, len(g))
            kinds, kind = np.unique(g[a:b], return_inverse=True)
            lo = np.searchsorted(ends - ORDER + 1, a, side="right")
            hi = np.searchsorted(starts, b)
            f = np.clip(starts[lo:hi], a, b) - a
            t = np.clip(ends[lo:hi] - ORDER + 1, a, b) - a
            for j, table in enumerate(self.tables):
                run = np.concatenate([[0.0], np.cumsum(table.log_prob(kinds)[kind], dtype=np.float64)])
                total[lo:hi, j] += run[np.maximum(t, f)] - run[f]
        return -total / np.maximum(n, 1)[:, None], n

    def rejects(self, ce: np.ndarray, best: np.ndarray, n: np.ndarray) -> np.ndarray:
        if self.bars is None:
            return np.zeros(len(ce), bool)
        at = np.minimum(np.log2(np.maximum(n, 1)), CLASSES - 1)
        lo = at.astype(np.int64)
        hi = np.minimum(lo + 1, CLASSES - 1)
        bar = self.bars[best, lo] + (at - lo) * (self.bars[best, hi] - self.bars[best, lo])
        return ce[np.arange(len(ce)), best] > bar


def pieces(text: str) -> list[str]:
    """The text and, for every power of two up to its length, at most PIECES
    pieces of so many characters from places spread over it, from the start of
    a word where one is near."""
    out = [text]
    for c in 2 ** np.arange(CLASSES):
        for start in np.linspace(0, len(text) - c, min(PIECES, len(text) // c), dtype=np.int64):
            word = text.rfind(" ", max(start - 32, 0), start) + 1
            out.append(text[word or start:][:c])
    return out


def bars(lang: np.ndarray, doc: np.ndarray, n: np.ndarray, ce: np.ndarray, langs: int) -> np.ndarray | None:
    """Highest accepted cross-entropy [language, class] from the calibration
    pieces' language numbers, texts, symbol counts and cross-entropies; None if
    there is too little to calibrate on.

    A bar is the KEEP quantile of the language's pieces of the length, or four
    upper spreads (more for few texts, which do not show the quantile) above
    their median where that is higher. With under five texts of a
    length the pieces of all languages count; with under five of these too, the
    bar of the next shorter length holds. No bar is below that of a longer length."""
    kind = np.minimum(np.rint(np.log2(np.maximum(n, 1))), CLASSES - 1)
    out = np.full((langs, CLASSES), np.nan)
    for j in range(langs):
        for k in range(CLASSES):
            for part in ((kind == k) & (lang == j), kind == k):
                x, texts = ce[part], len(np.unique(doc[part]))
                if texts >= 5:
                    middle, upper = np.quantile(x, [0.5, 0.8413])
                    bound = middle + (4 + 4 / np.sqrt(texts)) * (upper - middle)
                    out[j, k] = max(np.quantile(x, KEEP, method="higher"), bound)
                    break
            else:
                out[j, k] = out[j, k - 1] if k else np.nan
    # Lengths before the first with enough texts accept everything.
    out = np.where(np.isnan(out), np.inf, out)
    return np.maximum.accumulate(out[:, ::-1], axis=1)[:, ::-1] if np.isfinite(out).any() else None


def fit(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
    """counts: language -> (distinct ORDER-gram keys, how often each occurs)."""
    langs = sorted(counts)
    by_lang = []  # by language: by order (keys, counts)
    for lang in langs:
        k, c = counts[lang]
        o = np.argsort(k)
        by = {ORDER: (k[o], c[o].astype(np.float64))}
        for n in range(ORDER - 1, 0, -1):
            # Continuation count: distinct symbols seen before the n-gram.
            lk, lc = np.unique(_low(by[n + 1][0], n), return_counts=True)
            by[n] = (lk, lc.astype(np.float64))
        by_lang.append(by)
    vocab = len(np.unique(np.concatenate([by[1][0] for by in by_lang]))) + 1
    return Model(langs, [_table(by, vocab) for by in by_lang])


def _table(by: dict[int, tuple[np.ndarray, np.ndarray]], vocab: int) -> Table:
    keys, logp, contexts, logback, floor, prob = [], [], [], [], 0.0, None
    for n in range(1, ORDER + 1):
        k, c = by[n]
        n1, n2 = (c == 1).sum(), (c == 2).sum()
        d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        ctx = np.unique(k >> np.uint64(16)) if n > 1 else np.zeros(1, np.uint64)
        own = np.searchsorted(ctx, k >> np.uint64(16)) if n > 1 else np.zeros(len(k), np.int64)
        total = np.bincount(own, c, len(ctx))
        lam = d * np.bincount(own, minlength=len(ctx)) / total
        if n == 1:
            lower = np.full(len(k), 1 / vocab)
            floor = np.log(lam[0] / vocab)
        else:
            # The end of an n-gram of the language is one of its (n-1)-grams.
            lower = prob[np.searchsorted(keys[n - 2], _low(k, n - 1))]
        prob = np.maximum(c - d, 0) / total[own] + lam[own] * lower
        keys.append(k)
        logp.append(np.log(prob).astype(np.float32))
        contexts.append(ctx)
        logback.append(np.log(lam).astype(np.float32))
    return Table(keys, logp, contexts, logback, np.float32(floor))


def held_out() -> Column:
    """crc32 of doc_id as text, modulo 3, is 1 (a null doc_id is not held out)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, docs_per_lang: int = 1500, chars_per_lang: int = 16_000_000) -> Model | None:
    """Fit on rows that are not held out and have doc_id, text and lang.

    A tenth of the sample is kept from the counts and calibrates rejection.
    The n-gram counts are summed by Spark; the driver gets those of the sample,
    and one small row for each calibration piece."""
    spark = with_workers(docs.sparkSession)
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / 1e6
    rows = docs.select("doc_id", "text", "lang").where(
        r"doc_id is not null and text rlike '\\p{L}' and lang is not null").where(~held_out()).withColumn("draw", draw)
    found = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.length("text")).alias("chars"),
                                     F.min("draw").alias("least")).collect()
    if not found:
        return None
    langs = sorted(r["lang"] for r in found)
    part = {r["lang"]: (min(docs_per_lang / r["rows"], chars_per_lang / r["chars"]), r["least"]) for r in found}
    parts = spark.createDataFrame([(lang, i, *part[lang]) for i, lang in enumerate(langs)],
                                  "lang string, place long, share double, least double")
    # The rows of the least draw are always in the sample and always counted.
    sample = rows.join(F.broadcast(parts), "lang").where("draw < share or draw = least").withColumn(
        "calibrate", (F.pmod(F.xxhash64("doc_id", F.lit("calibrate")), F.lit(10)) == 0) & (F.col("draw") > F.col("least")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            places, texts = b["place"].to_numpy(), b["text"].to_pylist()
            for place in np.unique(places):
                own = [texts[i] for i in np.flatnonzero(places == place)]
                for a in range(0, len(own), 256):
                    s, n = symbols(own[a:a + 256])
                    if len(s) < ORDER:
                        continue
                    g, width = grams(s), n + ORDER - 1
                    # Grams that end in a pad of the next text are not real.
                    real = np.zeros(len(s) + 1, np.int64)
                    np.add.at(real, np.cumsum(width) - width + ORDER - 1, 1)
                    np.add.at(real, np.cumsum(width), -1)
                    k, c = np.unique(g[np.cumsum(real)[ORDER - 1:len(s)] > 0], return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(k), place)), pa.array(k.view(np.int64)), pa.array(c)],
                        names=["place", "gram", "n"])

    train_rows = sample.where("not calibrate").select("place", "text")
    counted = (train_rows.mapInArrow(count, "place long, gram long, n long")
               .groupBy("place", "gram").agg(F.sum("n").alias("n"))).toArrow()
    if not counted.num_rows:
        return None
    place, gram, n = (counted[c].to_numpy() for c in ("place", "gram", "n"))
    order = np.argsort(place, kind="stable")
    ends = np.searchsorted(place[order], np.arange(len(langs) + 1))
    model = fit({lang: (gram[order[a:b]].view(np.uint64), n[order[a:b]])
                 for lang, a, b in zip(langs, ends[:-1], ends[1:]) if b > a})
    shared = spark.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        place = {lang: j for j, lang in enumerate(m.langs)}
        for b in batches:
            for lang, doc, text in zip(b["lang"].to_pylist(), b["doc"].to_pylist(), b["text"].to_pylist()):
                if lang in place:
                    ce, n = m.entropies(pieces(text))
                    real = n > 0
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([x] * int(real.sum()), pa.int64()) for x in (place[lang], doc)]
                        + [pa.array(n[real]), pa.array(ce[real, place[lang]])], names=["lang", "doc", "n", "ce"])

    seen = sample.where("calibrate").select("lang", F.xxhash64("doc_id").alias("doc"), "text").mapInArrow(
        judge, "lang long, doc long, n long, ce double").toPandas()
    model.bars = bars(*(seen[c].to_numpy() for c in ("lang", "doc", "n", "ce")), len(model.langs))
    return model


def predict(model: Model | None, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """lang_pred, score and rejected of each text."""
    pred, score, rejected = [UND] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
    own = [i for i, t in enumerate(texts) if model is not None and t and LETTER.search(t)]
    at = 0
    while at < len(own):
        size, to = 0, at
        while to < len(own) and (to == at or size + len(texts[own[to]]) <= BLOCK):
            size += len(texts[own[to]])
            to += 1
        part = own[at:to]
        at = to
        ce, n = model.entropies([texts[i] for i in part])
        best = ce.argmin(axis=1)
        score[part] = 1 / np.exp(ce.min(axis=1, keepdims=True) - ce).sum(axis=1)
        rejected[part] = model.rejects(ce, best, n)
        for i, j in zip(part, best):
            pred[i] = model.langs[j]
    return pred, score, rejected


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score, rejected for every row of ``docs``."""
    spark = with_workers(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            pred, score, rejected = predict(shared.value, b["text"].to_pylist())
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], pa.array(pred, pa.string()), pa.array(score), pa.array(rejected)],
                names=["doc_id", "lang_pred", "score", "rejected"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, lang_pred string, score double, rejected boolean")


def accepted(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with all their columns."""
    spark = with_workers(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            yield b.filter(pa.array(~predict(shared.value, b["text"].to_pylist())[2]))

    return docs.mapInArrow(run, docs.schema)
