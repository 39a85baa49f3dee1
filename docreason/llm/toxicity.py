"""Toxicity of texts behind a noisy channel of look-alikes, spacing and repetition.

A character model (trigrams over the letters of all documents' words, accents
folded, interpolated Witten-Bell) says which words are likely. A written token is
a lattice: look-alike symbols may be letters, runs of a letter may be shorter,
separators may be nothing or a word boundary, each at a channel cost; single
letters in a row are one lattice with their spaces as separators. Viterbi finds
the likeliest words of a lattice. Plain tokens (letters, no doubled letter) are
words as they stand.

The score is a logistic regression over restored words: whole words, and stems (a
word's first 3 to 6 letters, once, twice and three times among the distinct words
of a text), so that words made from a toxic stem count though none was seen
before. Features are chosen from counts over all labelled rows that are not held
out: those in ``MIN_SHARE`` of the toxic texts at least (and two), more frequent
there than in the others by ``MIN_Z`` standard errors; ``FEATURES`` at most, those
of the highest z, out of the ``CANDIDATES`` that most toxic texts have. Toxic texts
count once for each sketch (least shingle hash), so that copies of one text do not
make its words toxic. The regression is fitted on a sample of ``SAMPLE`` of these
rows in expectation. Candidates, sample and the 27^3 counts of the character model
are all that reaches the driver, whatever the input.

Edge cases: a null or empty text has no words and gets the score of such a text;
without labelled rows of both kinds every score is the share of toxic labels (0
without labels). A document with several labels counts with each; repeated rows
are scored one by one. Labels or documents without doc_id are not learned from.
Extra columns are not looked at. Letters outside a-z after folding are word
boundaries. A lattice of more than ``PART`` symbols (a token without white space)
is decoded in parts, the path so far fixed at a cut.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docreason.llm.common import store, with_workers
from docreason.llm.langid import held_out

PART, KNOWN, SLICE = 4096, 600_000, 1 << 20
STEMS, TIMES = (3, 4, 5, 6), (1, 2, 3)
MIN_SHARE, MIN_Z, FEATURES, CANDIDATES, SAMPLE, RIDGE = 0.02, 4.0, 300, 50_000, 20_000, 0.1
THRESHOLD = 0.7
#: Boundary is symbol 0, a to z are 1 to 26.
N = 27
#: Letters that a symbol may stand for.
LOOK_ALIKE = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a",
              "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "*": "abcdefghijklmnopqrstuvwxyz",
              "#": "abcdefghijklmnopqrstuvwxyz", "%": "abcdefghijklmnopqrstuvwxyz"}
#: Channel costs (log probabilities): a look-alike for a letter, a symbol for any
#: letter, a run of two or of more that was one letter, a separator dropped between
#: words or between single letters, a boundary between single letters, a dropped
#: digit, symbol in a word, symbol at its end, and such a symbol as a boundary.
AS, ANY, SHORTER_2, SHORTER, JOINED, SPACED, APART = -1.0, -3.3, -6.0, -1.0, -1.5, -0.3, -3.0
DROP_DIGIT, DROP_INNER, DROP_EDGE, BREAK = -9.0, -8.0, -2.5, -4.0
SINGLES = re.compile(r"(?<!\S)\S(?:\s+\S){2,}(?!\S)")
PLAIN = re.compile(r"[a-z]+")
DOUBLED = re.compile(r"([a-z])\1")
RUN = re.compile(r"(.)\1+", re.S)
STRIP = ".,;:!?\"'()[]{}<>«»“”‘’…-_*#%&$|/\\"
_CODE = {chr(96 + i): i for i in range(1, N)}


def _fold(text: str) -> str:
    text = "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))
    return text.replace("ß", "ss").lower()


#: Lower-case letters of the Latin blocks without their accents.
_LATIN = {i: _fold(chr(i)) for i in range(0xC0, 0x250) if chr(i).isalpha()}


def fold(text: str) -> str:
    """Lower case without accents."""
    text = text.lower()
    if not text.isascii() and not (text := text.translate(_LATIN)).isascii():
        text = _fold(text)
    return text


def squeeze(word: str) -> str:
    """The word with every run of a letter as one."""
    return RUN.sub(r"\1", word)


@dataclass
class CharacterModel:
    logp: list[float]  # of symbol c after x, y at (x * N + y) * N + c

    @classmethod
    def fit(cls, counts: np.ndarray) -> "CharacterModel":
        """counts[x, y, c] of words with two boundaries before and one after."""
        c3 = counts.reshape(N, N, N).astype(np.float64)
        lower = np.full(N, 1 / N)
        for c in (c3.sum((0, 1)), c3.sum(0), c3):
            total, kinds = c.sum(-1, keepdims=True), (c > 0).sum(-1, keepdims=True)
            lower = np.where(total > 0, (c + kinds * lower) / np.maximum(total + kinds, 1), lower)
        logp = np.log(np.broadcast_to(lower, (N, N, N))).copy()
        logp[0, 0, 0] = 0.0  # a second boundary costs nothing
        return cls(logp.reshape(-1).tolist())


def lattice(token: str) -> list[list[tuple[tuple[int, ...], float]]]:
    """Segments of a folded token; each a list of (symbols, channel cost)."""
    core = [i for i, c in enumerate(token) if c in _CODE or c.isdigit()]
    lo, hi = (core[0], core[-1]) if core else (0, -1)

    def single(i: int) -> bool:
        """One letter or look-alike with none beside it."""
        return 0 <= i < len(token) and not any(0 <= k < len(token) and token[k].isalnum() for k in (i - 1, i + 1))

    out, i = [], 0
    while i < len(token):
        c, j = token[i], i
        while j < len(token) and token[j] == c:
            j += 1
        n, within = j - i, lo <= i <= hi
        if c in _CODE:
            x = _CODE[c]
            out.append([((x,), 0.0)] if n == 1 else [((x, x), 0.0 if n == 2 else 1.5 * SHORTER), ((x,), SHORTER_2 if n == 2 else SHORTER)])
        elif c in LOOK_ALIKE and (within or len(LOOK_ALIKE[c]) <= 2 and c != "(" and not (c in "!|" and i > hi)):
            letters = LOOK_ALIKE[c]
            cost = AS if len(letters) <= 2 else ANY
            ways = [((_CODE[x],) * k, cost + (SHORTER if k < n else 0.0)) for x in letters for k in range(1, min(n, 2) + 1)]
            drop, cut = (DROP_DIGIT, DROP_DIGIT) if c.isalnum() else (DROP_INNER, BREAK) if within else (DROP_EDGE, 0.0)
            out.append([*ways, ((), drop), ((0,), cut)])
        elif c.isalnum() or not within:
            out.append([((0,), 0.0)])
        elif single(i - 1) and single(j):
            out.append([((), SPACED), ((0,), APART)])
        else:
            out.append([((0,), 0.0), ((), JOINED)])
        i = j
    return out


def decode(model: CharacterModel, segments: list[list[tuple[tuple[int, ...], float]]]) -> list[str]:
    """The words of the likeliest path (Viterbi over the last two symbols)."""
    logp, symbols = model.logp, []
    x0, y0 = 0, 0
    for a in range(0, max(len(segments), 1), PART):
        part = segments[a:a + PART]
        if a + PART >= len(segments):
            part = [*part, [((0,), 0.0)]]
        states = {x0 * N + y0: (0.0, None)}
        for ways in part:
            after: dict[int, tuple[float, object]] = {}
            for state, (score, path) in states.items():
                for emitted, cost in ways:
                    s, to, back = score + cost, state, path
                    for c in emitted:
                        s += logp[to * N + c]
                        to = to % N * N + c if c else 0
                        back = (c, back)
                    if to not in after or s > after[to][0]:
                        after[to] = (s, back)
            states = after
        end, (_, path) = max(states.items(), key=lambda x: x[1][0])
        x0, y0 = divmod(end, N)
        own = []
        while path is not None:
            own.append(path[0])
            path = path[1]
        symbols += own[::-1]
    return "".join(chr(96 + c) if c else " " for c in symbols).split()


class Restorer:
    """A worker's decoder with the tokens it has seen. ``bases``: only words
    with one of these whole words or stems are kept; without, all are."""

    def __init__(self, model: CharacterModel, bases: set[str] | None = None):
        self.model, self.bases = model, bases
        self.other: set[str] = set()
        self.words: dict[str, tuple[str, ...]] = {}
        # What a word must begin with to have one of the bases, as it stands and
        # with runs of letters as one.
        known = [x.rstrip("$") for x in bases or ()]
        self.begins = {x[:3] for x in known}
        self.squeezed = {squeeze(x) for x in known}
        self.widths = sorted({len(x) for x in self.squeezed})
        # Of plain words that begin with two different letters, only those with
        # one of these pairs can have a base, runs shortened or not.
        self.firsts = {x[:2] for x in self.squeezed}
        self.by_pair = bases is not None and all(len(x) > 1 for x in self.squeezed)

    def restore(self, token: str) -> list[str]:
        """The words of a lower-case token."""
        core = token.strip(STRIP)
        if not core.isascii():
            core = fold(core)
        if PLAIN.fullmatch(core) and not (token[0] in "$@+!|" or token[-1] in "$@+"):
            if self.by_pair and core[:2] not in self.firsts and len(core) > 1 and core[0] != core[1]:
                return []
            if not DOUBLED.search(core):
                return [core] if self.bases is None or core[:3] in self.begins else []
            if self.bases is not None:
                # Shortening runs does not change the squeezed word.
                least = squeeze(core)
                if not any(least[:n] in self.squeezed for n in self.widths):
                    return []
            return decode(self.model, lattice(core))
        folded = fold(token)
        if not any(c in _CODE for c in folded):
            return []
        return decode(self.model, lattice(folded))

    def texts(self, texts: list[str]) -> tuple[list[set[str]], list[int]]:
        """Distinct restored words of each text, and its number of distinct tokens."""
        own = []
        for t in texts:
            low = t.lower()
            words = low.split()
            tokens = set(words)
            if b"\1\1\1" in bytes(map((1).__eq__, map(len, words))):  # three single characters in a row
                tokens.update(" ".join(m.group().split()) for m in SINGLES.finditer(low))
            own.append(tokens)
        if len(self.other) + len(self.words) > KNOWN:
            self.other.clear()
            self.words.clear()
        for token in set().union(*own).difference(self.other):
            if token in self.words:
                continue
            # Cheaper to see than to remember: words of which none can have a base.
            if self.by_pair and token.isascii():
                pair = token[:2]
                if pair.isalpha() and pair not in self.firsts and pair[0] != pair[-1] and token[-1] not in "$@+" and (
                        token.isalpha() or token.rstrip(STRIP).isalpha()):
                    continue
            words = self.restore(token)
            if self.bases is not None:
                words = [w for w in words if not self.bases.isdisjoint(bases(w))]
            if words:
                self.words[token] = tuple(words)
            else:
                self.other.add(token)
        known = self.words.keys()
        return [{w for t in x & known for w in self.words[t]} for x in own], list(map(len, own))


def bases(word: str) -> list[str]:
    """A word's features without their number: the whole word, its stems."""
    return [word + "$", *[word[:n] for n in STEMS if len(word) >= n]]


def features(words: set[str]) -> set[str]:
    n = Counter(x for w in words for x in bases(w))
    return {f"{x}{k}" for x, c in n.items() for k in (TIMES if x[-1] != "$" else TIMES[:1]) if c >= k}


def _slices(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    at = 0
    while at < len(texts):
        part, chars = [], 0
        for t in texts[at:at + 2000]:
            if part and chars + len(t or "") > SLICE:
                break
            part.append(t or "")
            chars += len(t or "")
        yield at, part
        at += len(part)


def character_counts(docs: DataFrame) -> np.ndarray:
    """Trigram counts over the words of all documents."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(N ** 3, np.int64), Counter()
        code = np.zeros(128, np.int64)
        code[97:123] = np.arange(1, N)

        def add() -> None:
            words = []
            for token, n in seen.items():
                core = token.strip(STRIP)
                if PLAIN.fullmatch(core := core if core.isascii() else fold(core)):
                    words.append((core, n))
            seen.clear()
            if not words:
                return
            s = code[np.frombuffer(("@@" + "@@".join(w for w, _ in words) + "@").encode(), np.uint8)]
            width = np.fromiter((len(w) + 2 for w, _ in words), np.int64, len(words))
            weight = np.repeat(np.fromiter((n for _, n in words), np.int64, len(words)), width)
            gram = (s[:-2] * N + s[1:-1]) * N + s[2:]
            # The trigram that starts at a word's second boundary has its first
            # two letters; the one at its last letter, the boundary after it;
            # that over two boundaries belongs to no word.
            first = np.cumsum(width) - width
            weight, real = weight[:len(gram)], np.ones(len(gram), bool)
            real[first[1:] - 1] = False
            total[:] += np.bincount(gram[real], weight[real], N ** 3).astype(np.int64)

        for b in batches:
            for _, part in _slices(b["text"].to_pylist()):
                for t in part:
                    seen.update(t.lower().split())
                if len(seen) > KNOWN:
                    add()
        add()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["gram", "n"])

    out = np.zeros(N ** 3, np.int64)
    found = (docs.select("text").mapInArrow(count, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n"))).toArrow()
    out[found["gram"].to_numpy()] = found["n"].to_numpy()
    return out


@dataclass
class Model:
    characters: CharacterModel
    features: dict[str, int]
    weights: np.ndarray  # by feature, then of the log number of tokens
    constant: float

    def score(self, words: list[set[str]], tokens: list[int]) -> np.ndarray:
        z = np.full(len(words), self.constant) + (self.weights[-1] * np.log1p(tokens) if self.features else 0)
        for i, x in enumerate(words):
            z[i] += sum(self.weights[self.features[f]] for f in features(x) if f in self.features) if x else 0
        return 1 / (1 + np.exp(-np.clip(z, -700, 700)))


def _sketch(text: str) -> int:
    words = text.split()
    grams = {" ".join(words[i:i + 5]) for i in range(max(len(words) - 4, 1))}
    return min(xxhash.xxh64_intdigest(g) for g in grams) - (1 << 63)


def _regression(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last column is constant
    and not shrunk."""
    w, shrink = np.zeros(x.shape[1]), np.full(x.shape[1], RIDGE)
    shrink[-1] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + np.diag(shrink + 1e-9), x.T @ (y - p) - shrink * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Learns the character model from all documents, the features from all
    labelled rows that are not held out, the weights from a sample of these."""
    spark = with_workers(docs.sparkSession)
    characters = CharacterModel.fit(character_counts(docs))
    shared = spark.sparkContext.broadcast(characters)
    labels = labels.select("doc_id", F.col("toxic").alias("label")).where("label is not null and doc_id is not null")
    # Joined once, by a shuffle at every size; the passes below read the labelled texts back.
    rows = store(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where("doc_id is not null").where(~held_out())
                 .join(labels.where(~held_out()).hint("merge"), "doc_id"), "toxicity-labelled")

    def toxic_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(shared.value)
        for b in batches:
            for _, part in _slices(b["text"].to_pylist()):
                found = [({"", *features(words)}, _sketch(t)) for t, words in zip(part, restorer.texts(part)[0])]
                yield pa.RecordBatch.from_arrays([pa.array([f for x, _ in found for f in x], pa.string()),
                                                  pa.array([k for x, k in found for _ in x], pa.int64())], names=["feature", "sketch"])

    toxic = store(rows.where("label <> 0").select("text").mapInArrow(toxic_features, "feature string, sketch long")
                  .distinct().groupBy("feature").agg(F.count(F.lit(1)).alias("n")), "toxicity-features")
    n1 = (toxic.where("feature = ''").agg(F.max("n")).first()[0]) or 0
    least = max(2.0, MIN_SHARE * n1)
    found = {r["feature"]: r["n"] for r in toxic.where("feature <> ''").where(F.col("n") >= least)
             .orderBy(F.desc("n"), "feature").limit(CANDIDATES).collect()}
    kept = spark.sparkContext.broadcast((set(found), {_base(f) for f in found}))

    def clean_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, base = kept.value
        restorer, place, rows = Restorer(shared.value, base), {x: i for i, x in enumerate(sorted(base))}, 0
        at, total = {}, np.zeros((len(TIMES), len(base)), np.int64)
        for b in batches:
            for _, part in _slices(b["text"].to_pylist()):
                rows += len(part)
                for words in restorer.texts(part)[0]:
                    for w in words:
                        if w not in at:
                            at[w] = [place[x] for x in bases(w) if x in place]
                    own, n = np.unique(np.fromiter(chain.from_iterable(map(at.__getitem__, words)), np.int64), return_counts=True)
                    for i, k in enumerate(TIMES):
                        total[i, own[n >= k]] += 1
                if len(at) > KNOWN:
                    at.clear()
        found = [("", rows)] + [(f, int(total[TIMES.index(int(f[-1])), place[_base(f)]])) for f in names]
        yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())],
                                         names=["feature", "n"])

    clean = {r["feature"]: r["n"] for r in rows.where("label = 0").select("text").mapInArrow(clean_features, "feature string, n long")
             .groupBy("feature").agg(F.sum("n").alias("n")).collect()}
    n0 = clean.get("", 0)
    if not n1 or not n0:
        return Model(characters, {}, np.zeros(0), 700.0 if n1 else -700.0)
    names = sorted(found)
    c1, c0 = (np.array([x.get(f, 0) for f in names], np.float64) for x in (found, clean))
    p = (c1 + c0) / (n1 + n0)
    z = (c1 / n1 - c0 / n0) / np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / n1 + 1 / n0))
    order = [i for i in np.argsort(-z, kind="stable")[:FEATURES] if z[i] >= MIN_Z]
    place = {names[i]: k for k, i in enumerate(order)}
    bases_of = {_base(f) for f in place}

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(shared.value, bases_of)
        for b in batches:
            for at, part in _slices(b["text"].to_pylist()):
                words, tokens = restorer.texts(part)
                yield pa.RecordBatch.from_arrays(
                    [b["label"].slice(at, len(part)).cast(pa.int32()), pa.array(tokens, pa.int32()),
                     pa.array([[place[f] for f in features(x) if f in place] for x in words], pa.list_(pa.int32()))],
                    names=["label", "tokens", "found"])

    share = min(1.0, SAMPLE / labels.count())
    taken = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.lit(int(share * 1_000_000))
    sample = rows.where(taken).select("text", "label").mapInArrow(sampled, "label int, tokens int, found array<int>").toArrow()
    x = np.zeros((sample.num_rows, len(place) + 2))
    for i, own in enumerate(sample["found"].to_pylist()):
        x[i, own] = 1
    x[:, -2], x[:, -1] = np.log1p(sample["tokens"].to_numpy()), 1
    w = _regression(x, (sample["label"].to_numpy() != 0).astype(np.float64)) if len(x) else np.zeros(len(place) + 2)
    return Model(characters, place, w[:-1], float(w[-1]))


def _base(feature: str) -> str:
    return feature[:-1]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted for every row of ``docs``."""
    spark = with_workers(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        restorer = Restorer(m.characters, {_base(f) for f in m.features})
        for b in batches:
            for at, part in _slices(b["text"].to_pylist()):
                s = m.score(*restorer.texts(part))
                yield pa.RecordBatch.from_arrays(
                    [b["doc_id"].slice(at, len(part)), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))],
                    names=["doc_id", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, predicted int")
