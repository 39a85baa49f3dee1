"""Quality rules as a ledger of failure bits and measurements.

Every rule is evaluated once per document; the ledger keeps its measurements and
one bit for each rule that failed. A policy is a version and a mask of rules: a
document is kept if it fails none of them. Policies and ablations (what a policy
would keep without one rule) are bitwise work on the ledger and never read a text
again.

All work is DataFrame functions over arrays of one row; nothing is shuffled.
Repeated 5-word windows are looked for by hashes; only texts with equal ones
sort theirs to find the places.

Words are ``[^\\x20\\x09-\\x0D]+``. Null text has no words, fails the word-count
rule and has zero for every measurement. Repeated rows get a row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docreason.llm.common import documents

SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
WINDOW = 5

#: Rules in the order of their bits: name, and the test over the measurements.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 10"),
    ("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "n_symbols > n_words"),
    ("duplicate_lines", "n_lines >= 4 and 100 * n_dup_lines > 50 * n_lines"),
    ("short_words", "n_words >= 10 and word_chars < 2 * n_words"),
    ("long_words", "n_words >= 10 and word_chars > 25 * n_words"),
]
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeated_windows"]
#: Versions of the policy: masks of the rules that count.
POLICIES: dict[str, int] = {
    "base": BASE,
    "v1": BASE | BIT["symbols"] | BIT["duplicate_lines"],
    "v2": sum(BIT.values()),
}
CURRENT = "v2"


def word_array(text: Column) -> Column:
    """The words of a text; an empty array if there is none."""
    bare = F.btrim(text, F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_RUN))


def _tail(x: Column, first: int, size: Column) -> Column:
    """x from its element ``first`` (from 1) on, ``size`` elements, none below 0."""
    return F.slice(x, F.lit(first), F.greatest(size, F.lit(0)))


def _pairs(x: Column, apart: int, n: Column) -> Column:
    """Hashes of the first n elements of x, each with that ``apart`` places on."""
    return F.zip_with(_tail(x, 1, n), _tail(x, 1 + apart, n), lambda a, b: F.xxhash64(a, b))


def repeated_words(df: DataFrame, words: str, out: str) -> DataFrame:
    """Add ``out``: the words in 5-word windows that occur twice or more.

    Each step is a column of its own, so that none is computed twice; the
    columns named _rep_ are dropped. Windows are equal if their 64-bit hashes
    are."""
    n = F.size(words)
    keep = df.columns
    df = df.withColumn("_rep_one", F.transform(words, lambda w: F.xxhash64(w)))
    df = df.withColumn("_rep_two", _pairs(F.col("_rep_one"), 1, n - 1))
    df = df.withColumn("_rep_four", _pairs(F.col("_rep_two"), 2, n - 3))
    five = F.zip_with(_tail(F.col("_rep_four"), 1, n - 4), _tail(F.col("_rep_one"), 5, n - 4), lambda a, b: F.xxhash64(a, b))
    df = df.withColumn("_rep_five", five)
    # Only texts with equal windows go on; the others have a null from here.
    some = F.size(F.array_distinct("_rep_five")) < F.size("_rep_five")
    placed = F.array_sort(F.transform("_rep_five", lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    df = df.withColumn("_rep_sorted", F.when(some, placed))
    m = F.size("_rep_sorted")
    same = F.zip_with(_tail(F.col("_rep_sorted"), 1, m - 1), _tail(F.col("_rep_sorted"), 2, m - 1), lambda a, b: a["h"] == b["h"])
    df = df.withColumn("_rep_same", same)
    no = F.array(F.lit(False))
    either = F.zip_with(F.concat(no, "_rep_same"), F.concat("_rep_same", no), lambda a, b: a | b)
    at = F.zip_with("_rep_sorted", either, lambda w, e: F.when(e, w["p"]))
    df = df.withColumn("_rep_places", F.sort_array(F.filter(at, lambda p: p.isNotNull())))
    width = F.zip_with("_rep_places", _tail(F.col("_rep_places"), 2, F.size("_rep_places") - 1),
                       lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))))
    total = F.aggregate(width, F.lit(0).cast("long"), lambda s, x: s + x)
    return df.select(*keep, F.coalesce(total, F.lit(0).cast("long")).alias(out))


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements n_words, word_chars, n_symbols, n_lines,
    n_dup_lines, n_repeat_words, and failure_bits, for every row."""
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    words = documents(docs).select("doc_id", word_array(F.col("text")).alias("words"), lines.alias("lines"),
                                   F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"))
    measured = words.select(
        "doc_id", "words", "n_symbols", F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"))
    counted = repeated_words(measured, "words", "n_repeat_words").drop("words")
    bits = sum((F.when(F.expr(test), F.lit(BIT[name])).otherwise(F.lit(0)) for name, test in RULES), F.lit(0))
    return counted.withColumn("failure_bits", bits.cast("long"))


def passes(bits: Column, version: str = CURRENT) -> Column:
    return bits.bitwiseAND(F.lit(POLICIES[version]).cast("long")) == 0


def ablations(entries: DataFrame, policies: dict[str, int] = POLICIES) -> DataFrame:
    """For each policy version and rule in it: n_docs, n_kept, and n_only_rule,
    the documents that the policy would keep without that rule."""
    counted = entries.groupBy("failure_bits").agg(F.count(F.lit(1)).alias("n"))  # at most 2 ** rules rows
    cases = F.array(*[F.struct(F.lit(v).alias("version"), F.lit(m).cast("long").alias("mask"), F.lit(name).alias("rule"),
                               F.lit(BIT[name]).cast("long").alias("bit"))
                      for v, m in policies.items() for name, _ in RULES if m & BIT[name]])
    failed = F.col("failure_bits").bitwiseAND(F.col("c.mask"))
    return (counted.select("failure_bits", "n", F.explode(cases).alias("c"))
            .groupBy(F.col("c.version").alias("version"), F.col("c.rule").alias("rule"))
            .agg(F.sum("n").alias("n_docs"), F.sum(F.when(failed == 0, F.col("n")).otherwise(0)).alias("n_kept"),
                 F.sum(F.when(failed == F.col("c.bit"), F.col("n")).otherwise(0)).alias("n_only_rule")))
