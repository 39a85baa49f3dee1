import random
import re
from collections import Counter

from docreason.llm import rules


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    count = Counter(windows)
    hit = {j for i, w in enumerate(windows) if count[w] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines), len(lines) - len(set(lines)), len(hit))


def test_measurements_match_brute_force(spark):
    rng = random.Random(4)
    say = lambda n, v: " ".join(rng.choice(v) for _ in range(n))
    texts = [None, "", " \t\n", "one", "a b c d e", "a b c d e f", "a a a a a a", "x y z u v w " * 400, "é é ## <b>\n\nq\n q\nq",
             "l 1\nl 1\r\nl 1\n \n", "\x0bw\x0c", "long " * 30_000 + "tail"]
    texts += [say(rng.randrange(0, 60), ["a", "b", "Ć", "d&", "e\n"]) for _ in range(60)]
    df = spark.createDataFrame([(i // 2, t, 1, "w") for i, t in enumerate(texts)] + [(None, "null id", 1, "")],
                               "doc_id long, text string, n_words int, words string")
    got = [(r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_lines"], r["n_dup_lines"], r["n_repeat_words"])
           for r in rules.ledger(df).collect()]
    want = [(i // 2, *brute(t)) for i, t in enumerate(texts)] + [(None, *brute("null id"))]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert rules.ledger(df.limit(0)).count() == 0


def test_policies_and_ablations(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    entries = rules.ledger(docs).cache()
    rows = entries.collect()
    for v, mask in rules.POLICIES.items():
        kept = entries.where(rules.passes(entries["failure_bits"], v)).count()
        assert kept == sum(not r["failure_bits"] & mask for r in rows)
    for r in rules.ablations(entries).collect():
        mask, bit = rules.POLICIES[r["version"]], rules.BIT[r["rule"]]
        assert r["n_docs"] == len(rows)
        assert r["n_kept"] + r["n_only_rule"] == sum(not x["failure_bits"] & (mask & ~bit) for x in rows)
        assert r["n_kept"] == sum(not x["failure_bits"] & mask for x in rows)
    assert rules.ablations(entries.limit(0)).count() == 0
    for r in rows:
        base = r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]
        assert bool(r["failure_bits"] & rules.BASE) == base
