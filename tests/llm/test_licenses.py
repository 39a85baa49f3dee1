import random
import re

from docreason.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_base(text):
    w = words(text)
    places, labels = [], set()
    for p, label in licenses.PHRASES:
        p = p.split()
        at = [i for i in range(len(w)) if w[i:i + len(p)] == p]
        places += at
        labels |= {label} if at else set()
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def brute_spans(text, templates):
    w, out = words(text), set()
    for label, t in templates:
        v = words(t)
        n = len(v) - 2
        diag = {}
        for q in range(n):
            for p in range(len(w) - 2):
                if w[p:p + 3] == v[q:q + 3]:
                    diag.setdefault(p - q, set()).add((p, q))
        group, last = [], None
        for d in [*sorted(diag), None]:
            if group and (d is None or d - last > 3):
                pq = set().union(*(diag[x] for x in group))
                cover = len({q for _, q in pq}) / n
                if cover >= 0.8:
                    out.add((label, min(p for p, _ in pq), max(p for p, _ in pq) + 2, cover))
                group = []
            if d is not None:
                group.append(d)
                last = d
    return out


def test_matches_brute_force(spark):
    rng = random.Random(5)
    filler = ["the", "License", "mit", "General", "public", "É", "under", "of", "apache", "version", "K"]
    say = lambda n: " ".join(rng.choice(filler) for _ in range(n))
    texts = [None, "", "mit", "MIT license", "mit-license.apache\nLICENSE mit license mit license", "general public license",
             "mit licenseé", "x" + say(400)]
    for _, t in licenses.TEMPLATES:
        v = t.split()
        texts += [say(8) + " " + t + " " + say(5), " ".join(v[: len(v) // 2] + ["odd"] + v[len(v) // 2:]),
                  " ".join(v[: len(v) // 2]), t.upper() + "!! " + t]
    texts += [say(rng.randrange(3, 60)) for _ in range(40)] + ["word " * 50_000 + licenses.TEMPLATES[3][1]]
    ids = [*range(len(texts) - 1), None]
    df = spark.createDataFrame([(i, t, "w", 1) for i, t in zip(ids, texts)], "doc_id long, text string, words string, n int")
    got = {(r["doc_id"], r["label"], r["first"], r["last"], round(r["cover"], 9)) for r in licenses.spans(df).collect()}
    assert got == {(i, s, a, b, round(c, 9)) for i, t in zip(ids, texts) for s, a, b, c in brute_spans(t, licenses.TEMPLATES)}
    rows = licenses.scan(df).collect()
    assert len(rows) == len(texts)
    by = {r["doc_id"]: r for r in rows}
    for i, t in zip(ids, texts):
        r, base = by[i], brute_base(t)
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == base
        more = brute_spans(t, licenses.TEMPLATES)
        assert r["labels"] == ",".join(sorted(set(filter(None, base[4].split(","))) | {s[0] for s in more}))
        assert r["score"] == (1.0 if base[1] else max((s[3] for s in more), default=0.0))


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "Licensed under CC BY-NC 4.0."), (1, "Licensed under CC BY-NC 4.0."), (1, "other")],
                               "doc_id long, text string")
    assert sorted((r["doc_id"], r["labels"], r["n_base"]) for r in licenses.scan(df).collect()) == [
        (1, "", 0), (1, "cc-by-nc", 0), (1, "cc-by-nc", 0)]
    assert licenses.scan(df.limit(0)).count() == 0
