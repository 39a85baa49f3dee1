import zlib

import numpy as np

from docreason.llm import langid

SF = "/root/testdata/sf0.001"


def test_symbols_fold_and_collapse():
    s, n = langid.symbols(["Ab  9c", "", "  É!", "x"])
    assert "".join(map(chr, s)) == "   ab c" + "   " + "   é " + "   x"
    assert n.tolist() == [4, 0, 2, 1]


def brute(counts, text, vocab):
    """Interpolated Kneser-Ney by its definition, one symbol at a time."""
    grams = {4: counts}
    for n in (3, 2, 1):
        low = {}
        for g in grams[n + 1]:
            low[g[1:]] = low.get(g[1:], 0) + 1
        grams[n] = low

    def prob(g, n):
        if n == 0:
            return 1 / vocab
        c = grams[n]
        n1, n2 = (sum(v == k for v in c.values()) for k in (1, 2))
        d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        same = [v for k, v in c.items() if k[:-1] == g[:-1]]
        low = prob(g[1:], n - 1)
        if not same:
            return low
        return max(c.get(g, 0) - d, 0) / sum(same) + d * len(same) / sum(same) * low

    s = "   " + text
    return -sum(np.log(prob(s[i - 3:i + 1], 4)) for i in range(3, len(s))) / len(text)


def test_model_is_interpolated_kneser_ney():
    texts = {"a": "the cat and the dog and then that", "b": "der hund und die katze und dann das"}
    raw, counts = {}, {}
    for lang, t in texts.items():
        s = "   " + t
        raw[lang] = {}
        for i in range(3, len(s)):
            raw[lang][s[i - 3:i + 1]] = raw[lang].get(s[i - 3:i + 1], 0) + 1
        keys, n = np.unique(langid.grams(langid.symbols([t])[0]), return_counts=True)
        counts[lang] = keys, n
    model = langid.fit(counts)
    vocab = len(set("".join(texts.values()))) + 1
    probe = ["the hound", "dxq zz das und", "a", "the cat and the dog and then that"]
    got, n = model.entropies(probe)
    for i, p in enumerate(probe):
        for j, lang in enumerate(model.langs):
            assert abs(got[i, j] - brute(raw[lang], p, vocab)) < 1e-4
    langid.BLOCK, keep = 7, langid.BLOCK  # block borders change nothing
    try:
        assert np.allclose(model.entropies(probe)[0], got, atol=1e-5)
    finally:
        langid.BLOCK = keep


def test_held_out_accuracy_and_edges(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.train(docs)
    extra = spark.createDataFrame([(-1, None), (-2, "12 -- 34"), (-3, ""), (None, "the and that with")],
                                  "doc_id long, text string")
    out = langid.identify(docs.select("doc_id", "text").unionAll(extra), model).collect()
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    held = [r for r in out if r["doc_id"] in truth and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert len(out) == len(truth) + 4
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) >= 0.97
    assert np.mean([r["rejected"] for r in held]) <= 0.03
    by = {r["doc_id"]: r for r in out}
    assert all(by[i]["lang_pred"] == "und" and by[i]["rejected"] and by[i]["score"] == 0 for i in (-1, -2, -3))
    assert by[None]["lang_pred"] == "en"
    assert all(0 <= r["score"] <= 1 for r in out)


def test_noise_is_rejected(spark):
    model = langid.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    odd = spark.createDataFrame([(1, "qzx wvkq xxzzq jjqv zzkx qwzx vvqk xqzj " * 20), (2, "Привет мир как дела " * 20)],
                                "doc_id long, text string")
    assert [r["rejected"] for r in langid.identify(odd, model).collect()] == [True, True]


def test_unlearned_language_is_rejected_at_every_length(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    model = langid.train(docs.where("lang <> 'en'"))
    rows = [r for r in docs.collect() if r["text"] and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    for size in (100, 300, 1000):
        known, other = ([r["text"][:size] for r in rows if (r["lang"] == "en") == en and len(r["text"]) >= size] for en in (False, True))
        assert np.mean(langid.predict(model, other)[2]) >= 0.9, size
        assert np.mean(langid.predict(model, known)[2]) <= 0.03, size


def test_every_labelled_language_is_learned(spark):
    rng = np.random.default_rng(3)
    # Over a million 4-grams in one language, a few short rows in 120 others.
    large = [(i, "".join(map(chr, rng.integers(0x4E00, 0x5A00, 4000))), "a") for i in range(450)]
    words = [(1000 + 9 * j + i, " ".join([f"{'bcdfghjklmnp'[j % 12]}{'aeiouyäöüé'[j // 12]}s"] * 5), f"z{j:03}")
             for j in range(120) for i in range(9)]
    docs = spark.createDataFrame(large + words, "doc_id long, text string, lang string")
    model = langid.train(docs)
    assert model.langs == sorted({d[2] for d in large + words})
    probe = [large[0][1]] + [w[1] for w in words[::9]]
    assert langid.predict(model, probe)[0] == ["a"] + [w[2] for w in words[::9]]
    # A language is never dropped, however small its share of rows or characters.
    assert langid.train(docs, docs_per_lang=1, chars_per_lang=1).langs == model.langs


def test_bars_by_length():
    rng = np.random.default_rng(1)
    n = np.repeat([16, 64, 256], 400)
    ce = 2 + rng.normal(0, 1, 1200) / np.sqrt(n)
    lang, doc = np.zeros(1200, int), np.tile(np.arange(100), 12)
    got = langid.bars(lang, doc, n, ce, 1)[0]
    assert np.isinf(got[:4]).all()
    assert all(2 + 2 / 2 ** (k / 2) < got[k] < 2 + 6 / 2 ** (k / 2) for k in (4, 6, 8))
    assert (np.diff(got[4:]) <= 0).all() and got[-1] == got[8]
    assert langid.bars(lang[:3], doc[:3], n[:3], ce[:3], 1) is None


def test_no_labelled_rows(spark):
    docs = spark.createDataFrame([(1, "some text", None), (2, None, "en")], "doc_id long, text string, lang string")
    model = langid.train(docs)
    assert model is None
    assert [(r["lang_pred"], r["rejected"]) for r in langid.identify(docs, model).collect()] == [("und", True)] * 2
    assert langid.identify(docs.limit(0), model).count() == 0
