import corpus_pipeline
import pytest

from docreason.llm import langid, pii
from tests.llm import test_decontam, test_packing, test_simhash

SF = "/root/testdata/sf0.001"


def brute(spark, docs, bench):
    """Rows (doc_id, text) that reach packing, stage by stage, in plain Python."""
    table = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    model, field = langid.train(table), pii.train()
    rows = [d for d in docs if not langid.predict(model, [d[1]])[2][0]]
    prints = {d[0]: test_simhash.brute_print(d[1]) for d in rows}
    groups = test_simhash.brute_components(prints, 4)
    kept = {min(i for i in groups if groups[i] == g) for g in set(groups.values())}
    out = []
    for d in rows:
        if d[0] not in kept:
            continue
        _, hit, _ = test_decontam.brute(d[1], bench, 10)
        text = d[1]
        if hit:
            starts = [h for h in hit if h - 1 not in hit]
            ends = [h + 1 for h in hit if h + 1 not in hit]
            from docreason.llm.decontam import cut_words
            text = cut_words(text, starts, ends)
        out.append((d[0], pii.replaced(text, pii.all_spans([text], field)[0])))
    return out


def test_pipeline_matches_brute_force(spark):
    pytest.importorskip("public_tokenizers")
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    want = brute(spark, docs, bench)
    test_packing.check(corpus_pipeline.run(spark, SF).collect(), 2048, want)


def test_stages_keep_columns_and_edge_rows(spark):
    base = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, None, "en", None, None), (-1, "", None, "s", 0), (-2, None, "x", "s", None)], base.schema)
    text = base.where("length(text) > 500").first()
    twice = spark.createDataFrame([text, text], base.schema)
    docs = base.unionAll(odd).unionAll(twice)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.schema.simpleString() == base.schema.simpleString(), name
        rows = out.collect()
        assert stage(spark, docs.limit(0), SF).count() == 0
        if name == "near_duplicates":
            assert sum(r["doc_id"] == text["doc_id"] for r in rows) == 1
            assert sum(not (r["text"] or "").strip() for r in rows) == 1  # all wordless rows are one group
        elif name != "language_id":
            assert len(rows) == docs.count()
        assert all(r["n_chars"] == len(r["text"]) for r in rows if r["text"] and r["n_chars"] is not None)
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), SF).count() == 0
