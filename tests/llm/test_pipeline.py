"""The pipeline against the stages' own brute-force versions and whole-row invariants."""

import corpus_pipeline as pipeline
from tests.llm.test_near import brute_components
from tests.llm.test_tokenizers import check_packing


def test_stages_keep_columns_and_take_effect(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    assert [n for n, _ in pipeline.STAGES] == ["quality_classifier", "language_id", "ngram_jaccard_join", "best_fit_packing"]
    now = docs
    kept = {}
    for name, stage in pipeline.STAGES[:-1]:
        now = pipeline.written(spark, stage(spark, now, sf_dir), name)
        assert now.columns == docs.columns
        kept[name] = {r.doc_id: r.text for r in now.collect()}
    clean = {k for k, r in labels.items() if r.quality == 1 and r.toxic == 0}
    assert len(clean & kept["quality_classifier"].keys()) >= 0.95 * len(clean)
    before = sorted(kept["language_id"].items())
    assert set(kept["ngram_jaccard_join"]) == {k for k, _, c in brute_components(before, 5, 80) if k == c}
    rows = pipeline.packing(spark, now, sf_dir).collect()
    assert {r.doc_id for r in rows} == set(kept["ngram_jaccard_join"])
    check_packing(rows, 2048)
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in pipeline.run(spark, sf_dir).collect()) == sorted((r.doc_id, r.piece, r.ids_crc32) for r in rows)


def test_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, k0 string"
    text = "una frase con muchas palabras que se repite dos veces"
    rows = [(1, text, "es", "a", 1, "x", "y"), (1, text, "es", "a", 1, "x", "y"), (2, text, "es", "a", 1, None, None), (None, "some other words here", "en", None, None, None, None), (5, None, None, None, None, None, None), (6, "", "en", "a", 0, "", "")]
    docs = spark.createDataFrame(rows, schema)
    sf_dir = "/root/testdata/sf0.001"
    first = pipeline.quality(spark, docs, sf_dir)
    assert first.columns == docs.columns and {r.doc_id for r in first.collect()} == {1, 2, None}
    assert pipeline.language(spark, docs, sf_dir).columns == docs.columns
    near = pipeline.near_duplicates(spark, docs, sf_dir).collect()
    assert sorted(str(r.doc_id) for r in near) == ["1", "5", "6", "None"]
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).collect() == []
