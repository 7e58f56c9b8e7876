"""The pipeline against the operators' brute-force forms, and its edge rows."""

import corpus_pipeline
from furrow.llm import decontam, neardup, pii


def test_stages_keep_what_they_should(spark, tmp_path):
    clean = [" ".join(f"d{i}w{k}" for k in range(80)) for i in range(12)]
    leak = " ".join(f"item{k}" for k in range(30))
    rows = [(i, t, "en", "s1", len(t)) for i, t in enumerate(clean)]
    rows += [(50, clean[0], "en", "s2", 1), (51, clean[1] + " tail", "en", "s1", 1), (52, clean[2] + " " + leak + " " + clean[2][::-1], "en", "s1", 1), (53, "too short", "en", "s1", 9), (54, None, None, None, None), (55, " ".join(f"mail m{k}@x{k}.org y{k}" for k in range(40)), "de", "s3", 1)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        path = f"{tmp_path}/{name}"
        stage(spark, docs, str(tmp_path)).write.parquet(path)
        docs = spark.read.parquet(path)
        seen[name] = {r.doc_id: r for r in docs.collect()}
        if name != "target_mixing":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
    assert set(seen["quality_rules"]) == {*range(12), 50, 51, 52, 55}
    assert set(seen["ngram_jaccard_join"]) == {*range(12), 52, 55}
    assert set(seen["benchmark_decontamination"]) == {*range(12), 55}
    private = seen["pii_surrogates"]
    assert set(private) == {*range(12), 55} and "m3@x3.org" not in private[55].text and private[0].text == clean[0]
    assert len({private[55].text[s:e] for s, e, _ in pii.find_entities(private[55].text)}) == 40
    assert set(seen["target_mixing"]) <= set(private) and "probability" in docs.columns


def test_stages_on_an_empty_table_and_whole_run(spark, tmp_path):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    empty = spark.createDataFrame([], schema)
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
    small = "/root/testdata/sf0.001"
    out = corpus_pipeline.run(spark, small).collect()
    ids = [r.doc_id for r in out]
    assert ids and len(ids) == len(set(ids))
    items = decontam.Items([(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()])
    items.choose(__import__("numpy").zeros(len(items.keys), dtype=int))
    assert not any(decontam.search(items, r.text) for r in out)
    cache = neardup._WordHash()
    sets = [set(neardup.shingles(r.text, cache).tolist()) for r in out]
    # Surrogates are drawn after de-duplication, so texts may differ from those compared; none may be equal.
    assert len({frozenset(s) for s in sets}) == len(sets)
