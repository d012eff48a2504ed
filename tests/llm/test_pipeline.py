import corpus_pipeline


def test_stages_keep_the_columns_and_use_their_decisions(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    now, n = docs, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, now, sf)
        assert after.columns == docs.columns, name
        kept = after.select("doc_id").distinct()
        assert kept.join(now.select("doc_id"), "doc_id", "left_anti").count() == 0
        if name != "mixing":
            assert after.count() == kept.count() <= now.count()
        now = spark.createDataFrame(after.collect(), docs.schema)
    assert 0.5 * n < now.select("doc_id").distinct().count() <= n
    last = corpus_pipeline.STAGES[-1][1](spark, now, sf)
    assert last.count() == now.count()
