"""Small tables are dealt over all cores; columns and filters still reach the scan."""

from parlance.queries import registry


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_small_text_tables_are_dealt_and_pruned(spark, sf):
    df = registry.table(spark, sf, "documents").where("doc_id > 5").select("doc_id", "text")
    assert "RoundRobinPartitioning" in plan_of(df)
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan_of(df)
    assert "GreaterThan(doc_id,5)" in plan_of(df)
    assert df.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert "RoundRobin" not in plan_of(registry.table(spark, sf, "embeddings"))


def test_large_tables_stay_as_they_are_read(spark, sf, monkeypatch):
    monkeypatch.setattr(registry, "SMALL_BYTES", 10)
    assert "RoundRobin" not in plan_of(registry.table(spark, sf, "documents"))
