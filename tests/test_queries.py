"""Every query against its DuckDB SQL on the smallest tables, and the shape of those that have none."""

import glob
import math
import os

import duckdb
import pytest

from parlance.queries import QUERIES, SQL


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5)
    return float(v) if hasattr(v, "as_tuple") else v


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, sf, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=lambda r: tuple(map(str, r)))
    found = duck.sql(SQL[name])
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    want = sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=lambda r: tuple(map(str, r)))
    assert got == want
    assert got


@pytest.mark.parametrize("name", ["logmel", "clean_pipeline", "ablation_matrix", "cleaned_wer"])
def test_has_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert {"lang", "mean_wer", "n"} == set(__spark_entry__.entry(spark).columns)
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_topk_holds_no_label_whole(spark, sf):
    plan = QUERIES["topk_similar"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan
    assert "WindowGroupLimit" in plan


def test_punctuation_capitals_are_single_letters(spark, tmp_path):
    """As SQL has them: ẞ for ß."""
    texts = [". ßen, ßt. ßa! o ß", "ŉa. ᾀb! ﬁn? ǆa. éa", "straße. ß"]
    spark.createDataFrame([(1 + 10 * i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, QUERIES["punct_restore"](spark, str(tmp_path)).collect()))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(con.sql(f"select doc_id, text from ({SQL['punct_restore']})").fetchall())
    assert "ẞen" in got[0][1]


@pytest.mark.parametrize("name", ["spans_en", "spans_ko", "spans_es", "filler_label_histogram"])
def test_spans_are_computed_once(spark, sf, name):
    """Once, where the table is dealt out: not in a filter of sizes before that as well."""
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" not in plan.split("Repartition")[-1]
    assert sum("regexp_extract_all" in line for line in plan.split("\n")) == 1
