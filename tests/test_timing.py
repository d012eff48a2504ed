"""A row for each layer, with counts and ordered percentiles."""

import pytest
from pyspark.sql import functions as F

from parlance.plans import pipeline, timing


def test_one_row_a_stage(spark):
    rows = [("um hello", "en"), ("fine.", "en"), (None, "en"), ("i have twenty two", "en")]
    df = spark.createDataFrame(rows, "text string, lang string")
    stages = {"filler": pipeline.filler_stage, "numerals": pipeline.numeral_stage, "same": lambda t, lang: t}
    got = {r.stage: r for r in timing.layer_latency(df, stages, warmup=1, runs=3).collect()}
    assert {n: (r.rows, r.changed, r.runs) for n, r in got.items()} == {"filler": (4, 1, 3), "numerals": (4, 1, 3), "same": (4, 0, 3)}
    assert all(0 <= r.p50_us <= r.p95_us for r in got.values())


def test_empty_table_and_wrong_numbers(spark):
    df = spark.createDataFrame([], "text string, lang string")
    got = timing.layer_latency(df, {"upper": lambda t, lang: F.upper(t)}, warmup=0, runs=1).collect()
    assert [(r.stage, r.rows, r.p50_us) for r in got] == [("upper", 0, None)]
    with pytest.raises(ValueError):
        timing.layer_latency(df, {}, runs=0)
