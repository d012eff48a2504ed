"""How long each layer of the cleaner takes over a table, an utterance at a time on average."""

from __future__ import annotations

import time

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from parlance.operators import scoring
from parlance.plans.pipeline import Stage


def layer_latency(df: DataFrame, stages: dict[str, Stage], warmup: int = 2, runs: int = 10, text: str = "text", lang: str = "lang") -> DataFrame:
    """stage, rows, changed, runs, p50_us, p95_us: a row for each stage.

    Each run is one job over the whole table, whose rows are kept by the executors, with
    what it saw observed as it went by: how many rows, and how many texts the stage
    changed.  A sample is a run's wall time divided by its rows; what the same job takes
    without a stage is measured first, and its median taken off.  Percentiles are those
    of the samples after the warm-up.  A table without rows gives no samples.
    """
    if warmup < 0 or runs < 1:
        raise ValueError("at least one run, and no negative warm-up")
    held = df.select(F.col(text).alias("_t"), F.col(lang).alias("_l")).persist(StorageLevel.MEMORY_AND_DISK)

    def samples(name: str, stage: Stage) -> list[tuple]:
        out = []
        for i in range(warmup + runs):
            seen = Observation()
            made = held.select("_t", stage(F.col("_t"), F.col("_l")).alias("_o")).observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(~F.col("_o").eqNullSafe(F.col("_t"))).alias("changed"))
            began = time.perf_counter()
            made.write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - began
            if i >= warmup:
                rows = seen.get["rows"]
                out.append((name, rows, seen.get["changed"], 1e6 * took / rows if rows else None))
        return out

    try:
        idle = samples("", lambda t, _: t)
        found = [s for name, stage in stages.items() for s in samples(name, stage)]
    finally:
        held.unpersist()
    spark = df.sparkSession
    schema = "stage string, rows bigint, changed bigint, us double"
    base = spark.createDataFrame(idle, schema).agg(scoring.latency("us", 0.5)[0].alias("base")).first().base or 0.0
    timed = spark.createDataFrame(found, schema).withColumn("us", F.when(F.col("us").isNotNull(), F.greatest(F.col("us") - base, F.lit(0.0))))
    low, high = scoring.latency("us")
    return timed.groupBy("stage").agg(F.max("rows").alias("rows"), F.max("changed").alias("changed"), F.count("*").cast("int").alias("runs"), low.alias("p50_us"), high.alias("p95_us"))
