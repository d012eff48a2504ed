"""Tables in the shared folder, and components of a graph that stays in Spark."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: While a table is written: texts vary by orders of magnitude, so fewer rows and bytes a batch keep
#: Python workers small; and what a finished job has shuffled is of no more use, so Spark deletes it.
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
WRITING = {BATCH_ROWS: "2048", "spark.sql.execution.arrow.maxBytesPerBatch": "4m", "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


class Workspace:
    """Intermediate tables, written below spark.checkpoint.dir so that lost executors cost no more than their tasks.

    Where that is not set, a local session (tests) gets a temporary folder; a cluster is refused.
    """

    def __init__(self, spark: SparkSession, name: str):
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            root = tempfile.mkdtemp(prefix="parlance-")
            spark.conf.set("spark.checkpoint.dir", root)
        self.spark, self.root = spark, f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"

    @contextmanager
    def writing(self, rows: int | None = None) -> Iterator[None]:
        """Settings for the jobs that write a table; the session has its own again afterwards.  rows: of an Arrow batch, fewer where rows are large."""
        before = {key: self.spark.conf.get(key, None) for key in WRITING}
        for key, value in WRITING.items():
            self.spark.conf.set(key, value)
        if rows:
            self.spark.conf.set(BATCH_ROWS, str(rows))
        try:
            yield
        finally:
            for key, value in before.items():
                if value is None:
                    self.spark.conf.unset(key)
                else:
                    self.spark.conf.set(key, value)

    def table(self, df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
        """Writes df and returns what was written."""
        path = f"{self.root}/{name}"
        with self.writing(rows):
            df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def release(self) -> None:
        """Lets Spark delete the shuffle files of finished stages; it learns of them when their plans are collected as garbage."""
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, *names: str) -> None:
        """Deletes tables that nothing reads any more."""
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def components(work: Workspace, edges: DataFrame, name: str = "cc") -> DataFrame:
    """(node, root): the smallest node that each node of ``edges`` (a, b) can reach.

    Large-star and small-star steps in turn, each a hash aggregation whose result
    is written; a node's neighbours are joined with their minimum and never held
    together, so that a star with many leaves needs no large row.
    """
    live = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    live = work.table(live, f"{name}_0")
    before, step = None, 0
    while True:
        step += 1
        both = live.unionByName(live.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.where("u <> v").distinct()
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v")))
        after = work.table(small.distinct(), f"{name}_{step}")
        work.drop(f"{name}_{step - 1}")
        now = after.agg(F.count("*"), F.sum("u"), F.sum("v"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        live = after
        if now == before:
            return live.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
        before = now
