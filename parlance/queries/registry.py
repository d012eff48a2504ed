"""Queries by name, each with the DuckDB SQL that gives the same rows where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame."""

    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            SQL[key] = sql
        return f

    return add


#: A scan gives one task for each row group at most, however many cores there are; below so many bytes a core a table is dealt over all of them.
SMALL_BYTES = 16 << 20
TEXTS = ("documents", "conversations")


def spread(df: DataFrame) -> DataFrame:
    """A small table, whose rows are dear to work on, over all cores; the rows moved are bounded by the cores, and a large table stays as it is read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if 1 < cores and size < SMALL_BYTES * cores else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in TEXTS else df


def sql_list(values) -> str:
    return "[" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + "]"


def quoted(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)


def spark_quoted(values) -> str:
    return ", ".join("'" + str(v).replace("'", "\\'") + "'" for v in values)
