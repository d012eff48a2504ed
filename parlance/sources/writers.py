"""Writers: audio, annotations, baselines, and what an output row shows."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType


def encode_wav(samples, rate: int, channels: int) -> bytes:
    """16-bit PCM, clamped to +-1 and cut towards zero."""
    body = (np.clip(np.asarray(samples, np.float32), -1, 1) * np.float32(32767)).astype("<i2").tobytes()
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(body), b"WAVE", b"fmt ", 16, 1, channels, rate, rate * channels * 2, channels * 2, 16, b"data", len(body))
    return head + body


@F.pandas_udf(BinaryType())
def wav_of(samples: pd.Series, rate: pd.Series, channels: pd.Series) -> pd.Series:
    return pd.Series([None if s is None else encode_wav(s, int(r), int(c)) for s, r, c in zip(samples, rate, channels, strict=True)])


def shown_text(kind: Column, text: Column, action: Column) -> Column:
    """What is shown of an output: its text, a command's action, or nothing."""
    return F.when(kind == "Command", action).otherwise(F.coalesce(text, F.lit("")))


def emit(outputs: DataFrame, kind: str = "kind") -> DataFrame:
    """outputs with success and error: a plain sink takes text insertions only."""
    ok = F.col(kind) == "TextInsertion"
    return outputs.withColumn("success", ok).withColumn("error", F.when(~ok, F.concat(F.lit("unsupported output: "), kind)))


def undo(emitted: DataFrame, order: str = "seq") -> DataFrame:
    """Without the last row; an empty sink has nothing to undo."""
    last = emitted.agg(F.max(order).alias("_last"))
    return emitted.join(last, F.col(order) < F.col("_last")).drop("_last")


def check_annotations(rows: DataFrame) -> DataFrame:
    """utterance_id and the fillers whose place or text does not fit."""
    wrong = lambda s: (s["start"] < 0) | (s["end"] > F.length("text")) | (F.substring(F.col("text"), s["start"] + 1, s["end"] - s["start"]) != s["label"])
    return rows.select("utterance_id", F.filter("fillers", wrong).alias("wrong")).where(F.size("wrong") > 0)


def annotations(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def baseline_json(rows: DataFrame) -> DataFrame:
    """One JSON document of (lang, struct of metrics) rows; as many rows as languages meet."""
    metrics = F.struct(*[c for c in rows.columns if c != "lang"])
    return rows.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("lang", metrics.alias("m"))))).alias("languages")).select(F.to_json(F.struct("languages"), {"pretty": "true"}).alias("value"))


def find_spans(text: Column, needles: Column) -> Column:
    """Spans of needles in order, each sought from the end of the one before; null where one is missing."""

    def step(s: Column, n: Column) -> Column:
        at = F.call_function("locate", n, text, s["cursor"] + 1) - 1
        span = F.when(at >= 0, F.struct(at.cast("int").alias("start"), (at + F.length(n)).cast("int").alias("end"), n.alias("label")))
        return F.struct(F.when(at >= 0, at + F.length(n)).otherwise(s["cursor"]).cast("int").alias("cursor"), F.concat(s["spans"], F.array(span)).alias("spans"))

    zero = F.struct(F.lit(0).cast("int").alias("cursor"), F.array().cast("array<struct<start:int,end:int,label:string>>").alias("spans"))
    return F.aggregate(needles, zero, step, lambda s: s["spans"])
