"""Session reductions, the same in batch and in Structured Streaming.

Events are rows (session_id, seq, ts, kind, text, samples) of kind audio, partial,
final or cancel.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

IDLE, ACTIVATING, RECORDING, PROCESSING, EMITTING, CANCELLING = "Idle", "Activating", "Recording", "Processing", "Emitting", "Cancelling"
STEPS = ((IDLE, ACTIVATING), (ACTIVATING, RECORDING), (RECORDING, PROCESSING), (PROCESSING, EMITTING), (EMITTING, IDLE), (CANCELLING, IDLE))
LEGAL = (*STEPS, *((s, CANCELLING) for s in (ACTIVATING, RECORDING, PROCESSING, EMITTING)))
NO_SPEECH = "no speech detected"


def last_final(events: DataFrame) -> DataFrame:
    """session_id, text, error: partials are ignored, the last final wins, a cancelled session has no text."""
    final = (F.col("kind") == "final") & F.col("text").isNotNull()
    found = events.groupBy("session_id").agg(
        F.max_by(F.when(final, F.col("text")), F.when(final, F.col("seq"))).alias("text"),
        F.max_by(F.when(F.col("kind") == "error", F.col("text")), F.when(F.col("kind") == "error", F.col("seq"))).alias("detail"),
        F.bool_or(F.col("kind") == "cancel").alias("cancelled"),
    )
    empty = F.coalesce(F.col("text"), F.lit("")) == ""
    error = F.when(F.col("cancelled"), "cancelled").when(empty, F.concat(F.lit(NO_SPEECH), F.coalesce(F.concat(F.lit(" ("), "detail", F.lit(")")), F.lit(""))))
    return found.select("session_id", F.when(~F.col("cancelled") & ~empty, F.col("text")).alias("text"), error.alias("error"))


def outcomes(events: DataFrame, contexts: DataFrame, key: str = "app") -> DataFrame:
    """session_id, text, context, error: how each session ends, in batch and in a stream alike.

    events: (session_id, seq, kind, text, key); beside the kinds of a recording there are
    'end' (no more results), 'context' (the snapshot is there) and 'refined' (a text, or
    null where the refiner failed).  contexts: a static table of (key, context), the
    latest by value where a key has several.  It is joined to the 'end' events alone, so
    once for each session, and nothing of it waits in the state.

    A cancellation ends the stage in which it comes: recording before 'end', context
    before 'context', refinement before 'refined'; a later one changes nothing, nor does
    one of a session that ended without speech.  A failed refiner leaves the raw text.
    A session that is still in a stage has neither text nor error.
    """
    ended = F.col("kind") == "end"
    known = contexts.groupBy(F.col(key).alias("_key")).agg(F.max("context").alias("_context"))
    joined = events.withColumn("_key", F.when(ended, F.col(key))).join(known, "_key", "left")
    at = lambda kind: F.min(F.when(F.col("kind") == kind, F.col("seq")))
    last = lambda kind, value: F.max_by(F.when(F.col("kind") == kind, F.col(value)), F.when(F.col("kind") == kind, F.col("seq")))
    final = (F.col("kind") == "final") & F.col("text").isNotNull()
    found = joined.groupBy("session_id").agg(
        at("end").alias("end"), at("context").alias("fetched"), at("refined").alias("refined"), at("cancel").alias("cancelled"),
        F.max_by(F.when(final, F.col("text")), F.when(final, F.col("seq"))).alias("raw"), last("refined", "text").alias("output"), last("error", "text").alias("detail"), last("end", "_context").alias("context"),
    )
    before = lambda step: F.col(step).isNull() | (F.col("cancelled") < F.col(step))
    cancelled, silent = F.col("cancelled").isNotNull(), F.coalesce("raw", F.lit("")) == ""
    speechless = F.concat(F.lit(NO_SPEECH), F.coalesce(F.concat(F.lit(" ("), "detail", F.lit(")")), F.lit("")))
    error = (
        F.when(cancelled & before("end"), "cancelled during recording")
        .when(F.col("end").isNotNull() & silent, speechless)
        .when(cancelled & before("fetched"), "cancelled during context")
        .when(cancelled & before("refined"), "cancelled during refinement")
    )
    done = F.col("end").isNotNull() & F.col("fetched").isNotNull() & F.col("refined").isNotNull()
    out = found.withColumn("error", error)
    return out.select("session_id", F.when(F.col("error").isNull() & done, F.coalesce("output", "raw")).alias("text"), F.when(F.col("fetched").isNotNull(), F.col("context")).alias("context"), "error")


def refined(raw: Column, output: Column) -> Column:
    """A refiner's output, or the raw text where it failed."""
    return F.coalesce(output, raw)


def transitions(states: DataFrame) -> DataFrame:
    """session_id, seq, before, state, legal: each step of a session from Idle."""
    before = F.lag("state", 1, IDLE).over(Window.partitionBy("session_id").orderBy("seq"))
    pair = F.concat_ws(">", "before", "state")
    return states.withColumn("before", before).select("session_id", "seq", "before", "state", pair.isin(*[f"{a}>{b}" for a, b in LEGAL]).alias("legal"))


def rechunk(events: DataFrame, size: int = 1600) -> DataFrame:
    """session_id, chunk, samples: a session's samples in chunks of one size, the last one shorter.

    Each event's samples are cut where a chunk begins, by the session's running length; only
    the pieces of one chunk are ever gathered, so a session may have any length.
    """
    spoken = events.where(F.size("samples") > 0)
    past = F.sum(F.size("samples").cast("bigint")).over(Window.partitionBy("session_id").orderBy("seq", F.hash("samples")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = spoken.withColumn("_at", past - F.size("samples"))
    first, last = F.floor(F.col("_at") / size), F.floor((F.col("_at") + F.size("samples") - 1) / size)
    cut = placed.withColumn("chunk", F.explode(F.sequence(first, last)))
    start = F.greatest(F.col("chunk") * size - F.col("_at"), F.lit(0))
    end = F.least((F.col("chunk") + 1) * size - F.col("_at"), F.size("samples").cast("bigint"))
    piece = F.slice("samples", (start + 1).cast("int"), (end - start).cast("int"))
    chunks = cut.select("session_id", F.col("chunk").cast("int").alias("chunk"), F.struct("_at", piece.alias("s")).alias("piece")).groupBy("session_id", "chunk")
    return chunks.agg(F.flatten(F.transform(F.array_sort(F.collect_list("piece")), lambda c: c["s"])).alias("samples"))


def rechunk_stream(events: DataFrame, size: int = 1600, timeout: str = "10 minutes") -> DataFrame:
    """The same on a stream: samples wait in the session's state until a chunk is full; the rest goes out at a 'final' event.

    Events with a ``ts`` column and a watermark on it also end a session that has been silent
    for ``timeout`` of event time.  Without, it ends by 'final' alone: time that passes on the
    clock would ask for batch after batch, so that a run over what there is would never end.
    Chunks follow the order of arrival; within a batch that of ``seq``.
    """
    out = "session_id bigint, chunk int, samples array<double>"
    timed = "EventTimeTimeout" if _has_watermark(events) else "NoTimeout"
    wait_ms = int(pd.Timedelta(timeout).total_seconds() * 1000)

    def run(key, frames: Iterator[pd.DataFrame], state):
        number, held = state.get if state.exists else (0, [])
        number, held, rows, over, last = int(number), [float(x) for x in held], [], state.hasTimedOut, 0
        for frame in frames:
            for row in frame.sort_values("seq").itertuples():
                held += [] if row.samples is None else [float(x) for x in row.samples]
                over = over or row.kind == "final"
            if timed == "EventTimeTimeout" and len(frame):
                last = max(last, int(frame["_ms"].max()))
        while len(held) >= size or (over and held):
            rows.append((key[0], number, held[:size]))
            held, number = held[size:], number + 1
        if over:
            if state.exists:
                state.remove()
        else:
            state.update((number, held))
            if timed == "EventTimeTimeout":
                state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + wait_ms)
        yield pd.DataFrame(rows, columns=["session_id", "chunk", "samples"])

    if timed == "EventTimeTimeout":
        events = events.withColumn("_ms", F.coalesce(F.unix_millis("ts"), F.lit(0)))
    return events.groupBy("session_id").applyInPandasWithState(run, out, "chunk int, held array<double>", "append", timed)


def _has_watermark(events: DataFrame) -> bool:
    return "ts" in events.columns and "EventTimeWatermark" in events._jdf.queryExecution().logical().toString()


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", seconds: int = 600) -> DataFrame:
    """Runs a stream over what there is, writes it and returns what was written.  In complete mode the last state replaces what was there.

    A run that has not ended after ``seconds`` is stopped and raises TimeoutError.
    """

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(path)

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
    try:
        if not query.awaitTermination(seconds):
            raise TimeoutError(f"the stream has not ended after {seconds} seconds")
    finally:
        query.stop()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


class IntakeListener(StreamingQueryListener):
    """Keeps the rows that each batch of a query took in, to see that a bound on intake holds."""

    def __init__(self) -> None:
        self.rows: dict[str, list[int]] = {}

    def onQueryStarted(self, event) -> None:
        self.rows[str(event.id)] = []

    def onQueryProgress(self, event) -> None:
        if event.progress.numInputRows:
            self.rows.setdefault(str(event.progress.id), []).append(event.progress.numInputRows)

    def onQueryIdle(self, event) -> None:
        """Nothing came in."""

    def onQueryTerminated(self, event) -> None:
        """What was counted stays."""


def bounded_intake(spark: SparkSession, schema, path: str, files: int | None = None, size: str | None = None) -> DataFrame:
    """A stream over Parquet files that takes in at most so many files, or bytes, a batch: what waits stays in the folder and not in memory."""
    if (files is None) == (size is None) or (files is not None and files < 1):
        raise ValueError("give a number of files, or a size, for a batch")
    bound = ("maxFilesPerTrigger", str(files)) if files is not None else ("maxBytesPerTrigger", size)
    return spark.readStream.schema(schema).option(*bound).parquet(path)
