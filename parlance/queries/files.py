"""Queries of readers and writers: whole tables written in a format of the engine's own and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.plans.pipeline import shared_path
from parlance.queries.registry import query, table
from parlance.sources import readers, writers

KINDS = "['pure_filler', 'contextual_filler', 'self_correction', 'clean']"


def written(df: DataFrame, name: str) -> str:
    """A folder with the lines of a one-column table."""
    path = f"{shared_path(df.sparkSession, name)}/lines"
    df.write.text(path)
    return path


@query(f"SELECT 'd' || doc_id AS id, {KINDS}[(doc_id % 4 + 1)::int] AS category, text AS reference, upper(source) AS asr_hypothesis FROM documents")
def fixture_read(spark, sf):
    kind = F.expr(f"array({KINDS[1:-1]})[cast(doc_id % 4 as int)]")
    rows = table(spark, sf, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), kind.alias("category"), F.col("text").alias("reference"), F.upper("source").alias("asr_hypothesis"), F.lit(1).alias("more"))
    return readers.fixtures(spark, written(rows.select(F.to_json(F.struct("*")).alias("value")), "fixtures"))


NEEDLES = "WITH d AS (SELECT doc_id, text, string_split(text, ' ') AS w FROM documents), n AS (SELECT doc_id, text, w[1] AS a, w[len(w) // 2 + 1] AS b FROM d), p AS (SELECT *, strpos(text, a) - 1 AS i FROM n), q AS (SELECT *, CASE WHEN strpos(substr(text, i + length(a) + 1), b) > 0 THEN strpos(substr(text, i + length(a) + 1), b) - 1 + i + length(a) END AS j FROM p)"


def needles(spark, sf) -> DataFrame:
    """The first and the middle word of each document, sought in this order."""
    w = F.split("text", " ")
    pair = F.array(F.get(w, F.lit(0)), F.get(w, F.floor(F.size(w) / 2).cast("int")))
    return table(spark, sf, "documents").select("doc_id", "text", writers.find_spans(F.col("text"), pair).alias("spans"))


@query(NEEDLES + " SELECT doc_id, i::int AS first, j::int AS middle, (j + length(b))::int AS until FROM q")
def needle_spans(spark, sf):
    s = F.col("spans")
    return needles(spark, sf).select("doc_id", s[0]["start"].alias("first"), s[1]["start"].alias("middle"), s[1]["end"].alias("until"))


@query(NEEDLES + " SELECT doc_id, 2 - (j IS NULL)::int AS fillers, a AS label, 0 AS repairs, text FROM q")
def annotation_read(spark, sf):
    """Annotations written and read; lists that are not there are empty."""
    rows = needles(spark, sf).select(F.col("doc_id").cast("string").alias("utterance_id"), "text", F.filter("spans", lambda s: s.isNotNull()).alias("fillers"))
    path = f"{shared_path(spark, 'annotations')}/rows"
    writers.annotations(rows, path)
    got = readers.annotations(spark, path)
    return got.select(F.col("utterance_id").cast("bigint").alias("doc_id"), F.size("fillers").alias("fillers"), F.col("fillers")[0]["label"].alias("label"), F.size("repairs").alias("repairs"), "text")


@query(NEEDLES + " SELECT doc_id, 1 AS wrong FROM q WHERE doc_id % 3 = 0")
def annotation_check(spark, sf):
    """Every third document has a span that begins before its text."""
    moved = F.transform(F.slice("spans", 1, 1), lambda s: s.withField("start", F.when(F.col("doc_id") % 3 == 0, -1).otherwise(s["start"])))
    rows = needles(spark, sf).select(F.col("doc_id").alias("utterance_id"), "text", moved.alias("fillers"))
    return writers.check_annotations(rows).select(F.col("utterance_id").alias("doc_id"), F.size("wrong").alias("wrong"))


@query("SELECT lang, round(avg(n_chars) / 10000, 6) AS wer, round(avg(n_chars) / 20000, 6) AS cer, min(n_chars)::double AS asr_p50, max(n_chars)::double AS e2e_p50, count(*) / 1000 AS rtf FROM documents GROUP BY lang")
def baseline_read(spark, sf):
    """A baseline document of one entry a language, written and read."""
    by = table(spark, sf, "documents").groupBy("lang").agg(F.avg("n_chars").alias("mean"), F.min("n_chars").cast("double").alias("low"), F.max("n_chars").cast("double").alias("high"), F.count("*").alias("n"))
    latency = lambda c: F.struct(F.col(c).alias("p50"), F.col(c).alias("p95"))
    rows = by.select("lang", F.col("n").alias("samples"), (F.col("mean") / 10000).alias("wer"), (F.col("mean") / 20000).alias("cer"), latency("low").alias("asr_latency_ms"), latency("high").alias("e2e_latency_ms"), (F.col("n") / 1000).alias("rtf"))
    got = readers.baseline(spark, written(writers.baseline_json(rows), "baseline"))
    return got.select("lang", F.round("wer", 6).alias("wer"), F.round("cer", 6).alias("cer"), "asr_p50", "e2e_p50", "rtf")


@query("SELECT p_name AS word, min(p_brand) AS phonemes FROM part GROUP BY p_name")
def dictionary_read(spark, sf):
    """A JSON object of all names of parts and their first brand; a dictionary is one document."""
    pairs = table(spark, sf, "part").groupBy(F.col("p_name").alias("word")).agg(F.min("p_brand").alias("phonemes"))
    one = pairs.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("word", "phonemes")))).alias("value"))
    return readers.dictionary(spark, written(one, "dictionary"))


@query("SELECT vec_id, len(embedding)::int AS n, round(list_sum(list_transform(embedding, lambda x: round(x::double, 4))), 4) AS shift, round(2 * list_sum(list_transform(embedding, lambda x: round(x::double, 4))), 4) AS scale FROM embeddings")
def cmvn_read(spark, sf):
    """Means and scales as bracketed text, parsed."""
    rounded = F.transform("embedding", lambda x: F.round(x.cast("double"), 4))
    shown = lambda v: F.array_join(F.transform(v, lambda x: F.format_string("%.4f", x)), " ")
    text = F.concat(F.lit("<Nnet>\n<AddShift> 64 64\n<LearnRateCoef> 0 [ "), shown(rounded), F.lit(" ]\n<Rescale> 64 64\n<LearnRateCoef> 0 [\n"), shown(F.transform(rounded, lambda x: x * 2)), F.lit("\n]\n</Nnet>"))
    got = table(spark, sf, "embeddings").select("vec_id", readers.parse_cmvn(text).alias("c"))
    total = lambda v: F.round(F.aggregate(v, F.lit(0.0), lambda s, x: s + x), 4)
    return got.select("vec_id", F.size("c.shift").alias("n"), total(F.col("c.shift")).alias("shift"), total(F.col("c.scale")).alias("scale"))


@query("SELECT doc_id, len(string_split(text, ' '))::int AS n_json, string_split(text, ' ')[1] AS first, len(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' '))::int AS n_lines FROM documents")
def tokens_read(spark, sf):
    """Each document's words as a JSON list and as lines."""
    listed = F.to_json(F.split("text", " "))
    lines = F.concat(F.array_join(F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " "), "\n"), F.lit("\n\n"))
    got = table(spark, sf, "documents").select("doc_id", readers.tokens_json(listed).alias("j"), readers.tokens_text(lines).alias("t"))
    return got.select("doc_id", F.size("j").alias("n_json"), F.get("j", F.lit(0)).alias("first"), F.size("t").alias("n_lines"))


@query("""SELECT event_id, event_type = 'click' AS success, CASE WHEN event_type <> 'click' THEN 'unsupported output: ' || event_type END AS error FROM (SELECT event_id, CASE WHEN event_type = 'click' THEN 'click' ELSE event_type END AS event_type FROM events)
WHERE event_id < (SELECT max(event_id) FROM events)""")
def emitter_undo(spark, sf):
    """Clicks are insertions, all else a plain sink refuses; the last row is undone."""
    kind = F.when(F.col("event_type") == "click", "TextInsertion").otherwise(F.col("event_type"))
    out = writers.undo(writers.emit(table(spark, sf, "events").select("event_id", kind.alias("kind"))), "event_id")
    return out.select("event_id", "success", "error")
