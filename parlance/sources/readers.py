"""Readers with explicit schemas: audio, fixtures, annotations, manifests, baselines, dictionaries, vocabularies."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, IntegerType, StructField, StructType

FIXTURE = "id string, category string, reference string, asr_hypothesis string"
SPAN = "struct<start:int,end:int>"
ANNOTATION = f"utterance_id string, text string, fillers array<struct<start:int,end:int,label:string>>, repairs array<struct<reparandum:{SPAN},interregnum:{SPAN},repair:{SPAN},type:string>>, expected_text string, corrections array<struct<original:string,replacement:string>>"
LATENCY = "struct<p50:double,p95:double>"
BASELINE = f"schema_version int, generated string, asr_model string, languages map<string,struct<samples:int,wer:double,cer:double,asr_latency_ms:{LATENCY},e2e_latency_ms:{LATENCY},rtf:double>>"
LAYER_BASELINE = f"schema_version int, generated string, languages map<string,struct<fixtures:int,ablation:map<string,double>,layer_latency_us:map<string,{LATENCY}>>>"


def fixtures(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; blank lines are skipped, bad ones fail."""
    return spark.read.schema(FIXTURE).option("mode", "FAILFAST").json(path)


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; missing lists are empty, a missing repair type is 'substitution'."""
    df = spark.read.schema(ANNOTATION).option("mode", "FAILFAST").json(path)
    for c in ("fillers", "repairs", "corrections"):
        df = df.withColumn(c, F.coalesce(c, F.array().cast(df.schema[c].dataType)))
    return df.withColumn("repairs", F.transform("repairs", lambda r: r.withField("type", F.coalesce(r["type"], F.lit("substitution")))))


def parse_manifest(lines: DataFrame, value: str = "value") -> DataFrame:
    """(id, audio_path, reference) of lines with three columns; the third keeps later tabs; the header goes."""
    parts = F.split(F.regexp_replace(value, r"\r$", ""), "\t", 3)
    rows = lines.select(parts.alias("p")).where((F.size("p") == 3) & (F.get("p", F.lit(0)) != "id"))
    return rows.select(F.col("p")[0].alias("id"), F.col("p")[1].alias("audio_path"), F.col("p")[2].alias("reference"))


def manifest(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """The rows of a manifest, with ``most`` its first ones only."""
    rows = parse_manifest(spark.read.text(path))
    return rows if most is None else rows.limit(most)


def baseline(spark: SparkSession, path: str) -> DataFrame:
    """(lang, wer, cer, asr_p50, e2e_p50, rtf) of a baseline document."""
    rows = spark.read.schema(BASELINE).option("multiLine", True).json(path).select(F.explode("languages").alias("lang", "b"))
    return rows.select("lang", "b.wer", "b.cer", F.col("b.asr_latency_ms.p50").alias("asr_p50"), F.col("b.e2e_latency_ms.p50").alias("e2e_p50"), "b.rtf")


def layer_baseline(spark: SparkSession, path: str) -> DataFrame:
    """(lang, kind, name, value) of a layer baseline document."""
    rows = spark.read.schema(LAYER_BASELINE).option("multiLine", True).json(path).select(F.explode("languages").alias("lang", "b"))
    first = rows.select("lang", F.lit("ablation").alias("kind"), F.explode("b.ablation").alias("name", "value"))
    second = rows.select("lang", F.lit("latency").alias("kind"), F.explode("b.layer_latency_us").alias("name", "l")).select("lang", "kind", "name", F.col("l.p50").alias("value"))
    return first.unionByName(second)


def dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(word, phonemes) of a JSON object."""
    text = spark.read.option("wholetext", True).text(path)
    return text.select(F.explode(F.from_json("value", "map<string,string>")).alias("word", "phonemes"))


def _bracket(text: Column, after: str) -> Column:
    inner = F.regexp_extract(text, rf"(?s){after}.*?\[([^\]]*)\]", 1)
    return F.transform(F.filter(F.split(inner, r"\s+"), lambda x: x != ""), lambda x: x.cast("double"))


def parse_cmvn(text: Column) -> Column:
    """struct<shift, scale>: the first bracket after each mark; null unless both have one size, not 0."""
    shift, scale = _bracket(text, "<AddShift>"), _bracket(text, "<Rescale>")
    return F.when((F.size(shift) > 0) & (F.size(shift) == F.size(scale)), F.struct(shift.alias("shift"), scale.alias("scale")))


def tokens_json(text: Column) -> Column:
    """A JSON list of pieces by id; an empty list is an error."""
    got = F.from_json(text, "array<string>")
    return F.when(F.size(got) > 0, got).otherwise(F.raise_error(F.lit("empty token list")).cast("array<string>"))


def tokens_text(text: Column) -> Column:
    """A piece a line; blank lines at the end go."""
    return F.split(F.regexp_replace(text, r"(\r?\n)+\s*$", ""), r"\r?\n")


def parse_vocabulary(lines: DataFrame, value: str = "value") -> DataFrame:
    """(piece, first_id, last_id) of 'piece id' lines, split at the last blank."""
    m = lines.select(F.regexp_extract(value, r"^(.*) (\d+)$", 1).alias("piece"), F.regexp_extract(value, r"^(.*) (\d+)$", 2).alias("id")).where("id <> ''")
    return m.groupBy("piece").agg(F.min(F.col("id").cast("bigint")).alias("first_id"), F.max(F.col("id").cast("bigint")).alias("last_id"))


def language_id(languages: Column, lang: Column) -> Column:
    """An id from a map by language, regional forms by their first part."""
    key = F.lower(lang)
    return F.coalesce(F.element_at(languages, key), F.element_at(languages, F.substring_index(key, "-", 1)))


def decode_wav(raw: bytes) -> tuple[list[float], int, int]:
    """16-bit PCM RIFF/WAVE; chunks are word-aligned."""
    if raw[:4] != b"RIFF" or raw[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at, form = 12, None
    while at + 8 <= len(raw):
        kind, size = struct.unpack_from("<4sI", raw, at)
        if kind == b"fmt ":
            form = struct.unpack_from("<HHIIHH", raw, at + 8)
        elif kind == b"data":
            if form is None or form[5] != 16:
                raise ValueError("16-bit PCM only")
            body = raw[at + 8 : at + 8 + size]
            return (np.frombuffer(body[: len(body) // 2 * 2], "<i2") / np.float32(32768)).tolist(), form[2], form[1]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


@F.pandas_udf(StructType([StructField("samples", ArrayType(FloatType())), StructField("sample_rate", IntegerType()), StructField("channels", IntegerType())]))
def audio_of(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([decode_wav(c) for c in content], columns=["samples", "sample_rate", "channels"])


def wav(spark: SparkSession, path: str) -> DataFrame:
    """(path, samples, sample_rate, channels) of all .wav files below a folder, by path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.wav").load(path)
    return files.select("path", audio_of("content").alias("a")).select("path", "a.*").orderBy("path")


def first_by_id(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each id."""
    names = [c for c in rows.columns if c != key]
    best = rows.groupBy(key).agg(F.min_by(F.struct(*names), F.col(order)).alias("r"))
    return best.select(key, *[F.col(f"r.{c}").alias(c) for c in names])
