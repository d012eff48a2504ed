"""Regression gates: measured values against a baseline."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Tolerances:
    error_absolute: tuple[float, float] = (0.03, 0.07)
    error_relative: tuple[float, float] = (0.10, 0.30)
    asr_latency: tuple[float, float] = (0.50, 1.50)
    e2e_latency: tuple[float, float] = (0.30, 1.00)
    rtf: tuple[float, float] = (0.50, 1.50)
    rtf_most: float = 1.0
    latency_most_ms: float = 1000.0
    ablation: tuple[float, float] = (0.02, 0.05)
    layer_latency: tuple[float, float] = (1.50, 3.50)
    layer_latency_most_us: float = 1_000_000.0


DEFAULT = Tolerances()


def _status(fail: Column, warn: Column) -> Column:
    return F.when(fail, "fail").when(warn, "warn").otherwise("pass")


def error_rate(measured: Column, baseline: Column, t: Tolerances = DEFAULT) -> Column:
    """Absolute or relative rise; NaN fails; a baseline of 0 has no relative rise."""
    rise = measured - baseline
    relative = F.when(baseline > 0, rise / baseline).otherwise(0.0)
    broken = F.isnan(measured) | F.isnan(baseline)
    return F.when(broken, "fail").otherwise(_status((rise >= t.error_absolute[1]) | (relative >= t.error_relative[1]), (rise >= t.error_absolute[0]) | (relative >= t.error_relative[0])))


def relative_rise(measured: Column, baseline: Column, limits: tuple[float, float]) -> Column:
    """Relative rise alone; a baseline of 0 or less passes."""
    rise = F.when(baseline > 0, (measured - baseline) / baseline)
    return F.coalesce(_status(rise >= limits[1], rise >= limits[0]), F.lit("pass"))


def ceiling(measured: Column, limit: float) -> Column:
    """A warning at or above the limit, never a failure."""
    return F.when(F.lit(limit > 0) & ~F.isnan(measured) & (measured >= limit), "warn").otherwise("pass")


def drift(measured: Column, baseline: Column, t: Tolerances = DEFAULT) -> Column:
    """Any change, to the better as well; a missing baseline warns."""
    change = F.abs(measured - baseline)
    return F.when(baseline.isNull(), "warn").otherwise(_status(change >= t.ablation[1], change >= t.ablation[0]))


def check_languages(measured: DataFrame, baseline: DataFrame, t: Tolerances = DEFAULT) -> DataFrame:
    """(lang, metric, status) from rows (lang, wer, cer, asr_p50, e2e_p50, rtf); a language without baseline warns."""
    b = baseline.select("lang", *[F.col(c).alias(f"b_{c}") for c in ("wer", "cer", "asr_p50", "e2e_p50", "rtf")], F.lit(True).alias("_known"))
    both = measured.join(b, "lang", "left")
    m = {c: F.col(c) for c in ("wer", "cer", "asr_p50", "e2e_p50", "rtf")}
    o = {c: F.col(f"b_{c}") for c in m}
    shown = lambda c: m[c].isNotNull() & o[c].isNotNull()
    rows = [
        ("wer", F.when(shown("wer"), error_rate(m["wer"], o["wer"], t))),
        ("cer", F.when(shown("cer"), error_rate(m["cer"], o["cer"], t))),
        ("asr_latency_p50_ms", relative_rise(m["asr_p50"], o["asr_p50"], t.asr_latency)),
        ("e2e_latency_p50_ms", relative_rise(m["e2e_p50"], o["e2e_p50"], t.e2e_latency)),
        ("rtf", F.when(shown("rtf"), relative_rise(m["rtf"], o["rtf"], t.rtf))),
        ("rtf_absolute", F.when(m["rtf"].isNotNull(), ceiling(m["rtf"], t.rtf_most))),
        ("asr_latency_p50_ms_absolute", ceiling(m["asr_p50"], t.latency_most_ms)),
        ("e2e_latency_p50_ms_absolute", ceiling(m["e2e_p50"], t.latency_most_ms)),
    ]
    known = F.array(*[F.struct(F.lit(n).alias("metric"), s.alias("status")) for n, s in rows])
    missing = F.array(F.struct(F.lit("baseline").alias("metric"), F.lit("warn").alias("status")))
    every = both.select("lang", F.explode(F.when(F.col("_known"), known).otherwise(missing)).alias("r"))
    return every.select("lang", "r.metric", "r.status").where("status is not null")


def check_layers(measured: DataFrame, baseline: DataFrame, t: Tolerances = DEFAULT) -> DataFrame:
    """(lang, kind, name, status) from rows (lang, kind, name, value) of kind 'ablation' or 'latency'."""
    both = measured.join(baseline.withColumnRenamed("value", "_b"), ["lang", "kind", "name"], "left")
    m, b = F.col("value"), F.col("_b")
    latency = F.when(b.isNull(), "warn").otherwise(relative_rise(m, b, t.layer_latency))
    status = F.when(F.col("kind") == "ablation", drift(m, b, t)).otherwise(latency)
    top = F.when((F.col("kind") == "latency") & b.isNotNull(), ceiling(m, t.layer_latency_most_us))
    rows = F.array(F.struct(F.lit("").alias("suffix"), status.alias("status")), F.struct(F.lit("_absolute").alias("suffix"), top.alias("status")))
    return both.select("lang", "kind", "name", F.explode(rows).alias("r")).where("r.status is not null").select("lang", "kind", F.concat("name", "r.suffix").alias("name"), "r.status")


def overall(verdicts: DataFrame, *keys: str) -> DataFrame:
    """Whether any check failed."""
    return verdicts.groupBy(*keys).agg(F.bool_or(F.col("status") == "fail").alias("failed"), F.count_if(F.col("status") == "warn").alias("warnings"))
