"""Pipelines of stages, the runtime registry and the paths of shared tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.functions.text import let
from parlance.operators import corrections, fillers, polish

Stage = Callable[[Column, Column], Column]


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share; where that is not set, a local session gets a temporary one and a cluster is refused."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="parlance-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def filler_stage(text: Column, lang: Column) -> Column:
    return fillers.by_language(text, lang)["text"]


def correction_stage(text: Column, lang: Column) -> Column:
    return corrections.remove(text)["text"]


def spoken_stage(text: Column, lang: Column) -> Column:
    return polish.spoken_forms(text, lang)


def numeral_stage(text: Column, lang: Column) -> Column:
    return polish.inverse_normalise(text, lang)


def punctuation_stage(text: Column, lang: Column) -> Column:
    return polish.punctuate(text)


def paragraph_stage(text: Column, lang: Column) -> Column:
    return polish.paragraphs(text)


CORRECTIONS = "array<struct<kind:string,original:string,replacement:string>>"


def _kinds(kind: str, pairs: Column) -> Column:
    return F.transform(pairs, lambda p: F.struct(F.lit(kind).alias("kind"), p["original"].alias("original"), p["replacement"].alias("replacement")))


def _single(when: Column, kind: str, original: Column, replacement: Column) -> Column:
    return F.when(when, F.array(F.struct(F.lit(kind).alias("kind"), original.alias("original"), replacement.alias("replacement"))))


#: What a stage removes, as array<string>, from (text before, language).
REMOVED: dict[Stage, Callable[[Column, Column], Column]] = {filler_stage: lambda t, lang: fillers.by_language(t, lang)["removed"]}
#: What a stage corrects, as CORRECTIONS, from (text before, language, text after).
CORRECTED: dict[Stage, Callable[[Column, Column, Column], Column]] = {
    correction_stage: lambda t, lang, after: let(corrections.remove(t)["original"], lambda gone: _single(gone.isNotNull(), "SelfCorrectionRemoved", gone, F.lit(""))),
    spoken_stage: lambda t, lang, after: _kinds("SpokenFormNormalized", polish.spoken_changes(t, lang)),
    numeral_stage: lambda t, lang, after: _single(t != after, "NumeralNormalized", t, after),
    punctuation_stage: lambda t, lang, after: F.concat(_kinds("Capitalized", polish.capitals(t)), F.coalesce(let(polish.inserted_mark(t), lambda m: _single(m.isNotNull(), "PunctuationInserted", F.lit(""), m)), F.array().cast(CORRECTIONS))),
}


@dataclass
class Cleaner:
    """Ordered stages over a text column; a stage that gives null keeps the text before it."""

    filters: list[Stage] = field(default_factory=list)
    processors: list[Stage] = field(default_factory=list)
    refiner: Callable[[Column], Column] | None = None

    def filter(self, stage: Stage) -> Cleaner:
        return Cleaner([*self.filters, stage], self.processors, self.refiner)

    def process(self, stage: Stage) -> Cleaner:
        return Cleaner(self.filters, [*self.processors, stage], self.refiner)

    def refine(self, refiner: Callable[[Column], Column]) -> Cleaner:
        """The last step; where it gives null the raw text is the output."""
        return Cleaner(self.filters, self.processors, refiner)

    def apply(self, df: DataFrame, text: str = "text", lang: str = "lang", out: str = "clean_text", removed: str | None = None, corrected: str | None = None) -> DataFrame:
        """df with ``out``.  Each stage is a column of its own, so none is computed more than once.

        removed, corrected: names of further columns with what the filters removed
        (array<string>) and what the processors corrected (kind, original, replacement),
        in the order of the stages; stages that say nothing of it have no part in them.
        """
        if self.refiner is None:
            raise ValueError("missing required component: refiner")
        made, last = df.withColumn("_0", F.col(text)), 0
        gone, changed = [], []
        for n, stage in enumerate((*self.filters, *self.processors), 1):
            made, last = made.withColumn(f"_{n}", F.coalesce(stage(F.col(f"_{n - 1}"), F.col(lang)), F.col(f"_{n - 1}"))), n
            if stage in REMOVED:
                gone.append(F.coalesce(REMOVED[stage](F.col(f"_{n - 1}"), F.col(lang)), F.array().cast("array<string>")))
            if stage in CORRECTED:
                changed.append(F.coalesce(CORRECTED[stage](F.col(f"_{n - 1}"), F.col(lang), F.col(f"_{n}")), F.array().cast(CORRECTIONS)))
        if removed:
            made = made.withColumn(removed, F.concat(F.array().cast("array<string>"), *gone))
        if corrected:
            made = made.withColumn(corrected, F.concat(F.array().cast(CORRECTIONS), *changed))
        return made.withColumn(out, F.coalesce(self.refiner(F.col(f"_{last}")), F.col(text))).drop(*[f"_{n}" for n in range(last + 1)])


REFINERS: dict[str, Callable[[Column], Column]] = {
    "passthrough": lambda t: t,
    "uppercase": F.upper,
    "fail": lambda t: F.when(F.lit(False), t),
}


def fixed(text: str) -> Callable[[Column], Column]:
    return lambda t: F.lit(text)


def standard() -> Cleaner:
    """Fillers, self-corrections, spoken forms, numerals, punctuation, paragraphs."""
    out = Cleaner().filter(filler_stage)
    for stage in (correction_stage, spoken_stage, numeral_stage, punctuation_stage, paragraph_stage):
        out = out.process(stage)
    return out.refine(REFINERS["passthrough"])


class RouterError(Exception):
    """An unknown runtime, or a request that its factory refuses."""


@dataclass(frozen=True)
class Request:
    runtime: str
    language: str
    source: str
    options: dict = field(default_factory=dict)


class Router:
    """Runtimes by name; a later registration replaces an earlier one."""

    def __init__(self) -> None:
        self.factories: dict[str, Callable[[Request], object]] = {}

    def register(self, name: str, factory: Callable[[Request], object]) -> Router:
        self.factories[name] = factory
        return self

    def build(self, request: Request) -> object:
        if request.runtime not in self.factories:
            raise RouterError(f"unknown runtime: {request.runtime}")
        try:
            return self.factories[request.runtime](request)
        except (KeyError, TypeError, ValueError) as e:
            raise RouterError(f"{request.runtime}: {e}") from e


#: Options that each known runtime takes, and those it needs.
OPTIONS = {
    "whisper-local": ({"cli_path"}, {"cli_path"}), "parakeet": ({"feature_size"}, set()), "paraformer": (set(), set()),
    "canary": ({"int8"}, set()), "sensevoice": ({"with_itn"}, set()), "whisper-onnx": ({"quant"}, set()),
}


def checked(name: str, build: Callable[[Request], object]) -> Callable[[Request], object]:
    """A factory that refuses options its runtime does not know or lacks ones that it needs."""
    allowed, needed = OPTIONS[name]

    def run(request: Request) -> object:
        if extra := set(request.options) - allowed:
            raise ValueError(f"unknown options: {', '.join(sorted(extra))}")
        if missing := needed - set(request.options):
            raise ValueError(f"missing options: {', '.join(sorted(missing))}")
        return build(request)

    return run
