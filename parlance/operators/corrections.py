"""Self-correction removal: a cue, what it takes back, and what stands in its place.

Each detector gives struct<text, original> or null where nothing fires.  Detectors
are behind a test for their cues, so rows without any cost one regular expression.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from parlance.functions.lexicon import SEPARATORS, cues
from parlance.functions.text import ALNUM, chars, col, let, words

AROUND = r"[,.;:!? \t]"


def overlap(before: Column, after: Column) -> Column:
    """The largest k up to 5 for which the k-th word from the end of ``before`` is the first of ``after``."""
    n = F.least(F.size(before), F.size(after), F.lit(5))
    hits = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: (k <= n) & (F.lower(F.get(before, F.size(before) - k)) == F.lower(F.get(after, F.lit(0)))))
    return F.coalesce(F.array_max(hits), F.lit(0))


def _found(text: Column, original: Column) -> Column:
    return F.struct(text.alias("text"), original.alias("original"))


def _by_overlap(before: Column, after: Column, cue: str) -> Column:
    """Drops the words that the repair starts anew; null without an overlap."""

    def repaired(b: Column) -> Column:
        return let(let(words(after), lambda a: overlap(b, a)), lambda k: cut(b, k))

    def cut(b: Column, k: Column) -> Column:
        keep = F.slice(b, F.lit(1), F.size(b) - k)
        gone = F.slice(b, F.size(b) - k + 1, k)
        return F.when((k > 0) & (after != ""), _found(F.when(F.size(keep) > 0, F.concat_ws(" ", F.array_join(keep, " "), after)).otherwise(after), F.concat(F.array_join(gone, " "), F.lit(f" {cue}"))))

    return let(words(before), repaired)


def _by_segment(before: Column, after: Column, cue: str, comma: str, joint: str, glue: str, kept_glue: str) -> Column:
    """Drops the last segment before the cue; null if either side is empty."""

    def repaired(s: Column) -> Column:
        kept = F.array_join(F.slice(s, F.lit(1), F.size(s) - 1), kept_glue)
        last = F.regexp_replace(F.regexp_replace(F.get(s, F.size(s) - 1), r"(?U)^\s+", ""), r"(?U)\s+$", "")
        return _found(F.when(kept == "", after).otherwise(F.concat(kept, F.lit(joint), after)), F.concat(last, F.lit(glue + cue)))

    return F.when((before != "") & (after != ""), let(F.split(before, comma), repaired))


def _first(text: Column, attempts: list[Column], gate: str) -> Column:
    """The first attempt that gives a result, where the text holds any cue at all."""
    return F.when(text.rlike(gate), F.coalesce(*attempts))


def _any(lang: str, case: str = "") -> str:
    return case + "|".join(re.escape(c) if not c.isalpha() else c for c in cues(lang))


def english(text: Column | str) -> Column:
    """The first place of each cue, anywhere in a word."""
    t = col(text)

    def attempt(cue: str) -> Column:
        at = F.locate(cue, F.lower(t))
        before = F.regexp_replace(F.substring(t, F.lit(1), at - 1), r"(?U)\s+$", "")
        after = F.regexp_replace(F.substring(t, at + len(cue), F.length(t)), r"(?U)^\s+", "")
        return F.when(at > 0, _by_overlap(before, after, cue))

    return _first(t, [attempt(c) for c in cues("en")], _any("en", "(?iu)"))


def _each_place(t: Column, cue: str, left: str, right: str, repair) -> Column:
    """The first place of a cue between boundaries at which ``repair(before, after)`` gives a result."""
    parts = F.split(F.lower(t), f"(?<![{left}]){re.escape(cue) if ' ' in cue else cue}(?![{right}])")

    def tried(p: Column) -> Column:
        def at(k: Column) -> Column:
            place = F.length(F.array_join(F.slice(p, F.lit(1), k), cue))
            before = F.regexp_replace(F.substring(t, F.lit(1), place), f"{AROUND}+$", "")
            after = F.regexp_replace(F.substring(t, place + len(cue) + 1, F.length(t)), f"^{AROUND}+", "")
            return F.when((before != "") & (after != ""), repair(before, after))

        found = F.filter(F.transform(F.sequence(F.lit(1), F.size(p) - 1), at), lambda x: x.isNotNull())
        return F.when(F.size(p) > 1, F.get(found, F.lit(0)))

    return let(parts, tried)


def spanish(text: Column | str) -> Column:
    """Every place of each cue as a word of its own; only ASCII letters count as neighbours."""
    t = col(text)
    attempts = [_each_place(t, c, "A-Za-z", "A-Za-z", lambda b, a, c=c: _by_overlap(b, a, c)) for c in cues("es")]
    return _first(t, attempts, _any("es", "(?iu)"))


def korean(text: Column | str) -> Column:
    """Every place of each cue between characters that are no letters or digits."""
    t = col(text)
    attempts = [_each_place(t, c, ALNUM, ALNUM, lambda b, a, c=c: _by_segment(b, a, c, "[,.!?;]", ", ", " ", ",")) for c in cues("ko")]
    return _first(t, attempts, _any("ko"))


def chinese(text: Column | str) -> Column:
    """The first place of each cue; clause commas around it go."""
    t = col(text)

    def attempt(cue: str) -> Column:
        at = F.locate(cue, t)
        before = F.regexp_replace(F.regexp_replace(F.substring(t, F.lit(1), at - 1), "[、，, ]+$", ""), r"(?U)\s+$", "")
        after = F.regexp_replace(F.regexp_replace(F.substring(t, at + len(cue), F.length(t)), "^[、，, ]+", ""), r"(?U)^\s+", "")
        return F.when(at > 0, _by_segment(before, after, cue, "[、，]", "，", "", "，"))

    return _first(t, [attempt(c) for c in cues("zh")], _any("zh"))


def japanese(text: Column | str) -> Column:
    """As for Chinese, with the ideographic comma alone."""
    t = col(text)

    def attempt(cue: str) -> Column:
        at = F.locate(cue, t)
        before = F.regexp_replace(F.regexp_replace(F.substring(t, F.lit(1), at - 1), "、+$", ""), r"(?U)\s+$", "")
        after = F.regexp_replace(F.regexp_replace(F.substring(t, at + len(cue), F.length(t)), "^、+", ""), r"(?U)^\s+", "")
        return F.when(at > 0, _by_segment(before, after, cue, "、", "、", "", "、"))

    return _first(t, [attempt(c) for c in cues("ja")], _any("ja"))


DETECTORS = {"ko": korean, "zh": chinese, "ja": japanese, "es": spanish, "en": english}


def remove(text: Column | str, lang: Column | str | None = None) -> Column:
    """struct<text, original>: the first detector that fires, most specific first; with ``lang``, only that language's.  original is null where none does."""
    t = col(text)
    attempts = [f(t) if lang is None else F.when(col(lang) == name, f(t)) for name, f in DETECTORS.items()]
    return F.coalesce(*attempts, _found(t, F.lit(None).cast("string")))


def diff_span(before: Column | str, after: Column | str) -> Column:
    """What a rewriting took out: the longest common suffix, then the longest common prefix outside it; null if nothing."""

    def common(x: Column, y: Column) -> Column:
        n = F.least(F.size(x), F.size(y))
        return F.array_min(F.filter(F.sequence(F.lit(0), n), lambda i: (i == n) | (F.get(x, i) != F.get(y, i))))

    def spanned(c: Column) -> Column:
        a, b = c["a"], c["b"]
        suffix = let(F.reverse(a), lambda x: let(F.reverse(b), lambda y: common(x, y)))
        short = lambda x, s: F.slice(x, F.lit(1), F.size(x) - s)
        prefix = lambda s: let(short(a, s), lambda x: let(short(b, s), lambda y: common(x, y)))
        return let(suffix, lambda s: let(prefix(s), lambda p: F.when(p < F.size(a) - s, F.struct(p.cast("int").alias("start"), (F.size(a) - s).cast("int").alias("end")))))

    return let(F.struct(chars(col(before)).alias("a"), chars(col(after)).alias("b")), spanned)


def trim_cue(text: Column | str, span: Column, lang: str) -> Column:
    """The span without separators at its end, the longest cue before them, and separators before that."""
    t = col(text)
    tail = f"(?U)[\\s{re.escape(SEPARATORS)}]+$"
    body = F.substring(t, span["start"] + 1, span["end"] - span["start"])
    bare = F.regexp_replace(body, tail, "")
    cut = bare
    for cue in reversed(cues(lang)):
        cut = F.when(bare.endswith(cue), F.regexp_replace(F.substring(bare, F.lit(1), F.length(bare) - len(cue)), tail, "")).otherwise(cut)
    return F.when(span.isNotNull(), F.struct(span["start"].alias("start"), (span["start"] + F.length(cut)).cast("int").alias("end")))
