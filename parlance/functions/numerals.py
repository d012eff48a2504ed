"""Spoken numerals as digits, and lenient normalisation, as native Columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from parlance.functions.lexicon import DROPPED, KO_CLASSIFIERS, KO_DIGITS, KO_LARGE, KO_SMALL, SPLITTING, ZH_DIGITS, ZH_UNITS, english_numbers
from parlance.functions.text import chars, col, let

ZH_RUN = f"[{ZH_DIGITS}〇{ZH_UNITS}]+"
KO_DIGIT, KO_UNIT = "".join(KO_DIGITS), "".join([*KO_SMALL, *KO_LARGE])
KO_TOKEN = f"[{KO_DIGIT}{KO_UNIT}0-9]"
KO_RUN = f"(?U){KO_TOKEN}(?:\\s?{KO_TOKEN})*"


def rewrite_runs(text: Column, pattern: str, convert) -> Column:
    """Each match of the pattern replaced by convert(match, text behind it)."""

    def rewritten(t: Column) -> Column:
        def joined(gaps: Column) -> Column:
            new = F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), lambda r, i: convert(r, F.get(gaps, i + 1)))
            return F.array_join(F.zip_with(gaps, new, lambda g, r: F.concat(g, F.coalesce(r, F.lit("")))), "")

        return F.when(t.rlike(pattern), let(F.split(t, pattern), joined)).otherwise(t)

    return let(text, rewritten)


def _number(symbols: Column, step, first: tuple) -> Column:
    """Folds symbols over (total, section, last, have) and adds up what is open."""
    zero = F.struct(*[F.lit(v).cast("bigint").alias(n) for n, v in zip(("total", "section", "last", "have"), first, strict=True)])
    return F.aggregate(symbols, zero, step, lambda s: s["total"] + s["section"] + s["last"])


def _state(total, section, last, have) -> Column:
    return F.struct(*[(x if isinstance(x, Column) else F.lit(x)).cast("bigint").alias(n) for n, x in zip(("total", "section", "last", "have"), (total, section, last, have), strict=True)])


def _zh_value(run: Column) -> Column:
    def step(s: Column, c: Column) -> Column:
        digit = F.call_function("locate", c, F.lit(ZH_DIGITS))
        one = F.when(s["have"] == 1, s["last"]).otherwise(F.lit(1))
        return (
            F.when(digit > 0, _state(s["total"], s["section"], digit - 1, 1))
            .when(c == "十", _state(s["total"], s["section"] + one * 10, 0, 0))
            .when(c == "百", _state(s["total"], s["section"] + s["last"] * 100, 0, 0))
            .when(c == "千", _state(s["total"], s["section"] + s["last"] * 1000, 0, 0))
            .when(c == "万", _state(s["total"] + (s["section"] + s["last"]) * 10**4, 0, 0, 0))
            .otherwise(_state(s["total"] + (s["section"] + s["last"]) * 10**8, 0, 0, 0))
        )

    return _number(chars(run), step, (0, 0, 0, 0))


def chinese_numerals(text: Column | str) -> Column:
    """Runs with a unit by place value (only 十 stands for one of itself), others digit by digit."""

    def convert(run: Column, _: Column) -> Column:
        plain = F.translate(run, "〇", "零")
        return F.when(plain.rlike(f"[{ZH_UNITS}]"), _zh_value(plain).cast("string")).otherwise(F.translate(plain, ZH_DIGITS, "0123456789"))

    return rewrite_runs(col(text), ZH_RUN, convert)


def _ko_value(segment: Column) -> Column:
    def step(s: Column, c: Column) -> Column:
        arabic = c.rlike("[0-9]")
        digit = F.lit(None).cast("bigint")
        for k, v in KO_DIGITS.items():
            digit = F.when(c == k, F.lit(v).cast("bigint")).otherwise(digit)
        out = F.when(arabic, _state(s["total"], s["section"], s["last"] * 10 + F.when(arabic, c).cast("bigint"), 1)).when(digit.isNotNull(), _state(s["total"], s["section"], digit, 1))
        one = F.when(s["have"] == 1, s["last"]).otherwise(F.lit(1))
        for k, v in KO_SMALL.items():
            out = out.when(c == k, _state(s["total"], s["section"] + one * v, 0, 0))
        open_ = s["section"] + s["last"]
        for k, v in KO_LARGE.items():
            out = out.when(c == k, _state(s["total"] + F.when(open_ == 0, 1).otherwise(open_) * v, 0, 0, 0))
        return out.otherwise(s)

    return _number(chars(segment), step, (0, 0, 0, 0))


def korean_numerals(text: Column | str) -> Column:
    """Runs of digits and units, single blanks inside dropped; a new number starts where a Korean digit follows another.

    A number needs a digit and a unit; a single digit counts before a classifier only.
    Digits 0 to 9 belong to runs, so that numbers one blank apart become one.
    """
    classifier = "^(?:" + "|".join(KO_CLASSIFIERS) + ")"

    def convert(run: Column, gap: Column) -> Column:
        bare = F.regexp_replace(run, r"(?U)\s", "")
        behind = F.regexp_replace(F.coalesce(gap, F.lit("")), r"(?U)^\s", "")

        def segments(parts: Column) -> Column:
            def one(part: Column, i: Column) -> Column:
                follow = F.coalesce(F.get(parts, i + 1), behind)
                number = part.rlike(f"[{KO_DIGIT}0-9]") & part.rlike(f"[{KO_UNIT}]")
                single = (F.length(part) == 1) & part.rlike(f"[{KO_DIGIT}]") & follow.rlike(classifier)
                return F.when(number, _ko_value(part).cast("string")).when(single, _ko_value(part).cast("string")).otherwise(part)

            return F.array_join(F.transform(parts, one), " ")

        return let(F.split(F.regexp_replace(bare, f"(?<=[{KO_DIGIT}])(?=[{KO_DIGIT}])", "|"), r"\|"), segments)

    def rewritten(t: Column) -> Column:
        # without Korean symbols a run is digits alone, which only lose the blanks between them
        joined = F.regexp_replace(t, r"(?U)(?<=[0-9])\s(?=[0-9])", "")
        return F.when(t.rlike(f"[{KO_DIGIT}{KO_UNIT}]"), rewrite_runs(t, KO_RUN, convert)).otherwise(joined)

    return let(col(text), rewritten)


def english_number_words(text: Column | str) -> Column:
    """Whole tokens between single blanks; everything else as it is, and a text without one costs one test."""
    known = english_numbers()
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    named = "|".join(re.escape(w) for w in sorted(known, key=len, reverse=True))
    return rewrite_runs(col(text), f"(?<![^ ])(?:{named})(?![^ ])", lambda w, _: F.element_at(table, w))


def lenient(text: Column | str) -> Column:
    """Numerals as digits, punctuation dropped, dashes and white space as single blanks, lower case."""
    t = korean_numerals(chinese_numerals(col(text)))
    bare = F.regexp_replace(t, f"[{re.escape(DROPPED)}]", "")
    spaced = F.regexp_replace(bare, f"(?U)[\\s{re.escape(SPLITTING)}]+", " ")
    return english_number_words(F.lower(F.regexp_replace(F.regexp_replace(spaced, "^ ", ""), " $", "")))
