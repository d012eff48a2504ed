"""Column functions over text: tokens, segments, offsets, scripts, sentences.

All work on code points, are null for null and run inside the JVM.  White space is
Unicode's unless stated.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

ALNUM = r"\p{IsAlphabetic}\p{N}"
BLANKS = r"(?U)\s+"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strings(values) -> Column:
    """An array literal, also when empty."""
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def trim(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(?U)^\s+", ""), r"(?U)\s+$", "")


def words(text: Column | str) -> Column:
    """White-space tokens."""
    return F.filter(F.split(col(text), BLANKS), lambda w: w != "")


def clean(word: Column) -> Column:
    """Lower case, cut to the leading run of letters and digits."""
    return F.regexp_extract(F.lower(word), f"^[{ALNUM}]*", 0)


def chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def flags(values: Column, symbol: Callable[[Column, Column], Column]) -> Column:
    """A string with one symbol for each element."""
    return F.array_join(F.transform(values, symbol), "")


def keep(values: Column, marks: Column, wanted: str) -> Column:
    """The elements whose symbol is among ``wanted``."""
    zipped = F.zip_with(values, chars(marks), lambda v, m: F.struct(v.alias("v"), m.alias("m")))
    return F.transform(F.filter(zipped, lambda x: x["m"].isin(*wanted)), lambda x: x["v"])


def pieces(text: Column) -> Column:
    """Each token with the white space before it; joined they give the text up to its last token."""
    return F.regexp_extract_all(text, F.lit(r"(?U)\s*\S+"), F.lit(0))


BLOCK = 16


def _between(n: Column, first: Column, stop: Column) -> Column:
    """The sum of n[first:stop], element by element: a slice would copy all of n."""
    return F.when(stop > first, F.aggregate(F.sequence(first, stop - 1), F.lit(0), lambda s, k: s + F.coalesce(F.get(n, k), F.lit(0)))).otherwise(0)


def offsets(parts: Column) -> Column:
    """struct<n, blocks>: lengths of the pieces and what lies before each 16th, from which any prefix is soon added up."""

    def of(n: Column) -> Column:
        sums = F.transform(F.sequence(F.lit(0), F.floor(F.size(n) / BLOCK).cast("int")), lambda b: _between(n, b * BLOCK, (b + 1) * BLOCK))
        starts = F.aggregate(sums, F.array(F.lit(0)), lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + x)))
        return F.struct(n.alias("n"), starts.alias("blocks"))

    return let(F.transform(parts, lambda p: F.length(p)), of)


def before(sums: Column, i: Column) -> Column:
    """The length of the first i pieces."""
    block = F.floor(i / BLOCK).cast("int")
    return F.get(sums["blocks"], block) + _between(sums["n"], block * BLOCK, i)


def piece_span(parts: Column, sums: Column, first: Column, last: Column) -> Column:
    """Code points [start, end) from token ``first`` to token ``last`` (from 0); sums: from ``offsets``."""
    blank = F.length(F.regexp_extract(F.get(parts, first), r"(?U)^\s*", 0))
    whole = _between(sums["n"], first, last + 1)
    return let(before(sums, first), lambda at: F.struct((at + blank).cast("int").alias("start"), (at + whole).cast("int").alias("end")))


def sentences(text: Column | str) -> Column:
    """Sentences with their terminators, trimmed, none empty."""
    found = F.regexp_extract_all(col(text), F.lit(r"[^.!?。！？]*[.!?。！？]|[^.!?。！？]+$"), F.lit(0))
    return F.filter(F.transform(found, trim), lambda s: s != "")


def script(text: Column | str) -> Column:
    """Latin, Hangul, Hanzi, Kana or Other, by counts of characters."""
    t = col(text)
    latin, hangul, hanzi, kana = (
        F.regexp_count(t, F.lit(c)) for c in (r"[A-Za-z]", r"[가-힣ᄀ-ᇿ㄰-㆏]", r"[一-鿿㐀-䶿]", r"[぀-ヿ]")
    )
    counts = F.struct(latin.alias("l"), hangul.alias("h"), hanzi.alias("z"), kana.alias("k"))
    return let(
        counts,
        lambda c: F.when((c["k"] > 0) & (c["k"] + c["z"] >= c["l"]) & (c["k"] + c["z"] >= c["h"]), "Kana")
        .when((c["h"] > c["l"]) & (c["h"] > c["z"]), "Hangul")
        .when((c["z"] > c["l"]) & (c["z"] > c["h"]), "Hanzi")
        .when(c["l"] > 0, "Latin")
        .when(c["l"].isNotNull(), "Other"),
    )
