"""Error rates, span and pair scores, aggregates, latency summaries."""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from parlance.functions.text import col


def common_start(a: Sequence, b: Sequence) -> int:
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


def is_within(a: Sequence, b: Sequence) -> bool:
    """Whether b is a with more put in."""
    rest = iter(b)
    return all(x in rest for x in a)


def least_edits(a: Sequence, b: Sequence) -> int:
    """A lower bound: what the longer has more than both have of each element."""
    x, y = Counter(a), Counter(b)
    return max(len(a), len(b)) - sum(min(n, y[w]) for w, n in x.items() if w in y)


def some_edits(a: Sequence, b: Sequence, reach: int = 4) -> int:
    """An upper bound: the edits of one alignment, which goes on at the nearest equal elements, of two in a row if there are."""
    n, m, i, j, cost = len(a), len(b), 0, 0, 0
    ways = [(p, q, max(p, q)) for k in range(1, reach + 1) for p, q in [(k, k), *[x for r in range(k) for x in ((r, k), (k, r))]]]
    a, b = [*a, *[None] * (reach + 1)], [*b, *[""] * (reach + 1)]
    while i < n and j < m:
        if a[i] == b[j]:
            i += 1
            j += 1
            continue
        way = None
        for p, q, k in ways:
            if a[i + p] == b[j + q]:
                if i + p + 1 >= n or a[i + p + 1] == b[j + q + 1]:
                    way = p, q, k
                    break
                way = way or (p, q, k)
        p, q, k = way or (1, 1, 1)
        i += p
        j += q
        cost += k
    return cost + max(n - i, m - j)


def columns(pattern: Sequence, text: Sequence, up: int, down: int) -> tuple[int, int]:
    """Differences down a column of Levenshtein's table, as bits of whole numbers (Myers, Hyyrö): from the column before ``text`` to the one after it, along its top one more a step."""
    places: dict = {}
    bit = 1
    for x in pattern:
        places[x] = places.get(x, 0) | bit
        bit <<= 1
    whole = bit - 1
    for x in text:
        eq = places.get(x, 0) | down
        diagonal = ((((eq & up) + up) ^ up) | eq) & whole
        right = (down | (whole ^ (up | diagonal))) << 1 | 1
        left = (up & diagonal) << 1
        up, down = (left | (whole ^ ((diagonal | right) & whole))) & whole, diagonal & right
    return up, down


def in_corridor(a: Sequence, b: Sequence, most: int) -> int:
    """Levenshtein distance of a and b, b no shorter, where it is ``most`` at most.

    Only elements that both have can be matched.  Of n of them in a's start and k in b's
    start, a way that passes there leaves |n - k| without a match (less what one side has
    more of them in all), so that only places where that fits into ``most`` are looked at.
    """
    in_a, in_b = set(a), set(b)
    known, shared = [0, *accumulate(x in in_b for x in a)], [0, *accumulate(x in in_a for x in b)]
    spare = known[-1] - shared[-1]
    slack = most - len(b) + min(known[-1], shared[-1])
    block = max(256, 2 * slack)
    first, last, corner, up, down = 0, 0, 0, 0, 0
    for i in range(0, len(a), block):
        part = a[i : i + block]
        start = bisect_left(shared, known[i] - max(0, spare) - slack)
        end = bisect_right(shared, known[i + len(part)] + max(0, -spare) + slack) - 1
        gone = (1 << (start - first)) - 1
        corner += (up & gone).bit_count() - (down & gone).bit_count()
        up, down = up >> (start - first) | ((1 << (end - last)) - 1) << (last - start), down >> (start - first)
        first, last = start, end
        up, down = columns(b[first:last], part, up, down)
        corner += len(part)
    return corner + up.bit_count() - down.bit_count()


def distance(a: Sequence, b: Sequence) -> int:
    """Levenshtein distance of two texts or token lists.

    Exact: a bound from below that meets one from above is the distance; where they don't
    meet, the table is filled as far as the one from above lets through.
    """
    if a == b:
        return 0
    start = common_start(a, b)
    a, b = a[start:][::-1], b[start:][::-1]
    end = common_start(a, b)
    a, b = sorted((a[end:], b[end:]), key=len)
    if not a or is_within(a, b):
        return len(b) - len(a)
    if len(a) <= 64:
        return in_corridor(a, b, len(b))
    least = least_edits(a, b)
    if least == len(b):
        return least
    most = min(some_edits(a, b), len(b))
    return least if least == most else in_corridor(a, b, most)


def tokens(text: str) -> list[str]:
    """White-space tokens, as ``words`` has them: U+001C to U+001F are no white space, other than for Python."""
    if any(c in text for c in "\x1c\x1d\x1e\x1f"):
        return re.findall(r"(?:[\x1c-\x1f]|\S)+", text)
    return text.split()


def characters(text: str) -> str:
    """The text without white space."""
    return "".join(tokens(text))


def rate(reference: str | None, hypothesis: str | None, split: Callable[[str], Sequence]) -> float | None:
    if reference is None or hypothesis is None:
        return None
    said = split(reference)
    return distance(said, split(hypothesis)) / len(said) if said else math.nan


def rates(df: DataFrame, *keep: str, **wanted: tuple[Callable[[str], Sequence], str, str]) -> DataFrame:
    """df's columns ``keep`` and a rate for each of ``wanted``: name=(tokens or characters, column of references, column of hypotheses); NaN for an empty reference."""
    texts = list(dict.fromkeys(c for _, *pair in wanted.values() for c in pair))
    kept = df.select(*keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [pa.array([rate(r.as_py(), h.as_py(), split) for r, h in zip(batch.column(f"_{r}"), batch.column(f"_{h}"))], pa.float64()) for split, r, h in wanted.values()]
            yield pa.RecordBatch.from_arrays([*map(batch.column, range(len(keep))), *made], [*keep, *wanted])

    schema = StructType([*kept.schema.fields, *[StructField(name, DoubleType()) for name in wanted]])
    return df.select(*keep, *[F.col(c).alias(f"_{c}") for c in texts]).mapInArrow(run, schema)


def _column(split: Callable[[str], Sequence], reference: Column | str, hypothesis: Column | str) -> Column:
    @F.arrow_udf("double")
    def run(references: pa.Array, hypotheses: pa.Array) -> pa.Array:
        return pa.array([rate(r.as_py(), h.as_py(), split) for r, h in zip(references, hypotheses)], pa.float64())

    return run(col(reference), col(hypothesis))


def wer(reference: Column | str, hypothesis: Column | str) -> Column:
    """Word edits by reference words, of columns of a table; for what is computed with lambdas, which Spark does not always hand to an Arrow function, see ``rates``."""
    return _column(tokens, reference, hypothesis)


def cer(reference: Column | str, hypothesis: Column | str) -> Column:
    """Character edits by reference characters, white space left out; see ``wer``."""
    return _column(characters, reference, hypothesis)


def mean_skipping(rate: Column | str) -> Column:
    """Mean over the defined rates."""
    return F.avg(F.when(~F.isnan(col(rate)), col(rate)))


def mean_counting(rate: Column | str) -> Column:
    """Undefined rates add nothing but count."""
    return F.sum(F.when(F.isnan(col(rate)) | col(rate).isNull(), 0.0).otherwise(col(rate))) / F.count(F.lit(1))


def latency(ns: Column | str, *quantiles: float) -> list[Column]:
    """Exact interpolated percentiles."""
    return [F.percentile(col(ns), F.lit(q)) for q in (quantiles or (0.5, 0.95))]


def real_time_factor(processing: Column | str, audio: Column | str) -> Column:
    return F.sum(col(processing)) / F.nullif(F.sum(col(audio)), F.lit(0.0))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of half-open spans; 0 where both are empty."""
    inter = F.greatest(F.least(a["end"], b["end"]) - F.greatest(a["start"], b["start"]), F.lit(0))
    union = (a["end"] - a["start"]) + (b["end"] - b["start"]) - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def _places(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end")))


def counts(tp: Column, n_predicted: Column, n_gold: Column) -> Column:
    return F.struct(tp.cast("bigint").alias("tp"), (n_predicted - tp).cast("bigint").alias("fp"), (n_gold - tp).cast("bigint").alias("fn"))


def strict_match(predicted: Column, gold: Column) -> Column:
    """tp, fp, fn of spans that agree in both ends, as sets."""
    p, g = F.array_distinct(_places(predicted)), F.array_distinct(_places(gold))
    return counts(F.size(F.array_intersect(p, g)), F.size(p), F.size(g))


def one_to_one(starts: np.ndarray, ends: np.ndarray, gold_starts: np.ndarray, gold_ends: np.ndarray, threshold: float) -> int:
    """Matches of ``iou_match`` for a row.  A span that shares enough with another starts less than its own length by the threshold before the other's end, so only those are looked at."""
    order = np.argsort(gold_starts, kind="stable")
    places, firsts, lasts = order.tolist(), gold_starts[order].tolist(), gold_ends[order].tolist()
    if threshold > 0:
        low = np.searchsorted(firsts, ends - np.maximum(ends - starts, 1) / threshold, "left").tolist()
        high = np.searchsorted(firsts, ends, "left").tolist()
    else:
        low, high = [0] * len(starts), [len(places)] * len(starts)
    free, found = [True] * len(places), 0
    for p, (a, b) in enumerate(zip(starts.tolist(), ends.tolist())):
        best = None
        for g in range(low[p], high[p]):
            if free[g]:
                inter = max(min(b, lasts[g]) - max(a, firsts[g]), 0)
                union = (b - a) + (lasts[g] - firsts[g]) - inter
                share = inter / union if union > 0 else 0.0
                if share >= threshold and (best is None or (share, -places[g]) > best[0]):
                    best = (share, -places[g]), g
        if best:
            free[best[1]] = False
            found += 1
    return found


COUNTS = pa.struct([("tp", pa.int64()), ("fp", pa.int64()), ("fn", pa.int64())])


def _matched(predicted: pa.Array, gold: pa.Array, threshold: float) -> pa.Array:
    ends_of = lambda x: [np.asarray(x.field(f).cast(pa.int64())) for f in ("start", "end")]
    out = []
    for p, g in zip(predicted, gold):
        if not p.is_valid or not g.is_valid:
            out.append(None)
            continue
        tp = one_to_one(*ends_of(p.values), *ends_of(g.values), threshold)
        out.append({"tp": tp, "fp": len(p) - tp, "fn": len(g) - tp})
    return pa.array(out, COUNTS)


def iou_match(predicted: Column, gold: Column, threshold: float = 0.5) -> Column:
    """Greedy one to one in the order of predictions: the best gold span still free, the first of equals.  Of columns of a table, as with ``wer``; for others see ``iou_matches``."""

    @F.arrow_udf("struct<tp:bigint,fp:bigint,fn:bigint>")
    def run(p: pa.Array, g: pa.Array) -> pa.Array:
        return _matched(p, g, threshold)

    return run(_places(predicted), _places(gold))


def iou_matches(df: DataFrame, *keep: str, predicted: str, gold: str, threshold: float = 0.5) -> DataFrame:
    """df's columns ``keep`` and, as m, the counts of ``iou_match``."""
    kept = df.select(*keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*map(batch.column, range(len(keep))), _matched(batch.column("_p"), batch.column("_g"), threshold)], [*keep, "m"])

    schema = StructType([*kept.schema.fields, StructField("m", StructType([StructField(c, LongType()) for c in ("tp", "fp", "fn")]))])
    return df.select(*keep, _places(F.col(predicted)).alias("_p"), _places(F.col(gold)).alias("_g")).mapInArrow(run, schema)


def pair_match(predicted: Column, gold: Column) -> Column:
    """Matches of multisets: each distinct element as often as both have it."""
    n = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    tp = F.aggregate(F.array_distinct(predicted), F.lit(0), lambda s, x: s + F.least(n(predicted, x), n(gold, x)))
    return counts(tp, F.size(predicted), F.size(gold))


def f1(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    """Precision, recall, F1; NaN where undefined."""
    nan = F.lit(float("nan"))
    precision = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(nan)
    recall = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(nan)
    both = F.when(F.isnan(precision) | F.isnan(recall) | (precision + recall == 0), F.when(F.isnan(precision) | F.isnan(recall), nan).otherwise(0.0)).otherwise(2 * precision * recall / (precision + recall))
    return precision, recall, both


def micro(df: DataFrame, match: str, *keys: str) -> DataFrame:
    """Sums of tp, fp, fn over rows, with precision, recall and F1."""
    summed = df.groupBy(*keys).agg(*[F.sum(F.col(match)[c]).alias(c) for c in ("tp", "fp", "fn")])
    p, r, f = f1(F.col("tp"), F.col("fp"), F.col("fn"))
    return summed.select(*keys, "tp", "fp", "fn", p.alias("precision"), r.alias("recall"), f.alias("f1"))


def confusion(fired: Column, expected: Column) -> list[Column]:
    """Utterance-level counts."""
    cells = {"tp": fired & expected, "fp": fired & ~expected, "fn": ~fired & expected, "tn": ~fired & ~expected}
    return [F.count_if(c).alias(n) for n, c in cells.items()]
