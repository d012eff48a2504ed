"""Greedy and beam decoding over rows of scores, as folds inside the JVM.

A hypothesis is struct<tokens array<int>, score double>.  ``beam_step`` is one step for
a model that scores each hypothesis by itself: it returns the next hypotheses with the
place of the one that each comes from, by which a model's caches are put in order.
``beam_search`` folds it over rows that do not depend on the hypothesis.

Rules: the gates (repetition penalty over a hypothesis's own tokens, least length,
margin of the end) come before the log-softmax; each hypothesis offers its ``width``
best tokens, equals by index; all offers are taken by falling score, equals by the
hypothesis and then as offered, until ``width`` hypotheses go on or ``width`` have
ended.  The end token closes a hypothesis without its own score; at the first step it is
a token like any other.  The best of ended and open ones by score / length ** alpha wins,
equals as they ended, then as they stand.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from parlance.functions.decoding import argmax_first, length_normalised, log_softmax, margin_gate, minimum_length_gate, repetition_penalty, top_k
from parlance.functions.text import let

HYPOTHESES = "array<struct<tokens:array<int>,score:double>>"
ENDED = "array<struct<tokens:array<int>,score:double,length:int>>"


@dataclass(frozen=True)
class Options:
    """width: of the beam; end: the token that closes; most: tokens at most; ratio, margin: of the gates (0: none); penalty: of repetition (1: none); alpha: of the length."""

    end: int
    width: int = 4
    most: int = 256
    ratio: float = 0.0
    margin: float = 0.0
    penalty: float = 1.0
    alpha: float = 0.6


def gated(scores: Column, history: Column, frames: Column, options: Options) -> Column:
    """Scores after repetition penalty, least length and margin of the end."""
    if options.penalty != 1:
        scores = repetition_penalty(scores, history, options.penalty)
    if options.ratio > 0:
        scores = minimum_length_gate(scores, options.end, F.size(history), frames, options.ratio)
    return margin_gate(scores, options.end, options.margin) if options.margin > 0 else scores


def _hypothesis(tokens: Column, score: Column) -> Column:
    return F.struct(tokens.cast("array<int>").alias("tokens"), score.cast("double").alias("score"))


def beam_step(active: Column, ended: Column, rows: Column, frames: Column, options: Options) -> Column:
    """struct<active, parents array<int>, ended> after one step; rows: the scores of each active hypothesis."""
    numbered = F.transform(active, lambda h, i: F.struct(h["tokens"].alias("tokens"), h["score"].alias("score"), i.alias("i")))

    def offers(h: Column, row: Column) -> Column:
        best = top_k(log_softmax(gated(row, h["tokens"], frames, options)), options.width)
        return F.transform(best, lambda t, rank: F.struct((-(h["score"] + t["value"])).alias("n"), h["i"].alias("parent"), rank.alias("rank"), t["index"].cast("int").alias("token"), h["tokens"].alias("tokens"), h["score"].alias("score")))

    def take(s: Column, c: Column) -> Column:
        closed = F.concat(s["ended"], F.array(F.struct(c["tokens"].alias("tokens"), c["score"].alias("score"), F.size(c["tokens"]).alias("length"))))
        going = F.concat(s["active"], F.array(_hypothesis(F.concat(c["tokens"], F.array(c["token"])), -c["n"])))
        made = lambda a, p, e: F.struct(a.alias("active"), p.alias("parents"), e.alias("ended"))
        full = (F.size(s["active"]) >= options.width) | (F.size(s["ended"]) >= options.width)
        onward = made(going, F.concat(s["parents"], F.array(c["parent"])), s["ended"])
        return F.when(full, s).when(c["token"] == options.end, made(s["active"], s["parents"], closed)).otherwise(onward)

    start = F.struct(F.array().cast(HYPOTHESES).alias("active"), F.array().cast("array<int>").alias("parents"), ended.cast(ENDED).alias("ended"))
    return F.aggregate(F.array_sort(F.flatten(F.zip_with(numbered, rows, offers))), start, take)


def beam_search(rows: Column, frames: Column, options: Options) -> Column:
    """struct<tokens, score, length, parents>: the best hypothesis over rows of scores (one a step), and the parents of each step's hypotheses; null without rows.

    frames: encoder frames, for the least length.
    """
    if options.width < 1 or options.most < 1:
        raise ValueError("a beam has a width and a length of at least one")

    def first(row: Column) -> Column:
        best = top_k(log_softmax(gated(row, F.array().cast("array<int>"), frames, options)), options.width)
        return F.transform(best, lambda t: _hypothesis(F.array(t["index"]), t["value"]))

    def state(active: Column, ended: Column, parents: Column, going: Column) -> Column:
        return F.struct(active.cast(HYPOTHESES).alias("active"), ended.cast(ENDED).alias("ended"), parents.cast("array<array<int>>").alias("parents"), going.alias("going"))

    def merge(s: Column, row: Column) -> Column:
        def after(made: Column) -> Column:
            none = F.size(made["active"]) == 0
            going = ~none & (F.size(made["ended"]) < options.width)
            return state(F.when(none, s["active"]).otherwise(made["active"]), made["ended"], F.concat(s["parents"], F.array(made["parents"])), going)

        step = beam_step(s["active"], s["ended"], F.transform(s["active"], lambda _: row), frames, options)
        return F.when(s["going"] & (F.size(s["active"][0]["tokens"]) < options.most), let(step, after)).otherwise(s)

    def finish(s: Column) -> Column:
        open_ones = F.transform(s["active"], lambda h: F.struct(h["tokens"].alias("tokens"), h["score"].alias("score"), F.size(h["tokens"]).alias("length")))
        ranked = F.transform(F.concat(s["ended"], open_ones), lambda h, i: F.struct((-length_normalised(h["score"], h["length"], options.alpha)).alias("n"), i.alias("i"), h["tokens"].alias("tokens"), h["length"].alias("length")))
        return let(F.array_min(ranked), lambda b: F.struct(b["tokens"].alias("tokens"), (-b["n"]).alias("score"), b["length"].alias("length"), s["parents"].alias("parents")))

    start = state(first(F.get(rows, F.lit(0))), F.array(), F.array(), F.lit(True))
    return F.when(F.size(rows) > 0, let(start, lambda s: F.aggregate(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), s, merge, finish)))


def greedy(rows: Column, frames: Column, options: Options) -> Column:
    """struct<tokens, scores>: the best token of each row until the end, and its log-probability after the gates."""

    def merge(s: Column, row: Column) -> Column:
        def chosen(scores: Column) -> Column:
            best = argmax_first(scores)
            longer = F.struct(F.concat(s["tokens"], F.array(best)).alias("tokens"), F.concat(s["scores"], F.array(F.get(log_softmax(scores), best))).alias("scores"), F.lit(True).alias("going"))
            return F.when(best == options.end, F.struct(s["tokens"].alias("tokens"), s["scores"].alias("scores"), F.lit(False).alias("going"))).otherwise(longer)

        return F.when(s["going"] & (F.size(s["tokens"]) < options.most), let(gated(row, s["tokens"], frames, options), chosen)).otherwise(s)

    start = F.struct(F.array().cast("array<int>").alias("tokens"), F.array().cast("array<double>").alias("scores"), F.lit(True).alias("going"))
    return F.aggregate(rows, start, merge, lambda s: F.struct(s["tokens"].alias("tokens"), s["scores"].alias("scores")))
