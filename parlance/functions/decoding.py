"""Scoring and selection steps of sequence decoders, over arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parlance.functions.text import let


def argmax_first(row: Column) -> Column:
    return (F.array_position(row, F.array_max(row)) - 1).cast("int")


def argmax_last(row: Column) -> Column:
    return (F.size(row) - F.array_position(F.reverse(row), F.array_max(row))).cast("int")


def ctc_collapse(ids: Column, blank: int = 0) -> Column:
    """Repetitions first, then blanks."""
    return F.filter(F.filter(ids, lambda x, i: (i == 0) | (x != F.get(ids, i - 1))), lambda x: x != blank)


def repetition_penalty(scores: Column, history: Column, penalty: float = 2.0) -> Column:
    """Scores of ids in the history: negative ones times the penalty, others divided by it, once each."""
    return F.transform(scores, lambda s, i: F.when(F.array_contains(history, i), F.when(s < 0, s * penalty).otherwise(s / penalty)).otherwise(s))


def log_softmax(scores: Column) -> Column:
    top = F.array_max(scores)
    return let(top + F.ln(F.aggregate(scores, F.lit(0.0), lambda s, x: s + F.exp(x.cast("double") - top))), lambda z: F.transform(scores, lambda x: x.cast("double") - z))


def length_normalised(score: Column, length: Column, alpha: float = 0.6) -> Column:
    return score / F.pow(F.greatest(length, F.lit(1)), F.lit(alpha))


def top_k(scores: Column, k: int) -> Column:
    """(value, index) by falling value, equals by index."""
    rows = F.transform(scores, lambda s, i: F.struct((-s).alias("n"), i.alias("index"), s.alias("value")))
    return F.transform(F.slice(F.array_sort(rows), 1, k), lambda r: F.struct(r["value"].alias("value"), r["index"].alias("index")))


def _forbid(scores: Column, at: int, when: Column) -> Column:
    return F.transform(scores, lambda s, i: F.when((i == at) & when, float("-inf")).otherwise(s.cast("double")))


def minimum_length_gate(scores: Column, end: int, emitted: Column, frames: Column, ratio: float = 0.2) -> Column:
    """No end before ratio * frames tokens, rounded up."""
    return _forbid(scores, end, emitted < F.ceil(frames * ratio))


def margin_gate(scores: Column, end: int, margin: float = 2.0) -> Column:
    """The end must lead the best other score by the margin; kept if no other is finite."""
    rivals = F.filter(F.transform(scores, lambda s, i: F.when(i != end, s.cast("double"))), lambda s: s.isNotNull() & (s > float("-inf")) & (s < float("inf")))
    best = F.array_max(rivals)
    return _forbid(scores, end, F.coalesce(F.get(scores, F.lit(end)).cast("double") < best + margin, F.lit(False)))


def strip_prefix(ids: Column, prefix: Column, special_from: int) -> Column:
    """Without the prompt and without ids from ``special_from`` on."""
    return F.filter(F.slice(ids, F.size(prefix) + 1, F.size(ids)), lambda x: x < special_from)


def valid_frames(mask: Column) -> Column:
    return F.size(F.filter(mask, lambda x: x != 0))


def pieces_of(ids: Column, vocabulary: Column) -> Column:
    """Pieces by place; ids out of range are dropped."""
    return F.filter(F.transform(ids, lambda i: F.get(vocabulary, i.cast("int"))), lambda p: p.isNotNull())


def join_sentence_pieces(pieces: Column) -> Column:
    """Word starts (▁) as blanks, specials in angle brackets dropped."""
    return F.trim(F.replace(F.array_join(F.filter(pieces, lambda p: ~p.rlike(r"^<[^>]*>$")), ""), F.lit("▁"), F.lit(" ")))


def join_bpe(pieces: Column) -> Column:
    """Pieces that end in @@ go on in the next; CJK pieces stand without blanks between them."""
    text = F.regexp_replace(F.array_join(F.filter(pieces, lambda p: ~p.rlike(r"^<[^>]*>$")), " "), "@@( |$)", "")
    cjk = r"[぀-ヿ㐀-䶿一-鿿]"
    return F.regexp_replace(text, f"(?<={cjk}) (?={cjk})", "")
