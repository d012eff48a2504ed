"""Filler removal by the likeness of words' vectors to a lexicon's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions.lexicon import ENGLISH, FillerLexicon
from parlance.functions.text import clean, let, strings, words
from parlance.functions.vectors import dot
from parlance.operators.fillers import _boundaries, _marked_tokens

THRESHOLD = 0.82


def filler_words(spoken: DataFrame, vectors: DataFrame, matrix: DataFrame | None = None, lexicon: FillerLexicon = ENGLISH, threshold: float = THRESHOLD) -> DataFrame:
    """The distinct words of ``spoken`` (word) that are members of the lexicon and whose vector is near one of its words'.

    vectors: (word, vector), of length 1, of words as they are spoken; a word without one
    is near none.  matrix: the same of the lexicon's words, by default taken from vectors.
    Words meet the matrix by name, a row for each word and lexicon word; the lexicon is a
    fixed short list.
    """
    known = vectors.groupBy("word").agg(F.first("vector").alias("vector"))
    members = spoken.where(clean(F.col("word")).isin(*lexicon.pure)).select("word").distinct().join(known, "word")
    rows = (known if matrix is None else matrix).select(F.col("word").alias("_name"), F.col("vector").alias("_lexicon")).where(F.col("_name").isin(*lexicon.pure))
    pairs = members.withColumn("_name", F.explode(strings(lexicon.pure))).join(rows, "_name")
    return pairs.groupBy("word").agg(F.max(dot(F.col("vector"), F.col("_lexicon"))).alias("similarity")).where(F.col("similarity") >= threshold)


def _cleaned(tokens: Column, near: Column, lexicon: FillerLexicon) -> Column:
    """struct<text, removed>: the near words, then contextual ones at the starts of sentences and clauses."""

    def symbol(w: Column) -> Column:
        ends = w.rlike(r"[.!?,]$")
        contextual = clean(w).isin(*lexicon.contextual) if lexicon.contextual else F.lit(False)
        return F.when(F.array_contains(near, w), "p").when(contextual, F.when(ends, "C").otherwise("c")).otherwise(F.when(ends, "K").otherwise("k"))

    def result(m: Column) -> Column:
        of = lambda s: F.transform(F.filter(m, lambda x: x["m"] == s), lambda x: x["t"])
        kept = F.transform(F.filter(m, lambda x: ~x["m"].isin("p", "x")), lambda x: x["t"])
        return F.struct(F.array_join(kept, " ").alias("text"), F.concat(of("p"), of("x")).alias("removed"))

    return let(_marked_tokens(tokens, _boundaries(F.array_join(F.transform(tokens, symbol), ""))), result)


def by_vectors(utterances: DataFrame, vectors: DataFrame, matrix: DataFrame | None = None, lexicon: FillerLexicon = ENGLISH, threshold: float = THRESHOLD) -> DataFrame:
    """utt_id, text, removed of (utt_id, text): members near the lexicon, then contextual fillers; no pairs.

    Whether a word goes depends on its spelling alone, so an utterance sends its distinct
    members and gets back those that go; other words and texts take no part in the joins.
    A null text gives null; utt_ids are unique.
    """
    split = utterances.select("utt_id", words(F.col("text")).alias("_w"))
    spelt = split.select("utt_id", F.explode(F.array_distinct(F.filter("_w", lambda w: clean(w).isin(*lexicon.pure)))).alias("word"))
    near = spelt.join(filler_words(spelt, vectors, matrix, lexicon, threshold).select("word"), "word").groupBy("utt_id").agg(F.collect_set("word").alias("_near"))
    both = split.join(near, "utt_id", "left")
    found = F.when(F.col("_w").isNotNull(), _cleaned(F.col("_w"), F.coalesce("_near", F.array().cast("array<string>")), lexicon))
    return both.select("utt_id", found.alias("_r")).select("utt_id", F.col("_r.text").alias("text"), F.col("_r.removed").alias("removed"))
