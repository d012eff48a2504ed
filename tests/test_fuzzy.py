"""The segment join against brute force, and how few pairs it compares."""

import random

import pytest
from pyspark.sql import functions as F

from parlance.operators import fuzzy
from parlance.queries.numeric import distinct_words


def edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def expected(sounds, entries, threshold):
    out = {}
    for s in sounds:
        found = [(-(1 - edits(s, e) / max(len(s), len(e)) if s or e else 1.0), e) for e in entries]
        found = [x for x in found if -x[0] >= threshold]
        if found:
            out[s] = (min(found)[1], round(-min(found)[0], 6))
    return out


@pytest.mark.parametrize("threshold", [1.0, 0.7, 0.3])
def test_best_matches_equal_brute_force(spark, threshold):
    rng = random.Random(int(threshold * 100))
    word = lambda most: "".join(rng.choice("abɪʃ") for _ in range(rng.randint(0, most)))
    entries = sorted({word(16) for _ in range(80)})
    sounds = {word(16) for _ in range(40)}
    for e in entries:  # near ones too
        s = list(e)
        for _ in range(rng.randint(0, 4)):
            at = rng.randint(0, len(s))
            s[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "ʃ"])
        sounds.add("".join(s))
    left = spark.createDataFrame([(s,) for s in [*sounds, *sounds, None]], "phonemes string")
    right = spark.createDataFrame([(e, e) for e in entries] + [("unheard", None)], "word string, phonemes string")
    got = {r.phonemes: (r.entry, round(r.similarity, 6)) for r in fuzzy.best_matches(left, right, threshold).collect()}
    assert got == expected(sounds, entries, threshold)


def test_equal_sounds_give_the_first_word_and_thresholds_are_checked(spark):
    left = spark.createDataFrame([("kat",)], "phonemes string")
    right = spark.createDataFrame([("knight", "kat"), ("cat", "kat")], "word string, phonemes string")
    assert [tuple(r) for r in fuzzy.best_matches(left, right).collect()] == [("kat", "cat", 1.0)]
    assert fuzzy.best_matches(left, right.limit(0)).collect() == []
    with pytest.raises(ValueError):
        fuzzy.best_matches(left, right, 0.0)


def test_few_pairs_of_like_length_are_compared(spark):
    sounds = distinct_words(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).withColumnRenamed("w", "phonemes")
    entries = distinct_words(spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")).select(F.col("w").alias("word"), F.col("w").alias("phonemes"))
    compared = fuzzy.candidates(sounds, entries, 0.85).distinct().count()
    n, m = sounds.groupBy(F.length("phonemes").alias("n")).count(), entries.groupBy(F.length("word").alias("m")).agg(F.count("*").alias("k"))
    like = n.join(m, F.col("m").between(F.ceil(F.col("n") * 0.85 - 1e-9), F.floor(F.col("n") / 0.85 + 1e-9))).agg(F.sum(F.col("count") * F.col("k"))).first()[0]
    assert 0 < compared < like / 100
    plan = fuzzy.best_matches(sounds, entries)._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan
