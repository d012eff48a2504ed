"""Edit distances against the plain recurrence, and rates of long texts."""

import random

import pytest
from pyspark.sql import functions as F

from parlance.functions import numerals
from parlance.operators import scoring


def plain(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("kinds", [2, 4, 50])
def test_distance_is_levenshtein(kinds):
    rng = random.Random(kinds)
    for n in range(600):
        a = [rng.randrange(kinds) for _ in range(rng.randrange(rng.choice([5, 40, 130])))]
        near = [x for w in a for x in rng.choice([[w]] * 8 + [[w, 99], [77], []])]
        b = near if n % 2 else [rng.randrange(kinds) for _ in range(rng.randrange(130))]
        want = plain(a, b)
        assert scoring.distance(a, b) == want, (a, b)
        assert scoring.distance("".join(chr(97 + x) for x in a), "".join(chr(97 + x) for x in b)) == want
        short, long = sorted((a, b), key=len)
        if short:
            assert scoring.least_edits(a, b) <= want <= scoring.some_edits(a, b)
            assert scoring.in_corridor(short, long, want) == want


def test_blocks_of_the_corridor():
    """Over several blocks, with marks hung on words and words put in, out and about."""
    rng = random.Random(7)
    a = [rng.randrange(60) for _ in range(900)]
    b = [x for i, w in enumerate(a) for x in ([w, 61] if i % 7 == 0 else [] if i % 31 == 3 else [w + 1] if i % 23 == 5 else [w])]
    assert scoring.distance(a, b) == scoring.distance(b, a) == plain(a, b)


def test_rates_of_long_texts(spark):
    """More distinct words than a plane of Unicode has code points, and a text of 300,000 characters."""
    words = [f"w{i}" for i in range(70_000)]
    worse = [x for i, w in enumerate(words) for x in ([w + "."] if i % 20 == 0 else [w, "um"] if i % 10 == 5 else [w])]
    text = "abcdefghij " * 27_000
    rows = [(1, " ".join(words), " ".join(worse)), (2, text, text.replace("j a", "j um a")), (3, "a\x1cb c", "a\x1cb d"), (4, None, "a"), (5, " ", "a")]
    df = spark.createDataFrame(rows, "i int, r string, h string")
    got = {r["i"]: r for r in scoring.rates(df, "i", w=(scoring.tokens, "r", "h"), c=(scoring.characters, "r", "h")).collect() if r["i"] != 1}
    got[1] = scoring.rates(df.where("i = 1"), "i", w=(scoring.tokens, "r", "h")).first()
    assert got[1]["w"] == 0.15
    assert got[2]["c"] == pytest.approx(2 * 26_999 / 270_000)
    assert got[3]["w"] == 0.5
    assert got[4]["w"] is None and got[5]["w"] != got[5]["w"]


def test_rates_of_what_lambdas_make(spark):
    df = spark.createDataFrame([("이천 십 일 년, Twenty-One", "2011 년 x")], "r string, h string")
    made = df.select(F.lit(1).alias("i"), numerals.lenient("r").alias("r"), numerals.lenient("h").alias("h"))
    assert scoring.rates(made, "i", w=(scoring.tokens, "r", "h")).first()["w"] == 0.5


def greedy(predicted, gold, threshold):
    """As the definition says: each prediction takes the best gold span still free, the first of equals."""
    free, found = set(range(len(gold))), 0
    for a, b in predicted:
        best = None
        for g in sorted(free):
            inter = max(min(b, gold[g][1]) - max(a, gold[g][0]), 0)
            union = (b - a) + (gold[g][1] - gold[g][0]) - inter
            share = inter / union if union > 0 else 0.0
            if share >= threshold and (best is None or share > best[0]):
                best = share, g
        if best:
            free.remove(best[1])
            found += 1
    return found


@pytest.mark.parametrize("threshold", [0.0, 0.3, 0.5, 1.0])
def test_iou_matches_of_any_spans(spark, threshold):
    """Crossing, equal, empty, in any order; and 30,000 of them in one row."""
    rng = random.Random(3)
    spans = lambda n: [(a, a + rng.randrange(9)) for a in (rng.randrange(30) for _ in range(n))]
    rows = [(i, spans(rng.randrange(12)), spans(rng.randrange(12))) for i in range(60)]
    if threshold:
        rows.append((60, [(5 * i, 5 * i + 4) for i in range(30_000)], [(5 * i, 5 * i + 3) for i in range(30_000)]))
    span = "array<struct<start:int,end:int>>"
    df = spark.createDataFrame(rows, f"i int, p {span}, g {span}")
    got = {r["i"]: tuple(r["m"]) for r in scoring.iou_matches(df, "i", predicted="p", gold="g", threshold=threshold).collect()}
    for i, p, g in rows[:60]:
        tp = greedy(p, g, threshold)
        assert got[i] == (tp, len(p) - tp, len(g) - tp), (p, g)
    if threshold:
        assert got[60][0] == (30_000 if threshold < 0.76 else 0)
