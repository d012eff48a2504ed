"""Labels of a token classifier as punctuation and capitals; the head of a manifest."""

from pyspark.sql import functions as F

from parlance.operators import labels
from parlance.sources import readers


def hot(*names):
    return [[1.0 if label == name else 0.0 for label in labels.LABELS] for name in names]


def run(spark, text, word_ids, scores):
    df = spark.createDataFrame([(text, word_ids, scores)], "t string, w array<int>, s array<array<double>>")
    r = df.select(labels.labelled("t", F.col("w"), F.col("s")).alias("r")).first().r
    return r and (r.text, [tuple(c) for c in r.corrections])


def test_first_token_of_each_word_counts(spark):
    got = run(spark, " hello  world ", [None, 0, 0, 1, None], hot("OO", "OU", "!O", ".O", "OU"))
    assert got == ("Hello world.", [("Capitalized", "h", "H"), ("PunctuationInserted", "", ".")])


def test_ties_go_to_the_last_and_short_labels_say_nothing(spark):
    flat = [[0.0] * len(labels.LABELS)]
    assert run(spark, "a", [0], flat) == ("a-", [("PunctuationInserted", "", "-")])
    df = spark.createDataFrame([("O",), ("",), ("?U",)], "l string")
    assert [tuple(r.p) for r in df.select(labels.parse_label(F.col("l")).alias("p")).collect()] == [(None, False), (None, False), ("?", True)]


def test_words_without_tokens_and_labels_out_of_range(spark):
    assert run(spark, "one two three", [0, 2], hot("OU", ",U")) == ("One two Three,", [("Capitalized", "o", "O"), ("Capitalized", "t", "T"), ("PunctuationInserted", "", ",")])
    assert run(spark, "one", [0], [[0.0] * 15 + [9.0]]) == ("one", [])
    assert run(spark, "one two", [0, 1], hot("OU")) == ("One two", [("Capitalized", "o", "O")])
    assert run(spark, "1st É", [0, 1], hot("OU", "OU")) == ("1st É", [])
    assert run(spark, "", [], []) == ("", [])
    assert run(spark, None, [], []) is None


def test_manifest_head(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("id\taudio_path\treference\n" + "".join(f"u{i}\ta{i}.wav\tr\n" for i in range(9)))
    assert [r.id for r in readers.manifest(spark, str(tmp_path / "m.tsv"), 3).collect()] == ["u0", "u1", "u2"]
    assert readers.manifest(spark, str(tmp_path / "m.tsv")).count() == 9
