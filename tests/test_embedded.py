"""The embedding filter: likeness and membership, then the contextual pass."""

from pyspark.sql import functions as F

from parlance.operators import embedded

UNIT = {"um": (1.0, 0.0), "uh": (0.0, 1.0)}


def run(spark, texts, spoken, **options):
    docs = spark.createDataFrame(list(enumerate(texts)), "utt_id long, text string").withColumn("vector", F.lit("clash"))
    vectors = spark.createDataFrame([(w, list(v)) for w, v in {**UNIT, **spoken}.items()], "word string, vector array<double>")
    matrix = vectors.where(F.col("word").isin(*UNIT))
    return [(r.text, r.removed) for r in embedded.by_vectors(docs, vectors, matrix, **options).orderBy("utt_id").collect()]


def test_members_near_the_lexicon_go_and_others_stay(spark):
    spoken = {"Um,": (0.9, 0.4359), "uh!": (0.7071, 0.7071), "umbrella": (1.0, 0.0), "hmm": (0.0, -1.0)}
    got = run(spark, ["Um, the umbrella", "uh! um hmm er", "", None, "um uh"], spoken)
    assert got == [("the umbrella", ["Um,"]), ("uh! hmm er", ["um"]), ("", []), (None, None), ("", ["um", "uh"])]


def test_threshold_counts_and_repeated_words_too(spark):
    spoken = {"ah": (0.82, 0.5724)}
    assert run(spark, ["ah ah no"], spoken)[0] == ("no", ["ah", "ah"])
    assert run(spark, ["ah ah no"], spoken, threshold=0.83)[0] == ("ah ah no", [])


def test_contextual_words_at_the_start_of_what_is_left(spark):
    got = run(spark, ["um so well we go", "we so go. well, actually yes", "you know um right"], {})
    assert got == [("we go", ["um", "so", "well"]), ("we so go. yes", ["well,", "actually"]), ("you know right", ["um"])]


def test_a_matrix_of_its_own(spark):
    docs = spark.createDataFrame([(1, "um uh")], "utt_id long, text string")
    spoken = spark.createDataFrame([("um", [0.0, 1.0]), ("uh", [1.0, 0.0]), ("uh", [1.0, 0.0])], "word string, vector array<double>")
    matrix = spark.createDataFrame([("er", [1.0, 0.0])], "word string, vector array<double>")
    assert embedded.by_vectors(docs, spoken, matrix).first().text == "um"
    # without one, the lexicon's words stand for themselves
    assert embedded.by_vectors(docs, spoken).first().text == ""
    assert embedded.by_vectors(docs, spoken.limit(0)).first().text == "um uh"
