"""Written forms of spoken English numbers."""

import random

from pyspark.sql import functions as F

from parlance.operators import itn
from parlance.queries.spoken import spoken

CASES = {
    "i have twenty five dollars": "i have $25",
    "room three hundred four, please": "room 304, please",
    "one hundred and five people": "105 people",
    "two million three hundred thousand and seven": "2300007",
    "twelve hundred euros.": "€1200.",
    "three point one four": "3.14",
    "zero point five percent!": "0.5%!",
    "two point five million dollars": "$2.5 million",
    "five dollars and twenty cents": "$5.20",
    "ninety nine cents": "$0.99",
    "the twenty first century": "the 21st century",
    "his hundredth game": "his hundredth game",
    "the one hundred and third try and the eleventh": "the 103rd try and the 11th",
    "the two thousandth": "the 2000th",
    "wait a second, first things first": "wait a second, first things first",
    "on march fifth twenty twenty five we met": "on march 5 2025 we met",
    "March the fifth": "March the fifth",
    "the fifth of march two thousand and nine": "5 march 2009",
    "july twenty second nineteen oh five": "july 22 1905",
    "at two thirty pm.": "at 02:30 p.m.",
    "seven a.m. tomorrow": "07:00 a.m. tomorrow",
    "half past seven, quarter to one": "07:30, 12:45",
    "eight o'clock": "08:00",
    "twenty-five and thirty-first": "25 and 31st",
    "one two three": "one two three",
    "five and six": "5 and 6",
    "five. six": "5. 6",
    "hundred thousand": "hundred thousand",
    "  spaced\n\ttwenty  two \n": "  spaced\n\t22 \n",
    "tension often ends": "tension often ends",
    "Forty Two": "42",
    "fifty dollars fifty": "$50 50",
    "at this point five": "at this point 5",
    "": "",
}




def test_all_forms(spark):
    rows = spark.createDataFrame(list(CASES.items()), "said string, want string").select("said", "want", itn.english_written("said").alias("got")).collect()
    wrong = [(r.said, r.got, r.want) for r in rows if r.got != r.want]
    assert not wrong, wrong


def test_null_and_long_texts(spark):
    long = "word " * 50_000 + "twenty two " * 2_000 + "end"
    got = spark.createDataFrame([(None,), (long,)], "t string").select(itn.english_written("t").alias("t")).collect()
    assert got[0].t is None
    assert got[1].t == long  # "twenty two twenty two ..." is one run, and no number
    apart = "sum of twenty two and then " * 2_000
    assert spark.createDataFrame([(apart,)], "t string").select(itn.english_written("t").alias("t")).first().t == apart.replace("twenty two", "22")


def test_every_kind_of_cardinal(spark):
    rng = random.Random(6)
    numbers = [*range(1, 130), *(rng.randrange(1, 10 ** rng.randint(3, 9)) for _ in range(300))]
    df = spark.createDataFrame([(n,) for n in numbers], "n long").select("n", F.expr(f"concat('about ', {spoken('n')}, ' of them')").alias("t"))
    assert all(r.got == f"about {r.n} of them" for r in df.select("n", itn.english_written("t").alias("got")).collect())


def test_no_python_in_the_plan(spark):
    plan = spark.range(3).select(itn.english_written(F.col("id").cast("string")).alias("t"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
    assert "Arrow" not in plan
