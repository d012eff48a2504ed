import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.llm import queries, toxicity
from parlance.llm.language import _flatten

DOCS, LABELS = "doc_id long, text string", "doc_id long, toxic int"
STEMS = [a + b for a in ("ta", "ne", "lo", "shi", "ma", "ru") for b in ("ren", "dal", "vi", "ston", "pe", "kur")]
BAD = ["grobnak", "vlimzor", "skurtag"]


def text(rng: random.Random, n: int, bad: int = 0, forms=("",)) -> str:
    words = [rng.choice(STEMS) + rng.choice(["", "s", "ed", "ing"]) for _ in range(n)]
    for i in rng.sample(range(n), bad):
        words[i] = rng.choice(BAD) + rng.choice(forms)
    return " ".join(words).capitalize() + "."


@pytest.fixture(scope="module")
def scorer():
    rng = random.Random(3)
    return toxicity.Scorer([(int(i % 3 == 0), text(rng, rng.randint(20, 300), 3 if i % 3 == 0 else 0, ("", "s", "ed", "y", "er", "ing"))) for i in range(600)])


def test_held_out_texts(scorer):
    rng = random.Random(8)
    toxic = scorer.scores([text(rng, rng.randint(10, 400), 2) for _ in range(200)])
    clean = scorer.scores([text(rng, rng.randint(1, 3000)) for _ in range(200)])
    assert (toxic >= 0.7).mean() >= 0.99
    assert (clean >= 0.7).mean() <= 0.01


def test_unseen_forms_of_toxic_words_and_unseen_ordinary_words(scorer):
    rng = random.Random(9)
    forms = scorer.scores([text(rng, 120, 2, ("ish", "ful", "ness")) for _ in range(100)])
    assert (forms >= 0.7).mean() >= 0.5  # endings, and letters in them, that no toxic word had
    strange = scorer.scores([text(rng, 80) + " quixote zephyr 12 jazz" for _ in range(100)])
    assert (strange >= 0.7).mean() <= 0.02


def test_both_models_are_distributions_over_the_next_character():
    a, b = Counter({"abc": 4, "abd": 1, "b": 2}), Counter({"abd": 3, "ca": 2, "cb": 1, "d": 5})
    model = toxicity.SharedBackoff(a, b, order=4, shared=2)
    # a word of one or two letters: over all continuations from a shared alphabet the mass stays below one, and close to it
    letters = "abcd"
    words = ["", *letters]
    total = np.zeros(2)
    for depth in range(7):
        flat, first = _flatten([w for w in words if w] or ["a"])
        words = [w for w in words if w]
        total += np.exp(model.log_probability(flat, first)).sum(0)
        words = [w + c for w in words for c in letters] if depth < 4 else []
        if not words:
            break
    assert ((total > 0.7) & (total <= 1.0)).all()


def test_shared_orders_give_both_classes_the_same_value():
    model = toxicity.SharedBackoff(Counter({"abc": 4, "q": 1}), Counter({"xyz": 3, "q": 1}), order=5, shared=2)
    for k in range(2):
        assert (model.value[k][:, 0] == model.value[k][:, 1]).all()
    assert (model.value[3][:, 0] != model.value[3][:, 1]).any()


def test_best_run_equals_a_plain_walk(scorer):
    rng = random.Random(4)
    texts = [text(rng, n) for n in (1, 2, 3, 4, 5, 40)] + ["", None, "12 3"]
    got = scorer.comparer.features(texts)
    for row, t in zip(got, texts, strict=True):
        words = toxicity.LETTERS.findall((t or "").lower())
        flat, first = _flatten(words) if words else (None, None)
        if not words:
            assert (row == 0).all()
            continue
        p = scorer.comparer.model.log_probability(flat, first)
        d, n = p[:, 0] - p[:, 1], np.array([len(w) + 1 for w in words])
        run = min(toxicity.RUN, len(words))
        want = [d.sum() / n.sum(), (d / n).max(), max(d[i : i + run].sum() / n[i : i + run].sum() for i in range(len(words) - run + 1))]
        assert np.allclose(row, want)


def test_query(spark, sf):
    got = {r.doc_id: r for r in queries.op13_toxicity(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect()
    assert sorted(got) == sorted(d.doc_id for d in docs)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    held = {r.doc_id for r in spark.range(len(docs)).withColumnRenamed("id", "doc_id").where(queries.id_remainder(3) == 1).collect()}
    assert {i for i, r in got.items() if r.held_out} == held & set(got)


def test_accuracy_on_held_out_rows(spark):
    big = "/root/testdata/sf0.1"
    found = queries.op13_toxicity(spark, big).where("held_out").join(spark.read.parquet(f"{big}/labels.parquet"), "doc_id").join(spark.read.parquet(f"{big}/documents.parquet").select("doc_id", "lang"), "doc_id")
    rows = found.groupBy("lang", "toxic").agg(F.avg("predicted").alias("rate"), F.count("*").alias("n")).collect()
    rate = {(r.lang, r.toxic): r.rate for r in rows}
    assert rate["en", 1] >= 0.9
    assert all(rate[lang, 0] <= 0.02 for lang in ("en", "de", "fr", "es"))


def test_ids_labels_and_odd_rows(spark):
    rng = random.Random(12)
    docs = [(i, text(rng, 60, 3 * (i % 2))) for i in range(120)]
    labels = [(i, i % 2) for i in range(120)] + [(0, None), (1, 0), (None, 1), (5000, 1)]
    odd = [(None, docs[1][1]), (None, None), (500, ""), (500, ""), (501, docs[1][1]), (502, "1234 !!"), (503, text(rng, 60_000)), (504, "x" * 300_000)]
    df = spark.createDataFrame(docs + odd, DOCS).withColumns({"toxic": F.lit(7), "score": F.lit("clash"), "lang": F.lit(None).cast("string")}).repartition(3)
    marks = spark.createDataFrame(labels, LABELS).withColumn("text", F.lit("clash"))
    model = toxicity.fit(df, marks, F.lit(True), per_class=40)
    got = toxicity.score(df, model).collect()
    assert len(got) == len(docs) + len(odd)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r.score)
    assert by[500][0] == by[500][1] == by[502][0]
    assert by[500][0] < 0.5
    assert by[501] == by[1]
    assert by[1][0] in by[None]
    assert by[503][0] < 0.7


def test_repeated_ids_stay_bounded(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([(7, text(rng, 10)) for _ in range(300)] + [(8, text(rng, 10, 2)) for _ in range(5)], DOCS)
    seen = []
    real = toxicity.Scorer.__init__
    toxicity.Scorer.__init__ = lambda self, sample, **o: (seen.extend(sample), real(self, sample, **o))[1]
    try:
        toxicity.fit(df, spark.createDataFrame([(7, 0), (8, 1)], LABELS), F.lit(True), per_class=20)
    finally:
        toxicity.Scorer.__init__ = real
    assert Counter(label for label, _ in seen) == {0: 20, 1: 5}


def test_no_labels_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], DOCS)
    for labels in ([], [(1, 1)], [(1, None)]):
        model = toxicity.fit(docs, spark.createDataFrame(labels, LABELS), F.lit(True))
        assert [r.score for r in toxicity.score(docs, model).collect()] == [0, 0]
    assert toxicity.score(docs.limit(0), model).collect() == []
