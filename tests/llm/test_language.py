import math
import random
from collections import Counter

import numpy as np

from parlance.llm import language
from parlance.llm.queries import id_remainder


def test_probabilities_sum_to_one():
    """Over all characters, seen or not, for contexts of every length."""
    words = [Counter({"abba": 3, "abc": 2, "ba": 1, "caab": 1}), Counter({"xy": 2, "yab": 1})]
    model = language.KneserNey(words, order=4)
    alphabet = [chr(c) for c in range(97, 123)]
    for prefix in ("", "a", "ab", "abb", "zz", "abba"):
        total = np.zeros(2)
        # the chance of all words that begin so by their next character, or end here
        base = _prefix(model, prefix)
        for c in alphabet:
            total += np.exp(_prefix(model, prefix + c) - base)
        total += np.exp(model.log_probability(*language._flatten([prefix]))[0] - base)
        # the characters that never occur hold their uniform share
        unseen = np.exp(_prefix(model, prefix + "é") - base)
        assert np.allclose(total + unseen * (language.ALPHABET - 27), 1, atol=1e-9)


def _prefix(model, prefix):
    """Log-probability of the characters of a prefix, without an end."""
    flat, first = language._flatten([prefix])
    full = model.log_probability(flat, first)[0]
    marked = flat.copy()
    end = model.log_probability(marked, first)[0]
    assert np.allclose(full, end)
    return full - _last(model, flat)


def _last(model, flat):
    """Log-probability of the last symbol alone."""
    p = np.full((len(flat), model.languages), 1 / language.ALPHABET) * model.root
    context = None
    for k, (whole, _, use) in enumerate(language._grams(flat, np.array([0]), model.order)):
        if not use[-1]:
            break
        if k:
            before = _index(model.keys[k - 1], context)
            if before is None:
                break
            p[-1] *= model.left[k - 1][before]
        at = _index(model.keys[k], whole[-1])
        if at is not None:
            p[-1] += model.value[k][at]
        context = language._grams(flat, np.array([0]), model.order)[k][0][-2]
    return np.log(p[-1])


def _index(keys, x):
    i = int(np.searchsorted(keys, x))
    return i if i < len(keys) and keys[i] == x else None


def test_held_out_accuracy_and_rejection(spark, sf):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("held_out", id_remainder(4) == 2)
    model = language.fit(docs.where("not held_out"))
    rows = language.identify(docs, model, keep=("doc_id", "held_out", "lang")).collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == 1000
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert not any(r["rejected"] for r in rows)
    rnd = random.Random(1)
    junk = ["".join(rnd.choice("бвгджзклмн ") for _ in range(300)), "qzxjkvw " * 40]
    assert all(p[3] for p in model.predict(junk))


def _sentences(seed, n, syllables):
    rnd = random.Random(seed)
    return [" ".join("".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 3))) for _ in range(60)) for _ in range(n)]


def test_rare_and_wrong_labels_do_not_open_the_limits():
    one = _sentences(1, 150, ["ka", "to", "mi", "re", "sun"])
    two = _sentences(2, 150, ["ble", "gor", "chi", "wen", "ast"])
    rare, copied = _sentences(3, 4, ["pul", "vex", "jo", "dri"]), _sentences(4, 3, ["ka", "to", "mi", "re", "sun"])
    sample = [("one", t) for t in one] + [("two", t) for t in two] + [("rare", t) for t in rare] + [("copied", t) for t in copied] + [("single", "xalu xulo luxa loxu ulxo")]
    # a tenth of "two" is text of "one", and some is noise
    rnd = random.Random(5)
    noise = ["".join(rnd.choice("βγδζθλμξπσφχψω ") for _ in range(300)) for _ in range(8)]
    sample[150:150] = [("two", t) for t in _sentences(6, 15, ["ka", "to", "mi", "re", "sun"])] + [("two", t) for t in noise[:3]]
    model = language.Identifier(sample)
    assert np.isfinite(model.limits).all()
    junk = ["".join(rnd.choice("бвгджзклмнпрст ") for _ in range(300)) for _ in range(5)] + ["漢字仮名交じり文 東京都庁前 " * 9, "qzxjkvw " * 40]
    junk += _sentences(7, 3, ["hyf", "nqa", "zzu", "ewp"])  # a language that was not learned
    assert all(p[3] for p in model.predict(junk))
    clean = _sentences(8, 20, ["ka", "to", "mi", "re", "sun"]) + _sentences(9, 20, ["ble", "gor", "chi", "wen", "ast"]) + _sentences(10, 5, ["pul", "vex", "jo", "dri"])
    assert not any(p[3] for p in model.predict(clean))


def test_texts_without_letters(spark):
    docs = spark.createDataFrame([(1, None, "en", "a"), (2, "123 --", None, None), (3, "hello there", "en", "b"), (None, "", "fr", "c")], "doc_id bigint, text string, lang string, score string")
    model = language.fit(docs)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(docs, model).collect()}
    assert got[1] == got[2] == got[None] == ("und", 0.0)
    assert {r["doc_id"] for r in language.accepted(docs, model).collect()} <= {3}
    assert language.identify(docs.limit(0), model).count() == 0
    empty = language.fit(docs.limit(0))
    assert [r["lang_pred"] for r in language.identify(docs, empty).collect()] == ["und"] * 4
    assert math.isfinite(model.temperature)
