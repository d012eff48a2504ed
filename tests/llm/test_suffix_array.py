import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from parlance.llm import suffix_array as sa


def brute(docs, width):
    """(doc_id, n_bytes, n_removed, n_spans, sha256) by looking at every window."""
    raw = sorted((i, (t or "").encode()) for i, t in docs)
    seen, out = set(), {}
    for i, b in raw:
        gone = bytearray(len(b))
        for p in range(len(b) - width + 1):
            w = b[p : p + width]
            if w in seen:
                gone[p : p + width] = b"\1" * width
            seen.add(w)
        runs = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out[i] = (len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


@given(st.lists(st.integers(0, 3), max_size=60))
@settings(max_examples=200, deadline=None)
def test_suffix_array_sorts(text):
    assert sa.suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def made_up(seed, n=80):
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choices("abcdeé", k=rnd.randint(1, 9))) for _ in range(60)]
    text = lambda k: " ".join(rnd.choice(vocab) for _ in range(k))
    common, docs = text(30), []
    for _ in range(n):
        kind = rnd.random()
        if kind < 0.2 and docs:
            docs.append(docs[rnd.randrange(len(docs))])
        elif kind < 0.5 and docs:
            words = docs[rnd.randrange(len(docs))].split(" ")
            for _ in range(rnd.randint(1, 4)):
                words[rnd.randrange(len(words))] = rnd.choice(vocab)
            docs.append(" ".join(words))
        elif kind < 0.7:
            docs.append(f"{text(rnd.randint(1, 40))} {common} {text(rnd.randint(1, 40))}")
        else:
            docs.append(text(rnd.randint(1, 120)))
    docs += ["a" * 400, "a" * 150, "ab" * 200, "", None, "x" * 99, "x" * 100, common * 3, "é" * 120]
    order = list(range(len(docs)))
    rnd.shuffle(order)
    return [(i, t) for i, t in zip(order, docs, strict=True)]


@pytest.mark.parametrize("options", [{}, {"salt_rows": 2, "buffer": 500}])
def test_removes_what_brute_force_removes(spark, options):
    docs = made_up(5)
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in sa.remove_repeats(df, **options).collect()}
    want = brute(docs, 100)
    assert got == want
    assert sum(v[1] for v in want.values()) > 10_000


def test_empty_table_and_extra_columns(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string, h string, n int")
    assert sa.remove_repeats(empty).count() == 0
    clash = spark.createDataFrame([(1, "q" * 120, "x", None), (2, "q" * 120, None, 1)], "doc_id bigint, text string, h string, n int")
    want = brute([(1, "q" * 120), (2, "q" * 120)], 100)
    assert {r["doc_id"]: r["n_removed"] for r in sa.remove_repeats(clash).collect()} == {i: v[1] for i, v in want.items()}


def test_null_and_large_ids_and_a_long_text(spark):
    """Null ids keep their text; ids beyond 2**53 and below 0 keep their order; a text longer than a slice."""
    long = "".join(random.Random(3).choices("abcdefgh ", k=2_300_000))
    docs = [(2**60 + 1, "p" * 130), (2**60, "p" * 130), (-5, long), (7, long[1_000_000:1_000_400]), (None, "p" * 130), (None, long[:200])]
    got = sa.remove_repeats(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    removed = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_bytes"], r["n_removed"]) for r in got)
    assert removed == [(False, -5, len(long), 0), (False, 7, 400, 400), (False, 2**60, 130, 129), (False, 2**60 + 1, 130, 130), (True, 0, 130, 0), (True, 0, 200, 0)]
