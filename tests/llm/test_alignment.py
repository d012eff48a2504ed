import random
from pathlib import Path

import numpy as np
import pytest

from parlance.llm import alignment, queries

A, B = (str(queries.tokenizer_path(n)) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
SCHEMA = "doc_id long, text string"
ODD = [
    None, "", " ", "\n", "a", " a", "a ", "a  b", "a\n\nb", "a \n b", "a\n b", "\na", "a\tb", "a \tb", "a\r\nb", "a　b", "x ▁y", "▁", "é é € \U0001f600 ﬁ ½",
    "<|endoftext|> <s> </s> <unk> <0x41> <0x0A>", "it's we'll DON'T", "1,234.50 $5 #x @y", "a\x00b \x1f c\x85d \xa0 e", "x" * 3000, "﻿start", "é", " ́", "   \n   \n", "tail\n", "a.b,c d. e.\nF ... 3.14 e.g., (x).", "a\x01b, c\x01\x01 .", ".", ",a", "é.com", "tail \n\n ", "你好 世界。한국어",
]


def rows_of(df) -> list[tuple]:
    return [tuple(r[c] for c in COLUMNS) for r in df.orderBy("doc_id").collect()]


def test_whole_table_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    assert rows_of(queries.op11_token_alignment(spark, sf)) == alignment.brute_force([d.text for d in docs], A, B)


@pytest.mark.parametrize("chars", [alignment.SLICE_CHARS, 10])
def test_odd_texts_in_slices_of_any_size(spark, chars):
    rng = random.Random(5)
    texts = [*ODD, *ODD[:4], *("".join(rng.choice(["a", "be", " ", " ", "\n", "\t", "\xa0", " ", ".", ",", ".", "9", "é", "the", "!?", "\x01"]) for _ in range(rng.randint(1, 40))) for _ in range(300))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], SCHEMA).selectExpr("*", "'x' as slice", "1 as pair", "2 as n_a").repartition(3)
    want = alignment.brute_force(texts, A, B)
    assert rows_of(alignment.align(df, A, B, chars)) == want
    assert sum(w[0] > 0 for w in want) > 250


def test_null_and_repeated_ids_are_documents_of_their_own(spark):
    df = spark.createDataFrame([(None, "one two"), (None, "one two"), (7, "one"), (7, None)], SCHEMA)
    got = alignment.align(df, A, B).collect()
    assert sorted((r.doc_id is None, r.n_a) for r in got) == [(False, 0), (False, 1), (True, 2), (True, 2)]


def test_empty_table(spark):
    assert alignment.align(spark.createDataFrame([], SCHEMA), A, B).collect() == []


def test_very_long_text_and_unbroken_text(spark):
    texts = ["word and another, " * 60_000, "über" * 20_000]
    got = rows_of(alignment.align(spark.createDataFrame(list(enumerate(texts)), SCHEMA), A, B))
    known = alignment.Aligner(A, B)
    for row, text in zip(got, texts, strict=True):
        a, b = known.a.encode(" " + text, add_special_tokens=False).ids, known.b.encode(text)
        ends = [np.cumsum([len(s[i]) for i in ids]) for ids, s in ((a, known.walker.a_bytes), (b, known.walker.b_bytes))]
        n = len(np.intersect1d(*ends))
        assert row[:4] == (len(a), len(b), n, len(a) + len(b) - n)


def test_groups_spell_the_text(spark):
    text = "It's naïve, 你好!\nnext line"
    got = alignment.groups(spark.createDataFrame([(1, text), (2, ""), (3, "▁")], SCHEMA), A, B).orderBy("start").collect()
    known = alignment.Aligner(A, B)
    whole = (" " + text).encode()
    assert {r.doc_id for r in got} == {1}
    assert got[-1].end == len(whole)
    for r in got:
        assert b"".join(known.walker.a_bytes[i] for i in r.a) == b"".join(known.walker.b_bytes[i] for i in r.b) == whole[r.start : r.end]


def test_transitions_are_memoised_and_differences_found():
    t = alignment.Transducer([b"ab", b"c", b"a"], [b"a", b"bc", b"x"])
    assert t.walk([0, 1], [0, 1]) == ([0, 1, 4], [(2, 2)])
    known = dict(t.moves)
    assert t.walk([0, 1], [0, 1]) == ([0, 1, 4], [(2, 2)])
    assert t.moves == known
    assert t.walk([2, 2], [0, 0]) == ([6, 6], [(1, 1), (2, 2)])
    assert t.walk([0], [2]) is t.walk([0], [0]) is t.walk([2], [0, 0]) is None


def test_a_small_cache_gives_the_same():
    known = alignment.Aligner(A, B, keep=3)
    texts = ["one two three four five", "two six seven eight", "one nine"]
    for text in texts:
        at = known.places(text)
        assert ";".join(known.spelt[i] for i in at).count("|") == alignment.brute_force([text], A, B)[0][2]
        known.trim()
        assert len(known.known) <= 7
    assert Path(A).exists()
