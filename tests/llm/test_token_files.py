import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from parlance.llm import token_files
from parlance.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(str(tokenizer_path()))


@given(st.lists(st.integers(0, 40), max_size=3000))
@settings(max_examples=40, deadline=None)
def test_wavelet_matrix(ids):
    m = token_files.WaveletMatrix.build(np.array(ids, np.uint32), 6)
    payload = token_files.to_payload([7], np.array([len(ids)]), m)
    doc_ids, lengths, back = token_files.from_payload(payload)
    assert back.decode().tolist() == ids and doc_ids.tolist() == [7] and lengths.tolist() == [len(ids)]
    for i in range(0, len(ids), 97):
        assert back.access(i) == ids[i]
    for v in (0, 3, 40, 63, 64):
        assert back.count(v) == ids.count(v)
        assert back.occurrences(v) == [i for i, x in enumerate(ids) if x == v]
        a, b = len(ids) // 3, len(ids) // 2
        assert back.count(v, a, b) == ids[a:b].count(v)


@given(st.lists(st.sampled_from([*"ab  \n\n\t\r.,é1 日ſ<|>end", "<|endoftext|>", "\xa0", "\u3000", "\x1d", "'s", "I'll"]), max_size=60).map("".join))
@settings(max_examples=400, deadline=None)
def test_chunks_give_the_tokenizers_ids(tokenizer, text):
    encoder = token_files.encoder_of(str(tokenizer_path()), 0)
    encoder.keep = 5
    texts = [text, text + " " + text, None, text]
    for t, got in zip(texts, encoder.encode_many(texts), strict=True):
        assert got.tolist() == [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]


def test_documents_from_files(spark, tokenizer):
    rnd = random.Random(3)
    docs = [(i, " ".join(rnd.choice(["alpha", "beta,", "γάμμα", "\nLine"]) for _ in range(rnd.randint(0, 300))), "x") for i in range(300)]
    docs += [(1000, None, None), (1001, "", "y"), (None, "null id", "z"), (-(2**63), "least", "z"), (2**60 + 1, "x <|endoftext|> y", "z"), (2**60 + 2, "word " * 60_000, "z")]
    rnd.shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id bigint, text string, shard string").repartition(5)
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_files.token_files(df, str(tokenizer_path()), shard_tokens=500, part_bytes=4000).collect()}
    start, want = 0, {}
    for i, t, _ in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0)):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want[i] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert got == want


def test_other_vocabularies_and_too_few_planes(spark, tmp_path):
    """Ids from 65,536 up, another pre-tokenizer: encoded as they are, in as many planes as they need."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    other = Tokenizer(models.WordLevel({"[UNK]": 0, "alpha": 70_000, "beta": 3}, unk_token="[UNK]"))
    other.pre_tokenizer = pre_tokenizers.Whitespace()
    path = str(tmp_path / "words.json")
    other.save(path)
    df = spark.createDataFrame([(1, "alpha beta"), (2, "gamma, alpha")], "doc_id bigint, text string")
    got = {r["doc_id"]: (r["n_tokens"], r["ids_crc32"]) for r in token_files.token_files(df, path).collect()}
    for i, ids in ((1, [70_000, 3, 0]), (2, [0, 0, 70_000, 0])):
        assert got[i] == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    with pytest.raises(ValueError, match="17 bits"):
        token_files.token_files(df, path, levels=16)


def test_empty_table(spark):
    assert token_files.token_files(spark.createDataFrame([], "doc_id bigint, text string"), str(tokenizer_path())).count() == 0


def test_odd_white_space_is_found_in_any_kind_of_text():
    odd = "\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0   　﻿"
    for plain in ("a b\n\tc", "é b", "日 b", "😀"):
        assert not token_files.has_odd_space(plain)
        assert all(token_files.has_odd_space(plain + c + plain) for c in odd)


def test_each_distinct_piece_goes_to_the_model_once(tokenizer):
    encoder, seen = token_files.ChunkEncoder(str(tokenizer_path()), 0), []

    class Model:
        def tokenize(self, piece):
            seen.append(piece)
            return tokenizer.model.tokenize(piece)

    encoder.model = Model()
    text = "alpha, beta alpha, beta"
    for _ in range(2):
        assert encoder.encode(text).tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 0]
    assert sorted(seen) == sorted({"alpha", ",", "Ġbeta", "Ġalpha"})


def test_workers_keep_no_encoder_after_reading(spark):
    """Writers and readers share workers; what a writer knew would stay in an executor's memory for all later stages."""
    df = spark.range(40).selectExpr("id as doc_id", "concat('word ', id, ' and more') as text")
    spark.conf.set("spark.sql.files.openCostInBytes", "1g")  # a task for each file, so that all workers read
    try:
        assert token_files.token_files(df, str(tokenizer_path()), part_bytes=20).count() == 40
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")

    def held(batches):
        import pyarrow as pa

        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(token_files._encoders)])], ["n"])

    assert spark.range(0, 64, 1, 16).mapInArrow(held, "n bigint").selectExpr("sum(n)").first()[0] == 0


def test_pieces_are_looked_up_once_for_many_texts(tokenizer, monkeypatch):
    """However often a piece stands in texts that are encoded together, it is one look into what is known."""

    class Counted(token_files.Places):
        looks = 0

        def __getitem__(self, piece):
            Counted.looks += 1
            return super().__getitem__(piece)

    monkeypatch.setattr(token_files, "Places", Counted)
    encoder = token_files.ChunkEncoder(str(tokenizer_path()), 0)
    texts = ["alpha beta, " * 500, "", "beta alpha\n\n" * 500]
    for _ in range(2):
        for text, got in zip(texts, encoder.encode_many(texts), strict=True):
            assert got.tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 0]
    assert Counted.looks <= 2 * 10


@given(st.lists(st.lists(st.sampled_from([*"abZ  \n\n\t\r.,-é×÷ÿ127'日ſ\x00", "e\u0301", "'s", "'ll ", "\n\n\n", "  ", "ü-"]), max_size=12).map("".join), max_size=8))
@settings(max_examples=400, deadline=None)
def test_texts_are_cut_where_pre_tokens_end(tokenizer, texts):
    """Cuts are ends of pre-tokens, each text by itself; where only kinds of characters that are told apart stand, they are all of them."""
    parts = [t.encode() for t in texts]
    ends = np.cumsum([len(p) for p in parts], dtype=np.int64)
    got = token_files.cuts(b"".join(parts), ends).tolist()
    assert got == sorted(set(got))
    for text, part, end in zip(texts, parts, ends.tolist(), strict=True):
        begin = end - len(part)
        want = {len(text[:b].encode()) for _, (_, b) in tokenizer.pre_tokenizer.pre_tokenize_str(text)}
        here = {c - begin for c in got if begin < c <= end}
        assert here <= want and (not part or len(part) in here)
        if not set(text) & set("'×÷日ſ\x00\u0301"):
            assert here == want
