import random
import re

import pytest
from pyspark.sql import functions as F

from parlance.llm import jaccard


def shingle_set(text, k=5):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    found = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not found:
        return frozenset()
    return frozenset(tuple(found[i : i + k]) for i in range(max(1, len(found) - k + 1)))


def brute(docs):
    """doc_id -> (set size, smallest doc_id reachable) by comparing all pairs."""
    sets = {i: shingle_set(t) for i, t in docs}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def made_up(seed, n=260):
    rnd = random.Random(seed)
    vocab = ["w%d" % i for i in range(400)]
    passage = [rnd.choice(vocab) for _ in range(30)]
    docs = []
    for _ in range(n):
        kind = rnd.random()
        if kind < 0.55 and docs:
            w = docs[rnd.randrange(len(docs))].split(" ")
            for _ in range(rnd.randint(0, max(1, len(w) // 40))):
                spot = rnd.randrange(len(w))
                w[spot : spot + rnd.randint(0, 1)] = [rnd.choice(vocab)] * rnd.randint(0, 2)
            docs.append(" ".join(w) or "x")
        elif kind < 0.75:
            docs.append(" ".join(passage + [rnd.choice(vocab) for _ in range(rnd.randint(1, 14))]))
        else:
            docs.append(" ".join(rnd.choice(vocab) for _ in range(rnd.choice([1, 3, 4, 5, 6, 8, 9, 10, 13, 30, 60, 200]))))
    docs += [None, "", "  \n", "A b", "a  B", "one two three four five six seven eight nine", "one two three four five six seven eight"]
    order = list(range(len(docs)))
    rnd.shuffle(order)
    return list(zip(order, docs, strict=True))


@pytest.mark.parametrize(("seed", "options"), [(1, {}), (2, {"hot_share": 0.0001, "seeds": 1}), (3, {"hot_share": 0.3})])
def test_components_equal_brute_force(spark, seed, options):
    docs = made_up(seed)
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(df, **options).collect()}
    assert got == brute(docs)


def near_copy_group(seed, n):
    """Copies of one text with 0 to 9 words changed in each, most of which link with nobody, and a chain along which each is near the next alone."""
    rnd = random.Random(seed)
    base = ["b%d" % i for i in range(150)]
    docs = []
    for i in range(n):
        w = list(base)
        for at in rnd.sample(range(150), rnd.randint(0, 9)):
            w[at] = "x%d_%d" % (i, at)
        docs.append(" ".join(w))
    w = list(base)
    for at in range(3, 150, 12):
        w[at] = "chain%d" % at
        docs.append(" ".join(w))
    return list(enumerate(docs))


@pytest.mark.parametrize(("n", "block"), [(900, 64)])
def test_large_group_of_near_copies(spark, n, block):
    docs = near_copy_group(5, n)
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(df, block=block).collect()}
    assert got == brute(docs)


def test_large_groups_go_on_and_blocks_bring_every_allowed_pair():
    import numpy as np
    import pyarrow as pa

    sig = np.repeat([1, 2, 3], [3, 40, 30])
    root = np.concatenate([[1, 1, 2], np.arange(40), np.zeros(30, int)])
    doc = np.arange(73)
    batches = [pa.record_batch([pa.array(c[at : at + 7]) for c in (sig, root, doc)], ["sig", "root", "doc_id"]) for at in range(0, 73, 7)]
    for most in (10, 8192):
        out = pa.Table.from_batches(jaccard.meet_rows(iter(batches), 4, most)).to_pylist()
        assert {(r["a"], r["b"]) for r in out if r["sig"] is None} == {(0, 2), (1, 2)}
        assert {r["b"] for r in out if r["sig"] == 2} == set(range(3, 43))


def test_signatures_bring_every_link_together():
    """Without the first round: each pair above the threshold shares a signature, hot shingles or not."""
    import numpy as np

    rnd = np.random.default_rng(4)
    bands = jaccard.Bands(80, 100)
    pool = rnd.integers(0, 2**48, 4000, dtype=np.uint64)
    for hot_n in (0, 20, 4000):
        hot = np.sort(pool[:hot_n])
        for size in (4, 5, 9, 17, 40, 90, 250):
            for _ in range(40):
                a = rnd.choice(pool[: max(size * 2, 40)], size, replace=False)
                n = rnd.integers(0, max(1, size // 5) + 1)
                b = np.union1d(rnd.permutation(a)[n // 2 :], rnd.integers(0, 2**48, n - n // 2, dtype=np.uint64))
                inter = len(np.intersect1d(a, b))
                if 100 * inter < 80 * (len(a) + len(b) - inter):
                    continue
                seen = []
                for x in (a, b):
                    own = bands.of(np.array([len(x)]))
                    got = set()
                    for band in (own, own - 1):
                        if band[0] >= 0:
                            got |= set(jaccard.signatures(np.zeros(len(x), int), np.sort(x), np.array([len(x)]), bands, band, hot)[1].tolist())
                    seen.append(got)
                assert seen[0] & seen[1]


def test_texts_are_shuffled_once(spark):
    """Where the join with the representatives is not broadcast, its exchange of the texts is also that into buckets."""
    texts = spark.createDataFrame([(i, f"w{i}") for i in range(40)], "doc_id bigint, text string")
    reps = spark.createDataFrame([(i,) for i in range(0, 40, 3)], "doc_id bigint")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = jaccard.texts_of(texts, reps, 9)
        rows = got.select("doc_id", "text", F.spark_partition_id(), F.expr("pmod(hash(doc_id), 9)")).collect()
        plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted(r[:2] for r in rows) == [(i, f"w{i}") for i in range(0, 40, 3)]
    assert all(r[2] == r[3] for r in rows)
    assert plan.count("Exchange hashpartitioning") == 2


def test_sets_lie_in_one_file_a_bucket(spark):
    """Also where joins have more partitions than the bytes of the sets ask for: no task writes a file for each bucket."""
    from pathlib import Path

    from parlance.llm._spark import Workspace

    texts = spark.createDataFrame([(i, " ".join(f"w{i}_{j}" for j in range(9))) for i in range(300)], "doc_id bigint, text string")
    put = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "11"}
    before = {key: spark.conf.get(key) for key in put}
    for key, value in put.items():
        spark.conf.set(key, value)
    try:
        work = Workspace(spark, "files")
        join = jaccard.Join(work, 80, 100, 5, 0.001, 8, 2048)
        join.load(texts, texts.select("doc_id"), 1)
        files = list(Path(work.root, "sets").glob("*.parquet"))
        got = join.sets.agg(F.countDistinct("doc_id"), F.sum("n")).first()
        join.close()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert tuple(got) == (300, 1500)
    assert len(files) <= 11


def test_few_signatures_a_shingle():
    """A third of a set's size or so: few sets are also indexed in the band below."""
    import numpy as np

    rnd = np.random.default_rng(6)
    size = np.exp(rnd.uniform(np.log(40), np.log(2000), 400)).astype(np.int64)
    owner, tokens = np.repeat(np.arange(len(size)), size), rnd.integers(0, 2**63, int(size.sum()), dtype=np.uint64)
    bands = jaccard.Bands(80, 100)
    own = bands.of(size)
    below = np.where((own > 0) & (size * bands.num <= bands.high[own - 1] * bands.den), own - 1, -1)
    n = sum(len(jaccard.signatures(owner, tokens, size, bands, band, tokens[:0])[1]) for band in (own, below))
    assert n < 0.38 * len(tokens)


def test_sets_of_long_and_of_many_short_documents():
    import numpy as np
    import pyarrow as pa

    rnd = random.Random(8)
    long = [" ".join(rnd.choice("abcd") for _ in range(rnd.randint(1, 400))) for _ in range(30)]
    short = [" ".join(rnd.choice("ab") for _ in range(rnd.randint(0, 8))) for _ in range(300)]
    for texts in (long, short, [*long, "", None, *short]):
        batch = pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])
        digest, found = (pa.Table.from_batches(rows(iter([batch]), 5)) for rows in (jaccard.digest_rows, jaccard.set_rows))
        sizes = [len(shingle_set(t)) for t in texts]
        assert digest["n"].to_pylist() == sizes == found["n"].to_pylist()
        same = {}
        for t, *d in zip(texts, digest["d1"].to_pylist(), digest["d2"].to_pylist(), strict=True):
            assert same.setdefault(shingle_set(t), d) == d
        assert len({tuple(d) for d in same.values()}) == len(same)
        for n, tokens, bitmap in zip(sizes, found["tokens"].to_pylist(), found["bitmap"].to_pylist(), strict=True):
            u = jaccard.unpack(tokens)
            assert len(u) == n and (u[1:] > u[:-1]).all()
            bits = np.bincount((jaccard.mix(u) % np.uint64(1024)).astype(np.int64), minlength=1024) % 2
            assert np.packbits(bits.astype(bool)).tobytes() == bitmap


def test_heavy_shingles_have_exact_counts():
    import numpy as np
    import pyarrow as pa

    rnd = np.random.default_rng(9)
    sets = [np.unique(np.concatenate([rnd.integers(0, 60, 12), rnd.integers(2**32, 2**63, 3000)])).astype("<u8") for _ in range(900)]
    key, n = np.unique(np.concatenate(sets), return_counts=True)
    batches = [pa.record_batch([pa.array([s.tobytes() for s in sets[at : at + 100]], pa.binary())], ["tokens"]) for at in range(0, 900, 100)]
    got = pa.Table.from_batches(jaccard.heavy_rows(iter(batches), 0.1))
    assert dict(zip(got["token"].to_pylist(), got["n"].to_pylist(), strict=True)) == dict(zip(key[n >= 45].tolist(), n[n >= 45].tolist(), strict=True))
    none = pa.Table.from_batches(jaccard.heavy_rows(iter([]), 0.1))
    assert none.num_rows == 0 and [str(t) for t in none.schema.types] == ["int64", "int64"]


def test_empty_table_nulls_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string, n int, root int")
    assert jaccard.near_duplicates(empty).count() == 0
    rows = [(-1, "p q r s t u v", 1, 1), (2**60 + 1, "p q r s t u v", 1, 1), (1, "a b c d e f", 3, None), (None, "a b c d e f", None, 2), (None, None, 1, 1), (2, None, 0, 0)]
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string, n int, root int")).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got) == [("-1", 3, "-1"), ("1", 2, "1"), (str(2**60 + 1), 3, "-1"), ("2", 0, "2"), ("None", 0, "None"), ("None", 2, "1")]
