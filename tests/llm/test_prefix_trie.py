import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from parlance.llm import prefix_trie, queries

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def nodes(df, **options):
    key = lambda r: tuple((x is not None, x) for x in r)
    return sorted((tuple(r[c] for c in COLUMNS) for r in prefix_trie.prefix_trie(df, **options).collect()), key=key)


def expected(rows):
    return sorted(prefix_trie.brute_force(rows), key=lambda r: tuple((x is not None, x) for x in r))


def test_whole_table_equals_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = queries.op12_prefix_trie(spark, sf).select(*COLUMNS).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, expected(rows)))


def random_rows(seed: int, n: int) -> list[tuple]:
    """Few texts, so that openings and whole conversations repeat; ties, nulls, negative and absent base ids."""
    rng = random.Random(seed)
    rows = []
    for conv in rng.sample(range(-30, 400), n):
        opening = rng.choice([["a"], ["a", "b c"], ["a", "b c", "d"], [None, ""]])
        for turn, text in enumerate(opening + [rng.choice(["x", "y z", "", None, "é ü"]) for _ in range(rng.randint(0, 4))]):
            rows.append((conv, rng.choice([turn, turn, turn, 1, None]), rng.choice(["user", "user", "assistant", None]), text))
    rows += rng.sample(rows, n // 8)
    # no base and too few turns: rebuilt without a turn, members of the root that end there
    rows += [(c, 0, "user", "only") for c in range(1023, 1029)]
    return [*rows, (None, 0, "user", "no conversation")]


@pytest.mark.parametrize("most", [20_000, 3])
def test_random_conversations_at_any_group_size(spark, most):
    rows = random_rows(most, 90)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"node": F.lit("clash"), "depth": F.lit(1), "first": F.lit(2)}).repartition(5)
    got = nodes(df, most_links=most)
    assert got == expected(rows)
    assert next(r for r in got if r[1] == 0)[7] != prefix_trie.EMPTY


def test_copies_deep_prefixes_and_one_very_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 7)  # the copies' ends come in several chunks
    copies = [(c, t, "user", f"t{t}") for c in range(0, 400, 20) for t in range(4)]
    steps = [(c, t, "user", f"s{t}") for c in range(1000, 1400, 20) for t in range((c - 1000) // 20 + 1)]
    long = [(c, t, "user", f"l{t % 7}") for c in (2000, 2020) for t in range(3000)]
    rows = copies + steps + long
    found = nodes(spark.createDataFrame(rows, SCHEMA), most_links=2)
    # brute force is quadratic: without the long ones, whose nodes are a chain
    part = expected(copies + steps)
    chain = [r for r in found if r[0] == 2000 and r[1] > 0]
    assert len(chain) == 3000
    assert all(r[3] == 2 for r in chain)
    assert [r[6] for r in sorted(chain, key=lambda r: r[1])] == list(range(3000, 0, -1))
    assert [r for r in found if r[1] > 0 and r[0] < 2000] == [r for r in part if r[1] > 0]
    root = next(r for r in found if r[1] == 0)
    assert root[:6] == (0, 0, None, 42, 3, 3)
    assert root[6] == sum(r[6] for r in part if r[1] == 1) + 3000


def test_empty_table(spark):
    assert nodes(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA)) == []


def test_postorder_needs_no_recursion():
    n = 5000
    names = [i.to_bytes(16, "big") for i in range(1, n + 1)]
    part = pd.DataFrame({"conv_id": range(n), "n_convs": 2, "node": names, "parent": [prefix_trie.ROOT, *names[:-1]], "gain": 1, "tails": 1, "childless": 0})
    out = prefix_trie.sum_links(part)
    assert list(out["leaves"]) == list(range(n, 0, -1))
    assert list(out["saved"]) == list(range(n, 0, -1))
