import math

import numpy as np
import pytest

from parlance.llm import embeddings


def brute(rows, threshold=0.9):
    ok = {i: np.array(v, float) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    root, links = {i: i for i, _ in rows}, {i: 0 for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(ok)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if len(ok[i]) == len(ok[j]) and ok[i] @ ok[j] / np.linalg.norm(ok[i]) / np.linalg.norm(ok[j]) >= threshold:
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (links[i], find(i), find(i) == i) for i, _ in rows}


def made_up(seed=1, n=300, dim=64):
    rnd = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        if i and rnd.random() < 0.4:
            v = np.array(rows[rnd.integers(len(rows))][1]) + rnd.normal(0, rnd.choice([0.0, 0.2, 0.45]), dim)
        else:
            v = rnd.normal(0, 1, dim)
        rows.append((i, [float(np.float32(x)) for x in v]))
    ids = rnd.permutation(n).tolist()
    return [(i, v) for i, (_, v) in zip(ids, rows, strict=True)]


@pytest.mark.parametrize("options", [{}, {"cell_rows": 20, "probes": 15, "block": 16}])
def test_equals_brute_force(spark, options):
    rows = made_up()
    rows += [(1000, None), (1001, [0.0] * 64), (1002, [float("nan")] + [1.0] * 63), (1003, [None] * 64), (1004, [1.0, 2.0]), (1005, [2.0, 4.0]), (1006, [1.0, 2.0]), (1007, []), (1008, [float("inf")] * 64)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(3)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_duplicates(df, **options).collect()}
    assert got == brute(rows)


def test_estimates_are_unbiased_and_bounded():
    rnd = np.random.default_rng(2)
    codes = embeddings.Codes(64)
    x = embeddings.unit(rnd.normal(size=(200, 64)))
    y = embeddings.unit(x + rnd.normal(0, 0.3, (200, 64)))
    code, factor = codes.encode(y)
    value, bound = codes.estimates(codes.query(x, rnd), code, factor)
    error = value - x @ y.T
    assert abs(error.mean()) < 0.005
    assert (np.abs(error) <= bound).mean() > 0.995


@pytest.mark.parametrize("cosine", [0.92, 0.6])
def test_recall_with_a_dense_group(spark, cosine):
    """A third of the rows lies together, over many more cells than are probed; a tenth of all are near copies of others."""
    rnd = np.random.default_rng(4)
    n, dim = 6000, 64
    x = rnd.normal(0, 1, (n, dim)) / np.sqrt(dim)
    x[: n // 3] = np.sqrt(cosine) * embeddings.unit(rnd.normal(size=(1, dim))) + np.sqrt(1 - cosine) * x[: n // 3]
    x = embeddings.unit(x)
    of = rnd.permutation(n)
    x[of[: n // 10]] = embeddings.unit(x[of[n // 10 : n // 5]] + rnd.normal(0, 0.4 / np.sqrt(dim), (n // 10, dim)))
    x = x.astype(np.float32).astype(float)
    link = embeddings.unit(x) @ embeddings.unit(x).T >= 0.9
    want = link.sum(1) - 1
    df = spark.createDataFrame(list(zip(range(n), x.tolist(), strict=True)), "vec_id bigint, embedding array<float>").repartition(3)
    got = np.zeros(n, np.int64)
    for r in embeddings.near_duplicates(df, cell_rows=8, block=512).select("vec_id", "n_links").collect():
        got[r["vec_id"]] = r["n_links"]
    assert (got <= want).all()
    assert got[: n // 3].sum() >= 0.99 * want[: n // 3].sum()
    assert got[n // 3 :].sum() >= 0.9 * want[n // 3 :].sum()


def test_empty_table(spark):
    df = spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int, k1 int")
    assert embeddings.near_duplicates(df).count() == 0
