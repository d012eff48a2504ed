"""Greedy and beam decoding against plain Python and against all paths."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from parlance.functions import beam
from parlance.queries import QUERIES
from parlance.queries.numeric import DECODING, FRAMES, score_rows


def gated(row, history, frames, o):
    row = [(x * o.penalty if x < 0 else x / o.penalty) if i in history else x for i, x in enumerate(row)]
    if len(history) < math.ceil(frames * o.ratio):
        row[o.end] = -math.inf
    rivals = [x for i, x in enumerate(row) if i != o.end and math.isfinite(x)]
    if o.margin and rivals and row[o.end] < max(rivals) + o.margin:
        row[o.end] = -math.inf
    top = max(row)
    z = top + math.log(sum(math.exp(x - top) for x in row))
    return [x - z for x in row]


def search(rows, frames, o):
    """Lists of (tokens, score), step by step."""
    best = lambda lp: sorted(enumerate(lp), key=lambda x: (-x[1], x[0]))[: o.width]
    active = [([t], s) for t, s in best(gated(rows[0], [], frames, o))]
    ended = []
    for row in rows[1:]:
        if len(active[0][0]) >= o.most or len(ended) >= o.width:
            break
        offers = [(h, t, active[h][1] + s) for h in range(len(active)) for t, s in best(gated(row, active[h][0], frames, o))]
        new = []
        for h, t, s in sorted(offers, key=lambda x: (-x[2], x[0])):
            if len(new) >= o.width or len(ended) >= o.width:
                break
            if t == o.end:
                ended.append(active[h])
            else:
                new.append((active[h][0] + [t], s))
        if not new:
            break
        active = new
    found = [(s / max(len(t), 1) ** o.alpha, t) for t, s in ended + active]
    return max(found, key=lambda x: x[0])


def decode(spark, all_rows, o, frames=6):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(all_rows)], "i int, rows array<array<double>>")
    got = df.select("i", beam.beam_search(F.col("rows"), F.lit(frames), o).alias("d")).orderBy("i").collect()
    return [(r.d.score, list(r.d.tokens), r.d.parents) for r in got]


@pytest.mark.parametrize("o", [
    beam.Options(end=0, width=3), beam.Options(end=2, width=2, ratio=0.4, margin=0.3, penalty=1.5, alpha=1.0), beam.Options(end=1, width=5, most=3, alpha=0.0), beam.Options(end=0, width=1, penalty=2.0),
])
def test_equals_plain_search(spark, o):
    rng = random.Random(o.width)
    data = [[[rng.choice([-2.0, -1.0, 0.0, 0.5, 1.0, rng.gauss(0, 2)]) for _ in range(5)] for _ in range(rng.randint(1, 6))] for _ in range(60)]
    for (score, tokens, parents), rows in zip(decode(spark, data, o), data, strict=True):
        want = search(rows, 6, o)
        assert tokens == want[1]
        assert score == pytest.approx(want[0])
        assert all(0 <= p < o.width for step in parents for p in step)


def test_a_wide_beam_finds_the_best_of_all_paths(spark):
    rng = random.Random(1)
    o = beam.Options(end=0, width=400, ratio=0.0, penalty=1.7, alpha=0.6)
    data = [[[rng.gauss(0, 1) for _ in range(3)] for _ in range(4)] for _ in range(12)]
    for (score, tokens, _), rows in zip(decode(spark, data, o), data, strict=True):
        paths = []
        for n in range(1, 5):
            for path in itertools.product(range(3), repeat=n):
                if 0 in path[1:]:
                    continue  # the end closes, but as the first token
                total = sum(gated(rows[i], list(path[:i]), 6, o)[t] for i, t in enumerate(path))
                paths.append((total / n**o.alpha, list(path)))
        want = max(paths)
        assert (score, tokens) == (pytest.approx(want[0]), want[1])


def test_ties_and_ends(spark):
    flat = [[0.0, 0.0, 0.0]] * 3
    assert decode(spark, [flat], beam.Options(end=2, width=2))[0][1] in ([0, 0, 0], [0])
    assert decode(spark, [flat], beam.Options(end=2, width=2, alpha=0.0))[0][1] == search(flat, 6, beam.Options(end=2, width=2, alpha=0.0))[1]
    df = spark.createDataFrame([([],), (None,)], "rows array<array<double>>")
    assert [r.d for r in df.select(beam.beam_search(F.col("rows"), F.lit(1), beam.Options(end=0)).alias("d")).collect()] == [None, None]
    with pytest.raises(ValueError):
        beam.beam_search(F.col("rows"), F.lit(1), beam.Options(end=0, width=0))


def test_step_puts_each_hypothesis_after_its_parent(spark):
    df = spark.createDataFrame([([([7], -1.0), ([8], -1.5)], [[0.0, 3.0, -9.0], [0.0, -9.0, 5.0]])], "active array<struct<tokens:array<int>,score:double>>, rows array<array<double>>")
    out = df.select(beam.beam_step(F.col("active"), F.array(), F.col("rows"), F.lit(0), beam.Options(end=0, width=2)).alias("d")).first().d
    assert [list(h.tokens) for h in out.active] == [[7, 1], [8, 2]]
    assert list(out.parents) == [0, 1]


def test_query_equals_plain_search(spark, sf):
    rows = {r.utt_id: r.rows for r in score_rows(spark, sf).collect()}
    for r in QUERIES["beam_decode"](spark, sf).collect():
        score, tokens = search(rows[r.utt_id], FRAMES, DECODING)
        assert (r.tokens, r.length) == (" ".join(map(str, tokens)), len(tokens))
        assert r.score == pytest.approx(score, abs=1e-5)
