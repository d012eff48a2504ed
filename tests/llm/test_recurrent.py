import zlib
from collections import Counter
from math import log10

import numpy as np

from parlance.llm import recurrent
from parlance.llm.queries import op3_recurrent_score


def small_network(seed=0):
    tokens = np.array([10, 20, 30, 40, int(recurrent.END)], np.uint64)
    shape = recurrent.Shape(tokens, np.array([9, 7, 5, 3, 2]), 3, np.array([2.0, 0.0]), np.array([1.0, 0.0]))
    net = recurrent.Network(shape, 4, seed=seed)
    net.flat += np.random.default_rng(1).normal(0, 0.3, len(net.flat)).astype(np.float32)
    return net


def test_gradient():
    """Backpropagation through a window against differences of the loss."""
    net = small_network()
    rnd = np.random.default_rng(2)
    inputs, targets = rnd.integers(0, 7, (5, 3)), rnd.integers(0, 7, (5, 3))
    targets[2, 1] = -1
    h = rnd.normal(0, 0.5, (3, 4)).astype(np.float32)
    grad, _, _ = net.train_window(inputs, targets, h)
    n = (targets >= 0).sum()
    for i in rnd.choice(len(net.flat), 60, replace=False):
        was = net.flat[i]
        losses = []
        for step in (1e-2, -1e-2):
            net.flat[i] = was + step
            losses.append(net.train_window(inputs, targets, h)[2])
        net.flat[i] = was
        assert abs((losses[0] - losses[1]) / 2e-2 / n - grad[i]) < 2e-3


def test_training_reads_whole_documents(monkeypatch):
    """Over all rounds every training document passes once, from its first token to its end, the state set to zero before it only."""
    net = small_network()
    lengths = np.array([1, 700, 3, 64, 65, 5000, 17, 2, 90])
    rnd = np.random.default_rng(5)
    kinds = np.sort(net.shape.hashes)
    page = {"kinds": kinds, "endings": np.zeros(len(kinds), int), "ids": np.arange(len(lengths)), "held": np.arange(len(lengths)) == 4, "lengths": lengths, "codes": rnd.integers(0, len(kinds), lengths.sum())}
    symbols = net.shape.words_of(page["kinds"], page["endings"])[page["codes"]]
    parts = np.split(symbols, np.cumsum(lengths)[:-1])
    want = Counter(tuple(p.tolist()) for k, p in enumerate(parts) if k != 4)
    seen, lanes, plain = Counter(), {}, recurrent.Network.train_window

    def watched(self, inputs, targets, h, fresh):
        for k in range(inputs.shape[1]):
            for i, t, f in zip(inputs[:, k].tolist(), targets[:, k].tolist(), fresh[:, k].tolist(), strict=True):
                if t < 0:
                    continue
                if f:
                    seen[tuple(lanes.get(k, []))] += k in lanes
                    lanes[k] = []
                assert i == (lanes[k][-1] if lanes[k] else net.shape.end)
                lanes[k].append(t)
        return plain(self, inputs, targets, h, fresh)

    monkeypatch.setattr(recurrent.Network, "train_window", watched)
    tokens = 0
    for turn in range(2):
        tokens += recurrent.train_page(net, page, turn, 2, 16, 3, recurrent.Adam(len(net.flat), 0.01))
        for lane in lanes.values():
            seen[tuple(lane)] += 1
        lanes.clear()
    assert tokens == lengths.sum() - lengths[4]
    assert +seen == want
    assert np.isfinite(net.flat).all()


def one_long_page(net):
    """Many short documents and one of several times a lane's share."""
    rnd = np.random.default_rng(8)
    lengths = np.concatenate([rnd.integers(1, 40, 400), [6000]])
    kinds = np.sort(net.shape.hashes)
    return {"kinds": kinds, "endings": np.zeros(len(kinds), int), "ids": np.arange(len(lengths)), "held": np.zeros(len(lengths), bool), "lengths": lengths, "codes": rnd.integers(0, len(kinds), lengths.sum())}


def test_a_long_document_takes_few_windows_and_steps(monkeypatch):
    """Its lane goes on alone, in longer windows; other documents run beside it when scored."""
    net = small_network()
    page = one_long_page(net)
    windows, steps, plain, step = [], [], recurrent.Network.train_window, recurrent.Network.step
    monkeypatch.setattr(recurrent.Network, "train_window", lambda self, inputs, *a: windows.append(inputs.shape) or plain(self, inputs, *a))
    assert recurrent.train_page(net, page, 0, 1, 16, 32, recurrent.Adam(len(net.flat), 0.01)) == page["lengths"].sum()
    assert len(windows) < 6000 // 16 // 4
    assert all(a * b <= 16 * 32 for a, b in windows)
    monkeypatch.setattr(recurrent.Network, "step", lambda self, symbols, *a: steps.append(len(symbols)) or step(self, symbols, *a))
    symbols = net.shape.words_of(page["kinds"], page["endings"])[page["codes"]]
    got = recurrent.score_page(net, symbols, page["lengths"], 64, 16)
    assert len(steps) == 6000
    alone = [recurrent.score_page(net, part, np.array([len(part)]), 64, 16)[0] for part in np.split(symbols, np.cumsum(page["lengths"])[:-1])[-20:]]
    assert np.allclose(got[-20:], alone, rtol=1e-4)


def test_pages_hold_each_token_in_place():
    """Kinds are sorted and distinct, and codes give back every token with its ending."""
    import pyarrow as pa

    texts = ["b a B c", None, "", "zz\ta  a", "c c c"]
    batch = pa.record_batch([pa.array([4, 9, None, -1, 7]), pa.array([False, True, False, False, True]), pa.array(texts)], ["doc_id", "held_out", "text"])
    (row,) = recurrent.rows_of(recurrent.make_pages(iter([batch.slice(0, 2), batch.slice(2)]), 24, 1 << 20))
    page = recurrent.open_page(row)
    assert (np.diff(page["kinds"].astype(object)) > 0).all() and len(page["kinds"]) == 5
    assert page["lengths"].tolist() == [5, 1, 1, 4, 4] and page["null"].tolist() == [False, False, True, False, False]
    words = ["b", "a", "b", "c", "END", "END", "END", "zz", "a", "a", "END", "c", "c", "c", "END"]
    code_of = dict(zip(words, page["codes"].tolist(), strict=True))
    assert [code_of[w] for w in words] == page["codes"].tolist() and len(set(code_of.values())) == 5
    assert page["kinds"][code_of["END"]] == recurrent.END and page["endings"][code_of["END"]] == 0


def test_fresh_documents_within_a_window():
    """A window of two documents in one lane has the gradient of the two apart."""
    net = small_network()
    rnd = np.random.default_rng(6)
    inputs, targets = rnd.integers(0, 7, (7, 1)), rnd.integers(0, 7, (7, 1))
    h, fresh = rnd.normal(0, 0.5, (1, 4)).astype(np.float32), np.arange(7)[:, None] == 3
    both, last, loss = net.train_window(inputs, targets, h, fresh)
    one, _, loss_1 = net.train_window(inputs[:3], targets[:3], h)
    two, last_2, loss_2 = net.train_window(inputs[3:], targets[3:], np.zeros_like(h))
    assert np.allclose(both * 7, one * 3 + two * 4, atol=1e-5)
    assert np.allclose(last, last_2) and abs(loss - loss_1 - loss_2) < 1e-4


def test_next_symbols_sum_to_one_and_state_is_carried():
    net = small_network()
    h = np.random.default_rng(3).normal(0, 1, (1, 4)).astype(np.float32)
    every = np.exp([net.log_probabilities(h, np.array([s]))[0] for s in range(7)]).sum()
    assert abs(every - 1) < 1e-5
    symbols = np.random.default_rng(4).integers(0, 7, 300).astype(np.int32)
    lengths = np.array([120, 1, 179])
    whole = recurrent.score_page(net, symbols, lengths, 2, 7)
    at = 0
    for d, n in enumerate(lengths):
        h, previous, total = np.zeros((1, 4), np.float32), np.array([net.shape.end]), 0.0
        for s in symbols[at : at + n]:
            h = net.step(previous, h)[-1]
            previous = np.array([s])
            total += net.log_probabilities(h, previous)[0]
        at += n
        assert abs(total - whole[d]) < 1e-3


def test_counts_and_base_equal_brute_force(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    split = lambda t: [*"".join(c.lower() if c.isascii() else c for c in t or "").encode().split(), b"\0end"]
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in docs}
    counts = Counter(w for i, t in docs if not held[i] for w in split(t))
    n, v = counts.total(), len(counts)
    got = {r["doc_id"]: r for r in op3_recurrent_score(spark, sf).collect()}
    assert len(got) == len(docs)
    for i, t in docs:
        r, w = got[i], split(t)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(w), sum(x in counts for x in w), n)
        assert abs(r["base_score"] - sum(log10((counts[x] + 1) / (n + v + 1)) for x in w)) < 1e-6 * len(w)
    out = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, False, "a b a", 1), (2, True, None, 2), (None, None, "", 3), (1, False, "a b a", 1)], "doc_id long, held_out boolean, text string, page int")
    got = sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"]) for r in recurrent.score(df).collect())
    assert got == [("1", 4, 4, 9), ("1", 4, 4, 9), ("2", 1, 1, 9), ("None", 1, 1, 9)]
    assert recurrent.score(df.limit(0)).count() == 0
