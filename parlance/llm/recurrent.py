"""Language-model scoring with a gated recurrent network.

Words (A-Z lowered) and one end token a document feed a GRU written in numpy.  Its
output is factored: a softmax over classes, then one over a class's words.  The
``vocabulary`` most frequent tokens fall into classes of similar probability mass;
all other words belong to one of ``buckets`` classes by their last two bytes, and
within such a class a word has the share (c + 1) / (n + v + 1) of its count among
the class's n training tokens of v kinds, so unseen words are scored as well.

Counts cover all training tokens, and so does training, in one pass by truncated
backpropagation: each training document is read once from its first token to its
end, in windows with the state carried from one to the next.  The pass has
``rounds`` parts, each with other documents; shards train at the same time from the
same parameters, which are averaged by tokens after each part, in two levels, so
that the driver gets a bounded number of them.  Output biases start at the classes'
and words' frequencies.

Scoring carries the state across windows through the whole document; documents of
similar length run side by side.  A null or empty text is its end token alone.

Documents are kept in pages: the distinct word hashes of a run of documents, sorted,
and for each token its place among them.  Counts go from pages to a table and back
to the pages that need them by joins; no table of words is broadcast but the
vocabulary, whose size is a parameter.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm._bytes import LOWER, as_long, mix, text_slices, word_hashes, words
from parlance.llm._spark import Workspace

U64 = np.uint64
END = U64(0x656E64)
PAGE = "page bigint, kinds binary, endings binary, ids binary, held binary, lengths binary, codes binary"
F32 = np.float32


def make_pages(batches: Iterator[pa.RecordBatch], buckets: int, page_bytes: int) -> Iterator[pa.RecordBatch]:
    """Pages of (doc_id, held_out, text) rows."""
    ids, held, hashes, ends, lengths, size = [], [], [], [], [], 0

    def close() -> pa.RecordBatch:
        nonlocal ids, held, hashes, ends, lengths, size
        token, ending = np.concatenate(hashes), np.concatenate(ends)
        coded = pa.array(token).dictionary_encode()  # by a hash table: only the kinds are sorted
        kinds, codes = coded.dictionary.to_numpy(), coded.indices.to_numpy()
        order = np.argsort(kinds)
        place = np.empty(len(kinds), np.int32)
        place[order] = np.arange(len(kinds), dtype=np.int32)
        kinds, codes = kinds[order], place[codes]
        tail = np.empty(len(kinds), np.uint8)
        tail[codes] = ending
        parts = [as_long(kinds).tobytes(), tail.tobytes(), np.concatenate(ids).tobytes(), np.concatenate(held).tobytes(), np.concatenate(lengths).astype(np.int32).tobytes(), codes.tobytes()]
        page = struct.unpack("<q", hashlib.blake2b(parts[2] + parts[5], digest_size=8).digest())[0]
        ids, held, hashes, ends, lengths, size = [], [], [], [], [], 0
        return pa.RecordBatch.from_arrays([pa.array([page]), *(pa.array([p], pa.binary()) for p in parts)], ["page", "kinds", "endings", "ids", "held", "lengths", "codes"])

    for batch in batches:
        # bit 0: held out, bit 1: null id
        flags, at = batch.column(1).to_numpy(zero_copy_only=False).astype(np.uint8) | np.asarray(batch.column(0).is_null()).astype(np.uint8) << 1, 0
        for names, data, offsets in text_slices(batch.column(0).fill_null(0), batch.column(2)):
            n = len(names)
            start, end, doc = words(data, offsets)
            h = word_hashes(data, start, end)
            tail = LOWER[data[np.maximum(end - 2, start)]].astype(U64) * U64(256) + LOWER[data[end - 1]]
            count = np.bincount(doc, minlength=n) if n else np.zeros(0, np.int64)
            spot = np.cumsum(count)
            hashes.append(np.insert(h, spot, END))
            ends.append(np.insert((mix(tail) % U64(buckets)).astype(np.uint8), spot, 0))
            ids.append(names.astype(np.int64))
            held.append(flags[at : at + n])
            lengths.append(count + 1)
            at += n
            size += len(data)
            if size >= page_bytes:
                yield close()
    if ids:
        yield close()


def open_page(row: dict) -> dict:
    return {
        "kinds": np.frombuffer(row["kinds"], U64), "endings": np.frombuffer(row["endings"], np.uint8).astype(np.int32), "ids": np.frombuffer(row["ids"], np.int64),
        "held": np.frombuffer(row["held"], np.uint8) & 1 == 1, "null": np.frombuffer(row["held"], np.uint8) > 1, "lengths": np.frombuffer(row["lengths"], np.int32).astype(np.int64), "codes": np.frombuffer(row["codes"], np.int32),
    }


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {n: batch.column(k)[i].as_py() for k, n in enumerate(batch.schema.names)}


def count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(page, token, ending, n) with the training tokens of each kind on each page."""
    for row in rows_of(batches):
        p = open_page(row)
        train = np.repeat(~p["held"], p["lengths"])
        n = np.bincount(p["codes"][train], minlength=len(p["kinds"]))
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), row["page"])), pa.array(as_long(p["kinds"])), pa.array(p["endings"].astype(np.int16)), pa.array(n)], ["page", "token", "ending", "n"])


class Shape:
    """Vocabulary and classes: fixed by counts, shared by all."""

    def __init__(self, tokens: np.ndarray, counts: np.ndarray, classes: int, bucket_n: np.ndarray, bucket_v: np.ndarray):
        """tokens by falling count; bucket_n, bucket_v: tokens and kinds outside the vocabulary in each bucket."""
        order = np.argsort(tokens)
        self.hashes, self.word_of = tokens[order], order.astype(np.int32)
        self.end = int(np.flatnonzero(tokens == END)[0]) if (tokens == END).any() else 0
        self.v = len(tokens)
        mass = np.sqrt(counts.astype(float) + 1)
        self.word_class = np.minimum((np.cumsum(mass) - mass) / mass.sum() * classes, classes - 1).astype(np.int32) if self.v else np.zeros(0, np.int32)
        self.word_class = np.unique(self.word_class, return_inverse=True)[1].astype(np.int32).ravel()
        self.own = int(self.word_class.max()) + 1 if self.v else 0
        self.first = np.searchsorted(self.word_class, np.arange(self.own + 1))
        self.buckets = len(bucket_n)
        self.classes = self.own + self.buckets
        self.left = (bucket_n + bucket_v + 1).astype(float)
        class_n = np.concatenate([np.bincount(self.word_class, counts, self.own) if self.v else [], bucket_n]) + 1
        self.class_bias = np.log(class_n / class_n.sum()).astype(F32)
        self.word_bias = np.log(counts + 1.0).astype(F32)

    def words_of(self, kinds: np.ndarray, endings: np.ndarray) -> np.ndarray:
        """Input symbol of each kind: a vocabulary place, or v + bucket."""
        if not self.v:
            return endings.astype(np.int32)
        i = np.minimum(np.searchsorted(self.hashes, kinds), self.v - 1)
        return np.where(self.hashes[i] == kinds, self.word_of[i], self.v + endings).astype(np.int32)


class Network:
    """GRU with a class-factored softmax; all parameters lie in one flat array."""

    def __init__(self, shape: Shape, hidden: int, flat: np.ndarray | None = None, seed: int = 5):
        self.shape, self.hidden = shape, hidden
        sizes = [(shape.v + shape.buckets, 3 * hidden), (hidden, 3 * hidden), (3 * hidden,), (shape.classes, hidden), (shape.classes,), (max(shape.v, 1), hidden), (max(shape.v, 1),)]
        total = sum(int(np.prod(s)) for s in sizes)
        self.flat = np.zeros(total, F32) if flat is None else flat.astype(F32).copy()
        self.views, at = [], 0
        for s in sizes:
            n = int(np.prod(s))
            self.views.append(self.flat[at : at + n].reshape(s))
            at += n
        self.sizes = sizes
        if flat is None:
            rnd = np.random.Generator(np.random.PCG64(seed))
            self.views[0][:] = rnd.normal(0, 0.3, sizes[0])
            self.views[1][:] = rnd.normal(0, 0.5 / np.sqrt(hidden), sizes[1])
            self.views[3][:] = rnd.normal(0, 0.02, sizes[3])
            self.views[4][:] = shape.class_bias
            self.views[5][:] = rnd.normal(0, 0.02, sizes[5])
            if shape.v:
                self.views[6][:] = shape.word_bias

    def step(self, symbols: np.ndarray, h: np.ndarray, x: np.ndarray | None = None):
        """One step: gates and the new state; x: the symbols' rows of the input table with the bias, if at hand."""
        table, u, bias = self.views[:3]
        k = self.hidden
        a = table[symbols] + bias if x is None else x
        b = h @ u
        gates = a[:, : 2 * k] + b[:, : 2 * k]
        np.negative(gates, out=gates)
        np.exp(gates, out=gates)
        gates += 1
        np.reciprocal(gates, out=gates)
        z, r = gates[:, :k], gates[:, k:]
        hu = b[:, 2 * k :]
        n = np.tanh(a[:, 2 * k :] + r * hu)
        return z, r, n, hu, n + z * (h - n)

    def classes_of(self, symbols: np.ndarray) -> np.ndarray:
        s = self.shape
        out = symbols - s.v + s.own
        inside = symbols < s.v
        out[inside] = s.word_class[symbols[inside]]
        return out

    def biased(self) -> tuple[np.ndarray, np.ndarray, bool]:
        """Output weights of classes and words with the bias as one more column, and whether every logit is small enough for a plain exponential."""
        cw, cb, ww, wb = self.views[3:]
        both = np.concatenate([cw, cb[:, None]], 1), np.concatenate([ww, wb[:, None]], 1)
        return *both, all(np.abs(w).sum(1).max(initial=0) < 80 for w in both)  # states lie within -1 and 1

    def log_probabilities(self, h: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """Natural log-probability of each next symbol; of other words, that of their class."""
        s = self.shape
        cls = self.classes_of(symbols)
        order = np.argsort(_short(cls, s.classes), kind="stable")
        edge = np.searchsorted(cls[order], np.arange(s.own + 1))
        symbols, cls = symbols[order], cls[order]
        h = np.concatenate([h[order], np.ones((len(h), 1), F32)], 1)
        cw, ww, small = self.biased()
        got = np.einsum("ij,ij->i", h, cw[cls]).astype(np.float64)
        for at in range(0, len(h), ROWS):
            got[at : at + ROWS] -= _log_total(h[at : at + ROWS] @ cw.T, small)
        inside = int(edge[-1])
        got[:inside] += np.einsum("ij,ij->i", h[:inside], ww[symbols[:inside]])
        for c in range(s.own):
            lo, hi, a, b = edge[c], edge[c + 1], s.first[c], s.first[c + 1]
            if hi > lo:
                got[lo:hi] -= _log_total(h[lo:hi] @ ww[a:b].T, small)
        out = np.empty(len(h))
        out[order] = got
        return out

    def train_window(self, inputs: np.ndarray, targets: np.ndarray, h: np.ndarray, fresh: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, float]:
        """Gradient (flat), last state and loss of a window (steps, lanes); targets below 0 don't count, the state is 0 before ``fresh`` ones."""
        s, k, (table, u, bias) = self.shape, self.hidden, self.views[:3]
        steps, lanes = inputs.shape
        on = None if fresh is None or not fresh.any() else (~fresh[:, :, None]).astype(F32)
        x = table[inputs]
        x += bias
        starts, states = np.empty((steps, lanes, k), F32), np.empty((steps, lanes, k), F32)
        z, r, n, hu = (np.empty((steps, lanes, k), F32) for _ in range(4))
        for t in range(steps):
            starts[t] = h if on is None else h * on[t]
            z[t], r[t], n[t], hu[t], h = self.step(inputs[t], starts[t], x[t])
            states[t] = h
        grad = np.zeros_like(self.flat)
        g, at = [], 0
        for size in self.sizes:
            width = int(np.prod(size))
            g.append(grad[at : at + width].reshape(size))
            at += width
        # tokens by the class of their target
        live = np.flatnonzero(targets.ravel() >= 0)
        symbols = targets.ravel()[live]
        cls = self.classes_of(symbols)
        order = np.argsort(_short(cls, s.classes), kind="stable")
        live, symbols, cls = live[order], symbols[order], cls[order]
        edge = np.searchsorted(cls, np.arange(s.own + 1))
        out = np.concatenate([states.reshape(-1, k)[live], np.ones((len(live), 1), F32)], 1)
        cw, ww, small = self.biased()
        dout, loss, gc, gw = np.empty((len(live), k + 1), F32), 0.0, np.zeros_like(cw), np.zeros_like(ww)
        for at in range(0, len(live), ROWS):
            part = out[at : at + ROWS]
            p, lost = _residual(part @ cw.T, cls[at : at + ROWS], small)
            loss += lost
            gc += p.T @ part
            np.matmul(p, cw, out=dout[at : at + ROWS])
        for c in range(s.own):
            lo, hi, a, b = edge[c], edge[c + 1], s.first[c], s.first[c + 1]
            if hi > lo and b - a > 1:
                q, lost = _residual(out[lo:hi] @ ww[a:b].T, symbols[lo:hi] - a, small)
                loss += lost
                gw[a:b] = q.T @ out[lo:hi]
                dout[lo:hi] += q @ ww[a:b]
        g[3][:], g[4][:], g[5][:], g[6][:] = gc[:, :k], gc[:, k], gw[:, :k], gw[:, k]
        dstates = np.zeros((steps * lanes, k), F32)
        dstates[live] = dout[:, :k]
        dstates = dstates.reshape(steps, lanes, k)
        dh = np.zeros((lanes, k), F32)
        da, db = np.empty((steps, lanes, 3 * k), F32), np.empty((steps, lanes, 3 * k), F32)
        to_z, to_n, to_r = (starts - n) * z * (1 - z), (1 - z) * (1 - n * n), hu * r * (1 - r)
        back = np.ascontiguousarray(u.T)
        for t in range(steps - 1, -1, -1):
            d = dstates[t] + dh
            dn = d * to_n[t]
            gates = db[t]
            np.multiply(d, to_z[t], out=gates[:, :k])
            np.multiply(dn, to_r[t], out=gates[:, k : 2 * k])
            np.multiply(dn, r[t], out=gates[:, 2 * k :])
            da[t, :, 2 * k :] = dn
            dh = d * z[t]
            dh += gates @ back
            if on is not None:
                dh *= on[t]
        da[:, :, : 2 * k] = db[:, :, : 2 * k]
        g[1][:] = starts.reshape(-1, k).T @ db.reshape(-1, 3 * k)
        flat = da.reshape(-1, 3 * k)
        g[2][:] = flat.sum(0)
        order = np.argsort(_short(inputs.ravel(), len(table)), kind="stable")
        sorted_inputs = inputs.ravel()[order]
        edge = np.flatnonzero(np.concatenate([[True], sorted_inputs[1:] != sorted_inputs[:-1]]))
        g[0][sorted_inputs[edge]] = np.add.reduceat(flat[order], edge, axis=0)
        grad /= max(len(live), 1)
        return grad, h, float(loss)


def _short(x: np.ndarray, size: int) -> np.ndarray:
    """Numbers below size as 16-bit ones if they fit: those sort by radix."""
    return x.astype(np.uint16) if size <= 1 << 16 else x


#: Rows of logits at once: they stay in a core's cache.
ROWS = 1024
#: Times a window's steps where few lanes are left.
STRETCH = 8


def _log_total(logits: np.ndarray, small: bool) -> np.ndarray:
    """Logarithm of the sum of exponentials of each row, in place."""
    top = 0 if small else logits.max(1)
    if not small:
        logits -= top[:, None]
    np.exp(logits, out=logits)
    return np.log(logits.sum(1)).astype(np.float64) + top


def _residual(logits: np.ndarray, pick: np.ndarray, small: bool) -> tuple[np.ndarray, float]:
    """Softmax less one at each row's pick, in place, and the loss."""
    rows = np.arange(len(pick))
    if not small:
        logits -= logits.max(1, keepdims=True)
    np.exp(logits, out=logits)
    logits *= (1 / logits.sum(1))[:, None]
    loss = -float(np.log(np.maximum(logits[rows, pick], F32(1e-20))).sum(dtype=np.float64))
    logits[rows, pick] -= 1
    return logits, loss


class Adam:
    def __init__(self, n: int, rate: float):
        self.m, self.v, self.t, self.rate = np.zeros(n, F32), np.zeros(n, F32), 0, rate

    def update(self, flat: np.ndarray, grad: np.ndarray) -> None:
        self.t += 1
        part = grad - self.m
        part *= F32(0.1)
        self.m += part
        np.multiply(grad, grad, out=part)
        part -= self.v
        part *= F32(0.01)
        self.v += part
        rate = self.rate * np.sqrt(1 - 0.99**self.t) / (1 - 0.9**self.t)
        np.sqrt(self.v, out=part)
        part += F32(1e-6)
        np.divide(self.m, part, out=part)
        part *= F32(rate)
        flat -= part


def fill_lanes(length: np.ndarray, docs: np.ndarray, lanes: int) -> list[list[int]]:
    """Deals documents to at most so many lanes of about equal length, in their order within each; longest lane first."""
    heap, own = [(0, k) for k in range(min(lanes, len(docs)))], {}
    for d in docs[np.argsort(-length[docs], kind="stable")].tolist():
        n, k = heapq.heappop(heap)
        own[d] = k
        heapq.heappush(heap, (n + int(length[d]), k))
    out = [[] for _ in heap]
    for d in docs.tolist():
        out[own[d]].append(d)
    return sorted(out, key=lambda lane: -int(length[lane].sum()))


class Lanes:
    """Documents end to end in lanes, the longest first; ``target`` holds all lanes one after another."""

    def __init__(self, symbols: np.ndarray, length: np.ndarray, docs: np.ndarray, lanes: int, end: int):
        queues = fill_lanes(length, docs, lanes)
        self.docs = np.concatenate(queues)
        size = length[self.docs]
        edge = np.cumsum(size) - size
        first = np.cumsum(length) - length
        self.target = symbols[np.repeat(first[self.docs] - edge, size) + np.arange(int(size.sum()))]
        self.fresh = np.zeros(len(self.target), bool)
        self.fresh[edge] = True
        self.before = np.where(self.fresh, end, np.roll(self.target, 1))
        self.total = np.array([int(length[q].sum()) for q in queues])
        self.base = np.cumsum(self.total) - self.total

    def windows(self, window: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(place in ``target``, whether the lane still goes on) of each step and lane.

        A lane of one long document goes on alone: where few are left, windows have up to
        STRETCH times the steps, so that they stay about as large.
        """
        t = 0
        while t < self.total[0]:
            n = int(np.searchsorted(-self.total, -t, "left"))  # lanes longer than t stand first
            steps = min(window * min(STRETCH, max(1, len(self.total) // n)), int(self.total[0]) - t)
            step = t + np.arange(steps)[:, None]
            yield self.base[:n] + np.minimum(step, self.total[:n] - 1), step < self.total[:n]
            t += steps


def train_page(net: Network, page: dict, turn: int, rounds: int, window: int, lanes: int, adam: Adam) -> int:
    """Trains on a page's training documents of this round, each from its first token to its end; returns the tokens seen."""
    symbols = net.shape.words_of(page["kinds"], page["endings"])[page["codes"]]
    length = page["lengths"]
    spread = mix(page["ids"].astype(np.int64).view(U64) + U64(1))
    docs = np.flatnonzero(~page["held"] & (length > 0) & (spread % U64(rounds) == U64(turn)))
    if not len(docs):
        return 0
    line = Lanes(symbols, length, docs[np.argsort(spread[docs], kind="stable")], lanes, net.shape.end)
    h = np.zeros((len(line.total), net.hidden), F32)
    enough = len(line.total) * window // 2  # few lanes left: several windows make an update
    held, tokens, left = np.zeros_like(net.flat), 0, len(line.target)
    for at, inside in line.windows(window):
        grad, h, _ = net.train_window(line.before[at], np.where(inside, line.target[at], -1), h[: at.shape[1]], line.fresh[at] & inside)
        seen = int(inside.sum())
        grad *= F32(seen)
        held += grad
        tokens += seen
        left -= seen
        if tokens >= enough or not left:
            held /= F32(tokens)
            norm = float(np.sqrt(held @ held))
            held *= F32(min(1.0, 1.0 / max(norm, 1e-6)))
            adam.update(net.flat, held)
            held[:], tokens = 0, 0
    return len(line.target)


def score_page(net: Network, symbols: np.ndarray, length: np.ndarray, lanes: int, window: int) -> np.ndarray:
    """Sum of natural log-probabilities of each document's symbols.

    A page has no more lanes than end at about the same time: the longest document bounds the steps.
    """
    out = np.zeros(len(length))
    docs = np.flatnonzero(length > 0)
    if not len(docs):
        return out
    lanes = min(lanes, max(64, -(-int(length.sum()) // int(length.max()))))
    line = Lanes(symbols, length, docs, lanes, net.shape.end)
    owner = np.repeat(line.docs, length[line.docs])
    h = np.zeros((len(line.total), net.hidden), F32)
    for at, inside in line.windows(window):
        steps, n = at.shape
        x = net.views[0][line.before[at]]
        x += net.views[2]
        on = (~line.fresh[at][:, :, None]).astype(F32)
        h, states = h[:n], np.empty((steps, n, net.hidden), F32)
        for t in range(steps):
            h = states[t] = net.step(line.before[at[t]], h * on[t], x[t])[-1]
        place = at[inside]
        got = net.log_probabilities(states[inside], line.target[place])
        out += np.bincount(owner[place], got, len(length))
    return out


def average(spark, params: DataFrame, size: int, groups: int = 8) -> np.ndarray:
    """The mean of (weight, params) rows, summed in ``groups`` tasks before the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, weight = np.zeros(size), 0.0
        for row in rows_of(batches):
            total += np.frombuffer(row["params"], F32).astype(np.float64) * row["weight"]
            weight += row["weight"]
        yield pa.RecordBatch.from_arrays([pa.array([weight]), pa.array([total.tobytes()], pa.binary())], ["weight", "params"])

    parts = params.repartition(groups).mapInArrow(add, "weight double, params binary").toArrow().to_pylist()
    weight = sum(p["weight"] for p in parts)
    return (sum(np.frombuffer(p["params"]) for p in parts) / max(weight, 1e-9)).astype(F32) if weight else np.zeros(0, F32)


def score(docs: DataFrame, held_out: str = "held_out", vocabulary: int = 4096, classes: int = 40, buckets: int = 24, hidden: int = 16, rounds: int = 2, window: int = 32, lanes: int = 384, rate: float = 0.02, page_bytes: int = 32 << 20) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document of (doc_id, held_out, text)."""
    spark = docs.sparkSession
    work = Workspace(spark, "recurrent")
    rows = docs.select(F.col("doc_id").cast("bigint"), F.coalesce(F.col(held_out), F.lit(False)).alias("held_out"), "text")
    pages = work.table(rows.mapInArrow(lambda it: make_pages(it, buckets, page_bytes), PAGE), "pages")
    counted = work.table(pages.mapInArrow(count_rows, "page bigint, token bigint, ending smallint, n bigint"), "counted")
    totals = work.table(counted.groupBy("token").agg(F.sum("n").alias("c"), F.min("ending").alias("ending")), "totals")
    work.release()
    known = totals.where("c > 0")
    n_train, v_train = known.agg(F.sum("c"), F.count("*")).first()
    n_train, v_train = n_train or 0, v_train or 0
    top = known.orderBy(F.desc("c"), "token").limit(vocabulary).toArrow()
    tokens, counts = top["token"].to_numpy().view(U64), top["c"].to_numpy()
    per = known.groupBy("ending").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()
    bucket_n, bucket_v = np.zeros(buckets), np.zeros(buckets)
    for r in per:
        bucket_n[r["ending"]], bucket_v[r["ending"]] = r["n"], r["v"]
    endings = top["ending"].to_numpy().astype(int)
    bucket_n -= np.bincount(endings, counts, buckets) if len(endings) else 0
    bucket_v -= np.bincount(endings, minlength=buckets) if len(endings) else 0
    shape = Shape(tokens, counts, classes, bucket_n, bucket_v)
    flat = Network(shape, hidden).flat
    for turn in range(rounds):
        held = spark.sparkContext.broadcast((shape, flat))

        def learn(batches: Iterator[pa.RecordBatch], held=held, turn=turn) -> Iterator[pa.RecordBatch]:
            for row in rows_of(batches):
                net = Network(held.value[0], hidden, held.value[1])
                seen = train_page(net, open_page(row), turn, rounds, window, lanes, Adam(len(net.flat), rate / (1 + turn)))
                if seen:
                    yield pa.RecordBatch.from_arrays([pa.array([float(seen)]), pa.array([net.flat.tobytes()], pa.binary())], ["weight", "params"])

        trained = work.table(pages.mapInArrow(learn, "weight double, params binary"), f"trained_{turn}")
        got = average(spark, trained, len(flat))
        work.drop(f"trained_{turn}")
        work.release()
        flat = got if len(got) else flat
    held = spark.sparkContext.broadcast((shape, flat))
    needed = counted.select("page", "token").join(totals.select("token", "c"), "token")
    ddl = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        shape, flat = held.value
        net = Network(shape, hidden, flat)
        token, c = right["token"].to_numpy(), right["c"].to_numpy()
        out = []
        for row in left.to_pylist():
            p = open_page(row)
            order = np.argsort(token.view(U64))
            c_kind = c[order][np.searchsorted(token.view(U64)[order], p["kinds"])]
            symbols = shape.words_of(p["kinds"], p["endings"])
            base = np.log10((c_kind + 1) / (n_train + v_train + 1))
            rest = np.where(symbols >= shape.v, np.log((c_kind + 1) / shape.left[p["endings"]]), 0.0)
            doc = np.repeat(np.arange(len(p["ids"])), p["lengths"])
            n = len(p["ids"])
            model = score_page(net, symbols[p["codes"]], p["lengths"], 512, 64) + np.bincount(doc, rest[p["codes"]], n)
            out.append(pa.table({
                "doc_id": pa.array(p["ids"], mask=p["null"]), "held_out": pa.array(p["held"]), "n_tokens": p["lengths"],
                "n_known": np.bincount(doc, c_kind[p["codes"]] > 0, n).astype(np.int64), "train_tokens": np.full(n, n_train),
                "base_score": np.bincount(doc, base[p["codes"]], n), "score": model / np.log(10),
            }))
        return pa.concat_tables(out) if out else pa.table({k: [] for k in ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")})

    return pages.groupBy("page").cogroup(needed.groupBy("page")).applyInArrow(run, ddl)
