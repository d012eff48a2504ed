"""Benchmark decontamination by SimHash of item-sized windows.

A benchmark item has the fingerprint of its word shingles (64 bits, each bit the
sign of a sum over the shingles' hashes; a shingle's second, third, ... occurrence
counts as another one, so that weights don't matter and similar multisets have
similar fingerprints).  A document is read in windows of as many words as an item.
There is an index for each size of item: fingerprints are cut into four blocks of 16
bits; if two lie within ``radius`` bits, some block differs in at most radius // 4,
and each block value leads to the items of that size whose block is so near.  What
the index gives is held to the radius and then verified: the Jaccard similarity of
shingles weighted by how often each stands in the window must be at least
``threshold``.  At a similarity of 0.8 fingerprints of equal size differ in about 10
bits of 64 with a standard deviation of 3: the default radius of 20 leaves out less
than one pair in a thousand there, and none that is clearly closer.

Windows that share no shingle with any item have similarity 0 with all of them, so
only windows around shared shingles are fingerprinted; nothing else is left out.
Items are taken in blocks of ``block_items`` so that what is broadcast is bounded;
each block meets all documents.

Words are lowered runs without white space.  Items and documents without words
match nothing; fewer than five words are one shingle, so such an item matches the
same few words as a whole document only.  Null ids of either side stay null in the
result; rows with equal ids and texts count once as items and each as documents.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm._bytes import give_back, mix, shingles, text_slices, word_hashes, words

BLOCKS = 4
BITS = np.arange(64, dtype=np.uint64)


def signs(hashed: np.ndarray) -> np.ndarray:
    """+1 or -1 for each bit of each shingle's hash."""
    return (((mix(hashed ^ np.uint64(0x5851F42D4C957F2D))[:, None] >> BITS) & np.uint64(1)).astype(np.int8) << 1) - np.int8(1)


def fingerprint(sums: np.ndarray) -> np.ndarray:
    """Bytes (n, 8) of the fingerprints of rows of sums."""
    return np.ascontiguousarray(np.packbits(sums > 0, axis=-1, bitorder="little"))


def occurrences(hashed: np.ndarray) -> np.ndarray:
    """The same shingles with each further occurrence made another one."""
    order = np.argsort(hashed, kind="stable")
    head = np.concatenate([[True], hashed[order[1:]] != hashed[order[:-1]]])
    spot = np.arange(len(hashed))
    nth = np.empty(len(hashed), np.uint64)
    nth[order] = spot - np.maximum.accumulate(np.where(head, spot, 0))
    return hashed + nth * np.uint64(0x9E3779B97F4A7C15)


class Index:
    """The items of one block: shingles, fingerprints and a multi-index for each size."""

    def __init__(self, items: list[tuple[int | None, str]], radius: int, threshold: float, k: int = 5):
        self.radius, self.threshold, self.k = radius, threshold, k
        text = pa.array([t or "" for _, t in items], pa.string())
        _, data, offsets = next(text_slices(pa.array([0] * len(items)), text, 1 << 40)) if items else (None, np.zeros(0, np.uint8), np.zeros(1, np.int64))
        start, end, doc = words(data, offsets)
        hashed, owner, _ = shingles(word_hashes(data, start, end), doc, len(items), k)
        size = np.bincount(doc, minlength=len(items)) if len(doc) else np.zeros(len(items), int)
        live = np.flatnonzero(size)
        self.ids = [items[i][0] for i in live]
        self.words = size[live]
        self.weights = [Counter(hashed[owner == i].tolist()) for i in live]
        self.prints = fingerprint(np.array([signs(occurrences(hashed[owner == i])).sum(0, dtype=np.int32) for i in live]).reshape(-1, 64))
        self.shingles = np.unique(hashed)
        # which shingles the items of one size have
        self.of_size = {n: np.zeros(len(self.shingles), bool) for n in np.unique(self.words).tolist()}
        for n, own in zip(self.words.tolist(), self.weights, strict=True):
            self.of_size[n][np.searchsorted(self.shingles, np.array(list(own), np.uint64))] = True
        self.bloom = np.zeros(1 << 20, bool)
        self.bloom[(self.shingles & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        self.members = {n: np.flatnonzero(self.words == n) for n in self.of_size}
        self.tables: dict[tuple[int, int], dict[int, np.ndarray]] = {(n, b): {} for n in self.of_size for b in range(BLOCKS)}

    def near(self, size: int, block: int, value: int) -> np.ndarray:
        """The items of a size whose block is near a value; each value is looked up once and kept."""
        table = self.tables[size, block]
        if (found := table.get(value)) is None:
            if len(table) > 1 << 14:
                table.clear()
            own = self.members[size]
            blocks = self.prints[own].view(np.uint16)[:, block]
            found = table[value] = own[np.bitwise_count(blocks ^ np.uint16(value)) <= self.radius // BLOCKS]
        return found

    def shared(self, hashed: np.ndarray) -> np.ndarray:
        """The place of each shingle among the items', or -1."""
        at = np.flatnonzero(self.bloom[(hashed & np.uint64((1 << 20) - 1)).astype(np.int64)])
        i = np.minimum(np.searchsorted(self.shingles, hashed[at]), len(self.shingles) - 1)
        out = np.full(len(hashed), -1)
        out[at] = np.where(self.shingles[i] == hashed[at], i, -1)
        return out

    def matches(self, hashed: np.ndarray, place: np.ndarray, n_words: int) -> list[tuple[int, float, int, int, int]]:
        """(item, similarity, first word, words, windows) of each item that a window of one document matches best; place: from ``shared``.

        A window that matches an item of its size holds a shingle of one of that size.
        """
        common = np.flatnonzero(place >= 0)
        sizes = [n for n, own in self.of_size.items() if own[place[common]].any()]
        # sums are needed around shared shingles only, as far as the largest of those items reaches
        reach = max(sizes, default=0)
        near = np.zeros(len(hashed) + 1, np.int64)
        np.add.at(near, np.maximum(common - reach, 0), 1)
        np.add.at(near, np.minimum(common + reach, len(hashed)), -1)
        near = np.flatnonzero(np.cumsum(near[:-1]) > 0)
        order = np.argsort(hashed, kind="stable")
        before = np.full(len(hashed), -1)
        before[order[1:]] = np.where(hashed[order[1:]] == hashed[order[:-1]], order[:-1], -1)
        before = np.maximum.accumulate(before)  # a window holds a shingle twice if that of its end lies inside
        sums = np.zeros((len(near) + 1, 64), np.int32)
        np.cumsum(signs(hashed[near]), axis=0, out=sums[1:])
        found = {}
        for size in sizes:
            hits = np.zeros(len(hashed) + 1, np.int64)
            hits[common + 1] = self.of_size[size][place[common]]
            hits = np.cumsum(hits)
            span = max(size - self.k + 1, 1)
            if size > n_words or (size < self.k and size != n_words):
                continue
            start = np.arange(len(hashed) - span + 1)
            start = start[hits[start + span] > hits[start]]
            if not len(start):
                continue
            at = np.searchsorted(near, start)  # a window around a shared shingle lies in one stretch of ``near``
            prints = fingerprint(sums[at + span] - sums[at])
            for w in np.flatnonzero(before[start + span - 1] >= start).tolist():
                prints[w] = fingerprint(signs(occurrences(hashed[start[w] : start[w] + span])).sum(0, dtype=np.int32))
            pairs = []
            for b, values in enumerate(prints.view(np.uint16).T):
                got = [self.near(size, b, v) for v in values.tolist()]
                n = np.fromiter(map(len, got), np.int64, len(got))
                pairs.append(np.repeat(np.arange(len(start)), n) * len(self.ids) + np.concatenate(got))
            pairs = np.unique(np.concatenate(pairs))
            window, item = pairs // len(self.ids), pairs % len(self.ids)
            far = np.bitwise_count(prints[window] ^ self.prints[item]).sum(1)
            keep = far <= self.radius
            for w, i in zip(start[window[keep]].tolist(), item[keep].tolist(), strict=True):
                own, total = self.weights[i], int(self.weights[i].total())
                # the smaller weight sum is bounded by the shared shingles in the window
                if hits[w + span] - hits[w] < self.threshold * total:
                    continue
                here = Counter(hashed[w : w + span].tolist())
                both = sum(min(c, own[s]) for s, c in here.items() if s in own)
                score = both / (span + total - both)
                if score >= self.threshold:
                    was = found.get(i, (0.0, 0, 0))
                    found[i] = (score, w, was[2] + 1) if score > was[0] else (was[0], was[1], was[2] + 1)
        return [(i, score, w, int(self.words[i]), n) for i, (score, w, n) in sorted(found.items())]


SCHEMA = "doc_id bigint, item_id bigint, similarity double, first_word bigint, n_words bigint, n_windows bigint"
ARROW = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("similarity", pa.float64()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("n_windows", pa.int64())])


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, radius: int = 20, block_items: int = 20_000) -> DataFrame:
    """A row for each document and item that meet: the best window and the number of matching windows."""
    spark = docs.sparkSession
    blocks = max(1, -(-benchmark.count() // block_items))
    out = None
    for b in range(blocks):
        part = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b) if blocks > 1 else benchmark
        rows = part.select(F.col("item_id").cast("bigint"), "text").toArrow().to_pylist()
        held = spark.sparkContext.broadcast(Index(sorted({(r["item_id"], r["text"] or "") for r in rows}, key=lambda i: (i[0] is None, i)), radius, threshold))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            index = held.value
            for batch in batches:
                rows = []
                for ids, data, offsets in text_slices(batch.column(0), batch.column(1)) if len(index.ids) else ():
                    start, end, doc = words(data, offsets)
                    hashed, owner, _ = shingles(word_hashes(data, start, end), doc, len(ids), index.k)
                    place = index.shared(hashed)
                    if not (place >= 0).any():
                        continue
                    edge = np.searchsorted(owner, np.arange(len(ids) + 1))
                    size = np.bincount(doc, minlength=len(ids))
                    for d in np.unique(owner[place >= 0]).tolist():
                        a, e = edge[d], edge[d + 1]
                        rows += [(ids[d], index.ids[i], s, w, n, c) for i, s, w, n, c in index.matches(hashed[a:e], place[a:e], int(size[d]))]
                yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, ARROW, strict=True)], schema=ARROW)
            give_back()

        got = docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, SCHEMA)
        out = got if out is None else out.unionByName(got)
    return out



