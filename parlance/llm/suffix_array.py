"""Suffix-array removal of repeated byte strings.

``suffix_array`` sorts suffixes in linear grouping steps: suffixes stand in groups
that share a Lyndon prefix; groups are taken from the highest down, each following
its members' previous-smaller pointers to the suffixes just before, which move to
new groups above their old ones.  A second pass emits each group's order from the
sorted suffixes and the same pointers.  Nothing is renamed recursively.

``remove_repeats`` removes each byte covered by a ``width``-byte string that also
starts earlier (smaller doc_id, or same document and earlier start), judged on the
input.  Suffix arrays of a corpus do not fit a task, so the work is divided without
losing a match:

1. Each width-byte window is owned by the smallest of its k-gram hashes (the
   leftmost of equals), so equal windows have equal owners at equal places.  An
   owner with all the windows it owns is a piece.  Equal pieces are collapsed in
   their task: all but the first are repeats as a whole.
2. Pieces meet by the owner's hash.  A piece that stands alone holds no repeats.
   Equal pieces collapse again; what is left are the different pieces of an owner.
3. Those are cut into chunks of at most ``step`` windows on a grid from the owner.
   The bytes that a chunk's windows share are its key, and a chunk whose key
   stands alone is dropped.  A key with many chunks is salted over tasks.
4. Suffix arrays over the chunks of a task, in buffers of bounded size, bring equal
   windows together.  One row for each class and buffer goes on, with the digest of
   its bytes and its first place; the rest are repeats.  Classes of the same digest
   meet across buffers, and again all but the first are repeats.

Equality between buffers rests on a 128-bit digest, and of pieces on two
independent 64-bit hashes; within a buffer bytes are compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm._bytes import as_long, byte_table, mix, powers, text_slices
from parlance.llm._spark import Workspace

U64 = np.uint64
KGRAM = 32
GRAM_TABLE, PIECE_TABLE, CORE_TABLE = byte_table(21), byte_table(22), byte_table(23)
GRAM_BASE = 0xA0761D6478BD642F


def suffix_array(text: list[int]) -> list[int]:
    """Start of each suffix in order, by groups of Lyndon prefixes; all values at least 0."""
    n = len(text)
    if n < 2:
        return list(range(n))
    # groups in a list by id; up and down link them in order
    starts: dict[int, list[int]] = {}
    for i, c in enumerate(text):
        starts.setdefault(c, []).append(i)
    members = [starts[c] for c in sorted(starts)]
    size = [len(m) for m in members]
    up = list(range(1, len(members) + 1))
    up[-1] = -1
    down = list(range(-1, len(members) - 1))
    group = [0] * n
    for g, m in enumerate(members):
        for i in m:
            group[i] = g
    done = bytearray(n)
    previous = [-1] * n
    g = len(members) - 1
    while g >= 0:
        if size[g]:
            hits: dict[int, int] = {}
            if len(members[g]) > size[g]:
                members[g] = [i for i in members[g] if group[i] == g]
            own = members[g]
            own.sort()
            for i in own:
                j = i - 1
                while j >= 0 and done[j]:
                    j = previous[j]
                previous[i] = j
                done[i] = 1
                if j >= 0:
                    hits[j] = hits.get(j, 0) + 1
            if hits:
                most = max(hits.values())
                if most == 1:
                    rounds = [hits]
                else:
                    by: dict[int, list[int]] = {}
                    for j, c in hits.items():
                        by.setdefault(c, []).append(j)
                    rounds = [by[c] for c in sorted(by, reverse=True)]
                for moved in rounds:
                    split: dict[int, list[int]] = {}
                    for j in moved:
                        h = group[j]
                        if h in split:
                            split[h].append(j)
                        else:
                            split[h] = [j]
                    for h, m in split.items():
                        if len(m) == size[h]:
                            # the whole group moves: its place in the order stays, only what it shares has grown
                            continue
                        new = len(members)
                        members.append(m)
                        size.append(len(m))
                        size[h] -= len(m)
                        over = up[h]
                        up.append(over)
                        down.append(h)
                        up[h] = new
                        if over >= 0:
                            down[over] = new
                        for j in m:
                            group[j] = new
        g = down[g]
    # second pass: where each group starts, then its order from the sorted suffixes
    front = [0] * len(members)
    g = 0
    while down[g] >= 0:
        g = down[g]
    at = 1
    while g >= 0:
        front[g] = at
        at += size[g]
        g = up[g]
    order = [n] + [-1] * n
    placed = bytearray(n)
    for r in range(n + 1):
        j = order[r] - 1
        while j >= 0 and not placed[j]:
            h = group[j]
            order[front[h]] = j
            front[h] += 1
            placed[j] = 1
            j = previous[j]
    return order[1:]


def owners(data: np.ndarray, offsets: np.ndarray, width: int, k: int = KGRAM):
    """(hash, place, first window, windows) of each owner; windows lie within documents."""
    n = len(data)
    span = width - k + 1
    none = np.zeros(0, np.int64)
    if n < width:
        return np.zeros(0, U64), none, none, none
    up, down = powers(n + 1, GRAM_BASE | 1)
    total = np.zeros(n + 1, U64)
    np.cumsum(GRAM_TABLE[data] * up[:n], out=total[1:])
    h = mix((total[k:] - total[:-k]) * down[: n - k + 1])
    # high bits of the hash, low bits the distance: a minimum keeps the leftmost of equals
    low = (h >> U64(7)) << U64(7)
    size = 1
    while size * 2 <= span:
        low = np.minimum(low[:-size], low[size:] + U64(size))
        size *= 2
    if span > size:
        shift = span - size
        low = np.minimum(low[:-shift], low[shift:] + U64(shift))
    windows = n - width + 1
    own = np.arange(windows) + (low[:windows] & U64(127)).astype(np.int64)
    valid = np.ones(n + 1, bool)
    for e in offsets[1:]:  # the last width - 1 starts of each document would cross its end
        valid[max(e - width + 1, 0) : e] = False
    valid = valid[:windows]
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (own[1:] != own[:-1])
    # a document's first window starts a piece even if the byte before is in another document
    heads = offsets[:-1][offsets[:-1] < windows]
    new[heads] = valid[heads]
    first = np.flatnonzero(new)
    stop = valid.copy()
    stop[:-1] &= ~valid[1:] | new[1:]
    last = np.flatnonzero(stop)
    return h[own[first]], own[first], first, last - first + 1


def range_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, table: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each range of bytes and its length."""
    n = len(data)
    up, down = powers(n + 1)
    total = np.zeros(n + 1, U64)
    np.cumsum(table[data] * up[:n], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(U64))


PIECES = pa.schema([("h", pa.int64()), ("p", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("n", pa.int32()), ("lead", pa.int32())])
PIECE_DDL = "h bigint, p bigint, doc_id bigint, start bigint, n int, lead int"
CHUNKS = pa.schema([("h", pa.int64()), ("p", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("n", pa.int32()), ("bytes", pa.binary())])
CHUNK_DDL = "h bigint, p bigint, doc_id bigint, start bigint, n int, bytes binary"
#: In both, n is negative where the windows are known as repeats.


def batch_of(schema: pa.Schema, *cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def find_pieces(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Pieces of (doc_id, text) rows; equal pieces of a batch are collapsed to the first, neighbouring repeats to one row."""
    for batch in batches:
        parts = []
        for ids, data, offsets in text_slices(batch.column(0), batch.column(1)):
            h, place, first, n = owners(data, offsets, width)
            p = range_hashes(data, first, first + n + width - 1, PIECE_TABLE)
            doc = np.searchsorted(offsets, first, "right") - 1
            parts.append((h, p, ids[doc].astype(np.int64), first - offsets[doc], n, place - first))
        if not parts:
            continue
        h, p, doc, start, n, lead = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((start, doc, p, h))
        again = np.zeros(len(h), bool)
        again[order[1:]] = (h[order[1:]] == h[order[:-1]]) & (p[order[1:]] == p[order[:-1]])
        live = ~again
        yield batch_of(PIECES, as_long(h[live]), as_long(p[live]), doc[live], start[live], n[live], lead[live])
        doc, start, n = doc[again], start[again], n[again]
        if len(doc):
            order = np.lexsort((start, doc))
            doc, start, n = doc[order], start[order], n[order]
            head = np.ones(len(doc), bool)
            head[1:] = (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + n[:-1])
            at = np.flatnonzero(head)
            zero = np.zeros(len(at), np.int64)
            yield batch_of(PIECES, zero, zero, doc[at], start[at], -np.add.reduceat(n, at), zero)


def meet(batches: Iterator[pa.RecordBatch], alone: bool = False) -> Iterator[tuple[pa.RecordBatch, pa.RecordBatch]]:
    """From rows sorted by (h, p, doc_id, start): (rows that repeat an equal one, first rows).

    First rows are those of each different p; an h with a single p gives none unless ``alone``.
    """
    last_h = last_p = None
    pending: pa.RecordBatch | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        h, p = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        again = np.zeros(len(h), bool)
        again[1:] = (h[1:] == h[:-1]) & (p[1:] == p[:-1])
        again[0] = h[0] == last_h and p[0] == last_p
        firsts = np.flatnonzero(~again)
        send = np.zeros(len(h), bool)
        before = None
        if len(firsts):
            fh = h[firsts]
            joined = np.concatenate([[fh[0] == last_h], fh[1:] == fh[:-1]])
            use = joined.copy()
            use[:-1] |= joined[1:]
            if joined[0]:
                before = pending
            # a head at the batch's end waits for a rival; any older one has met its own by now or never will
            pending = None if use[-1] else batch.slice(int(firsts[-1]), 1)
            send[firsts] = True if alone else use
        last_h, last_p = h[-1], p[-1]
        out = [batch.filter(pa.array(send))]
        if before is not None and not alone:
            out.insert(0, before)
        repeats = batch.filter(pa.array(again))
        yield repeats, pa.Table.from_batches(out).combine_chunks().to_batches()[0] if sum(b.num_rows for b in out) else batch.slice(0, 0)


def negative(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The same rows as repeats."""
    return batch_of(batch.schema, *(-np.abs(c.to_numpy()) if f.name == "n" else c for c, f in zip(batch.columns, batch.schema, strict=True)))


def meet_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeats (n < 0) as they come or as found, and the different pieces of owners that have several."""
    known = []

    def fresh() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            repeat = batch.column(4).to_numpy() < 0
            known.append(batch.filter(pa.array(repeat)))
            yield batch.filter(pa.array(~repeat))

    for repeats, firsts in meet(fresh()):
        yield from (*known, negative(repeats), firsts)
        known.clear()
    yield from known


def cut_chunks(batches: Iterator[pa.RecordBatch], width: int, step: int) -> Iterator[pa.RecordBatch]:
    """From (doc_id, text, pieces) rows: chunks with their keys, those of a batch collapsed like pieces."""
    for batch in batches:
        rows = []
        for doc, text, pieces in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
            raw = np.frombuffer(text.as_buffer(), np.uint8)
            own = pieces.values.flatten()
            start, n, lead = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in own)
            high, low = lead // step, (lead - n + 1) // step
            count = high - low + 1
            piece = np.repeat(np.arange(len(n)), count)
            cell = high[piece] - (np.arange(len(piece)) - np.repeat(np.cumsum(count) - count, count))
            place = (start + lead)[piece]
            first = np.maximum(place - (cell + 1) * step + 1, start[piece])
            last = np.minimum(place - cell * step, (start + n - 1)[piece])
            core = place - cell * step
            key = mix(range_hashes(raw, core, core - step + 1 + width, CORE_TABLE) + cell.astype(U64))
            body = range_hashes(raw, first, last + width, PIECE_TABLE) + (place - first).astype(U64)
            rows.append((key, body, np.full(len(key), doc, np.int64), first, last - first + 1, [raw[a:b].tobytes() for a, b in zip(first.tolist(), (last + width).tolist(), strict=True)]))
        if not rows:
            continue
        key, body, doc, start, n = (np.concatenate([r[i] for r in rows]) for i in range(5))
        raw = np.array([b for r in rows for b in r[5]], object)
        order = np.lexsort((start, doc, body, key))
        key, body, doc, start, n, raw = (x[order] for x in (key, body, doc, start, n, raw))
        again = np.zeros(len(key), bool)
        again[1:] = (key[1:] == key[:-1]) & (body[1:] == body[:-1])
        n[again] *= -1
        raw[again] = None
        yield batch_of(CHUNKS, as_long(key), as_long(body), doc, start, n, raw.tolist())


class Sorter:
    """Suffix arrays over buffers of chunks."""

    def __init__(self, width: int, buffer: int):
        self.width, self.buffer = width, buffer
        self._clear()

    def _clear(self) -> None:
        self.rows: list[tuple] = []
        self.size = 0

    def add(self, doc: int, start: int, raw: bytes, split: bool) -> None:
        """split: windows equal to this chunk's may be in other buffers."""
        self.rows.append((doc, start, raw, split))
        self.size += len(raw) + 1

    def full(self) -> bool:
        return self.size >= self.buffer

    def flush(self) -> Iterator[pa.RecordBatch]:
        """Repeats (n < 0) and classes to go on (n = 1, their digest as h and p)."""
        if not self.rows:
            return
        text = np.zeros(self.size, np.int64)
        size = np.array([len(r[2]) for r in self.rows])
        begin = np.cumsum(size + 1) - size - 1
        inside = np.ones(self.size, bool)
        inside[begin + size] = False
        data = np.frombuffer(b"".join(r[2] for r in self.rows), np.uint8)
        text[inside] = data.astype(np.int64) + 1
        order = np.array(suffix_array(text.tolist()))
        chunk = np.repeat(np.arange(len(self.rows)), size + 1)
        at = order[(order - begin[chunk[order]]) <= (size - self.width)[chunk[order]]]
        if not len(at):
            self._clear()
            return
        bytes_ = np.zeros(self.size + self.width, np.uint8)
        bytes_[: self.size][inside] = data
        rows = np.lib.stride_tricks.sliding_window_view(bytes_, self.width)[at]
        head = np.ones(len(at), bool)
        head[1:] = (rows[1:] != rows[:-1]).any(1)
        doc = np.array([r[0] for r in self.rows], np.int64)[chunk[at]]
        start = np.array([r[1] for r in self.rows], np.int64)[chunk[at]] + at - begin[chunk[at]]
        cls = np.cumsum(head) - 1
        by = np.lexsort((start, doc, cls))
        first = np.ones(len(at), bool)
        first[1:] = cls[by][1:] != cls[by][:-1]
        repeat = by[~first]
        zero = np.zeros(len(repeat), np.int64)
        yield batch_of(CHUNKS, zero, zero, doc[repeat], start[repeat], np.full(len(repeat), -1), [None] * len(repeat))
        split = np.array([r[3] for r in self.rows])[chunk[at]]
        on = by[first][split[by[first]]]
        if len(on):
            digest = np.frombuffer(b"".join(hashlib.blake2b(rows[i].tobytes(), digest_size=16).digest() for i in on), np.int64).reshape(-1, 2)
            yield batch_of(CHUNKS, digest[:, 0].copy(), digest[:, 1].copy(), doc[on], start[on], np.ones(len(on)), [None] * len(on))
        self._clear()


def sort_chunks(batches: Iterator[pa.RecordBatch], width: int, buffer: int) -> Iterator[pa.RecordBatch]:
    """From chunks sorted by (h, p, doc_id, start), with salts: repeats, and first rows of classes that may go on elsewhere."""
    sorter = Sorter(width, buffer)
    last, broken = None, False
    for repeats, firsts in meet(batches, alone=True):
        yield batch_of(CHUNKS, *negative(repeats).columns[:5], pa.nulls(repeats.num_rows, pa.binary()))
        for h, doc, start, raw, salts in zip(*(firsts.column(i).to_pylist() for i in (0, 2, 3, 5, 6)), strict=True):
            if h != last:
                if sorter.full():
                    yield from sorter.flush()
                last, broken = h, salts > 1
            elif sorter.size >= 4 * sorter.buffer:
                # one key fills more than a buffer: it goes on in the next
                sorter.rows = [(*r[:3], True) for r in sorter.rows]
                broken = True
                yield from sorter.flush()
            sorter.add(doc, start, raw, broken)
    yield from sorter.flush()


def remove_repeats(docs: DataFrame, width: int = 100, step: int = 16, salt_rows: int = 2048, buffer: int = 1 << 17) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (start, end): what stays and what goes of each document.

    Null texts are empty.  A null doc_id has no place in the order: such rows keep their
    whole text and take nothing from others.  Rows that share a doc_id count as one
    document after the other only if their texts differ in nothing; give unique ids.
    """
    work = Workspace(docs.sparkSession, "suffixes")
    texts = docs.select(F.col("doc_id").cast("bigint"), F.coalesce("text", F.lit("")).alias("text"))
    by = F.when(F.col("n") < 0, F.xxhash64("doc_id", "start")).otherwise(F.col("h"))
    pieces = texts.where("doc_id is not null").mapInArrow(lambda it: find_pieces(it, width), PIECE_DDL)
    sorted_pieces = pieces.repartition(by).sortWithinPartitions("h", "p", "doc_id", "start")
    met = work.table(sorted_pieces.mapInArrow(meet_pieces, PIECE_DDL), "pieces")

    wanted = met.where("n > 0").groupBy("doc_id").agg(F.collect_list(F.struct("start", "n", "lead")).alias("pieces"))
    chunks = texts.join(wanted, "doc_id").select("doc_id", "text", "pieces")
    chunks = work.table(chunks.mapInArrow(lambda it: cut_chunks(it, width, step), CHUNK_DDL), "chunks")

    live = chunks.where("n > 0")
    salts = live.groupBy("h").agg(F.count("*").alias("_n")).where("_n > 1").select("h", F.ceil(F.col("_n") / salt_rows).cast("int").alias("salts"))
    salted = live.join(salts, "h").repartition("h", F.pmod("p", "salts")).sortWithinPartitions("h", "p", "doc_id", "start")
    classes = work.table(salted.mapInArrow(lambda it: sort_chunks(it, width, buffer), CHUNK_DDL), "classes")

    over = Window.partitionBy("h", "p").orderBy("doc_id", "start")
    later = classes.where("n > 0").withColumn("_r", F.row_number().over(over)).where("_r > 1")
    every = [t.where("n < 0").select("doc_id", "start", F.abs("n").alias("n")) for t in (met, chunks, classes)]
    every.append(later.select("doc_id", "start", "n"))
    spans = every[0].unionByName(every[1]).unionByName(every[2]).unionByName(every[3])
    spans = spans.groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias("found"))
    out = texts.join(spans, "doc_id", "left").select("doc_id", "text", "found")
    ddl = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<struct<start: bigint, end: bigint>>"
    return out.mapInArrow(lambda it: keep_rest(it, width), ddl)


def keep_rest(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """From (doc_id, text, found windows): the maximal removed runs and the digest of the bytes that stay."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        sizes, removed, shas, runs = [], [], [], []
        for text, found in zip(batch.column(1), batch.column(2), strict=True):
            raw = memoryview(text.as_buffer())
            own: list[dict] = []
            if found.is_valid:
                start, n = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in found.values.flatten())
                order = np.argsort(start, kind="stable")
                start, end = start[order], np.maximum.accumulate((start + n + width - 1)[order])
                head = np.ones(len(start), bool)
                head[1:] = start[1:] > end[:-1]
                at = np.flatnonzero(head)
                own = [{"start": a, "end": b} for a, b in zip(start[at].tolist(), end[np.append(at[1:], len(end)) - 1].tolist(), strict=True)]
            sha, last = hashlib.sha256(), 0
            for r in own:
                sha.update(raw[last : r["start"]])
                last = r["end"]
            sha.update(raw[last:])
            sizes.append(len(raw))
            removed.append(sum(r["end"] - r["start"] for r in own))
            shas.append(sha.hexdigest())
            runs.append(own)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array([len(r) for r in runs], pa.int64()), pa.array(shas, pa.string()), pa.array(runs, span)],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"],
        )
