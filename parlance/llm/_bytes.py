"""Vectorised byte-level words and rolling fingerprints over Arrow string columns.

A word is a run of bytes other than 0x20 and 0x09-0x0D; A-Z are lowered.  All
hashes are 64-bit polynomials over a seeded byte table, so they are the same in
every task and every run.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa

# Arrow's own pool keeps what it has freed; workers share an executor's memory with its JVM.
pa.set_memory_pool(pa.system_memory_pool())

_c = ctypes.CDLL(None)


def give_back() -> None:
    """Returns what is free in this worker to the system, where its allocator can: an idle worker keeps little."""
    if hasattr(_c, "malloc_trim"):
        _c.malloc_trim(0)


U64 = np.uint64
SPACES = bytes([0x20, 9, 10, 11, 12, 13])
#: Of texts handled at once: arrays over it take some 40 times as much in a worker.
SLICE_BYTES = 1 << 19
BASE = 0x9E3779B97F4A7C15 | 1


def byte_table(seed: int) -> np.ndarray:
    """256 random 64-bit values, one for each byte."""
    return np.random.Generator(np.random.PCG64(seed)).integers(1, 2**64, 256, dtype=np.uint64)


IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WORD_TABLE = byte_table(11)[LOWER]

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, base: int = BASE) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n, kept for the process."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, SLICE_BYTES + (SLICE_BYTES >> 1))
        inverse = pow(base, -1, 2**64)
        both = []
        for b in (base, inverse):
            out = np.empty(size, U64)
            out[0] = 1
            done = 1
            while done < size:
                step = min(done, size - done)
                np.multiply(out[:step], U64(pow(b, done, 2**64)), out=out[done : done + step])
                done += step
            both.append(out)
        have = _powers[base] = (both[0], both[1])
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def text_slices(ids: pa.Array, text: pa.Array, limit: int = SLICE_BYTES):
    """Yields (ids, bytes, offsets) of consecutive rows of about ``limit`` bytes; a null text is empty.

    ids are an int64 array, or an object array of int and None where the batch has a null id.
    """
    text = text.cast(pa.large_string())
    offsets = np.frombuffer(text.buffers()[1], np.int64, len(text) + 1, text.offset * 8)
    data = np.frombuffer(text.buffers()[2], np.uint8) if text.buffers()[2] is not None else np.zeros(0, np.uint8)
    if text.null_count:
        size = np.where(np.asarray(text.is_null()), 0, np.diff(offsets))
        keep = np.repeat(size > 0, np.diff(offsets))
        data = data[offsets[0] : offsets[-1]][keep]
        offsets = np.concatenate([[0], np.cumsum(size)])
    names = np.array(ids.to_pylist(), object) if ids.null_count else ids.to_numpy()
    at = 0
    while at < len(names):
        end = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        end = min(max(end, at + 1), len(names))
        yield names[at:end], data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of each word; words never cross documents. space: the bytes between words."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~space[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = offsets[(offsets > 0) & (offsets < n)]
    first[edges] |= inside[edges]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[edges - 1] |= inside[edges - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each lowered word."""
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, U64)
    np.cumsum(WORD_TABLE[data] * up[: len(data)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(U64))


def shingles(word: np.ndarray, doc: np.ndarray, n_docs: int, k: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, document and first word of each shingle of k words; a document with fewer words has its whole sequence as one."""
    count = np.bincount(doc, minlength=n_docs) if len(doc) else np.zeros(n_docs, np.int64)
    first = np.concatenate([[0], np.cumsum(count)])
    n = len(word)
    hashed = np.zeros(max(n - k + 1, 0), U64)
    for i in range(k):
        hashed = hashed * U64(0xD6E8FEB86659FD93) + word[i : i + len(hashed)]
    at = np.arange(len(hashed))
    whole = doc[: len(hashed)] == doc[k - 1 : k - 1 + len(hashed)] if len(hashed) else np.zeros(0, bool)
    hashed, at = mix(hashed[whole]), at[whole]
    few = np.flatnonzero((count > 0) & (count < k))
    if len(few):
        short = np.zeros(len(few), U64)
        for i in range(k - 1):
            more = count[few] > i
            short[more] = short[more] * U64(0xD6E8FEB86659FD93) + word[first[few[more]] + i]
        hashed = np.concatenate([hashed, mix(short + count[few].astype(U64))])
        at = np.concatenate([at, first[few]])
        order = np.argsort(at, kind="stable")
        hashed, at = hashed[order], at[order]
    return hashed, doc[at] if len(at) else np.zeros(0, np.int64), at


def as_long(x: np.ndarray) -> np.ndarray:
    """The same bits as signed integers, for Spark's long."""
    return np.ascontiguousarray(x).view(np.int64)
