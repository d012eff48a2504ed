"""Token-ID output: a wavelet matrix for each shard, written and read as one file format.

A shard holds the ids of consecutive documents in ascending doc_id order.  Its
payload is a header, the document ids (with a bit for each that is not null) and lengths, and one bit-plane for each bit
of an id (highest first) with the zeros of each plane and the number of ones
before every 512 bits.  From that alone one can decode all ids, read the id at a
place, count an id in a range and list its places.

Shards are binary rows that Spark writes to Parquet, compressed with zstd: the files
go through Spark's file systems and commit protocol, so tasks can be lost and repeated.  Empty and
null texts have the end id alone; rows that share a doc_id keep the order of their
texts.  A document longer than ``shard_tokens`` makes a shard of its own.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm._bytes import give_back
from parlance.llm._spark import Workspace

MAGIC = b"PWM1"
BLOCK = 512
ODD_SPACE = re.compile(r"[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f\u2060\u3000\ufeff]")
ODD_ASCII = "\x0b\x0c\x1c\x1d\x1e\x1f"
LETTER, MARK = r"A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff", r".,;:!?#&$%*|()+=/\x22\-"
SINGLE = re.compile(f" ?(?:[{LETTER}]+|[0-9]+|[{MARK}]+)").fullmatch
# Kinds of bytes; of two-byte letters, which all begin with 0xC3, the second byte is set by hand.
BLANK, LINE, IS_LETTER, IS_DIGIT, IS_MARK, OTHER = KINDS = range(6)
KIND = bytes(
    BLANK if c == " " else LINE if c in "\n\r\t" else IS_DIGIT if c in "0123456789" else IS_MARK if re.match(f"[{MARK}]", c) else IS_LETTER if c == "\xc3" or c.isascii() and c.isalpha() else OTHER
    for c in map(chr, range(256))
)
# Whether a pre-token ends between two kinds: before white space, after a line end, and where kinds change; in a run of white space before its last one, if more text follows.
CUT, CUT_IF_LAST, END = 1, 2, 3
BETWEEN = bytes(
    (CUT_IF_LAST if a <= LINE else CUT) if b <= LINE else CUT if a == LINE or a != b and BLANK != a != OTHER != b else 0
    for a in KINDS for b in KINDS
).ljust(256, b"\0")
ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def has_odd_space(text: str) -> bool:
    """Whether white space other than space, tab and line end is there; where only six characters can be, each is looked for by itself, which is faster."""
    return any(map(text.__contains__, ODD_ASCII)) if text.isascii() else ODD_SPACE.search(text) is not None


class WaveletMatrix:
    """Succinct bit-planes over non-negative integers below 2**levels."""

    def __init__(self, n: int, zeros: list[int], planes: list[np.ndarray], ranks: list[np.ndarray]):
        self.n, self.zeros, self.planes, self.ranks = n, zeros, planes, ranks
        self.levels = len(planes)

    @classmethod
    def build(cls, ids: np.ndarray, levels: int) -> WaveletMatrix:
        now = ids.astype(np.uint16 if levels <= 16 else np.uint32)
        zeros, planes, ranks = [], [], []
        for level in range(levels - 1, -1, -1):
            one = (now & now.dtype.type(1 << level)) != 0
            packed = np.packbits(one, bitorder="little")
            padded = np.zeros(-(-len(packed) // (BLOCK // 8)) * (BLOCK // 8), np.uint8)
            padded[: len(packed)] = packed
            ones = np.bitwise_count(padded.view(np.uint64)).reshape(-1, BLOCK // 64).sum(1, dtype=np.uint32)
            ranks.append(np.concatenate([[0], np.cumsum(ones)]).astype(np.uint32))
            planes.append(packed)
            mask, values = pa.BooleanArray.from_buffers(pa.bool_(), len(now), [None, pa.py_buffer(packed)]), pa.array(now)
            low = pc.filter(values, pc.invert(mask)).to_numpy()
            now = np.concatenate([low, pc.filter(values, mask).to_numpy()])
            zeros.append(len(low))
        return cls(len(ids), zeros, planes, ranks)

    def decode(self) -> np.ndarray:
        """All values in order: the planes are undone from the lowest up."""
        kind = np.uint16 if self.levels <= 16 else np.uint32
        now = np.zeros(self.n, kind)
        for k in range(self.levels - 1, -1, -1):
            one = np.unpackbits(self.planes[k], count=self.n, bitorder="little").view(bool)
            back = np.empty(self.n, kind)
            back[one] = now[self.zeros[k] :] | kind(1 << (self.levels - 1 - k))
            np.logical_not(one, out=one)
            back[one] = now[: self.zeros[k]]
            now = back
        return now

    def _rank1(self, k: int, i: int) -> int:
        block = i // BLOCK
        start, end = block * BLOCK // 8, i // 8
        got = int(self.ranks[k][block]) + int(ONES[self.planes[k][start:end]].sum())
        return got + (bin(int(self.planes[k][end]) & ((1 << (i % 8)) - 1)).count("1") if i % 8 else 0)

    def _bit(self, k: int, i: int) -> int:
        return int(self.planes[k][i // 8]) >> (i % 8) & 1

    def access(self, i: int) -> int:
        """The value at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for k in range(self.levels):
            bit, ones = self._bit(k, i), self._rank1(k, i)
            value = value << 1 | bit
            i = self.zeros[k] + ones if bit else i - ones
        return value

    def _range(self, value: int, start: int, end: int) -> tuple[int, int]:
        for k in range(self.levels):
            a, b = self._rank1(k, start), self._rank1(k, end)
            start, end = (self.zeros[k] + a, self.zeros[k] + b) if value >> (self.levels - 1 - k) & 1 else (start - a, end - b)
        return start, end

    def count(self, value: int, start: int = 0, end: int | None = None) -> int:
        """How often a value stands in [start, end)."""
        if value >> self.levels:
            return 0
        a, b = self._range(value, start, self.n if end is None else end)
        return b - a

    def _select(self, k: int, bit: int, j: int) -> int:
        """The place of the j-th (from 0) bit of that kind in plane k."""
        low, high = 0, len(self.ranks[k]) - 1
        before = lambda b: int(self.ranks[k][b]) if bit else min(b * BLOCK, self.n) - int(self.ranks[k][b])
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if before(mid) <= j else (low, mid)
        part = np.unpackbits(self.planes[k][low * BLOCK // 8 : (low + 1) * BLOCK // 8], bitorder="little")[: self.n - low * BLOCK]
        return low * BLOCK + int(np.flatnonzero(part == bit)[j - before(low)])

    def occurrences(self, value: int, start: int = 0, end: int | None = None) -> list[int]:
        """All places of a value in [start, end), ascending."""
        if value >> self.levels:
            return []
        a, b = self._range(value, start, self.n if end is None else end)
        found = []
        for place in range(a, b):
            for k in range(self.levels - 1, -1, -1):
                bit = value >> (self.levels - 1 - k) & 1
                place = self._select(k, bit, place - self.zeros[k] if bit else place)
            found.append(place)
        return sorted(found)


def to_payload(doc_ids: list[int | None], lengths: np.ndarray, matrix: WaveletMatrix) -> bytes:
    head = struct.pack("<4sIQQ", MAGIC, matrix.levels, matrix.n, len(doc_ids))
    known = np.array([i is not None for i in doc_ids], bool)
    parts = [head, np.asarray(matrix.zeros, "<u8").tobytes(), np.array([i or 0 for i in doc_ids], "<i8").tobytes(), np.packbits(known).tobytes(), lengths.astype("<i8").tobytes()]
    for ranks, plane in zip(matrix.ranks, matrix.planes, strict=True):
        parts += [ranks.astype("<u4").tobytes(), plane.tobytes()]
    return b"".join(parts)


def from_payload(payload: bytes) -> tuple[np.ma.MaskedArray, np.ndarray, WaveletMatrix]:
    """Document ids (null ones masked), their lengths and the matrix; arrays are views of the payload."""
    magic, levels, n, docs = struct.unpack_from("<4sIQQ", payload)
    if magic != MAGIC:
        raise ValueError("not a wavelet-matrix shard")
    at = struct.calcsize("<4sIQQ")

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(payload, kind, count, at)
        at += out.nbytes
        return out

    zeros, doc_ids, known, lengths = take("<u8", levels).tolist(), take("<i8", docs), take("u1", -(-docs // 8)), take("<i8", docs)
    doc_ids = np.ma.masked_array(doc_ids, np.unpackbits(known, count=docs) == 0)
    size = -(-n // 8)
    pairs = [(take("<u4", -(-size // (BLOCK // 8)) + 1), take("u1", size)) for _ in range(levels)]
    return doc_ids, lengths, WaveletMatrix(n, zeros, [p for _, p in pairs], [r for r, _ in pairs])


def byte_alphabet() -> dict[int, str]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(others)}


ALPHABET = byte_alphabet()
POINTS = np.array([ord(ALPHABET[b]) for b in range(256)], "<u4")
_encoders: dict[tuple[str, int], ChunkEncoder] = {}


def encoder_of(path: str, end_id: int) -> ChunkEncoder:
    """A worker's encoder, kept from task to task."""
    if (path, end_id) not in _encoders:
        _encoders[path, end_id] = ChunkEncoder(path, end_id)
    return _encoders[path, end_id]


def forget_encoders() -> None:
    """Drops a worker's encoders."""
    _encoders.clear()


class Places(dict):
    """Pieces by number; a new one gets the next and waits to be encoded."""

    def __init__(self) -> None:
        self.waiting: list[bytes] = []

    def __missing__(self, piece: bytes) -> int:
        self[piece] = place = len(self)
        self.waiting.append(piece)
        return place


def cuts(data: bytes, ends: np.ndarray) -> np.ndarray:
    """Places in texts, one after another up to ``ends``, at which pre-tokens end whatever else stands there; those of the texts are among them."""
    n = len(data)
    at, here = np.frombuffer(data, np.uint8), np.frombuffer(bytearray(data.translate(KIND)), np.uint8)
    lead = np.flatnonzero(at == 0xC3)
    letter = (at[lead + 1] | 0x20) != 0xB7  # but the signs of multiplication and division
    here[lead[~letter]], here[lead[letter] + 1] = OTHER, IS_LETTER
    found = np.zeros(n + 1, np.uint8)
    found[1:n] = np.frombuffer((here[:-1] * np.uint8(len(KINDS)) + here[1:]).tobytes().translate(BETWEEN), np.uint8)
    found[ends] = END
    blank = np.flatnonzero(found == CUT_IF_LAST)
    after = blank + 1
    found[blank[(found[after] == END) | (here[np.minimum(after, n - 1)] <= LINE)]] = 0
    found[0] = 0
    return np.flatnonzero(found)


class ChunkEncoder:
    """Encodes texts by the tokenizers library, each distinct piece once.

    Pieces end where the vocabulary's pre-tokens end: a text's ids are its pieces'
    ids one after another.  The bytes of many texts are cut at once and their pieces
    numbered by Arrow, so that only distinct ones are looked up.  Texts with other white space than space, tab and line
    ends, or with a token that was added to the vocabulary, are encoded as they are;
    so are all texts if the file has a normaliser or another pre-tokenizer than the
    byte-level one whose pieces these are.
    """

    def __init__(self, path: str, end_id: int, keep: int = 900_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        said = json.loads(self.tokenizer.to_str())
        before = said.get("pre_tokenizer") or {}
        self.by_piece = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True) and not said.get("normalizer")
        self.model = self.tokenizer.model
        self.end_id, self.keep = end_id, keep
        self._forget()

    def _forget(self) -> None:
        """Starts anew with the end mark."""
        self.places = Places()
        self.flat, self.used = np.zeros(1 << 16, np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32), 0
        self.start, self.size, self.seen = (np.zeros(1 << 14, np.int32) for _ in range(3))
        self.places[b""] = 0
        self._add(np.array([0]), np.array([self.end_id]), np.array([1]))

    def _retain(self) -> None:
        """Keeps the pieces seen more than once, or none if those are too many as well."""
        n = len(self.places)
        often = self.seen[:n] > 1
        often[0] = False
        names = [p for p, k in zip(self.places, often.tolist(), strict=True) if k]
        size, start = self.size[:n][often].astype(np.int64), self.start[:n][often]
        ids = self.flat[np.arange(size.sum()) + np.repeat(start - np.cumsum(size) + size, size)]
        self._forget()
        if len(names) <= self.keep // 2:
            self.places.update(zip(names, range(1, len(names) + 1), strict=True))
            self._add(np.arange(1, len(names) + 1), ids, size)

    def _add(self, at: np.ndarray, ids: np.ndarray, size: np.ndarray) -> None:
        """The ids, one after another, of the pieces at these places."""
        while len(at) and at[-1] >= len(self.start):
            self.start, self.size, self.seen = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size, self.seen))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.flat[self.used : self.used + len(ids)] = ids
        self.start[at], self.size[at] = self.used + np.cumsum(size) - size, size
        self.used += len(ids)

    def _learn(self) -> None:
        """Single pre-tokens go to the vocabulary's model as bytes in its alphabet.  Others are encoded as they are."""
        pieces, self.places.waiting = self.places.waiting, []
        first = len(self.places) - len(pieces)
        texts = [p.decode() for p in pieces]
        plain = np.fromiter((SINGLE(t) is not None for t in texts), bool, len(texts))
        at = np.flatnonzero(plain)
        if len(at):
            joined = b"\n".join([pieces[i] for i in at.tolist()])
            mapped = POINTS[np.frombuffer(joined, np.uint8)].tobytes().decode("utf-32-le").split(ALPHABET[10])
            ids, size = [], []
            for piece in mapped:
                found = [t.id for t in self.model.tokenize(piece)]
                ids += found
                size.append(len(found))
            self._add(first + at, np.array(ids, np.uint32), np.array(size))
        others = np.flatnonzero(~plain)
        if len(others):
            found = [x.ids for x in self.tokenizer.encode_batch_fast([texts[i] for i in others.tolist()], add_special_tokens=False)]
            self._add(first + others, np.concatenate([np.array(f, np.uint32) for f in found]), np.array([len(f) for f in found]))

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of a text and the end id."""
        return self.encode_many([text])[0]

    def encode_many(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text, with the end id after each."""
        if len(self.places) > self.keep:
            self._retain()
        parts, whole = [], {}
        for i, text in enumerate(texts):
            # two quick scans: a pattern of both would be tried at each character
            as_is = text and (not self.by_piece or has_odd_space(text) or any(t in text for t in self.added))
            if as_is:
                whole[i] = np.array([*self.tokenizer.encode(text, add_special_tokens=False).ids, self.end_id], np.uint32)
            parts.append(text.encode() if text and not as_is else b"")
        data, ends = b"".join(parts), np.cumsum([len(p) for p in parts])
        cut = cuts(data, ends)
        # an empty piece, the end mark, after each text
        bounds = np.concatenate([[0], np.sort(np.concatenate([cut, ends]), kind="stable")])
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(data)]).dictionary_encode()
        which, distinct = pieces.indices.to_numpy(), pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
        place = np.fromiter(map(self.places.__getitem__, distinct), np.int32, len(distinct))
        if self.places.waiting:
            self._learn()
        self.seen[place] += np.bincount(which, minlength=len(place)).astype(np.int32)
        at = place[which]
        size = self.size[at].astype(np.int64)
        end = np.cumsum(size)
        out = self.flat[np.arange(end[-1]) + np.repeat(self.start[at] - end + size, size)]
        found = np.split(out, end[np.searchsorted(cut, ends, "right") + np.arange(len(ends))][:-1])
        return [whole.get(i, f) for i, f in enumerate(found)]


def text_parts(column: pa.Array, chars: int = 1 << 21) -> Iterator[list[str | None]]:
    """Runs of texts of about so many characters."""
    part, size = [], 0
    for x in column:
        text = x.as_py()
        part.append(text)
        size += len(text or "")
        if size >= chars:
            yield part
            part, size = [], 0
    if part:
        yield part


SHARDS = pa.schema([("part", pa.int64()), ("shard", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("payload", pa.binary())])
DOCS = pa.schema([("part", pa.int64()), ("shard", pa.int64()), ("doc_id", pa.int64()), ("offset", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def bits_of(tokenizer: str, end_id: int) -> int:
    """The bit-planes that the ids of a vocabulary need."""
    from tokenizers import Tokenizer

    return max([end_id, *Tokenizer.from_file(tokenizer).get_vocab(with_added_tokens=True).values()]).bit_length() or 1


def write_shards(docs: DataFrame, path: str, tokenizer: str, levels: int | None = None, end_id: int = 0, shard_tokens: int = 1 << 20, part_bytes: int = 24 << 20) -> None:
    """Encodes documents and writes the shards below ``path`` (any file system of Spark's); levels: by default as many as the vocabulary needs."""
    least = bits_of(tokenizer, end_id)
    levels = levels or least
    if levels < least:
        raise ValueError(f"the vocabulary's ids need {least} bits")
    rows = docs.select(F.col("doc_id").cast("bigint"), "text")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-total // part_bytes), docs.sparkSession.sparkContext.defaultParallelism)
    ranged = rows.repartitionByRange(int(parts), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, encoder = TaskContext.get().partitionId(), None
        ids, held, size, shard = [], [], 0, 0

        def close() -> pa.RecordBatch:
            nonlocal ids, held, size, shard
            matrix = WaveletMatrix.build(np.concatenate(held), levels)
            payload = to_payload(ids, np.array([len(x) for x in held], np.int64), matrix)
            out = pa.RecordBatch.from_arrays([pa.array([part]), pa.array([shard]), pa.array([len(ids)]), pa.array([matrix.n]), pa.array([payload], pa.binary())], schema=SHARDS)
            ids, held, size, shard = [], [], 0, shard + 1
            return out

        for batch in batches:
            encoder = encoder or encoder_of(tokenizer, end_id)
            for doc_id, got in zip(batch.column(0).to_pylist(), (x for part in text_parts(batch.column(1)) for x in encoder.encode_many(part)), strict=True):
                if held and size + len(got) > shard_tokens:
                    yield close()
                ids.append(doc_id)
                held.append(got)
                size += len(got)
        if held:
            yield close()
        give_back()

    schema = "part bigint, shard bigint, n_docs bigint, n_tokens bigint, payload binary"
    with Workspace(docs.sparkSession, "tokens").writing():
        ranged.mapInArrow(encode, schema).write.mode("overwrite").option("compression", "zstd").parquet(path)


def read_documents(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the files."""
    shards = spark.read.parquet(path)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_encoders()  # a worker that reads has no use for what it knew when it wrote
        for batch in batches:
            for i in range(batch.num_rows):
                doc_ids, lengths, matrix = from_payload(batch.column(2)[i].as_py())
                ids = matrix.decode().astype("<u4")
                end = np.cumsum(lengths)
                crc = [zlib.crc32(ids[a:b]) for a, b in zip((end - lengths).tolist(), end.tolist(), strict=True)]
                n = len(doc_ids)
                keep = pa.array(doc_ids.data, mask=np.ma.getmaskarray(doc_ids))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, batch.column(0)[i].as_py())), pa.array(np.full(n, batch.column(1)[i].as_py())), keep, pa.array(end - lengths), pa.array(lengths), pa.array(crc, pa.int64())], schema=DOCS)
        give_back()

    found = shards.select("part", "shard", "payload").mapInArrow(decode, "part bigint, shard bigint, doc_id bigint, offset bigint, n_tokens bigint, ids_crc32 bigint")
    # ids before a part: of the runs of 1024 parts before its own (one row for each 24 GB or so of text), and of the parts before it in its run
    earlier = lambda *by: F.coalesce(F.sum("n").over(Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = shards.groupBy((F.col("part") / 1024).cast("bigint").alias("run"), "part").agg(F.sum("n_tokens").alias("n"))
    runs = parts.groupBy("run").agg(F.sum("n").alias("n")).select("run", earlier("run").alias("_runs"))
    before = parts.select("run", "part", earlier("run", "part").alias("_parts")).join(runs, "run").select("part", (F.col("_runs") + F.col("_parts")).alias("_parts"))
    within = shards.select("part", "shard", F.coalesce(F.sum("n_tokens").over(Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_shards"))
    place = within.join(before, "part").select("part", "shard", (F.col("_parts") + F.col("_shards")).alias("_base"))
    return found.join(place, ["part", "shard"]).select("doc_id", (F.col("_base") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Writes all documents' ids below the shared folder and returns what the files say of each document."""
    spark = docs.sparkSession
    path = f"{Workspace(spark, 'tokens').root}/shards"
    write_shards(docs, path, tokenizer, **options)
    return read_documents(spark, path)
