"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes.

A is a byte-level BPE file of the tokenizers library, B a sentencepiece model.  Both
encode space + text (B adds the space itself).  A transducer walks the two token
sequences: its state is the side that leads and the bytes that the other side has not
matched yet; the side behind gives the next token.  Transitions are memoised by state
and token.  An empty rest closes a group; every token taken while a rest dangles
overlaps the leading token, which is a link.

Where both tokenizers have a boundary whatever stands around (see ``Aligner``) a text is
cut to chunks, between which the rest is empty.  Each distinct chunk is encoded and
walked once and kept in a worker.

Pass one writes, for slices of documents, the sequence of chunks and the links of each
distinct chunk; links are counted by slice, then by id pair.  Pass two brings each
slice its own pairs with their totals, a row for each distinct pair of a slice: neither
the pairs of the corpus nor those of a document are ever sent about whole, and a
frequent pair has one row a slice.

Defined results: a text that is null, empty, or whose tokens do not spell space + text
byte for byte (it holds U+2581, say) has no tokens: zeros and '' for the digest.  Rows
that share a doc_id, and rows without one, are documents of their own.  Ties in counts
all are best.  Other columns are not read.  A document larger than a slice is a slice
of its own: 4 bytes for each word in memory beside its text.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm._bytes import give_back
from parlance.llm._spark import Workspace
from parlance.llm.token_files import ALPHABET

SAFE = re.compile(r"(?<=\S)(?=[ \n]\S)")
SLICE_CHARS = 8 << 20
BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")


class Transducer:
    """Memoised transitions over dangling rests; state 0 is the empty rest, where A goes first."""

    def __init__(self, a_bytes: list[bytes], b_bytes: list[bytes], keep: int = 400_000):
        self.a_bytes, self.b_bytes, self.keep = a_bytes, b_bytes, keep
        self.stride = len(b_bytes)
        self._forget()

    def _forget(self) -> None:
        self.states: dict[tuple[bool, bytes], int] = {(True, b""): 0}
        self.rests: list[tuple[bool, bytes]] = [(True, b"")]
        self.moves: dict[int, int] = {}

    def _state(self, a_leads: bool, rest: bytes) -> int:
        """The number of a state; without a rest nobody leads."""
        key = (a_leads, rest) if rest else (True, b"")
        if key not in self.states:
            self.states[key] = len(self.rests)
            self.rests.append(key)
        return self.states[key]

    def _move(self, state: int, token: int) -> int:
        """Where a token of the side behind leads; -1 where its bytes differ."""
        a_leads, rest = self.rests[state]
        if not state:
            return self._state(True, self.a_bytes[token])
        spelt = (self.b_bytes if a_leads else self.a_bytes)[token]
        if rest.startswith(spelt):
            return self._state(a_leads, rest[len(spelt) :])
        return self._state(not a_leads, spelt[len(rest) :]) if spelt.startswith(rest) else -1

    def walk(self, a: list[int], b: list[int]) -> tuple[list[int], list[tuple[int, int]]] | None:
        """Links as a * stride + b, and the ends (in a, in b) of each group; None if the bytes differ."""
        if len(self.moves) > self.keep:
            self._forget()
        moves, rests, stride = self.moves, self.rests, self.stride
        i = j = state = 0
        links, groups = [], []
        try:
            while True:
                if not state:
                    if i:
                        groups.append((i, j))
                    if i == len(a):
                        return (links, groups) if j == len(b) else None
                    token = a[i]
                    i += 1
                elif rests[state][0]:
                    token = b[j]
                    j += 1
                    links.append(a[i - 1] * stride + token)
                else:
                    token = a[i]
                    i += 1
                    links.append(token * stride + b[j - 1])
                key = state << 20 | token
                state = moves.get(key)
                if state is None:
                    state = moves[key] = self._move(key >> 20, token)
                if state < 0:
                    return None
        except IndexError:  # one side has ended with a rest left
            return None


class Aligner:
    """Chunks by text with their tokens, groups and links; when they are too many, those seen most often stay.

    A text is cut before each blank, line end and mark, and put together again where
    such a cut may not be a boundary of both tokenizers: a blank or line end is one
    between characters that are no white space, a mark after a letter, if no piece of
    B's vocabulary holds a letter before it.
    """

    def __init__(self, a_path: str, b_path: str, keep: int = 500_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        back = {c[1] if len(c) == 3 else c: byte for byte, c in ALPHABET.items()}
        added = {i: t.content.encode() for i, t in self.a.get_added_tokens_decoder().items()}
        names = {i: name for name, i in self.a.get_vocab(with_added_tokens=True).items()}
        a_bytes = [added[i] if i in added else bytes(back[c] for c in names.get(i, "")) for i in range(max(names) + 1)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        b_bytes = [bytes([int(BYTE_PIECE.fullmatch(p)[1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        joined = {p[i + 1] for p in pieces for i in range(len(p) - 1) if p[i].isalpha()}
        self.marks = [c for c in ".,;:!?" if c not in joined]
        self.walker, self.keep = Transducer(a_bytes, b_bytes), keep
        self.a_names, self.b_names = list(map(str, range(len(a_bytes)))), list(map(str, range(len(b_bytes))))
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.spelt: list[str] = []  # a chunk's groups as text; of one whose bytes differ ""
        self.flat, self.used = np.zeros(1 << 16, np.int64), 0  # links of all chunks
        #: by chunk: n_a, n_b, n_groups, n_links, where its links start, how often it was seen
        self.numbers = np.zeros((6, 1 << 14), np.int64)
        #: by chunk: can a cut before it be none, is it a mark, does it end in white space, does it end in a letter
        self.kind = np.zeros((4, 1 << 14), bool)

    def encode(self, chunks: list[str]) -> Iterator[tuple[list[int], list[int]]]:
        """Ids by A and B of each chunk; one that begins with no blank goes to B after a line end, which merges with nothing."""
        a = self.a.encode_batch_fast(chunks, add_special_tokens=False)
        b = self.b.encode([c[1:] if c[0] == " " else "\n" + c for c in chunks], num_threads=1)
        for chunk, x, y in zip(chunks, a, b, strict=True):
            yield x.ids, y if chunk[0] == " " else y[2:]

    def learn(self, chunks: list[str]) -> None:
        a_names, b_names = self.a_names, self.b_names
        for at in range(0, len(chunks), 4096):
            part = chunks[at : at + 4096]
            links, numbers, first = [], [], len(self.spelt)
            for chunk, (a, b) in zip(part, self.encode(part), strict=True):
                found, groups = self.walker.walk(a, b) or ([], [])
                i = j = 0
                texts = []
                for to_i, to_j in groups:
                    if to_i - i == 1 == to_j - j:
                        texts.append(f"{a[i]}|{b[j]}")
                    else:
                        texts.append(",".join([a_names[x] for x in a[i:to_i]]) + "|" + ",".join([b_names[x] for x in b[j:to_j]]))
                    i, j = to_i, to_j
                self.known[chunk] = len(self.spelt)
                self.spelt.append(";".join(texts))
                links += found
                numbers.append((len(a), len(b), len(groups), len(found)))
            ends = [c[-1] for c in part]
            kind = ([len(c) < 2 or c[1].isspace() if c[0] in " \n" else False for c in part], [c[0] not in " \n" for c in part], [c.isspace() for c in ends], [c.isalpha() for c in ends])
            self._add(first, np.array(links, np.int64), np.array(numbers, np.int64).T, np.array(kind, bool))

    def _add(self, first: int, links: np.ndarray, numbers: np.ndarray, kind: np.ndarray) -> None:
        """What is known of the chunks from a number on."""
        last = first + numbers.shape[1]
        while last > self.numbers.shape[1]:
            self.numbers, self.kind = (np.concatenate([x, np.zeros_like(x)], axis=1) for x in (self.numbers, self.kind))
        while self.used + len(links) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(links)] = links
        self.numbers[:4, first:last], self.kind[:, first:last] = numbers, kind
        self.numbers[4, first:last] = self.used + np.cumsum(numbers[3]) - numbers[3]
        self.numbers[5, first:last] = 0
        self.used += len(links)

    def links_of(self, places: np.ndarray) -> np.ndarray:
        """The links of these chunks, one chunk after another."""
        start, size = self.numbers[4, places], self.numbers[3, places]
        return self.flat[np.arange(size.sum()) + np.repeat(start - np.cumsum(size) + size, size)]

    def _places(self, chunks: list[str]) -> np.ndarray:
        at = list(map(self.known.get, chunks))
        if None in at:
            self.learn([c for c in dict.fromkeys(chunks) if c not in self.known])
            at = list(map(self.known.get, chunks))
        return np.array(at, np.int64)

    def _cut(self, text: str) -> list[str]:
        if "\x01" in text:
            return SAFE.split(" " + text)
        for c in (" ", "\n", *self.marks):
            text = text.replace(c, "\x01" + c)
        return (" " + text).split("\x01")

    def places(self, text: str | None) -> np.ndarray:
        """The chunks of space + text by number; none for a text without tokens."""
        if not text:
            return np.zeros(0, np.int64)
        chunks = self._cut(text)
        at = self._places(chunks)
        bare, mark, blank, letter = self.kind[:, at]
        wrong = np.where(mark[1:], ~letter[:-1], bare[1:] | blank[:-1])
        if wrong.any():
            bounds = [0, *(np.flatnonzero(~wrong) + 1).tolist(), len(chunks)]
            at = self._places(["".join(chunks[i:j]) for i, j in zip(bounds, bounds[1:])])  # noqa: B905
        return at if self.numbers[2, at].all() else np.zeros(0, np.int64)

    def trim(self) -> None:
        """Where it holds too many chunks, half the number stays, by how often they were seen; numbers given before are void then."""
        n = len(self.spelt)
        if n <= self.keep:
            return
        seen, names = self.numbers[5, :n], list(self.known)
        often = np.argsort(-seen, kind="stable")[: self.keep // 2]
        often = np.sort(often[seen[often] > 1])
        links, numbers, kind, spelt = self.links_of(often), self.numbers[:, often], self.kind[:, often], [self.spelt[i] for i in often.tolist()]
        self._forget()
        self.known, self.spelt = {names[i]: k for k, i in enumerate(often.tolist())}, spelt
        self._add(0, links, numbers[:4], kind)
        self.numbers[5, : len(often)] = numbers[5] >> 1


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner_of(a_path: str, b_path: str) -> Aligner:
    """A worker's aligner, kept from task to task."""
    if (a_path, b_path) not in _aligners:
        _aligners[a_path, b_path] = Aligner(a_path, b_path)
    return _aligners[a_path, b_path]


SLICES = "slice bigint, doc_id array<bigint>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, n_links array<bigint>, groups_sha256 array<string>, n_chunks array<int>, low binary, high binary, size binary, link_low binary, link_high binary, pair binary, count binary"
OUT = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"


def _halves(x: np.ndarray) -> tuple[bytes, bytes]:
    """Low and high 16 bits apart: the high ones compress to little."""
    return (x & 0xFFFF).astype("<u2").tobytes(), (x >> 16).astype("<u2").tobytes()


def _whole(low: bytes, high: bytes) -> np.ndarray:
    return np.frombuffer(low, "<u2").astype(np.int64) | np.frombuffer(high, "<u2").astype(np.int64) << 16


def _slice(aligner: Aligner, number: int, ids: list, places: list[np.ndarray], digests: list[str]) -> dict:
    """One row of pass one."""
    sizes = np.array([len(p) for p in places], np.int64)
    flat = np.concatenate(places) if places else np.zeros(0, np.int64)
    used, local, times = np.unique(flat, return_inverse=True, return_counts=True)
    often = np.argsort(-times, kind="stable")  # frequent chunks get small numbers
    rank = np.empty_like(often)
    rank[often] = np.arange(len(often))
    used, local, times = used[often], rank[local], times[often]
    aligner.numbers[5, used] += times
    links, n_links = aligner.links_of(used), aligner.numbers[3, used]
    pair, inverse = np.unique(links, return_inverse=True)
    count = np.bincount(inverse, np.repeat(times, n_links), len(pair)).astype(np.int64) if len(pair) else np.zeros(0, np.int64)
    edge = np.concatenate([[0], np.cumsum(sizes)])
    total = lambda values: np.diff(np.concatenate([[0], np.cumsum(values[local])])[edge]).tolist()
    low, high = _halves(local)
    link_low, link_high = _halves(inverse)
    return {
        "slice": number, "doc_id": ids, **{name: total(aligner.numbers[k, used]) for k, name in enumerate(("n_a", "n_b", "n_groups"))},
        "n_links": total(n_links), "groups_sha256": digests, "n_chunks": sizes.tolist(), "low": low, "high": high, "size": n_links.astype("<i4").tobytes(), "link_low": link_low, "link_high": link_high,
        "pair": pair.astype("<i8").tobytes(), "count": count.astype("<i8").tobytes(),
    }


def slices(docs: DataFrame, a_path: str, b_path: str, chars: int = SLICE_CHARS) -> DataFrame:
    """Pass one: a row for each run of documents of about so many characters."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(SLICES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, part, made = aligner_of(a_path, b_path), TaskContext.get().partitionId(), 0
        ids, places, digests, size = [], [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal ids, places, digests, size, made
            row = _slice(aligner, part << 32 | made, ids, places, digests)
            ids, places, digests, size, made = [], [], [], 0, made + 1
            aligner.trim()
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                at = aligner.places(text)
                ids.append(doc_id)
                places.append(at)
                digests.append(hashlib.sha256(";".join(map(aligner.spelt.__getitem__, at.tolist())).encode()).hexdigest() if len(at) else "")
                size += len(text or "")
                if size >= chars:
                    yield close()
        if ids:
            yield close()
        give_back()

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, SLICES)


def pair_counts(made: DataFrame) -> DataFrame:
    """(slice, pair, n) from slices: a row for each distinct pair of a slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, pair, count in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                pair = np.frombuffer(pair, "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pair), number)), pa.array(pair), pa.array(np.frombuffer(count, "<i8"))], ["slice", "pair", "n"])

    return made.select("slice", "pair", "count").mapInArrow(run, "slice bigint, pair bigint, n bigint")


def vocabulary_size(b_path: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size()


def id_pairs(made: DataFrame, stride: int) -> DataFrame:
    """(pair, a, b, n, best): how many links of the corpus hold the pair, and whether no other A id has more with this B id."""
    counted = pair_counts(made).groupBy("pair").agg(F.sum("n").alias("n"))
    counted = counted.select("pair", F.expr(f"pair div {stride}").alias("a"), (F.col("pair") % stride).alias("b"), "n")
    return counted.join(counted.groupBy("b").agg(F.max("n").alias("_most")), "b").select("pair", "a", "b", "n", (F.col("n") == F.col("_most")).alias("best"))


def _finish(row: pa.Table, pairs: pa.Table) -> pa.Table:
    """Pass two for one slice."""
    get = {name: row.column(name)[0].as_py() for name in row.column_names}
    order = np.argsort(pairs.column("pair").to_numpy())
    n, best = pairs.column("n").to_numpy()[order], pairs.column("best").to_numpy(zero_copy_only=False)[order].astype(np.int64)
    link, size = _whole(get["link_low"], get["link_high"]), np.frombuffer(get["size"], "<i4").astype(np.int64)
    local, edge = _whole(get["low"], get["high"]), np.concatenate([[0], np.cumsum(np.array(get["n_chunks"], np.int64))])
    found = []
    for value in (best, n):
        within = np.concatenate([[0], np.cumsum(value[link])])
        ends = np.cumsum(size)
        by_chunk = within[ends] - within[ends - size]
        found.append(pa.array(np.diff(np.concatenate([[0], np.cumsum(by_chunk[local])])[edge]), pa.int64()))
    column = lambda name, kind: pa.array(get[name], kind)
    return pa.table({"doc_id": column("doc_id", pa.int64()), **{c: column(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")}, "n_best": found[0], "count_sum": found[1], "groups_sha256": column("groups_sha256", pa.string())})


def align(docs: DataFrame, a_path: str, b_path: str, chars: int = SLICE_CHARS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each document (doc_id, text)."""
    work = Workspace(docs.sparkSession, "alignment")
    made = work.table(slices(docs, a_path, b_path, chars), "slices")
    pairs = work.table(id_pairs(made, vocabulary_size(b_path)).select("pair", "n", "best"), "pairs")
    own = pair_counts(made).select("slice", "pair").join(pairs, "pair").select("slice", "pair", "n", "best")
    return made.drop("pair", "count").groupBy("slice").cogroup(own.groupBy("slice")).applyInArrow(_finish, OUT)


def groups(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(doc_id, start, end, a, b): the ids of both sides over each group's bytes of space + text, in order of the text."""
    schema = "doc_id bigint, start bigint, end bigint, a array<int>, b array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = aligner_of(a_path, b_path)
        spelt = aligner.walker.a_bytes
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                at, rows, start = aligner.places(text.as_py()), [], 0
                for group in (g for i in at.tolist() for g in aligner.spelt[i].split(";")):
                    a, b = ([int(x) for x in side.split(",")] for side in group.split("|"))
                    end = start + sum(len(spelt[x]) for x in a)
                    rows.append((doc_id, start, end, a, b))
                    start = end
                aligner.trim()
                if rows:
                    cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())), strict=True)]
                    yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "end", "a", "b"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, schema)


def brute_force(texts: list[str | None], a_path: str, b_path: str) -> list[tuple]:
    """The columns of ``align`` without the id, straight from byte ranges, each text encoded whole; for tests."""
    from collections import Counter

    known = Aligner(a_path, b_path)
    rows, counts = [], Counter()
    for text in texts:
        whole = (" " + (text or "")).encode()
        a, b = (known.a.encode(" " + text, add_special_tokens=False).ids, known.b.encode(text)) if text else ([], [])
        spans = []
        for ids, spelt in ((a, known.walker.a_bytes), (b, known.walker.b_bytes)):
            ends = np.cumsum([len(spelt[i]) for i in ids]).tolist()
            spans.append(list(zip([0, *ends], ends)))  # noqa: B905
        if not text or any(b"".join(s[i] for i in ids) != whole for ids, s in ((a, known.walker.a_bytes), (b, known.walker.b_bytes))):
            rows.append(([], [], []))
            continue
        cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        found, links, first = [], [], [0, 0]
        for cut in cuts:
            side = []
            for k, ids in enumerate((a, b)):
                last = first[k]
                while last < len(ids) and spans[k][last][1] <= cut:
                    last += 1
                side.append(range(first[k], last))
                first[k] = last
            found.append("|".join(",".join(str(ids[i]) for i in r) for r, ids in zip(side, (a, b), strict=True)))
            links += [(a[i], b[j]) for i in side[0] for j in side[1] if max(spans[0][i][0], spans[1][j][0]) < min(spans[0][i][1], spans[1][j][1])]
        counts.update(links)
        rows.append(((len(a), len(b)), found, links))
    most = Counter()
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    return [(*(n or (0, 0)), len(g), len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for n, g, links in rows]
