"""Recordings as events: a data source over a folder of WAV files, in batch and as a stream.

``register(spark)``, then ``spark.read`` or ``spark.readStream`` with
``format("wav_events")``.  Each file is a session (its name without folder and ending);
its frames are mixed down to one channel and come in pieces of ``frames`` (default
16,000), and a 'final' event after the last one flushes what a re-chunker holds.  Pieces
are ranges of frames, so a long file is read by many tasks, each of which seeks to its
own frames.

A stream's offset is the name of the last file; files are taken by name, so recorders
name them in the order in which they are complete (a hidden or temporary file, with a
leading dot or underscore, is not there yet).  Only names after an offset are listed
into a batch; files that appear out of order are not seen.  ``path`` is anything that
pyarrow's file systems open, and all executors see.

Options: path; frames; files (most files a batch of a stream; all, if not given).
"""

from __future__ import annotations

import posixpath
import struct
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "session_id string, seq bigint, kind string, sample_rate int, samples array<double>"


@dataclass
class Piece(InputPartition):
    """Frames [first, first + count) of one file; the last piece of a file also ends its session."""

    path: str
    first: int
    count: int
    seq: int
    last: bool


def _filesystem(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def wav_header(file) -> tuple[int, int, int, int]:
    """(offset of the data, frames, channels, sample rate) of 16-bit PCM; reads chunk heads alone."""
    if (head := file.read(12))[:4] != b"RIFF" or head[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at, form = 12, None
    while len(head := file.read(8)) == 8:
        kind, size = struct.unpack("<4sI", head)
        at += 8
        if kind == b"fmt ":
            form = struct.unpack_from("<HHIIHH", file.read(16))
        elif kind == b"data":
            if form is None or form[5] != 16 or not form[1]:
                raise ValueError("16-bit PCM only")
            return at, size // (2 * form[1]), form[1], form[2]
        at += size + size % 2
        file.seek(at)
    raise ValueError("no data chunk")


def mixed_down(body: bytes, channels: int) -> np.ndarray:
    """Samples between -1 and 1, the mean of each frame's channels."""
    frames = np.frombuffer(body[: len(body) // (2 * channels) * 2 * channels], "<i2").reshape(-1, channels)
    return frames.mean(1) / 32768.0


class _Files:
    """The files of a folder and the pieces of each."""

    def __init__(self, options: dict):
        if "path" not in options:
            raise ValueError("a path is needed")
        self.path, self.frames = options["path"], int(options.get("frames", 16_000))
        self.most = int(options["files"]) if "files" in options else None
        if self.frames < 1 or (self.most is not None and self.most < 1):
            raise ValueError("frames and files are at least one")

    def names(self, after: str = "") -> list[str]:
        system, path = _filesystem(self.path)
        found = system.get_file_info(fs.FileSelector(path, recursive=False))
        names = (posixpath.basename(f.path) for f in found if f.type == fs.FileType.File)
        return sorted(n for n in names if n.lower().endswith(".wav") and n[0] not in "._" and n > after)

    def pieces(self, names: list[str]) -> list[Piece]:
        system, path = _filesystem(self.path)
        out = []
        for name in names:
            place = posixpath.join(path, name)
            with system.open_input_file(place) as file:
                frames = wav_header(file)[1]
            starts = range(0, frames, self.frames) if frames else [0]
            out += [Piece(name, s, min(self.frames, frames - s), i, i == len(starts) - 1) for i, s in enumerate(starts)]
        return out

    def read(self, piece: Piece) -> Iterator[tuple]:
        system, path = _filesystem(self.path)
        session = posixpath.splitext(piece.path)[0]
        with system.open_input_file(posixpath.join(path, piece.path)) as file:
            at, _, channels, rate = wav_header(file)
            file.seek(at + piece.first * 2 * channels)
            samples = mixed_down(file.read(piece.count * 2 * channels), channels)
        kinds = [("audio", samples.tolist())] if len(samples) else []
        kinds += [("final", [])] if piece.last else []
        rows = [(session, 2 * piece.seq + i, kind, rate, held) for i, (kind, held) in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.string(), pa.int32(), pa.list_(pa.float64())), strict=True)], ["session_id", "seq", "kind", "sample_rate", "samples"])


class _Batch(DataSourceReader):
    def __init__(self, options: dict):
        self.files = _Files(options)

    def partitions(self) -> Sequence[Piece]:
        return self.files.pieces(self.files.names())

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        return self.files.read(partition)


class _Stream(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.files, self.reached = _Files(options), ""

    def initialOffset(self) -> dict:
        return {"after": ""}

    def latestOffset(self) -> dict:
        names = self.files.names(self.reached)[: self.files.most]
        self.reached = names[-1] if names else self.reached
        return {"after": self.reached}

    def partitions(self, start: dict, end: dict) -> Sequence[Piece]:
        # after a restart the first batch says how far the stream was
        self.reached = max(self.reached, end["after"])
        return self.files.pieces([n for n in self.files.names(start["after"]) if n <= end["after"]])

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        return self.files.read(partition)

    def commit(self, end: dict) -> None:
        """Files stay where they are."""


class Recordings(DataSource):
    @classmethod
    def name(cls) -> str:
        return "wav_events"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Recordings)


def recordings(spark: SparkSession, path: str, stream: bool = False, **options) -> DataFrame:
    """The events of a folder of recordings."""
    register(spark)
    source = spark.readStream if stream else spark.read
    return source.format("wav_events").options(**options).load(path)
