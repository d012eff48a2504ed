"""Recordings as a source, re-chunked in batch and as a stream; bounded intake."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.sources import recordings, writers
from parlance.streaming import sessions


@pytest.fixture
def folder(tmp_path):
    rng = random.Random(4)
    place = tmp_path / "wav"
    place.mkdir()
    for i, (frames, channels) in enumerate([(1000, 1), (37, 2), (0, 1), (2500, 3), (16, 1)]):
        (place / f"s{i}.wav").write_bytes(writers.encode_wav([rng.uniform(-1, 1) for _ in range(frames * channels)], 16_000, channels))
    (place / "_late.wav").write_bytes(b"unfinished")
    (place / "note.txt").write_text("no recording")
    return place


def chunks(df):
    rows = df.orderBy("session_id", "chunk").collect()
    return [(r.session_id, r.chunk, [round(x, 6) for x in r.samples]) for r in rows]


def plain(folder, size):
    out = []
    for path in sorted(folder.glob("s*.wav")):
        with path.open("rb") as f:
            at, frames, channels, _ = recordings.wav_header(f)
        mono = recordings.mixed_down(path.read_bytes()[at:], channels)
        assert len(mono) == frames
        out += [(path.stem, i // size, [round(float(x), 6) for x in mono[i : i + size]]) for i in range(0, frames, size)]
    return out


@pytest.mark.parametrize("frames", [16_000, 100])
def test_batch_gives_the_same_chunks_for_any_pieces(spark, folder, frames):
    events = recordings.recordings(spark, str(folder), frames=frames)
    assert chunks(sessions.rechunk(events, 160)) == plain(folder, 160)
    finals = events.where("kind = 'final'").select("session_id").collect()
    assert sorted(r.session_id for r in finals) == ["s0", "s1", "s2", "s3", "s4"]
    assert events.rdd.getNumPartitions() >= (5 if frames == 16_000 else 10)


def test_stream_equals_batch_and_goes_on_where_it_was(spark, folder, tmp_path):
    def run():
        stream = recordings.recordings(spark, f"file://{folder}", stream=True, frames=200, files=2)
        numbered = stream.withColumn("session_id", F.expr("cast(substring(session_id, 2) as bigint)"))
        return sessions.run_available(sessions.rechunk_stream(numbered, 160), str(tmp_path / "out"), str(tmp_path / "state"), seconds=240)

    want = [(int(s[1:]), c, x) for s, c, x in plain(folder, 160)]
    for _ in range(8):  # a run takes in so many files; a second one changes nothing
        out = run()
        if chunks(out) == want:
            break
    assert chunks(out) == want
    (folder / "s7.wav").write_bytes(writers.encode_wav([0.5] * 200, 16_000, 1))
    out = run()
    more = [r for r in chunks(out) if r[0] == 7]
    assert [(c, len(x)) for _, c, x in more] == [(0, 160), (1, 40)]
    assert len(chunks(out)) == len(want) + 2


def test_wrong_files_and_options(spark, tmp_path):
    (tmp_path / "a.wav").write_bytes(b"not sound")
    with pytest.raises(Exception, match="RIFF"):
        recordings.recordings(spark, str(tmp_path)).collect()
    with pytest.raises(Exception, match="at least one"):
        recordings.recordings(spark, str(tmp_path), frames=0).collect()
    assert np.allclose(recordings.mixed_down(np.array([16384, -16384, 32767], "<i2").tobytes(), 2), [0.0])


def test_an_intake_of_one_file_ends_every_session(spark, tmp_path):
    rows = [(s, q, "final" if q == 5 else "audio", [float(s), float(q)]) for q in range(6) for s in range(4)]
    schema = "session_id long, seq long, kind string, samples array<double>"
    for q in range(6):  # a file for each step
        spark.createDataFrame([r for r in rows if r[1] == q], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.05)
    listener = sessions.IntakeListener()
    spark.streams.addListener(listener)
    try:
        stream = sessions.bounded_intake(spark, schema, str(tmp_path / "in"), files=1)
        out = sessions.run_available(sessions.rechunk_stream(stream, 5), str(tmp_path / "out"), str(tmp_path / "state"), seconds=240)
        for _ in range(50):
            if sum(map(sum, listener.rows.values())) >= len(rows):
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    took = [n for counts in listener.rows.values() for n in counts]
    assert took == [4] * 6
    assert out.groupBy("session_id").agg(F.sum(F.size("samples")).alias("n")).where("n = 12").count() == 4
    with pytest.raises(ValueError):
        sessions.bounded_intake(spark, schema, "x")
