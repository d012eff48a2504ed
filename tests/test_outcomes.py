"""Context and cancellation by stage, in batch and in a stream of one file at a time."""

import pytest

from parlance.streaming import sessions

SCHEMA = "session_id long, seq long, kind string, text string, app string"
SESSIONS = {
    1: ["final:a", "end", "context", "refined:A"],
    2: ["final:a", "cancel", "end", "context", "refined:A"],
    3: ["final:a", "end", "cancel", "context", "refined:A"],
    4: ["final:a", "end", "context", "cancel", "refined:A"],
    5: ["final:a", "end", "context", "refined:A", "cancel"],
    6: ["final:a", "final:b", "end", "context", "refined:"],
    7: ["error:boom", "end", "cancel"],
    8: ["final:a", "end"],
    9: ["partial:x"],
    10: ["cancel"],
    11: ["final:", "end", "context", "refined:A"],
}
WANT = {
    1: ("A", "mail", None), 2: (None, "mail", "cancelled during recording"), 3: (None, "mail", "cancelled during context"), 4: (None, "mail", "cancelled during refinement"), 5: ("A", "mail", None),
    6: ("b", "mail", None), 7: (None, None, "no speech detected (boom)"), 8: (None, None, None), 9: (None, None, None), 10: (None, None, "cancelled during recording"), 11: (None, "mail", "no speech detected"),
}


@pytest.fixture
def events(spark):
    rows = []
    for session, steps in SESSIONS.items():
        for seq, step in enumerate(steps):
            kind, _, text = step.partition(":")
            rows.append((session, seq, kind, text or None, "m" if session != 12 else None))
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture
def contexts(spark):
    return spark.createDataFrame([("m", "mail"), ("x", "other"), ("m", "fax")], "app string, context string")


def as_dict(df):
    return {r.session_id: (r.text, r.context, r.error) for r in df.collect()}


def test_batch(events, contexts):
    assert as_dict(sessions.outcomes(events, contexts)) == WANT


def test_stream_gives_the_same_however_events_are_dealt(spark, events, contexts, tmp_path):
    events.repartition(7).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = sessions.run_available(sessions.outcomes(stream, contexts), str(tmp_path / "out"), str(tmp_path / "state"), "complete", 240)
    assert as_dict(out) == WANT


def test_context_meets_only_the_end_of_a_session(events, contexts):
    plan = sessions.outcomes(events, contexts)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1
    assert "Cross" not in plan


def test_unknown_app_and_no_contexts(events, contexts):
    got = as_dict(sessions.outcomes(events, contexts.where("app = 'x'")))
    assert got[1] == ("A", None, None)
