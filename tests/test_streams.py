"""Streams in steps: sessions with lifetimes, two-stream joins, versions of a state table, rows that come too late."""

import datetime as dt
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from quirework.plans import streams
from quirework.streaming import joins, replay, sessions

START = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
REQUESTS = "session_id string, request_id long, ts timestamp, saves boolean, state string, step int"


def at(seconds):
    return None if seconds is None else START + dt.timedelta(seconds=seconds)


def store(spark, rows, seconds, grace, slot=60):
    df = spark.createDataFrame([(s, i, at(t), saves, state, step) for s, i, t, saves, state, step in rows], REQUESTS)
    run = replay.Replay(df, "store")
    out = run.all_steps(lambda stream, _: sessions.answered(stream, "1 hour", seconds, grace, slot))
    return {r.request_id: (r.outcome, r.state) for r in out.collect()}, run


def test_session_store_edges(spark):
    """Equal times are told apart by id; the end itself still counts; a late save is seen by reads after it, whatever arrived first; nulls are not answered."""
    rows = [
        ("a", 1, 0, False, None, 0), ("a", 3, 10, False, None, 0), ("a", 2, 10, True, "x", 1), ("a", 4, 310, False, None, 1), ("a", 5, 310.000001, False, None, 0), ("a", 6, 611, False, None, 0),
        ("b", 7, 5, True, None, 0), ("b", 8, 6, False, None, 1), ("b", 9, 200, True, "y", 1), ("b", 10, 450, False, None, 1), (None, 11, 5, False, None, 0), ("b", 12, None, False, None, 0), ("b", 13, 7, None, None, 0),
        ("zz", 99, 9_000, True, "end", 2),
    ]
    got, _ = store(spark, rows, 300, 300)
    assert got == {1: ("missing", None), 3: ("found", "x"), 4: ("found", "x"), 5: ("expired", None), 6: ("missing", None), 8: ("found", None), 13: ("found", None), 10: ("found", "y")}


def plain_store(rows, seconds, grace):
    out, held = {}, {}
    for s, i, t, saves, state, _ in sorted(rows, key=lambda r: (r[2], r[1])):
        if saves:
            held[s] = state, t + seconds
        elif s not in held or t > held[s][1] + grace:
            out[i] = "missing", None
        else:
            out[i] = ("found", held[s][0]) if t <= held[s][1] else ("expired", None)
    return out


def test_session_store_in_any_steps(spark):
    """Six steps or one, resumed from the checkpoint each time: the answers are those of a plain loop, and state doesn't grow with the stream."""
    rng = random.Random(7)
    rows = [(f"s{rng.randrange(6)}", i, rng.randrange(40_000), rng.random() < 0.4, f"v{i}", 0) for i in range(400)]
    rows.append(("end", 400, 60_000, True, "e", 0))
    delayed = [(*r[:5], (r[2] + rng.randrange(3_000)) // 9_000) for r in rows]
    want = plain_store(rows, 600, 900)
    got, run = store(spark, delayed, 600, 900)
    assert got == want and len(run.steps) == 6
    totals = [p["stateOperators"][0]["numRowsTotal"] for p in run.progress]
    assert max(totals) < 2.5 * totals[0]
    assert store(spark, rows, 600, 900)[0] == want


def test_calls_of_the_store_do_not_grow_with_requests():
    """Every call of the state's interface goes to another process: a bucket of three hundred requests of forty sessions takes a handful of them."""
    calls = []

    class State:
        value = None
        exists = lambda self: calls.append("exists") or self.value is not None
        get = lambda self: calls.append("get") or self.value
        update = lambda self, value: calls.append("update") or setattr(self, "value", value)
        clear = lambda self: calls.append("clear") or setattr(self, "value", None)
        __getattr__ = lambda self, name: lambda *_: calls.append(name)

    class Handle:
        getValueState = getMapState = lambda self, *_: State()
        registerTimer = lambda self, _: calls.append("registerTimer")

    class Watermark:
        getCurrentWatermarkInMs = lambda self: 10**9

    rng = random.Random(3)
    rows = [(f"s{rng.randrange(40)}", i, rng.randrange(400_000), rng.random() < 0.4, f"v{i}", 0) for i in range(300)]
    processor = sessions.SessionStore(3_600, 3_600, 60)
    processor.init(Handle())
    list(processor.handleInputRows((1,), iter([Row(session_id=s, request_id=i, ts_us=t * 10**6, saves=saves, state=state) for s, i, t, saves, state, _ in rows]), Watermark()))
    told = [list(processor.handleExpiredTimer((1,), Watermark(), None)) for _ in range(2)]
    assert {r.request_id: (r.outcome, r.state) for r in told[0]} == plain_store(rows, 3_600, 3_600) and told[1] == []
    assert len(calls) < 12


def test_live_sessions(spark):
    """By the clock: a session is found in the next step as long as its lifetime runs."""
    rows = [("a", 1, 0, True, "x", 0), ("a", 2, 1, False, None, 0), ("a", 3, 2, False, None, 1), ("b", 4, 2, False, None, 1)]
    df = spark.createDataFrame([(s, i, at(t), saves, state, step) for s, i, t, saves, state, step in rows], REQUESTS)
    out = replay.Replay(df, "live", settle="never").all_steps(lambda stream, _: sessions.answered_live(stream, 3600))
    assert {r.request_id: (r.outcome, r.state) for r in out.collect()} == {2: ("found", "x"), 3: ("found", "x"), 4: ("missing", None)}


def test_unstarted(spark):
    """Both bounds count; a start of another job, or before the submission, is none; undecided submissions wait; what is decided leaves the state."""
    rows = [(1, "s", 0, 0), (1, "t", 3600, 0), (2, "s", 0, 0), (2, "t", 3600.000001, 0), (3, "s", 100, 0), (3, "t", 99, 0), (4, "s", 100, 0), (4, "t", 100, 1), (5, "s", 200, 0), (None, "s", 50, 0), (None, "t", 50, 0), (6, "s", None, 0), (5, "t", 9_000, 1)]
    rows += [(7, "s", 20_000, 1), (8, "t", 20_000, 1), (7, "s", 20_000, 2), (8, "t", 20_001, 2)]
    run = replay.Replay(spark.createDataFrame([(j, k, at(t), step) for j, k, t, step in rows], "job_id int, kind string, ts timestamp, step int"), "unstarted")
    out = run.all_steps(lambda stream, _: joins.unstarted(stream.where("kind = 's'"), run.arrived().where("kind = 't'"), "1 HOUR", "1000 seconds"))
    assert out.columns[:3] == ["job_id", "kind", "ts"] and sorted((r.job_id for r in out.collect()), key=repr) == [2, 3, 5, None]
    assert run.progress[-1]["stateOperators"][0]["numRowsTotal"] <= 6


def test_versions(spark):
    schema = "k int, v string, n int"
    frame = lambda rows: spark.createDataFrame(rows, schema)
    parts = [[(1, "a", 1), (2, "b", 5), (None, "c", 9)], [(1, "d", 3), (2, "e", 4)], [(1, "f", 2), (3, "g", 0)]]
    states = []
    for order in ([0, 1, 2], [2, 0, 1], [1, 1, 2, 0, 0]):
        versions = joins.Versions(frame([]), "k", ["n", "v"])
        before = versions.read()
        for k in order:
            versions.upsert(frame(parts[k]))
        assert before.count() == 0 and versions.number == len(order)
        states.append(sorted(map(tuple, versions.read().collect())))
    assert states == [[(1, "d", 3), (2, "b", 5), (3, "g", 0)]] * 3


def test_late_rows_are_told(spark):
    rows = [(i, at(60 * i), i // 40) for i in range(120)] + [(500, at(10), 1), (501, at(2_000), 2), (502, at(60 * 79 - 600), 2), (503, at(60 * 79 - 599), 2), (7, at(420), 0)]
    run = replay.Replay(spark.createDataFrame(rows, "id int, ts timestamp, step int"), "late", settle="each")
    kept, late = joins.on_time(run, "id", "ts", "10 minutes")
    assert sorted((r.id, r.step) for r in late.collect()) == [(500, 1), (501, 2), (502, 2)]
    assert sorted(r.id for r in kept.collect()) == [*range(120), 503]


def test_empty_replay(spark):
    df = spark.createDataFrame([], "id int, ts timestamp, step int")
    kept, late = joins.on_time(replay.Replay(df, "none", settle="each"), "id", "ts", "1 hour")
    assert kept.count() == late.count() == 0


def test_arrival(spark):
    df = spark.createDataFrame([(at(0), 0), (at(9), 1), (at(9), 0), (None, 5)], "ts timestamp, d long")
    step = replay.arrival_step(F.col("ts"), F.col("d"), int(START.timestamp()) * 1_000_000, 10_000_000)
    assert [r[0] for r in df.select(step).collect()] == [0, 1, 0, None]


def test_what_a_stream_never_uses_is_not_staged(spark, sf_dir, monkeypatch):
    """Sign-ups and purchases alone are written for the steps of stream_unstarted, and states are saved as changes."""
    class Staged(Exception):
        pass

    def caught(rows, name):
        raise Staged({r.event_type for r in rows.select("event_type").distinct().collect()})

    monkeypatch.setattr(streams, "Replay", caught)
    with pytest.raises(Staged) as told:
        streams.stream_unstarted(spark, sf_dir)
    assert told.value.args[0] == {"signup", "purchase"}
    assert replay.with_rocksdb(spark).conf.get("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled") == "true"
