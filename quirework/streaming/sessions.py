"""A store of sessions with lifetimes, as a stateful stream over requests to it.

A save sets a session's state and its end, so many seconds after the save. A read up to the end (the moment itself included) finds the state and doesn't
prolong it; in the `grace` after the end it is told that the session expired, later (or before any save) that there is none.

Event time decides, not arrival: requests wait in slots of time until the watermark has passed their slot, and are then answered in order (time,
then id). So answers don't depend on the order or the steps in which requests arrive within the lateness, and a query that resumes from
its checkpoint goes on as if it had never stopped. Sessions are dealt to buckets by a hash. A bucket has a timer for the end of its first slot that waits, at which
all slots that the watermark has passed are answered, and one that removes sessions at the end of their grace: state is held for
live sessions and for requests as late as the lateness only. What lives and waits in one bucket is worked through in memory.

Requests later than the lateness are dropped, as everywhere in Spark. Requests without a session or a time are not answered.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .. import rules

ANSWER = "session_id string, request_id long, ts_us long, outcome string, state string"
_SESSIONS = "session_id array<string>, state array<string>, ends_us array<long>"
_WAITING = "session_id array<string>, ts_us array<long>, request_id array<long>, saves array<boolean>, state array<string>"


class SessionStore(StatefulProcessor):
    """The sessions of a bucket. Their columns are arrays in one value each, as every call of the state's interface costs far more than a request."""

    def __init__(self, seconds: int, grace: int, slot: int) -> None:
        self.life, self.grace, self.slot_ms = seconds * 1_000_000, grace * 1_000_000, slot * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sessions = handle.getValueState("sessions", _SESSIONS)
        self.waiting = handle.getValueState("waiting", _WAITING)
        self.settled: dict[tuple, int] = {}  # the watermark up to which this task has answered a bucket

    def _slot_end(self, ts_us: int) -> int:
        return (ts_us // 1000 // self.slot_ms + 1) * self.slot_ms

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        new = [(r.session_id, r.ts_us, r.request_id, r.saves, r.state) for r in rows]
        self._wait([*self._held(self.waiting), *new])
        self.handle.registerTimer(self._slot_end(min(r[1] for r in new)))
        yield from ()

    @staticmethod
    def _held(state: object) -> list[tuple]:
        columns = state.get() if state.exists() else None
        return list(zip(*columns, strict=True)) if columns else []

    def _wait(self, requests: list[tuple]) -> None:
        if requests:
            self.waiting.update(tuple(map(list, zip(*requests, strict=True))))
        else:
            self.waiting.clear()

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        if self.settled.get(key) == now:  # an earlier timer of this batch has done all of it
            return
        self.settled[key] = now
        held = self._held(self.waiting)
        ready = [r for r in held if self._slot_end(r[1]) <= now]
        before = {session: (state, ends) for session, state, ends in self._held(self.sessions)}
        live = dict(before)
        for session, ts, request, saves, value in sorted(ready, key=lambda r: r[1:3]):
            state, ends = live.get(session, (None, None))
            if saves:
                live[session] = value, ts + self.life
            elif ends is None or ts > ends + self.grace:
                yield Row(session_id=session, request_id=request, ts_us=ts, outcome="missing", state=None)
            else:
                yield Row(session_id=session, request_id=request, ts_us=ts, outcome="found" if ts <= ends else "expired", state=state if ts <= ends else None)
        live = {session: kept for session, kept in live.items() if (kept[1] + self.grace) // 1000 + self.slot_ms >= now}
        if ready:
            rest = [r for r in held if self._slot_end(r[1]) > now]
            self._wait(rest)
            if rest:
                self.handle.registerTimer(self._slot_end(min(r[1] for r in rest)))
        if live != before:
            if live:
                self.sessions.update(tuple(map(list, zip(*((session, *kept) for session, kept in live.items()), strict=True))))
            else:
                self.sessions.clear()
        if live:
            self.handle.registerTimer((min(ends for _, ends in live.values()) + self.grace) // 1000 + self.slot_ms + 1)

    def close(self) -> None:
        pass


class LiveSessions(StatefulProcessor):
    """The same store by the clock: requests are answered as they come, and Spark's own lifetimes of state (TTL) let sessions go. Nothing is told of ended ones."""

    def __init__(self, seconds: int) -> None:
        self.ms = seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.session = handle.getValueState("session", "state string", self.ms)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        for r in sorted(rows, key=lambda r: (r.ts_us, r.request_id)):
            if r.saves:
                self.session.update((r.state,))
            else:
                found = self.session.exists()
                yield Row(session_id=key[0], request_id=r.request_id, ts_us=r.ts_us, outcome="found" if found else "missing", state=self.session.get()[0] if found else None)

    def close(self) -> None:
        pass


def _requests(requests: DataFrame) -> DataFrame:
    return requests.where("session_id IS NOT NULL AND ts IS NOT NULL").select("ts", F.col("session_id").cast("string"), F.col("request_id").cast("long"), F.coalesce("saves", F.lit(False)).alias("saves"), F.col("state").cast("string"), F.unix_micros("ts").alias("ts_us"))


def answered(requests: DataFrame, late: str, seconds: int = rules.SESSION_SECONDS, grace: int = rules.SESSION_SECONDS, slot: int = 60, buckets: int = 8192) -> DataFrame:
    """Answers to the reads of a stream (session_id, request_id, ts, saves, state), by event time. Needs a RocksDB store (replay.with_rocksdb).

    buckets: what lives and waits in one of them is worked through in memory, so more sessions want more of them. A query that resumes must keep their number.
    """
    keyed = _requests(requests).withColumn("bucket", F.pmod(F.xxhash64("session_id"), F.lit(buckets))).withWatermark("ts", late).groupBy("bucket")
    return keyed.transformWithState(SessionStore(seconds, grace, slot), ANSWER, "append", "EventTime")


def answered_live(requests: DataFrame, seconds: int = rules.SESSION_SECONDS) -> DataFrame:
    """Answers by the clock, as requests come."""
    return _requests(requests).groupBy("session_id").transformWithState(LiveSessions(seconds), ANSWER, "append", "ProcessingTime")
