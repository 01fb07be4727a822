"""Circuit breakers over histories in parts of time: what a part does to any state that enters it is a function, and functions are folded over a key's parts.

`least` failures in a row open a breaker; for `seconds` from then on calls are refused; the next one is a probe, whose failure opens it again and whose success
closes it. What a call meets depends on all calls before it, yet no task goes through all calls of a key:

1. Each part of a key becomes its function. A closed breaker enters with 0, 1, ... least - 1 failures, so there are as many exits to know. An open one refuses calls up to
   its end; its exit depends on the call that is its probe, and only calls in the first `seconds` of a part can be. Going back from a
   part's last call, every one of these exits follows from those of later calls. Probes with the same exit are one entry.
2. A key's functions, a row for each part, are applied one after another in order: every part gets the state that enters it.
3. Parts go on from there, each by itself, and tell the outcome of every call.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import rules

#: Failures so far, and when the breaker opened if it is open (failures are `least` then).
State = tuple[int, int | None]
_STATE = "failures: int, opened: long"
_LONG_PAST = -(1 << 62)


def exits(at: list[int], failed: list[bool], least: int, life: int) -> tuple[list[State], list[tuple[int, State]]]:
    """The function of a part, from the times of its calls in order: exits by the failures a closed breaker enters with, and of an open one
    (time, exit): the first entry that isn't before the end of its refusals tells its exit; without such an entry it stays as it is."""
    n = resumes = len(at)
    closed: list[State] = [(f, None) for f in range(least)]
    probes: list[State] = [(0, None)] * n
    for i in reversed(range(n)):
        if failed[i]:
            ends = at[i] + life
            while resumes > i + 1 and at[resumes - 1] >= ends:
                resumes -= 1
            probes[i] = probes[resumes] if resumes < n else (least, at[i])
            closed = [*closed[1:], probes[i]]
        else:
            probes[i] = closed[0]
            closed = [closed[0]] * least
    out: list[tuple[int, State]] = []
    for t, state in zip(at, probes, strict=True):
        if out and out[-1][1] == state:
            out[-1] = t, state
        else:
            out.append((t, state))
        if t >= at[0] + life:
            break
    return closed, out


def leaves(entry: State, closed: list[State], probes: list[tuple[int, State]], life: int) -> State:
    """What a part makes of a state."""
    failures, opened = entry
    if opened is None:
        return closed[failures]
    return next((state for at, state in probes if at >= opened + life), entry)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.Array, list[int], list[bool]]]:
    """Name, place (an array of one), times and failures of each part; its rows follow each other, over batches too."""
    name, place, at, failed = None, None, [], []
    for batch in batches:
        names, times, bad = (batch.column(c) for c in ("_name", "_at", "_failed"))
        times, bad = times.to_numpy().tolist(), bad.to_pylist()
        edges = [0, *(np.flatnonzero(pc.not_equal(names.slice(1), names.slice(0, batch.num_rows - 1)).to_numpy(zero_copy_only=False)) + 1).tolist(), batch.num_rows] if batch.num_rows else [0]
        for a, b, own in zip(edges[:-1], edges[1:], names.take(pa.array(edges[:-1], pa.int64())).to_pylist(), strict=True):
            if own != name:
                if at:
                    yield name, place, at, failed
                name, place, at, failed = own, batch.column("_place").slice(a, 1), [], []
            at += times[a:b]
            failed += bad[a:b]
    if at:
        yield name, place, at, failed


def _lists(lists: list[list[tuple]], kinds: dict[str, pa.DataType]) -> pa.ListArray:
    """Lists of tuples as an array of lists of structs."""
    columns = zip(*(x for own in lists for x in own), strict=True) if any(lists) else [()] * len(kinds)
    fields = [pa.array(c, t) for c, t in zip(columns, kinds.values(), strict=True)]
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, lists)]), pa.int32()), pa.StructArray.from_arrays(fields, list(kinds)))


def _tuples(column: pa.ListArray) -> tuple[list[tuple], list[int]]:
    """The structs of all lists as tuples one after another, and where each list begins and the last ends."""
    flat, at = column.flatten(), np.cumsum([0, *pc.list_value_length(column).to_numpy()])
    return list(zip(*(x.to_pylist() for x in flat.flatten()), strict=True)), at.tolist()


def guarded(calls: DataFrame, key: str, order: list[str], failed: Column, least: int = rules.BREAKER_FAILURES, seconds: int = rules.BREAKER_SECONDS, part: Column | None = None) -> DataFrame:
    """What the breaker of each key does with its calls: key, the columns of order, outcome (refused, failed, passed) and is_open after the call.

    order[0] is the time of a call; calls without one come first and are long past; a null `failed` is no failure, null keys share a breaker. A part is a day, or
    what a caller gives instead; it must not fall where time rises. Spark sorts parts, spilling where it must; a task holds the times of one part.
    """
    life = seconds * 1_000_000
    place = F.struct(F.col(key).alias("key"), (F.to_date(order[0]) if part is None else part).alias("part"))
    micros = F.coalesce(F.unix_micros(F.col(order[0]).cast("timestamp")), F.lit(_LONG_PAST))
    rows = calls.select(key, *order, place.alias("_place"), micros.alias("_at"), F.coalesce(failed, F.lit(False)).alias("_failed")).withColumn("_name", F.to_json("_place")).withColumn("_hash", F.xxhash64("_name"))

    def functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = _parts(batches)
        while some := list(islice(parts, 5_000)):
            found = [exits(at, bad, least, life) for *_, at, bad in some]
            closed = _lists([x for x, _ in found], state)
            probes = _lists([[(t, *s) for t, s in x] for _, x in found], probe)
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in some], pa.string()), pa.concat_arrays([x[1] for x in some]), closed, probes], ["_name", "_place", "closed", "probes"])

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, now = None, (0, None)
        for batch in batches:
            entries = []
            (closed, ends), (probes, until) = _tuples(batch.column("closed")), _tuples(batch.column("probes"))
            for i, key_of in enumerate(batch.column("_key").to_pylist()):
                if key_of != of:
                    of, now = key_of, (0, None)
                entries.append(now)
                now = leaves(now, closed[ends[i] : ends[i + 1]], [(t, (f, o)) for t, f, o in probes[until[i] : until[i + 1]]], life)
            yield pa.RecordBatch.from_arrays([batch.column("_name"), pa.array([f for f, _ in entries], pa.int32()), pa.array([o for _, o in entries], pa.int64())], ["_name", "failures", "opened"])

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, failures, opened = None, 0, None
        for batch in batches:
            outcomes, opens = [], []
            for name, at, bad, enters, since in zip(*(batch.column(c).to_pylist() for c in ("_name", "_at", "_failed", "failures", "opened")), strict=True):
                if name != of:
                    of, failures, opened = name, enters, since
                if opened is not None and at < opened + life:
                    outcomes.append("refused")
                elif bad:
                    failures = min(failures + 1, least)
                    opened = at if failures >= least else None
                    outcomes.append("failed")
                else:
                    failures, opened = 0, None
                    outcomes.append("passed")
                opens.append(opened is not None)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (key, *order)), pa.array(outcomes, pa.string()), pa.array(opens, pa.bool_())], [key, *order, "outcome", "is_open"])

    state = {"failures": pa.int32(), "opened": pa.int64()}
    probe = {"at": pa.int64(), **state}
    # Sorted by a hash first, as names begin alike.
    dealt = rows.select("_hash", "_name", "_place", *order, "_at", "_failed").repartition("_name").sortWithinPartitions("_hash", "_name", *order)
    kind = StructType([*rows.select("_name", "_place").schema, *StructType.fromDDL(f"closed array<struct<{_STATE}>>, probes array<struct<at: long, {_STATE}>>")])
    parts = dealt.select("_name", "_place", "_at", "_failed").mapInArrow(functions, kind)
    parts = parts.select("_name", F.to_json(F.struct("_place.key")).alias("_key"), "_place.part", "closed", "probes")
    entries = parts.repartition("_key").sortWithinPartitions("_key", "part").mapInArrow(folded, "_name string, failures int, opened long")
    # Rows keep their partitions in a left join, so one shuffle serves it and the pass over parts.
    entered = rows.drop("_place").repartition("_name").join(entries, "_name", "left").sortWithinPartitions("_hash", "_name", *order)
    schema = calls.select(key, *order).schema.add("outcome", "string").add("is_open", "boolean")
    return entered.select(key, *order, "_name", "_at", "_failed", "failures", "opened").mapInArrow(told, schema)
