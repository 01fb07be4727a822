"""Breakers in parts of time against a plain loop over all calls of a key."""

import datetime as dt
import random

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quirework.operators import breaker


def loop(calls, least, life, entry=(0, None)):
    """Outcomes of (time, failed) in order, and the state after them."""
    failures, opened = entry
    out = []
    for at, bad in calls:
        if opened is not None and at < opened + life:
            out.append("refused")
        elif bad:
            failures = min(failures + 1, least)
            opened = at if failures == least else None
            out.append("failed")
        else:
            failures, opened = 0, None
            out.append("passed")
    return out, (failures, opened)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.booleans()), min_size=1, max_size=40), st.integers(1, 4), st.integers(0, 60))
def test_function_of_a_part(gaps, least, life):
    """For every state that can enter a part its function gives the state that a loop ends in."""
    at, calls = 1000, []
    for gap, bad in gaps:
        at += gap
        calls.append((at, bad))
    closed, probes = breaker.exits(np.array([t for t, _ in calls]), [b for _, b in calls], least, life)
    entries = [(f, None) for f in range(least)] + [(least, t) for t in range(calls[0][0] - life - 3, calls[0][0] + 1)]
    for entry in entries:
        assert breaker.leaves(entry, closed, probes, life) == loop(calls, least, life, entry)[1]


def test_against_a_loop(spark):
    """One key with most calls, null keys and times, parts of an hour or a day: the outcomes are those of one loop."""
    rng = random.Random(5)
    start = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(3000):
        at = None if rng.random() < 0.003 else start + dt.timedelta(seconds=rng.randrange(200_000))
        rows.append((i, rng.choice([None, "a", "b", "b", "b", "b"]), at, rng.choice([True, True, False, None])))
    calls = spark.createDataFrame(rows, "n long, k string, ts timestamp_ntz, bad boolean").repartition(5)
    want = {}
    for key in (None, "a", "b"):
        own = sorted((r for r in rows if r[1] == key), key=lambda r: (r[2] is not None, r[2] or start, r[0]))
        told, _ = loop([(-(1 << 62) if r[2] is None else int((r[2] - start).total_seconds()) * 1_000_000, bool(r[3])) for r in own], 3, 900_000_000)
        want |= {r[0]: o for r, o in zip(own, told, strict=True)}
    for part in (None, F.date_trunc("hour", "ts"), F.lit(1)):
        got = breaker.guarded(calls, "k", ["ts", "n"], F.col("bad"), 3, 900, part).collect()
        assert {r.n: r.outcome for r in got} == want and len(got) == len(rows)


def test_no_task_holds_more_than_a_part(spark):
    """With one key for all rows, its days are spread over partitions and its parts alone meet in one."""
    rows = [(i, "k", dt.datetime(2024, 1, 1) + dt.timedelta(hours=i)) for i in range(24 * 60)]
    out = breaker.guarded(spark.createDataFrame(rows, "n long, k string, ts timestamp_ntz"), "k", ["ts", "n"], F.col("n") % 3 == 0, 2, 60)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [r["count"] for r in breaker.guarded(spark.createDataFrame(rows, "n long, k string, ts timestamp_ntz"), "k", ["ts", "n"], F.col("n") % 3 == 0, 2, 60).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert out.count() == len(rows) and len(sizes) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(sizes) < 0.5 * len(rows)


def test_small_parts_are_handed_over_together():
    """Parts run over batches, and the functions of many parts are one array: nothing is built for each of them alone."""
    names, batches = [f'{{"key":{k // 7}}}' for k in range(60)], []
    for low in range(0, 60, 11):
        own = range(low, min(low + 11, 60))
        batches.append(pa.RecordBatch.from_pydict({"_name": [names[i] for i in own], "_place": [{"key": i // 7} for i in own], "_at": list(own), "_failed": [i % 2 == 0 for i in own]}))
    parts = list(breaker._parts(iter([batches[0].slice(0, 0), *batches])))
    assert [(n, p.to_pylist(), at, bad) for n, p, at, bad in parts] == [
        (f'{{"key":{k}}}', [{"key": k}], list(range(7 * k, min(7 * k + 7, 60))), [i % 2 == 0 for i in range(7 * k, min(7 * k + 7, 60))]) for k in range(9)
    ]
    kinds = {"at": pa.int64(), "failures": pa.int32(), "opened": pa.int64()}
    for lists in ([breaker.exits(at, bad, 2, 3)[1] for *_, at, bad in parts], [[]], []):
        rows = [[(t, *s) for t, s in x] for x in lists]
        flat, at = breaker._tuples(breaker._lists(rows, kinds))
        assert [flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)] == rows
