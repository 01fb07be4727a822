"""Histories in parts of time against plain windows over whole keys: null keys, null times, ties, one hot key, empty tables."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quirework.operators import history, jobs


@pytest.fixture(scope="module")
def events(spark):
    rng = random.Random(3)
    start = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(3000):
        key = rng.choice([None, 1, 2, 2, 2, 2, 3])
        at = None if rng.random() < 0.01 else start + dt.timedelta(minutes=5 * rng.randrange(6000))
        rows.append((i, key, at, rng.choice(["error", "error", "ok"]), rng.choice([None, None, i])))
    return spark.createDataFrame(rows, "id long, k int, ts timestamp, kind string, v long").repartition(7).cache()


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_filled(events):
    w = Window.partitionBy("k").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)
    want = events.select("*", F.last("v", ignorenulls=True).over(w).alias("got"))
    assert rows_of(history.filled(events, "k", ["ts", "id"], F.col("v"), "got")) == rows_of(want)
    by_hour = history.filled(events, "k", ["ts", "id"], F.col("v"), "got", F.date_trunc("hour", "ts"))
    assert rows_of(by_hour) == rows_of(want)
    assert history.filled(events.limit(0), "k", ["ts", "id"], F.col("v"), "got").count() == 0


def test_failure_runs(events):
    bad = F.col("kind") == "error"
    w = Window.partitionBy("k").orderBy("ts", "id")
    told = events.withColumn("good", F.sum(F.when(bad, 0).otherwise(1)).over(w))
    want = told.where(bad).groupBy("k", "good").agg(F.min("ts"), F.max("ts"), F.count("*").alias("n")).where("n >= 3").drop("good")
    got = jobs.failure_runs(events, "k", ["ts", "id"], bad, 3)
    assert rows_of(got) == rows_of(want) and got.count() > 100


def test_new_sessions(events):
    before = F.lag("ts").over(Window.partitionBy("k").orderBy("ts"))
    want = events.withColumn("b", before).where("b IS NULL OR ts > b + INTERVAL 300 SECONDS").groupBy("k", "ts").count()
    got = jobs.new_sessions(events, "k", "ts")
    assert got.columns == events.columns and rows_of(got.groupBy("k", "ts").count()) == rows_of(want)


def test_rows_are_shuffled_once(spark, events):
    """One exchange of the rows; the other three are of parts."""
    changed = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in changed}
    try:
        for k, v in changed.items():
            spark.conf.set(k, v)
        plan = history.filled(events, "k", ["ts", "id"], F.col("v"), "got")._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert plan.count("Exchange hashpartitioning") == 4
