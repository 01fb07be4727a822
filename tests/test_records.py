"""Log records and records of runs."""

import datetime as dt
import json
import time

from pyspark.sql import functions as F

from quirework.operators import records
from quirework.streaming import joins, replay


def test_log_records(spark):
    rows = [(dt.datetime(2024, 1, 2, 3, 4, 5, 60), "ERROR", 'a "quote"', "r1", "line 1\nline 2"), (dt.datetime(2024, 1, 2, 3, 4, 5), "INFO", "é", None, None), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "at timestamp_ntz, level string, message string, request string, trace string")
    out = df.select(records.log_record(F.col("at"), F.col("level"), F.col("message"), F.col("request"), F.col("trace"), F.struct("level")).alias("r")).collect()
    assert [json.loads(r.r) for r in out] == [
        {"timestamp": "2024-01-02T03:04:05.000060Z", "level": "ERROR", "service": "quirework", "message": 'a "quote"', "request_id": "r1", "traceback": "line 1\nline 2", "context": {"level": "ERROR"}},
        {"timestamp": "2024-01-02T03:04:05Z", "level": "INFO", "service": "quirework", "message": "é", "context": {"level": "INFO"}}, {"service": "quirework", "context": {}},
    ]


def test_runs_of_streams_and_batches(spark):
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i), i // 30) for i in range(60)] + [(99, dt.datetime(2024, 1, 1), 1)]
    run = replay.Replay(spark.createDataFrame(rows, "id int, ts timestamp, step int"), "records", settle="each")
    told = records.RunRecords()
    run.spark.streams.addListener(told)
    try:
        kept, late = joins.on_time(run, "id", "ts", "5 minutes")
        end = time.time() + 20
        while sum(r[2] for r in told.rows) < 61 and time.time() < end:
            time.sleep(0.2)
    finally:
        run.spark.streams.removeListener(told)
    table = told.taken(spark)
    assert table.agg(F.sum("rows"), F.sum("late")).first()[:] == (61, 1) and late.count() == 1 and table.where("state_rows > 0 AND millis >= 0").count() >= 2
    assert told.taken(spark).count() == 0
    df, seen = records.observed(kept, "kept", newest=F.max("id"))
    df.write.format("noop").mode("overwrite").save()
    assert seen.get == {"rows": 60, "newest": 59}
