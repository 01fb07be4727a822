"""Life cycles as streams: windows over events, sessions, states of jobs with a time limit, and an idempotent sink."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import IntegerType, StructField, StructType

from .. import rules
from ..operators.jobs import latest, live_status
from ..shared import shared_dir


def event_stream(spark: SparkSession, sf_dir: str, max_files: int | None = 16) -> DataFrame:
    """events as a stream of bounded steps, or with None of one; ts becomes a timestamp of the session's zone, as watermarks need."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    # A file source reads folders: the glob stands for one file or for the files of a folder of that name.
    reader = spark.readStream.schema(schema)
    stream = (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).parquet(f"{sf_dir}/event[s].parquet")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def daily_counts(events: DataFrame, late: str = "1 day") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n")).select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n")


def user_sessions(events: DataFrame, gap: str = "2 hours", late: str = "1 day") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.unix_micros("session_window.start").alias("start_us"), "n")


def without_repeats(events: DataFrame, key: str = "event_id", late: str | None = "1 day") -> DataFrame:
    """One event of each key; with late=None, for bounded replays, however far apart repeats are."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key]) if late else events.dropDuplicates([key])


def replayed(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """All that a bounded stream gives, written by the executors to the folder named by spark.checkpoint.dir and read again. In update mode the rows that a
    step changed, beside its number (`step`): the newest of each key are the result, and no step writes what it didn't change."""
    spark = stream.sparkSession
    path = f"{shared_dir(spark)}/quirework/{name}-{uuid.uuid4().hex}"

    def write(batch: DataFrame, step: int) -> None:
        (batch.withColumn("step", F.lit(step)) if mode == "update" else batch).write.mode("overwrite").parquet(f"{path}/out/batch={step}")

    stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{path}/check").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(StructType([*stream.schema, StructField("step", IntegerType())]) if mode == "update" else stream.schema).parquet(f"{path}/out/*")


#: Status to the statuses it may move to.
JOB_MOVES = {None: ("pending",), "pending": ("running", "failed"), "running": ("completed", "failed")}


def job_states(events: DataFrame, expire_after: str = "1 day", late: str = "1 day") -> DataFrame:
    """One row for each move of a job (job_id, status, ts) that its machine accepts. Events that it does not accept are dropped,
    so repeated ones change nothing; a state that event time leaves behind by the time limit goes."""
    limit = int(pd.Timedelta(expire_after).total_seconds() * 1000)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now = state.get[0] if state.exists else None
        moves, last = [], 0
        for r in sorted((r for part in parts for r in part.itertuples()), key=lambda r: r.ts):
            last = max(last, int(r.ts.timestamp() * 1000))
            if r.status in JOB_MOVES.get(now, ()):
                now = r.status
                moves.append((key[0], now, r.ts))
        if now:
            state.update((now,))
            state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + limit)
        if moves:
            yield pd.DataFrame(moves, columns=["job_id", "status", "ts"])

    return events.withWatermark("ts", late).groupBy("job_id").applyInPandasWithState(step, "job_id string, status string, ts timestamp", "status string", "append", GroupStateTimeout.EventTimeTimeout)


def batch_states(pages: DataFrame) -> DataFrame:
    """Status of each batch as its pages come in (batch_id, total, ok): pending, running, then completed, partial or failed. Rows whose ok is null are
    submissions. A running count, kept by Spark's own aggregation; a page's failure does not end its batch, repeated submissions change nothing."""
    known = pages.groupBy("batch_id").agg(F.max("total").alias("total"), F.count("ok").alias("done"), F.count_if("ok").alias("ok"))
    return known.select("batch_id", "done", "ok", live_status(F.col("total"), F.col("done"), F.col("ok")).alias("status"))


def session_states(saves: DataFrame, lives: str = f"{rules.SESSION_SECONDS} seconds", late: str = "1 day") -> DataFrame:
    """Each life of a session (session_id, state, saves, expires_at) from its saves (session_id, state, ts): a save renews it, and one after its end begins
    another. Its state is the one saved last (of equal times the greatest). Event time lets ended sessions go, so the stream holds live ones only."""
    life = saves.withWatermark("ts", late).groupBy(F.session_window("ts", lives), "session_id")
    return life.agg(F.max_by("state", F.struct("ts", "state")).alias("state"), F.count("*").alias("saves")).select("session_id", "state", "saves", F.col("session_window.end").alias("expires_at"))


def upsert_versions(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append the versions of each step under the step's own folder: a step that runs again replaces what it wrote before."""
    def write(batch: DataFrame, step: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/step={step}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, path: str, key: str = "job_id", order: str = "ts") -> DataFrame:
    """The newest version of each key that upsert_versions() wrote."""
    return latest(spark.read.parquet(path), key, [order, "step"]).drop("step")
