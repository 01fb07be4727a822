"""Streams that meet other tables: submissions that never start, requests enriched from a state table that changes, and rows that come too late."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.jobs import latest
from ..shared import shared_dir
from .replay import Replay


def unstarted(submitted: DataFrame, started: DataFrame, within: str, late: str) -> DataFrame:
    """Submissions (job_id, ts and whatever else) that no start (job_id, ts) follows within that time, as soon as the watermark tells that none can.

    A left outer join of two streams. Both sides are bounded in time, so Spark lets submissions go once they are decided and starts once no submission can
    come before them: state holds `within` and the lateness, however long the streams run. A start at the same moment counts. A job that is submitted again is a submission of
    its own. Rows without a time are dropped, submissions without a job never start.
    """
    s = submitted.where("ts IS NOT NULL").withWatermark("ts", late)
    t = started.where("ts IS NOT NULL").select(F.col("job_id").alias("_job"), F.col("ts").alias("_start")).withWatermark("_start", late)
    met = (F.col("job_id") == F.col("_job")) & (F.col("_start") >= F.col("ts")) & (F.col("_start") <= F.col("ts") + F.expr(f"INTERVAL {within}"))
    return s.join(t, met, "leftOuter").where("_start IS NULL").drop("_job", "_start")


class Versions:
    """A table of the newest state of each key, in versions: one is written beside the others and then named, and a stream reads the one of its step."""

    def __init__(self, empty: DataFrame, key: str, order: list[str]) -> None:
        self.spark, self.schema, self.key, self.order = empty.sparkSession, empty.schema, key, order
        self.path = f"{shared_dir(self.spark)}/quirework/versions-{uuid.uuid4().hex}"
        self.number = -1
        self._write(empty)

    def _write(self, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/version={self.number + 1}")
        self.number += 1

    def read(self, number: int | None = None) -> DataFrame:
        """A version that stays as it is while later ones are written."""
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/version={self.number if number is None else number}")

    def upsert(self, rows: DataFrame) -> None:
        """The next version: of the old rows and new ones the newest of each key. Rows in any order, repeated ones too, lead to the same table."""
        both = self.read().unionByName(rows.where(F.col(self.key).isNotNull()).select(self.schema.names))
        self._write(latest(both, self.key, self.order).select(self.schema.names))


def enriched(requests: DataFrame, states: DataFrame, key: str) -> DataFrame:
    """A stream of requests with the columns of their key's state in one version of a state table, null where it has none. Neither side is kept as state."""
    return requests.join(states, key, "left")


def on_time(replay: Replay, key: str, at: str, late: str) -> tuple[DataFrame, DataFrame]:
    """The rows of a replay that come within the lateness, one of each key, and those that come later. Every row is in one of the two or repeats a key.

    The first is a stream with a watermark; what Spark drops is found by the watermark that it reports for each step, written beside it, and counted
    against Spark's own metric: another number is an error, not a silent loss.
    """
    kept = replay.all_steps(lambda stream, _: stream.withWatermark(at, late).dropDuplicatesWithinWatermark([key]))
    rows = replay.staged()
    told = [(step, dt.datetime.fromisoformat(p["eventTime"]["watermark"])) for step, p in zip(replay.steps, replay.progress, strict=False)]  # every step has rows, unless the table is empty
    marks = rows.sparkSession.createDataFrame([(k, int(round(mark.timestamp() * 1000)) * 1000) for k, mark in told] or [(0, 0)], "step int, mark long")
    gone = rows.join(F.broadcast(marks), "step").where(F.unix_micros(at) <= F.col("mark")).drop("mark")
    path = f"{replay.path}/late"
    gone.write.parquet(path)
    gone = replay.rows.sparkSession.read.schema(gone.schema).parquet(path)
    dropped = sum(o["numRowsDroppedByWatermark"] for p in replay.progress for o in p["stateOperators"])
    if gone.count() != dropped:
        raise RuntimeError(f"{gone.count()} rows are older than their step's watermark, but Spark dropped {dropped}")
    return kept, gone
