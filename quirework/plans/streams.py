"""Queries over streams that run in steps and resume from their checkpoints; events arrive up to a day after their time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming import joins, sessions
from ..streaming.replay import Replay, arrival_step
from .tables import table

STEPS, DELAY = 4, 86_400


def arriving(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as timestamps of the session's zone, with the step they arrive in: a delay of up to a day, told by the id, mixes the steps."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    low, high = e.agg(F.unix_micros(F.min("ts")), F.unix_micros(F.max("ts"))).first()
    width = ((high or 0) - (low or 0)) // STEPS + 1
    return e.withColumn("step", arrival_step(F.col("ts"), F.col("event_id") * 7919 % DELAY, low or 0, width))


def stream_session_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases save their user's session for twelve hours, views read it; an ended one is told of for twelve hours more."""
    e = arriving(spark, sf_dir).where("event_type IN ('purchase', 'view')")
    requests = e.select(F.col("user_id").alias("session_id"), F.col("event_id").alias("request_id"), "ts", (F.col("event_type") == "purchase").alias("saves"), F.col("event_id").alias("state"), "step")
    answers = Replay(requests, "store").all_steps(lambda stream, _: sessions.answered(stream, f"{DELAY} seconds", 43_200, 43_200, 3_600))
    return answers.select("session_id", "request_id", "ts_us", "outcome", "state")


def stream_unstarted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign-ups that no purchase of their user follows within a day."""
    e = arriving(spark, sf_dir).where("event_type IN ('signup', 'purchase')")
    replay = Replay(e.select(F.col("user_id").alias("job_id"), "event_id", "event_type", "ts", "step"), "unstarted")
    kind = lambda stream, name: stream.where(F.col("event_type") == name).drop("event_type")
    out = replay.all_steps(lambda stream, _: joins.unstarted(kind(stream, "signup"), kind(replay.arrived(), "purchase"), "1 DAY", f"{DELAY} seconds"))
    return out.select("job_id", "event_id", F.unix_micros("ts").alias("ts_us"))


def stream_late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a lateness of two hours: how many events of each day come in time, and how many too late."""
    kept, late = joins.on_time(Replay(arriving(spark, sf_dir).select("event_id", "ts", "step"), "late", settle="each"), "event_id", "ts", "2 hours")
    day = F.date_format("ts", "yyyy-MM-dd").alias("day")
    both = kept.select(day, F.lit(1).alias("kept"), F.lit(0).alias("late")).unionByName(late.select(day, F.lit(0).alias("kept"), F.lit(1).alias("late")))
    return both.groupBy("day").agg(F.sum("kept").alias("kept"), F.sum("late").alias("late"))


def stream_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views with their user's last purchase as the state table has it when they arrive: purchases of earlier steps."""
    replay = Replay(arriving(spark, sf_dir).select("user_id", "event_id", "event_type", "ts", "step"), "enriched")
    state = lambda rows: rows.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("state"), F.col("ts").alias("saved"))
    versions = joins.Versions(state(replay.staged().limit(0)), "user_id", ["saved", "state"])

    def plan(stream: DataFrame, step: int) -> DataFrame:
        if step != replay.steps[0]:
            versions.upsert(state(replay.staged().where(F.col("step") == replay.steps[replay.steps.index(step) - 1])))
        return joins.enriched(stream.where("event_type = 'view'"), versions.read(), "user_id")

    return replay.all_steps(plan).select("event_id", "user_id", "state", F.unix_micros("saved").alias("saved_us"))


QUERIES = {"stream_session_store": stream_session_store, "stream_unstarted": stream_unstarted, "stream_late_rows": stream_late_rows, "stream_enriched": stream_enriched}

_ARRIVING = f"""a AS (
            SELECT *, epoch_us(ts) AS t, CAST(floor((epoch_us(ts) + (event_id * 7919 % {DELAY}) * 1000000 - (SELECT min(epoch_us(ts)) FROM events)) / (SELECT (max(epoch_us(ts)) - min(epoch_us(ts))) // {STEPS} + 1 FROM events)) AS INT) AS step FROM events
        )"""
SQL = {
    "stream_session_store": f"""
        WITH e AS (
            SELECT user_id, event_id, epoch_us(ts) AS t, event_type = 'purchase' AS saves FROM events WHERE event_type IN ('purchase', 'view')
        ), r AS (
            SELECT *, last_value(CASE WHEN saves THEN t END IGNORE NULLS) OVER w + 43200000000 AS ends, last_value(CASE WHEN saves THEN event_id END IGNORE NULLS) OVER w AS last
            FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING)
        )
        SELECT CAST(user_id AS VARCHAR) AS session_id, event_id AS request_id, t AS ts_us, CASE WHEN t <= ends THEN 'found' WHEN t <= ends + 43200000000 THEN 'expired' ELSE 'missing' END AS outcome,
            CASE WHEN t <= ends THEN CAST(last AS VARCHAR) END AS state
        FROM r WHERE NOT saves AND (t // 3600000000 + 1) * 3600000 <= (SELECT max(t) // 1000 FROM e) - {DELAY * 1000}
    """,
    "stream_unstarted": f"""
        WITH s AS (
            SELECT user_id, event_id, ts FROM events WHERE event_type = 'signup'
        ), p AS (
            SELECT user_id, ts FROM events WHERE event_type = 'purchase'
        )
        SELECT user_id AS job_id, event_id, epoch_us(ts) AS ts_us FROM s
        WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.user_id = s.user_id AND p.ts BETWEEN s.ts AND s.ts + INTERVAL 1 DAY)
            AND epoch_us(ts) + 86400000000 < (SELECT least((SELECT max(epoch_us(ts)) FROM s), (SELECT max(epoch_us(ts)) FROM p))) // 1000 * 1000 - {DELAY * 1_000_000}
    """,
    "stream_late_rows": f"""
        WITH {_ARRIVING}, tops AS (
            SELECT step, max(t) // 1000 * 1000 - 7200000000 AS top FROM a GROUP BY step
        ), marks AS (
            SELECT step, max(top) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mark FROM tops
        )
        SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) FILTER (t > coalesce(mark, 0)) AS kept, count(*) FILTER (t <= coalesce(mark, 0)) AS late FROM a JOIN marks USING (step) GROUP BY 1
    """,
    "stream_enriched": f"""
        WITH {_ARRIVING}, v AS (
            SELECT v.event_id, v.user_id, max_by(p.event_id, (p.t, p.event_id)) AS state, max(p.t) AS saved_us
            FROM (SELECT * FROM a WHERE event_type = 'view') v LEFT JOIN (SELECT * FROM a WHERE event_type = 'purchase') p ON p.user_id = v.user_id AND p.step < v.step GROUP BY ALL
        )
        SELECT * FROM v
    """,
}
