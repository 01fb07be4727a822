"""Stores of jobs, batches and sessions as tables of versions: latest state, listings, limits, lifetimes and roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import rules
from . import history


def latest(versions: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The newest version of each key. A grouped maximum: versions of a hot key combine before the shuffle."""
    rest = [c for c in versions.columns if c != key]
    newest = F.max_by(F.struct(*rest), F.struct(*order))
    return versions.groupBy(key).agg(newest.alias("v")).select(key, "v.*")


def recent(jobs: DataFrame, limit: int = rules.DEFAULT_LIMIT, created: str = "created_at", tie: str = "job_id") -> DataFrame:
    """The newest jobs; at most a hundred whatever is asked."""
    if limit < 0:
        raise ValueError("limit must not be negative")
    return jobs.orderBy(F.desc(created), tie).limit(min(limit, rules.MOST_LISTED))


def kept(touched: DataFrame, key: str, at: str, most: int = rules.MOST_KEPT) -> DataFrame:
    """The keys touched last, as many as a store keeps: a top-k, so partitions send only their own candidates."""
    last = touched.groupBy(key).agg(F.max(at).alias(at))
    return last.orderBy(F.desc(at), key).limit(most)


def unexpired(rows: DataFrame, now: Column, expires: str = "expires_at") -> DataFrame:
    """Rows that have not expired; the moment of expiry itself is still valid."""
    return rows.where(F.col(expires) >= now)


def orphans(submitted: DataFrame, started: DataFrame, key: str = "job_id") -> DataFrame:
    """Submitted jobs that never started."""
    return submitted.join(started.select(key).distinct(), key, "left_anti")


def batch_status(total: Column, ok: Column) -> Column:
    """No failure (or no page at all) is completed, some success partial, none failed."""
    return F.when(ok == total, "completed").when(ok > 0, "partial").otherwise("failed")


def batches(pages: DataFrame) -> DataFrame:
    """Roll-up of each batch: counts, status, distinct leads of its successful pages, total duration.

    Leads are made distinct by a grouped shuffle per lead before they are gathered, so a batch holds each once.
    """
    ok = F.col("status") == "completed"
    counts = pages.groupBy("batch_id").agg(
        F.count("*").alias("total_pages"), F.count_if(ok).alias("successful_pages"), F.count_if(~F.coalesce(ok, F.lit(False))).alias("failed_pages"), F.round(F.sum("duration_ms"), 2).alias("total_duration_ms")
    )
    kinds = ("emails", "phones", "social_links")
    def tagged_as(kind: str) -> Column:
        return F.transform(F.coalesce(F.col(kind), F.array().cast("array<string>")), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    tagged = F.flatten(F.array(*map(tagged_as, kinds)))
    leads = pages.where(ok).select("batch_id", F.explode(tagged).alias("lead")).select("batch_id", "lead.*").distinct()
    empty = F.array().cast("array<string>")
    gathered = leads.groupBy("batch_id").agg(*[F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.col("value")))).alias(f"all_{k}") for k in kinds])
    out = counts.join(gathered, "batch_id", "left")
    return out.select("*", batch_status(F.col("total_pages"), F.col("successful_pages")).alias("status")).fillna(0).select(
        "batch_id", "total_pages", "successful_pages", "failed_pages", "total_duration_ms", "status", *[F.coalesce(f"all_{k}", empty).alias(f"all_{k}") for k in kinds]
    )


def failure_runs(events: DataFrame, key: str, order: list[str], failed: Column, least: int = rules.BREAKER_FAILURES) -> DataFrame:
    """Runs of at least `least` consecutive failures of a key: first and last place and length.

    A run is told by the number of successes before it, counted by day and within days. order[0] is the time.
    """
    good = F.sum(F.when(F.col("_failed"), 0).otherwise(1))
    told = history.with_earlier(events.select(key, *order, failed.alias("_failed")), key, order[0], good, F.sum)
    told = told.withColumn("_good", F.coalesce(history.EARLIER, F.lit(0)) + good.over(Window.partitionBy(history.PLACE).orderBy(*order)))
    runs = told.where("_failed").groupBy(key, "_good").agg(F.min(order[0]).alias("first"), F.max(order[0]).alias("last"), F.count("*").alias("failures"))
    return runs.where(F.col("failures") >= least).drop("_good")


def new_sessions(events: DataFrame, key: str, at: str, seconds: int = rules.SESSION_SECONDS) -> DataFrame:
    """Events that found their key's session expired, or none."""
    told = history.with_earlier(events, key, at, F.max(at), F.last)
    told = told.withColumn("_before", F.coalesce(F.lag(at).over(Window.partitionBy(history.PLACE).orderBy(at)), history.EARLIER))
    return told.where(F.col("_before").isNull() | (F.col(at) > F.col("_before") + F.expr(f"INTERVAL {seconds} SECONDS"))).select(events.columns)


def live_status(total: Column, done: Column, ok: Column) -> Column:
    """Status of a batch under way: pending before its first page, running before its last, then as batch_status."""
    return F.when(done == 0, "pending").when(done < total, "running").otherwise(batch_status(done, ok))
