"""Settings of a session: quirework.* keys of the Spark configuration, with types; unknown keys are ignored."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import SparkSession

from . import rules


@dataclass(frozen=True)
class Settings:
    as_of_year: int = 2026
    session_seconds: int = rules.SESSION_SECONDS
    output_seconds: int = rules.OUTPUT_SECONDS
    max_files_per_trigger: int = 16
    retry_attempts: int = rules.MOST_ATTEMPTS
    breaker_failures: int = rules.BREAKER_FAILURES
    allow_mixed_domains: bool = False


def settings(spark: SparkSession) -> Settings:
    found = {}
    for f in fields(Settings):
        if (raw := spark.conf.get(f"quirework.{f.name}", None)) is not None:
            found[f.name] = raw.strip().lower() in ("1", "true", "yes") if isinstance(f.default, bool) else type(f.default)(raw)
    return Settings(**found)
