"""Log records as JSON with fixed keys, and records of what runs have done: from streams by a listener, from batches by observed metrics.

A record's keys are timestamp, level, service and message, and where they are known request_id, traceback and context. Times are UTC with a Z, with microseconds
unless these are zero. Null keys are left out; a null time or message leaves its key out too.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

SERVICE = "quirework"
RUNS = "name string, step long, rows long, late long, state_rows long, millis long, at string"


def log_record(at: Column, level: Column, message: Column, request_id: Column | None = None, traceback: Column | None = None, context: Column | None = None, service: str = SERVICE) -> Column:
    """One record; at is a time without a zone, or one in a session whose zone is UTC."""
    whole = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.date_format(at, ".SSSSSS")
    stamp = F.concat(whole, F.when(fraction == ".000000", "").otherwise(fraction), F.lit("Z"))
    known = [stamp.alias("timestamp"), level.alias("level"), F.lit(service).alias("service"), message.alias("message")]
    known += [c.alias(n) for n, c in (("request_id", request_id), ("traceback", traceback), ("context", context)) if c is not None]
    return F.to_json(F.struct(*known), {"ignoreNullFields": "true"})


class RunRecords(StreamingQueryListener):
    """A row for each batch of the streams of the session it is added to; the newest `most` are kept until they are taken."""

    def __init__(self, most: int = 10_000) -> None:
        self.rows: deque[tuple] = deque(maxlen=most)

    def onQueryStarted(self, event: object) -> None:
        pass

    def onQueryIdle(self, event: object) -> None:
        pass

    def onQueryTerminated(self, event: object) -> None:
        pass

    def onQueryProgress(self, event: object) -> None:
        p = event.progress
        late, held = (sum(getattr(o, n) for o in p.stateOperators) for n in ("numRowsDroppedByWatermark", "numRowsTotal"))
        self.rows.append((p.name or str(p.id), p.batchId, p.numInputRows, late, held, p.batchDuration, p.timestamp))

    def taken(self, spark: SparkSession) -> DataFrame:
        """The rows so far as a table, each given once."""
        rows = [self.rows.popleft() for _ in range(len(self.rows))]
        return spark.createDataFrame(rows, RUNS)


def observed(df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, Observation]:
    """df, and what an action on it will have told of it beside its result, in the same pass: the number of rows, and aggregates by name."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in metrics.items()]), seen
