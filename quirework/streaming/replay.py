"""Tables as streams of rows that arrive in steps: each step resumes the query from its checkpoint, as a restarted service does.

What a step gives is written by the executors to a folder of the step, under spark.checkpoint.dir; a step that runs again replaces it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..shared import shared_dir

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_rocksdb(spark: SparkSession) -> SparkSession:
    """A session of the same application whose streams keep their state in RocksDB: beyond memory, saved as changes of each step."""
    session = spark.newSession()
    for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        if (value := spark.conf.get(key, None)) is not None:
            session.conf.set(key, value)
    session.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    session.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    return session


def arrival_step(at: Column, delay_seconds: Column, low: int, width: int) -> Column:
    """The step in which a row arrives that is delayed after its time; low and width in microseconds."""
    return F.floor((F.unix_micros(at.cast("timestamp")) + delay_seconds * 1_000_000 - low) / width).cast("int")


def with_end(rows: DataFrame, at: str, after: str) -> DataFrame:
    """rows and, a step later, one that is null but for its time, so long after all others: watermarks pass them, and a bounded stream gives all its results."""
    last = rows.agg((F.max("step") + 1).alias("step"), (F.max(at) + F.expr(f"INTERVAL {after}")).alias(at)).where("step IS NOT NULL")
    return rows.unionByName(last, allowMissingColumns=True)


@dataclass
class Replay:
    """A stream over what has arrived so far, and its results.

    rows must have the column `step` (from 0). Rows of one step are read together, whatever files they are in.
    """

    rows: DataFrame
    name: str
    mode: str = "append"
    #: Which runs end with a batch without rows, which acts on the newest watermark: last, each (so that rows are late by the last step, not the one
    #: before it) or never (for streams by the clock, which would always ask for another one).
    settle: str = "last"
    #: What Spark reports of each batch that had rows, by step.
    progress: list[dict] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.spark = with_rocksdb(self.rows.sparkSession)
        self.path = f"{shared_dir(self.rows.sparkSession)}/quirework/{self.name}-{uuid.uuid4().hex}"
        self.schema = StructType([f for f in self.rows.schema if f.name != "step"])
        self.rows.write.partitionBy("step").parquet(f"{self.path}/staged")
        self.steps = sorted(r.step for r in self.staged().select("step").distinct().collect()) or [0]  # an empty table is one empty step

    def staged(self) -> DataFrame:
        """All rows, with their step."""
        return self.spark.read.schema(StructType([*self.schema.fields, StructField("step", IntegerType())])).parquet(f"{self.path}/staged")

    def arrived(self) -> DataFrame:
        """The stream of rows that have arrived."""
        return self.spark.readStream.schema(self.schema).parquet(f"{self.path}/in")

    def arrive(self, step: int) -> None:
        self.staged().where(F.col("step") == step).drop("step").write.mode("append").parquet(f"{self.path}/in")

    def run(self, stream: DataFrame, last: bool = True) -> None:
        """What has arrived since the last run."""
        self.spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", str(self.settle == "each" or last and self.settle == "last").lower())
        def write(batch: DataFrame, k: int) -> None:
            batch.write.mode("overwrite").parquet(f"{self.path}/out/batch={k}")

        query = stream.writeStream.foreachBatch(write).outputMode(self.mode).option("checkpointLocation", f"{self.path}/check").trigger(availableNow=True).start()
        query.awaitTermination()
        self.progress.extend(p for p in query.recentProgress if p["numInputRows"])

    def results(self, schema: StructType) -> DataFrame:
        return self.rows.sparkSession.read.schema(schema).parquet(f"{self.path}/out/*")

    def all_steps(self, plan: Callable[[DataFrame, int], DataFrame]) -> DataFrame:
        """The results of plan(stream, step) when step after step has arrived."""
        for step in self.steps:
            self.arrive(step)
            stream = plan(self.arrived(), step)
            self.run(stream, step == self.steps[-1])
        return self.results(stream.schema)
