"""Sharding by size-tiered compaction.

A store is a folder of immutable Parquet shards and of manifests. append() writes arrivals as small shards, compact() merges runs of similarly
sized shards - those in one tier of a geometric scale - into files of about a target size, and both end with the commit of the next version of
the manifest: the version's file is written under another name and renamed without overwriting, which fails if another writer was first; that
writer's version is then taken as the base of a new attempt. Readers take the newest version and see all of a commit or nothing. A failed job leaves
unlisted files that no reader looks at; vacuum() deletes shards that no kept version lists.

Many arrivals of one table are appended in one pass over it, each as a commit of its own. Merging reads the shards of a run and writes them again with fewer,
larger partitions: no rows are shuffled, and no task holds more than a target's worth. Only the list of shards (path, bytes, rows) is handled on the driver.

Defined results: an empty arrival commits a version without new shards; rows are never looked into, so nulls, repeated rows,
very long texts, ties and extra columns, whatever they are called, pass unchanged; an empty table and a store without versions read as no shards; shards of different arrivals must have the
same columns.
"""

from __future__ import annotations

import json
import math
import uuid
from collections import defaultdict
from dataclasses import asdict, dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import shared_dir


@dataclass(frozen=True)
class Shard:
    path: str  # relative to the store
    bytes: int
    rows: int
    level: int  # merges behind it


@dataclass(frozen=True)
class Version:
    number: int
    shards: tuple[Shard, ...]


class Store:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(conf)
        self._files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.root).toUri(), conf)
        self._no_options = spark.sparkContext._gateway.new_array(getattr(jvm, "org.apache.hadoop.fs.Options$Rename"), 0)

    def _list(self, folder: str) -> list[tuple[str, int]]:
        at = self._path(f"{self.root}/{folder}")
        return sorted((x.getPath().getName(), x.getLen()) for x in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def latest(self) -> Version:
        numbers = [int(n[1:-5]) for n, _ in self._list("manifests") if n.startswith("v") and n.endswith(".json")]
        return self.version(max(numbers)) if numbers else Version(0, ())

    def version(self, number: int) -> Version:
        text = self.spark.read.text(f"{self.root}/manifests/v{number:012d}.json", wholetext=True).first()[0]
        return Version(number, tuple(Shard(**x) for x in json.loads(text)))

    def _commit(self, base: Version, shards: tuple[Shard, ...]) -> bool:
        """Whether the version after base now is `shards`."""
        draft, final = self._path(f"{self.root}/manifests/.{uuid.uuid4().hex}"), self._path(f"{self.root}/manifests/v{base.number + 1:012d}.json")
        out = self._fs.create(draft)
        out.write(json.dumps([asdict(s) for s in shards]).encode())
        out.close()
        try:
            self._files.rename(draft, final, self._no_options)  # never overwrites
        except Py4JJavaError as e:
            self._fs.delete(draft, False)
            if not self._fs.exists(final):
                raise  # no other writer's doing
            return "FileAlreadyExists" not in str(e.java_exception) and self._holds(final, shards)
        return True

    def _holds(self, manifest, shards: tuple[Shard, ...]) -> bool:
        """Whether a commit whose answer was lost took place after all."""
        text = self.spark.read.text(manifest.toString(), wholetext=True).first()[0]
        return bool(shards) and json.loads(text) == [asdict(s) for s in shards]

    def commit(self, add: list[Shard], remove: set[str] = frozenset(), most_tries: int = 20) -> Version:
        """Add and remove shards in one step. Fails if a shard to be removed is gone by now."""
        for _ in range(most_tries):
            base = self.latest()
            if not remove <= {s.path for s in base.shards}:
                raise RuntimeError("another writer has removed shards of this commit")
            shards = (*(s for s in base.shards if s.path not in remove), *add)
            if self._commit(base, shards):
                return Version(base.number + 1, shards)
        raise RuntimeError(f"no commit in {most_tries} tries")

    def _shards(self, run: str, schema: StructType, level: int) -> list[Shard]:
        """The files with rows that a job has written to a folder."""
        sizes = {n: b for n, b in self._list(run) if n.endswith(".parquet")}
        if not sizes:
            return []
        rows = self.spark.read.schema(schema).parquet(f"{self.root}/{run}").groupBy(F.col("_metadata.file_name").alias("name")).agg(F.count("*").alias("n")).collect()
        return [Shard(f"{run}/{r['name']}", sizes[r["name"]], r["n"], level) for r in sorted(rows, key=lambda r: r["name"]) if r["n"]]

    def _written(self, df: DataFrame, level: int) -> list[Shard]:
        """Write df as one shard for each of its partitions that has rows."""
        run = f"shards/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{run}")
        return self._shards(run, df.schema, level)

    def append(self, arrivals: DataFrame) -> Version:
        """Commit the arrivals as small shards, one for each partition."""
        return self.commit(self._written(arrivals, 0))

    def append_each(self, df: DataFrame, arrival: Column) -> Version:
        """Commit the rows of each value of `arrival` (an integer) as an arrival of its own, in order, written in one pass over df."""
        run, name = f"shards/{uuid.uuid4().hex}", f"arrival-{uuid.uuid4().hex}"
        df.withColumn(name, arrival).write.partitionBy(name).parquet(f"{self.root}/{run}")
        folders = sorted((n for n, _ in self._list(run) if n.startswith(name)), key=lambda n: int(n.rsplit("=", 1)[1]))
        for folder in folders:
            self.commit(self._shards(f"{run}/{folder}", df.schema, 0))
        return self.latest() if folders else self.commit([])

    def read(self, shards: tuple[Shard, ...] | list[Shard] | None = None) -> DataFrame:
        shards = self.latest().shards if shards is None else shards
        if not shards:
            raise ValueError("the store has no shards")
        return self.spark.read.parquet(*[f"{self.root}/{s.path}" for s in shards])

    def compact(self, target: int, ratio: float = 4.0, least: int = 4, most_rounds: int = 20) -> Version:
        """Merge until no tier below the target holds `least` shards or half a target's bytes."""
        for _ in range(most_rounds):
            runs = plan(self.latest().shards, target, ratio, least)
            if not runs:
                break
            for run in runs:
                files = max(1, math.ceil(sum(s.bytes for s in run) / target))
                merged = self._written(self.read(run).coalesce(files), 1 + max(s.level for s in run))
                self.commit(merged, {s.path for s in run})
        return self.latest()

    def vacuum(self, keep: int = 1) -> int:
        """Delete shards that none of the newest `keep` versions lists; how many went."""
        newest = self.latest().number
        live = {s.path for v in range(max(1, newest - keep + 1), newest + 1) for s in self.version(v).shards}
        gone = 0
        todo = [f"shards/{run}" for run, _ in self._list("shards")]
        while todo:
            run = todo.pop()
            for name, _ in self._list(run):
                if name.startswith("arrival-"):
                    todo.append(f"{run}/{name}")
                elif name.endswith(".parquet") and f"{run}/{name}" not in live:
                    gone += bool(self._fs.delete(self._path(f"{self.root}/{run}/{name}"), False))
        return gone


def plan(shards: tuple[Shard, ...], target: int, ratio: float, least: int) -> list[list[Shard]]:
    """Runs of similarly sized shards to be merged. Shards of over half a target are done."""
    tiers: dict[int, list[Shard]] = defaultdict(list)
    for s in shards:
        if s.bytes < target / 2:
            tiers[int(math.log(max(s.bytes, 1), ratio))].append(s)
    return [sorted(t, key=lambda s: s.path) for _, t in sorted(tiers.items()) if len(t) >= least or (len(t) > 1 and sum(s.bytes for s in t) >= target / 2)]


def sharded(docs: DataFrame, arrivals: int = 8, target: int = 64 << 20, root: str | None = None) -> DataFrame:
    """Append docs as so many arrivals, dealt by a hash of the id whatever the files of docs are, compact, and read the store back: doc_id, shard,
    shard_rows, shard_bytes, level and version of every row that arrived."""
    spark = docs.sparkSession
    store = Store(spark, root or f"{shared_dir(spark)}/quirework/store-{uuid.uuid4().hex}")
    store.append_each(docs, F.pmod(F.xxhash64("doc_id"), F.lit(arrivals)).cast("int"))
    version = store.compact(target)
    store.vacuum()
    listed = spark.createDataFrame([("/".join(s.path.split("/")[-2:]), k, s.rows, s.bytes, s.level, version.number) for k, s in enumerate(version.shards)], "name string, shard int, shard_rows long, shard_bytes long, level int, version int")
    if not version.shards:
        return listed.select(F.lit(None).cast("long").alias("doc_id"), *listed.columns[1:])
    # Files of one pass have the same names in the folders of several arrivals.
    found = store.read(version.shards).select("doc_id", F.substring_index("_metadata.file_path", "/", -2).alias("name"))
    return found.join(F.broadcast(listed), "name").drop("name")
