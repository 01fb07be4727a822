"""A store of the newest version of each key: saves append, reads merge, compaction rewrites, lookups read one bucket and few row groups.

Saves are tables of versions beside a base table; both lie in buckets by a hash of the key, sorted by key in files with Bloom filters, so a lookup lists one folder, and
statistics and filters leave it the row groups that may hold the key. A manifest names the base and the tables since. It changes only by
renaming a whole draft to the next number, which fails if another writer was first (as atomically as the file system renames); then the change is made anew on what that writer left. Readers
keep the version they began with.

The state is a function of the set of versions that were ever saved, whatever their order, their repetition and the compactions between: of each key the
newest version (by `order`, then by its values), if it is among the `most` keys with the newest versions. A version that is `deleted` hides its key but holds its
place among them until newer keys push it out; so forgetting old keys early never changes what is kept later. Rows without a key are dropped.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import rules
from .jobs import latest


class KeyedStore:
    def __init__(self, spark: SparkSession, path: str, schema: StructType | str, key: str, order: list[str], buckets: int = 16, most: int | None = rules.MOST_KEPT) -> None:
        """schema: of the versions, without the column `deleted`."""
        self.spark, self.path, self.key, self.order, self.buckets, self.most = spark, path.rstrip("/"), key, order, buckets, most
        columns = StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self.columns = columns.names
        self.schema = StructType([*columns, *StructType.fromDDL("deleted boolean, bucket int")])
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._files = self._hadoop.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def manifest(self) -> tuple[int, dict]:
        """The number and the content of the newest manifest."""
        folder = self._hadoop.Path(f"{self.path}/manifests")
        names = [f.getPath().getName() for f in self._files.listStatus(folder)] if self._files.exists(folder) else []
        numbers = [int(n) for n in names if n.isdigit()]
        if not numbers:
            return 0, {"base": None, "deltas": []}
        return max(numbers), json.loads(self.spark.read.text(f"{self.path}/manifests/{max(numbers):08d}").first()[0])

    def _commit(self, change: Callable[[dict], dict]) -> int:
        draft = self._hadoop.Path(f"{self.path}/manifests/.{uuid.uuid4().hex}")
        while True:
            number, now = self.manifest()
            name = self._hadoop.Path(f"{self.path}/manifests/{number + 1:08d}")
            out = self._files.create(draft, True)
            out.write(json.dumps(change(now)).encode())
            out.close()
            if not self._files.exists(name) and self._files.rename(draft, name):
                return number + 1
            if self.manifest()[0] == number:
                raise RuntimeError(f"manifest {number + 1} can't be written")

    def _write(self, rows: DataFrame) -> str:
        """Rows in a folder of their own, by bucket and in the order of keys."""
        name = uuid.uuid4().hex
        dealt = rows.withColumn("bucket", self._bucket(F.col(self.key))).repartition("bucket").sortWithinPartitions("bucket", self.key)
        dealt.write.partitionBy("bucket").option(f"parquet.bloom.filter.enabled#{self.key}", "true").option("parquet.block.size", str(8 << 20)).parquet(f"{self.path}/tables/{name}")
        return name

    def _versions(self, manifest: dict) -> DataFrame:
        """All versions that a manifest names."""
        names = [n for n in (manifest["base"], *manifest["deltas"]) if n]
        if not names:
            return self.spark.createDataFrame([], self.schema)
        reader = self.spark.read.schema(self.schema)
        tables = [reader.parquet(f"{self.path}/tables/{n}") for n in names]
        out = tables[0]
        for t in tables[1:]:
            out = out.unionByName(t)
        return out

    def _newest(self, versions: DataFrame) -> DataFrame:
        values = [c for c in [*self.columns, "deleted"] if c not in (self.key, *self.order)]
        return latest(versions.select(*self.columns, "deleted"), self.key, [*self.order, *values])

    def _kept(self, newest: DataFrame) -> DataFrame:
        """Without keys that newer ones pushed out: one row tells where the newest `most` end."""
        if self.most is None:
            return newest
        place = F.struct(*self.order, self.key)
        last = newest.select(place.alias("p")).orderBy(F.desc("p")).limit(self.most).agg(F.min("p").alias("p"), F.count("*").alias("n")).first()
        if last.n < self.most:
            return newest
        names = [*self.order, self.key]
        edge = self.spark.createDataFrame([tuple(last.p)], newest.select(*names).schema).select(F.struct(*names).alias("_edge"))
        return newest.join(F.broadcast(edge), place >= F.col("_edge")).drop("_edge")

    def save(self, rows: DataFrame) -> int:
        """Versions (with or without a column `deleted`) of one step. Gives the number of the manifest that first holds them."""
        if "deleted" not in rows.columns:
            rows = rows.withColumn("deleted", F.lit(False))
        rows = rows.where(F.col(self.key).isNotNull()).withColumn("deleted", F.coalesce("deleted", F.lit(False)))
        name = self._write(self._newest(rows))
        return self._commit(lambda m: {"base": m["base"], "deltas": [*m["deltas"], name]})

    def compact(self) -> int:
        """Merge what was saved so far into a new base, without keys that were pushed out. Saves that come meanwhile stay beside it."""
        _, now = self.manifest()
        name = self._write(self._kept(self._newest(self._versions(now))))
        return self._commit(lambda m: {"base": name, "deltas": [d for d in m["deltas"] if d not in now["deltas"]]} if m["base"] == now["base"] else m)

    def state(self) -> DataFrame:
        """The store's rows."""
        return self._kept(self._newest(self._versions(self.manifest()[1]))).where("NOT deleted").select(self.columns)

    def lookup(self, value: object) -> DataFrame:
        """The newest version of one key, pushed out or not: a read of its bucket, in which row groups without the key are passed over."""
        kind = self.schema[self.key].dataType
        bucket = self.spark.range(1).select(self._bucket(F.lit(value).cast(kind))).first()[0]
        found = self._versions(self.manifest()[1]).where((F.col("bucket") == bucket) & (F.col(self.key) == F.lit(value).cast(kind)))
        return self._newest(found).where("NOT deleted").select(self.columns)
