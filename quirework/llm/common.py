"""What several operators share: the shared folder, written tables, and vectorised access to Arrow text."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import shared_dir


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quirework/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quirework_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the table that written() returned as df, once nothing reads it any more."""
    path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df._quirework_path)
    path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Send whole texts to Python at most `rows` at a time, where the session has Spark's default of 10,000."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_crc(doc_id: str | Column = "doc_id") -> Column:
    """crc32 of the id written as text."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string"))


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all values one after another, and their n + 1 offsets. Nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def portions(batch: pa.RecordBatch, column: str, most: int = 1 << 20):
    """Slices of a batch of about `most` bytes of text each; one longer text is a slice of its own."""
    _, offsets = text_bytes(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = x + _M1
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


#: ASCII upper case to lower case; bytes that end a word (space, tab to carriage return).
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLANK = np.zeros(256, bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True
_BASE, _INVERSE = 0x5851F42D4C957F2D, pow(0x5851F42D4C957F2D, -1, 1 << 64)


def word_spans(raw: np.ndarray, offsets: np.ndarray, blank: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each text the number of words before it (n + 1 values)."""
    n = len(raw)
    word = ~blank[raw]
    starts, ends = word.copy(), word.copy()
    starts[1:] &= ~word[:-1]
    ends[:-1] &= ~word[1:]
    inner = offsets[(offsets > 0) & (offsets < n)]
    starts[inner] = word[inner]
    ends[inner - 1] = word[inner - 1]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return s, e, np.searchsorted(s, offsets)


def word_hashes(raw: np.ndarray, s: np.ndarray, e: np.ndarray, most: int = 1 << 18) -> np.ndarray:
    """A 64-bit hash of the bytes of each word: differences of a running polynomial, then mixed.

    The hash doesn't depend on a word's place, so runs of words of about `most` bytes are done one after another.
    """
    if len(s) > 1 and e[-1] - s[0] > most:
        cuts = [0]
        while cuts[-1] < len(s):
            cuts.append(max(cuts[-1] + 1, int(np.searchsorted(e, s[cuts[-1]] + most, "right"))))
        return np.concatenate([word_hashes(raw[s[i] : e[j - 1]], s[i:j] - s[i], e[i:j] - s[i], max(most, int(e[j - 1] - s[i]))) for i, j in zip(cuts[:-1], cuts[1:], strict=True)])
    n = len(raw)
    with np.errstate(over="ignore"):
        power = np.full(n + 1, _BASE, np.uint64)
        power[0] = 1
        power = np.multiply.accumulate(power)
        back = np.full(n + 1, _INVERSE, np.uint64)
        back[0] = 1
        back = np.multiply.accumulate(back)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[:n], out=total[1:])
        return mix64((total[e] - total[s]) * back[s] ^ (e - s).astype(np.uint64))


def clear_shared(spark: SparkSession) -> None:
    """Delete all written tables of this library in the shared folder. Results that still read them must have been consumed."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/quirework")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
