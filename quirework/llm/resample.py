"""Importance resampling towards a target distribution, over hashed word n-grams, by external sort-count.

1. One pass over the texts writes each portion of documents as a packed stream of uint16 bucket numbers, one for each n-gram, with the
   places where documents begin. Texts are read once; what follows reads streams.
2. Streams are sorted and run-length encoded; runs add up to counts in each task, and tasks' counts by a grouped sum. No more than
   `buckets` rows reach the driver. The target table is counted in the same way.
3. A bucket's gain is floor(1000 * ln((t + 1) * (S + buckets) / ((s + 1) * (T + buckets)))), s and t being its counts, S and T all of them.
4. A second pass over the streams gathers gains and adds them up between the places (np.add.reduceat): a document's weight.
5. Weight and Gumbel noise, drawn from a keyed hash of the id, make the score. Drawing the highest scores is drawing without
   replacement in proportion to exp(weight / 1000). The draw is ranked over the cluster: rows are dealt into ranges of scores and sorted there, and
   ranks follow from the sizes of the ranges. Nothing but these sizes passes through one task.

Words are runs of letters A-Z (lower-cased), digits and everything beyond ASCII. The bucket of an n-gram is the CRC-32 of its bytes, words joined by
one space, modulo `buckets`. Checksums of words are computed once; those of n-grams follow by linearity: the checksum of `a b` is that of
`a` moved over the bytes of ` b`, plus that of ` b`.

Defined results: null and empty texts and texts without words have no features and weight 0; very long texts are a portion
alone; rows without an id take the noise of the empty id and come last in ties; repeated rows are
rows of their own, with ranks of their own in any order; an empty table gives no rows; an empty target leaves plain smoothing. Only the id and the text of
the tables are read, so other columns may have any name.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, portions, small_batches, text_bytes, word_spans, written

#: Bytes that no word holds: ASCII but letters and digits.
OTHER = np.zeros(256, bool)
OTHER[:128] = [not chr(c).isalnum() for c in range(128)]

_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, (_CRC >> 1) ^ np.uint32(0xEDB88320), _CRC >> 1)


def _moved(state: np.ndarray, table: np.ndarray) -> np.ndarray:
    """States times a linear map of 32 bits, given by its values for each byte at each of four places."""
    return table[0][state & 255] ^ table[1][state >> 8 & 255] ^ table[2][state >> 16 & 255] ^ table[3][state >> 24]


def _bytes_at_places() -> np.ndarray:
    return np.arange(256, dtype=np.uint32) << np.array([0, 8, 16, 24], np.uint32)[:, None]


#: How a checksum moves over n zero bytes: for each n below 64, and for 64, 128, 256, ... bytes.
_STEPS = [_bytes_at_places()]
for _ in range(64):
    _STEPS.append(_CRC[_STEPS[-1] & 255] ^ (_STEPS[-1] >> 8))
_FAR = [_STEPS.pop()]
while len(_FAR) < 25:
    _FAR.append(_moved(_FAR[-1], _FAR[-1]))
_NEAR = np.stack(_STEPS, 1).reshape(4, -1)


def over(crc: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Checksums moved over `size` more bytes each; XOR with the checksum of these bytes gives that of both together."""
    near = (size & 63) * 256
    out = _NEAR[0][near + (crc & 255)] ^ _NEAR[1][near + (crc >> 8 & 255)] ^ _NEAR[2][near + (crc >> 16 & 255)] ^ _NEAR[3][near + (crc >> 24)]
    far = size >> 6
    for k in range(int(far.max(initial=0)).bit_length()):
        some = np.flatnonzero(far >> k & 1)
        out[some] = _moved(out[some], _FAR[k])
    return out


def word_crcs(raw: np.ndarray, s: np.ndarray, e: np.ndarray, long: int = 64) -> np.ndarray:
    """The CRC-32 of each word: all words byte by byte side by side, shortest ones done first; longer ones than `long` alone."""
    size = e - s
    order = np.argsort(np.minimum(size, long + 1).astype(np.uint8), kind="stable")[::-1]
    at, left = s[order], size[order]
    state = np.full(len(s), 0xFFFFFFFF, np.uint32)
    for k in range(int(min(left[0], long)) if len(s) else 0):
        n = len(left) - int(np.searchsorted(left[::-1], k, "right"))  # words longer than k stand in front
        state[:n] = _CRC[(state[:n] ^ raw[at[:n] + k]) & 255] ^ (state[:n] >> 8)
    out = np.empty(len(s), np.uint32)
    out[order] = ~state
    for i in np.flatnonzero(size > long):
        out[i] = zlib.crc32(raw[s[i] : e[i]].tobytes())
    return out


def features(texts: pa.Array, n: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The buckets of all n-grams of 1 to n words of all texts one after another, the n + 1 places where texts begin, and their numbers of words."""
    raw, offsets = text_bytes(texts)
    raw = LOWER[raw]
    s, e, at = word_spans(raw, offsets, OTHER)
    crc, size = word_crcs(raw, s, e), e - s
    after = over(np.full(len(s), zlib.crc32(b" "), np.uint32), size) ^ crc  # of a space and the word
    words = np.diff(at)
    owner = np.repeat(np.arange(len(words)), words)
    left = at[1:][owner] - np.arange(len(s))  # words from here to the end of the text
    counts = sum(np.maximum(words - k, 0) for k in range(n))
    starts = np.concatenate([[0], np.cumsum(counts)])
    out = np.empty(int(starts[-1]), np.uint16)
    place, here, gram = starts[:-1].copy(), np.arange(len(s)), crc
    for k in range(n):
        if k:
            keep = left[here] > k
            here = here[keep]
            gram = over(gram[keep], size[here + k] + 1) ^ after[here + k]
        out[place[owner[here]] + here - at[owner[here]]] = gram % np.uint32(buckets)
        place += np.maximum(words - k, 0)
    return out, starts, words


def packed(table: DataFrame, key: str, n: int = 3, buckets: int = 10_000) -> DataFrame:
    """Streams: ids, numbers of words and of features of a portion's documents, and the packed buckets of all their features."""
    if buckets > 1 << 16:
        raise ValueError("a bucket's number must fit 16 bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(values: pa.Array) -> pa.ListArray:
            return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

        for batch in batches:
            for part in portions(batch, "text"):
                stream, starts, words = features(part.column("text"), n, buckets)
                columns = [row(part.column("id")), row(pa.array(words, pa.int64())), row(pa.array(np.diff(starts), pa.int64())), pa.array([stream.tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["ids", "words", "sizes", "stream"])

    return table.select(F.col(key).cast("long").alias("id"), "text").mapInArrow(run, "ids array<long>, words array<long>, sizes array<long>, stream binary")


def run_lengths(stream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of a stream and how often each stands in it, from its sorted copy."""
    ordered = np.sort(stream, kind="stable")  # a radix sort for 16 bits
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])[: len(ordered)])
    return ordered[starts], np.diff(np.concatenate([starts, [len(ordered)]]))


def counted(streams: DataFrame, buckets: int = 10_000) -> np.ndarray:
    """How many features of all streams are in each bucket. A task sends what it has counted, not its streams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for packed_row in batch.column(0):
                values, n = run_lengths(np.frombuffer(packed_row.as_py(), np.uint16))
                total[values] += n
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in streams.select("stream").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(own: np.ndarray, target: np.ndarray) -> np.ndarray:
    """What a feature of each bucket adds to a document's weight: thousandths of the log ratio of smoothed shares."""
    s, t, buckets = own.astype(float), target.astype(float), float(len(own))
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def weighed(streams: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features and weight of every document of the streams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, words, sizes, stream in zip(*(batch.column(c) for c in ("ids", "words", "sizes", "stream")), strict=True):
                n = sizes.values.to_numpy()
                weight = np.zeros(len(n), np.int64)
                some = np.flatnonzero(n)  # reduceat has no empty segments
                if len(some):
                    weight[some] = np.add.reduceat(gain[np.frombuffer(stream.as_py(), np.uint16)], (np.cumsum(n) - n)[some])
                yield pa.RecordBatch.from_arrays([ids.values, words.values, sizes.values, pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    return streams.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int) -> Column:
    """Standard Gumbel noise in thousandths, from the first 32 bits of a keyed digest of the id."""
    h = F.conv(F.left(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), F.lit(8)), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296))).cast("long")


def ranked(scored: DataFrame, percent: int) -> DataFrame:
    """scored (score, doc_id, row and others) with rank: 1, 2, 3, ... down the scores for the highest floor(percent of all), null for the others."""
    ranges = scored.repartitionByRange(F.desc("score"), F.asc_nulls_last("doc_id"), "row").sortWithinPartitions(F.desc("score"), F.asc_nulls_last("doc_id"), "row")
    ranges = written(ranges.withColumn("at", F.monotonically_increasing_id()), "ranges").withColumn("part", F.shiftright("at", 33))
    sizes = sorted((r.part, r.n) for r in ranges.groupBy("part").agg(F.count("*").alias("n")).collect())  # a row for each partition
    before, drawn = 0, percent * sum(n for _, n in sizes) // 100
    offsets = []
    for part, n in sizes:
        offsets.append((part, before))
        before += n
    place = F.broadcast(scored.sparkSession.createDataFrame(offsets, "part long, before long"))
    rank = F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1) + 1
    return ranges.join(place, "part").withColumn("rank", F.when(rank <= drawn, rank)).drop("part", "at", "before")


def resampled(docs: DataFrame, target: DataFrame, target_key: str, percent: int = 5, least_words: int = 20, seed: int = 42, n: int = 3, buckets: int = 10_000) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of docs; rank is null for rows that aren't drawn.

    Drawn are floor(percent * N / 100) of the N documents of at least `least_words` words.
    """
    small_batches(docs.sparkSession)
    streams = written(packed(docs, "doc_id", n, buckets), "streams")
    gain = gains(counted(streams, buckets), counted(packed(target, target_key, n, buckets), buckets))
    score = F.col("weight") + noise(F.col("doc_id"), seed)
    scored = written(weighed(streams, gain).withColumn("score", score).withColumn("row", F.monotonically_increasing_id()), "scored")
    out = ranked(scored.where(F.col("n_words") >= least_words), percent).unionByName(scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")))
    return out.select("doc_id", "n_features", "weight", "score", "rank")
