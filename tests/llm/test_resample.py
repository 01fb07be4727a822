"""Importance resampling against plain counting, and odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quirework.llm import resample

SCHEMA = "doc_id long, text string, score double, rank string, `n words` int"


def plain_features(text, n=3, buckets=10_000):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return [zlib.crc32(" ".join(words[i : i + k]).encode()) % buckets for k in range(1, n + 1) for i in range(len(words) - k + 1)], len(words)


def plain(docs, target, percent=5, least=20, buckets=10_000):
    own = [(i, *plain_features(t, buckets=buckets)) for i, t in docs]
    s, t = Counter(b for _, f, _ in own for b in f), Counter(b for x in target for b in plain_features(x, buckets=buckets)[0])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
    rows = []
    for i, f, n in own:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, f))
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    some = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0]))
    for k, r in enumerate(some[: percent * len(some) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=repr)


def drawn(spark, docs, target, **options):
    docs = spark.createDataFrame([(i, t, 1.0, "r", 2) for i, t in docs], SCHEMA).repartition(3)
    target = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    return sorted(map(tuple, resample.resampled(docs, target, "item_id", **options).collect()), key=repr)


ODD = [None, "", " .,- ", "One", "a b", "A B c", "É́ ΑΣ 漢字🙂x \x1c İ-9", "x" * 70_000 + " y " + "z" * 64 + " " + "z" * 65, "a\x00b\x7fc`d{e", "tail "]


def test_features():
    rng = np.random.default_rng(5)
    texts = ODD + [" ".join("w" * int(k) for k in rng.integers(1, 200, 50)) for _ in range(20)]
    for n in (1, 3):
        stream, starts, words = resample.features(pa.array(texts), n, 10_000)
        for k, t in enumerate(texts):
            want, count = plain_features(t, n)
            assert stream[starts[k] : starts[k + 1]].tolist() == want and words[k] == count
    stream, starts, words = resample.features(pa.array([], pa.string()), 3, 7)
    assert len(stream) == 0 and starts.tolist() == [0] and len(words) == 0


def test_run_lengths():
    values, n = resample.run_lengths(np.array([3, 1, 3, 65535, 3], np.uint16))
    assert (values.tolist(), n.tolist()) == ([1, 3, 65535], [1, 3, 1])
    assert [len(x) for x in resample.run_lengths(np.zeros(0, np.uint16))] == [0, 0]


@pytest.mark.parametrize("percent", [5, 37, 100])
def test_draw(spark, percent):
    rng = np.random.default_rng(1)
    docs = [(i, " ".join(f"w{x}" for x in rng.zipf(1.5, rng.integers(0, 60)) % 50)) for i in range(300)] + list(enumerate(ODD, 1000)) + [(None, "w1 " * 30)]
    target = ["w1 w2 w3 w1 w2", None, "w7 " * 9]
    assert drawn(spark, docs, target, percent=percent) == plain(docs, target, percent)


def test_ties_and_empty(spark):
    docs = [(7, "w1 w2 " * 15)] * 40 + [(8, "w1 " * 19)]
    rows = drawn(spark, docs, [], percent=50)
    assert sorted(r[4] for r in rows if r[4]) == list(range(1, 21)) and len(rows) == 41
    assert {r[:4] for r in rows} == {r[:4] for r in plain(docs, [])}
    assert drawn(spark, [], ["a"]) == [] and drawn(spark, docs[:1], [None]) == plain(docs[:1], [None])
    with pytest.raises(ValueError):
        drawn(spark, docs, [], buckets=1 << 17)


def test_long_text(spark):
    docs = [(1, " ".join(f"w{i * i % 9973}" for i in range(300_000))), (2, "w1 w4 w9")]
    assert drawn(spark, docs, ["w1 w4"], percent=100) == plain(docs, ["w1 w4"], 100)


def test_streams_are_smaller_than_their_features(spark, sf_dir):
    from quirework.llm.common import table

    streams = resample.packed(table(spark, sf_dir, "documents"), "doc_id").collect()
    assert sum(len(r.stream) for r in streams) == 2 * sum(sum(r.sizes) for r in streams)
