"""The store of newest versions: any order and repetition of steps, deletions, places pushed out, two writers, and what a lookup reads."""

import itertools
import random
import uuid

import pytest

from quirework.operators.keyed import KeyedStore

SCHEMA = "k string, ts long, v string"
STEP = SCHEMA + ", deleted boolean"


@pytest.fixture
def new(spark, tmp_path):
    return lambda **options: KeyedStore(spark, f"{tmp_path}/{uuid.uuid4().hex}", SCHEMA, "k", ["ts"], **{"buckets": 4, **options})


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def plain(steps, most):
    newest = {}
    for k, ts, v, deleted in itertools.chain(*steps):
        if k is not None:
            newest[k] = max(newest.get(k, (ts, v, bool(deleted))), (ts, v, bool(deleted)))
    kept = sorted(newest.items(), key=lambda x: (x[1][0], x[0]), reverse=True)[:most]
    return sorted((k, ts, v) for k, (ts, v, deleted) in kept if not deleted)


def test_any_order_gives_one_state(spark, new):
    rng = random.Random(2)
    steps = [[(rng.choice([None, *"abcdefgh"]), rng.randrange(12), rng.choice("xyz"), rng.choice([None, False, True])) for _ in range(12)] for _ in range(3)]
    want = plain(steps, 5)
    for order in ([0, 1, 2], [2, 1, 0], [1, 0, 0, 2, 1]):
        store = new(most=5)
        for n, k in enumerate(order):
            store.save(spark.createDataFrame(steps[k], STEP))
            if n % 2:
                store.compact()
        assert rows_of(store.state()) == want
        store.compact()
        assert rows_of(store.state()) == want and store.manifest()[1]["deltas"] == []


def test_empty_store(spark, new):
    store = new()
    assert store.state().count() == 0 and store.lookup("a").count() == 0 and store.manifest()[0] == 0
    store.compact()
    store.save(spark.createDataFrame([], SCHEMA))
    assert store.state().columns == ["k", "ts", "v"] and store.state().count() == 0 and store.manifest()[0] == 2


def test_two_writers(spark, new):
    """A save between a compaction's read and its commit is kept; a number is never given twice."""
    store = new(most=None)
    store.save(spark.createDataFrame([("a", 1, "x")], SCHEMA))
    other = KeyedStore(spark, store.path, SCHEMA, "k", ["ts"], 4, None)
    write = store._write
    store._write = lambda rows: (write(rows), other.save(spark.createDataFrame([("b", 1, "y")], SCHEMA)))[0]
    assert store.compact() == 3
    store._write = write
    assert rows_of(store.state()) == [("a", 1, "x"), ("b", 1, "y")] and len(store.manifest()[1]["deltas"]) == 1
    read = store.state()
    store.manifest, first = (lambda: (2, {"base": None, "deltas": []})), store.manifest
    with pytest.raises(Exception):  # noqa: B017  a stale number is refused by the file system
        store._commit(lambda m: m)
    store.manifest = first
    assert rows_of(read) == [("a", 1, "x"), ("b", 1, "y")]


def test_lookup_reads_one_bucket(spark, tmp_path):
    store = KeyedStore(spark, f"{tmp_path}/s", "id long, v string", "id", ["v"], buckets=8, most=None)
    store.save(spark.range(40_000).selectExpr("id * 7 AS id", "repeat(cast(id AS string), 5) AS v"))
    store.compact()
    store.save(spark.createDataFrame([(70, "zz"), (77, "a")], "id long, v string"))
    assert [tuple(r) for r in store.lookup(70).collect()] == [(70, "zz")] and store.lookup(71).count() == 0 and store.lookup(None).count() == 0

    def scanned(value):
        """(files, rows) that each scan of a lookup reads."""
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        try:
            df = store.lookup(value)
            df.collect()
            leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
        finally:
            spark.conf.unset("spark.sql.adaptive.enabled")
        metrics = [leaves.apply(i).metrics() for i in range(leaves.size())]
        return [(m.apply("numFiles").value(), m.apply("numOutputRows").value()) for m in metrics if m.contains("numFiles")]

    files = scanned(210_000)
    assert files and sum(n for n, _ in files) <= 2 and sum(n for _, n in files) <= 40_000 / 8 * 1.3
    missing = scanned(5)  # no such key: its row groups are passed over by the Bloom filter
    assert sum(n for _, n in missing) == 0
