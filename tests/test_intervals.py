"""Overlaps of intervals against a loop over all pairs."""

import random

import pytest

from quirework.operators import intervals


def frames(spark, a, b):
    return spark.createDataFrame(a, "k string, i int, a_low long, a_high long"), spark.createDataFrame(b, "k string, j int, b_low long, b_high long")


def loop(a, b):
    return sorted((i, j) for k, i, low, high in a for m, j, x, y in b if k is not None and k == m and None not in (low, high, x, y) and low <= high and x <= y and max(low, x) <= min(high, y))


@pytest.mark.parametrize("seed", [1, 2])
def test_any_widths(spark, seed):
    rng = random.Random(seed)

    def side(n):
        out = []
        for i in range(n):
            low = rng.randrange(-3_000, 3_000)
            out.append((rng.choice(["x", "x", "x", "y", None]), i, low, low + rng.choice([0, 0, 1, 2, 7, 8, 9, 100, 5_000, 1 << 40, -1])))
        return out + [("x", n, None, 5), ("x", n + 1, 5, None), ("x", n + 2, 0, 0), ("x", n + 3, 0, 0), ("x", n + 4, -(1 << 62), 1 << 62)]

    a, b = side(120), side(100)
    got = intervals.overlapping(*frames(spark, a, b), ("a_low", "a_high"), ("b_low", "b_high"), ["k"])
    assert got.columns == ["k", "i", "a_low", "a_high", "j", "b_low", "b_high"]
    assert sorted((r.i, r.j) for r in got.collect()) == loop(a, b)
    none = intervals.overlapping(frames(spark, [], [])[0], frames(spark, a, b)[1], ("a_low", "a_high"), ("b_low", "b_high"), ["k"])
    assert none.count() == 0


def test_few_candidates(spark):
    """Ten thousand points and a few intervals over all of them: a long interval isn't cut up, and points meet no interval far away."""
    points = [("x", i, i * 1_000, i * 1_000) for i in range(10_000)]
    spans = [("x", j, j * 1_000_000, j * 1_000_000 + 999_999) for j in range(10)] + [("x", 10, 0, 10_000_000)]
    a, b = frames(spark, points, spans)
    binned = intervals._binned(b.withColumn("_b", intervals._level(b.b_low, b.b_high)), ("b_low", "b_high"), "b", [], True)
    assert binned.count() <= 2 * len(spans)
    assert intervals.overlapping(a, b, ("a_low", "a_high"), ("b_low", "b_high"), ["k"]).count() == 20_000
