"""Overlaps with long and repeating items: time that is linear in the item, and equal results in both plans."""

import random
import time

from llm import brute
from quirework.llm import decontam


def tables(spark, docs, items):
    return spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")


def test_long_and_repeating_items(spark):
    rng = random.Random(4)
    prose = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    a, b = prose(20_000), prose(2_000)
    docs, items = tables(spark, [a, "foo bar " * 10_000, f"{prose(9_000)} {b} {prose(9_000)}", prose(20_000)], [a, "foo bar " * 200, b, " ".join(b.split()[:500])])
    rows = {(r.doc_id, r.item_id): (r["at"], r.matched) for r in decontam.overlaps(docs, items).collect()}
    assert rows == {(0, 0): (0, 13), (1, 1): (-386, 13), (2, 2): (9_000, 13), (2, 3): (9_000, 13)}
    began = time.time()
    decontam.overlaps(*tables(spark, ["foo bar " * 20], ["foo bar " * 20])).collect()
    short = time.time() - began
    began = time.time()
    decontam.overlaps(*tables(spark, ["foo bar " * 200], ["foo bar " * 200])).collect()
    assert time.time() - began < 2 * short + 2


def test_repeated_words_against_brute_force(spark):
    rng = random.Random(9)
    line = lambda: " ".join(rng.choice("abc") for _ in range(rng.randint(0, 40)))
    docs, items = [line() for _ in range(25)], [line() for _ in range(12)]
    for most in (2_000_000, 0):
        got = {(r.doc_id, r.item_id) for r in decontam.overlaps(*tables(spark, docs, items), broadcast_rows=most).collect()}
        want = brute.overlaps(list(enumerate(docs)), list(enumerate(items)))
        first = {t: i for i, t in reversed(list(enumerate(items)))}
        assert got == {(d, first[items[i]]) for d, i in want}
