"""Periodic runs against a plain search over all periods, and odd rows."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quirework.llm import queries, runs


def plain(words, least=6, power=4):
    found = {}
    for p in range(1, len(words) // power + 1):
        k = 0
        while k + p < len(words):
            start = k
            while k + p < len(words) and words[k] == words[k + p]:
                k += 1
            if k - start + p >= max(least, power * p):
                found.setdefault((start, k - start + p), p)
            k += k == start
    return sorted((s, n, p) for (s, n), p in found.items())


def listed(texts, **options):
    symbols, at = runs.numbered(texts)
    limits = np.repeat((np.diff(at) - 1) // options.get("power", 4), np.diff(at))
    own = [[] for _ in texts]
    for s, n, p in runs.runs(symbols, limits, **options):
        k = int(np.searchsorted(at, s, "right")) - 1
        own[k].append((s - int(at[k]), n, p))
    return [sorted(x) for x in own]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=70), max_size=4), st.sampled_from([(6, 4), (1, 3), (9, 3), (5, 6)]))
def test_any_words(texts, kind):
    assert listed(texts, least_words=kind[0], power=kind[1]) == [plain(t, *kind) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 10**9))
def test_planted(seed):
    rng = random.Random(seed)
    texts = []
    for _ in range(3):
        words = []
        for _ in range(rng.randint(1, 6)):
            unit = [rng.choice([b"x", b"y", b"%d" % rng.randrange(50)]) for _ in range(rng.randint(1, 12))]
            words += (unit * rng.randint(1, 9))[: rng.randint(1, 80)]
        texts.append(words)
    assert listed(texts) == [plain(t) for t in texts]


def test_refined_classes_are_equal_factors():
    rng = np.random.default_rng(2)
    symbols = np.append(rng.integers(0, 2, 200), 2)
    classes = runs.Classes(symbols)
    limits = np.full(len(symbols), 100)
    for length in range(1, 60):
        if length > 1:
            classes.refine(limits, length)
        factors = [tuple(symbols[i : i + length]) if i + length <= len(symbols) else i for i in range(len(symbols))]
        assert len(set(factors)) == len(set(zip(factors, classes.of.tolist(), strict=True))) == len(set(classes.of.tolist()))
        for c in set(classes.of.tolist()):
            assert sorted(classes.order[classes.begin[c] : classes.begin[c] + classes.size[c]]) == np.flatnonzero(classes.of == c).tolist()


def test_odd_rows(spark):
    long = " ".join(f"w{i % 3000}" for i in range(40_000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a"), (5, "a a a a a"), (6, "x a\n\na a a\ta a A"), (6, "x a\n\na a a\ta a A"), (None, "b " * 8), (7, long), (8, "é\u00a0é " * 9), (9, "a b " * 4 + "a"), (10, "a " * 20 + "b " * 20)]
    docs = spark.createDataFrame([(i, t, 5, "p") for i, t in rows], "doc_id long, text string, runs int, period string").repartition(4)
    got = {}
    for r in runs.collapsed(docs).collect():
        got.setdefault(r.doc_id, []).append((r.text, [tuple(x) for x in r.runs]))
    assert got == {
        1: [("", [])], 2: [("", [])], 3: [("", [])], 4: [("a", [])], 5: [("a a a a a", [])], 6: [("x a A", [(1, 6, 1)])] * 2, None: [("b", [(0, 8, 1)])],
        7: [(" ".join(f"w{i}" for i in range(3000)), [(0, 40_000, 3000)])], 8: [("é\u00a0é", [(0, 9, 1)])], 9: [("a b", [(0, 9, 2)])], 10: [("a b", [(0, 20, 1), (20, 20, 1)])],
    }
    assert runs.collapsed(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        runs.collapsed(docs, power=2)


def test_steps_grow_slowly():
    """What refinement touches grows as n log n also where a text of one period keeps classes large for many lengths."""
    def touched(n):
        symbols = np.append(np.arange(n) % (n // 5), n // 5)
        classes, total = runs.Classes(symbols), 0
        for length in range(2, n // 4):
            classes.refine(np.full(n + 1, n), length)
            total += len(classes.fresh)
        return total

    assert touched(4000) < 3 * touched(2000) and touched(4000) < 4000 * 13


def test_texts_without_words_that_the_hash_chooses(spark, tmp_path):
    """Ids 29, 37, 40 and 48 get a periodic end (crc32 % 10 = 0); without words there is none, and nothing is divided by their number."""
    rows = [(29, ""), (37, " \n"), (40, None), (48, "a"), (1, ""), (2, "a " * 6)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {(r.doc_id, r.text) for r in queries.repeating(spark.read.parquet(f"{tmp_path}/documents.parquet")).collect()} == set(rows)
    got = {r.doc_id: (r.n_runs, r.period, r.collapsed_sha256[:4]) for r in queries.op13_periodic_runs(spark, str(tmp_path)).collect()}
    assert got == {29: (0, None, "e3b0"), 37: (0, None, "e3b0"), 40: (0, None, "e3b0"), 48: (0, None, "ca97"), 1: (0, None, "e3b0"), 2: (1, 1, "ca97")}
