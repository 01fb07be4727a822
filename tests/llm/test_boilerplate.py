"""Near duplicates among texts that share a long passage: no link is lost in finer groups, and what is sent grows with the texts, not with their pairs."""

import random

import pytest

from llm import brute
from quirework.llm import neardup


def texts(seed, n, common, own):
    """Templates of `common` words with `own` words of their own each; some are altered copies of others, at any similarity."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(10**6)}"
    passage = [f"c{i}" for i in range(common)]
    out = []
    for _ in range(n):
        if out and rng.random() < 0.4:
            words = rng.choice(out).split()
            for _ in range(rng.choice([0, 1, 2, 4, 8, 12])):
                words[rng.randrange(len(words))] = word()
        else:
            words = passage + [word() for _ in range(own)]
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize(("common", "own"), [(60, 40), (90, 30), (30, 60), (80, 20)])
def test_no_link_is_lost(spark, common, own):
    docs = list(enumerate(texts(common, 160, common, own)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute.near_duplicates(docs)
    for most_open in (0, 100):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(df, block_rows=16, most_open=most_open).collect()}
        assert got == want


def test_prefixes_meet(spark):
    """Any two sets of the needed similarity share a shingle of their prefixes, however common shingles are ordered."""
    import numpy as np

    rng = np.random.default_rng(3)
    rows, sets = [], []
    for i in range(60):
        s = np.unique(rng.integers(0, 60, rng.integers(1, 50)).astype(np.uint64)) if i % 2 or not sets else np.unique(np.append(sets[-1][rng.random(len(sets[-1])) < 0.9], rng.integers(0, 60, 3).astype(np.uint64)))
        sets.append(s)
        rows.append((0, 0, i, i, len(s), True, bytearray(s.tobytes())))
    df = spark.createDataFrame(rows, "block int, hub long, rep long, print_a long, n_shingles long, open boolean, shingles binary")
    often = spark.createDataFrame([(0, int(v), int(rng.integers(1, 9))) for v in range(0, 60, 2)], "block int, shingle long, n long")
    for common in (often, often.limit(0)):
        prefix = {}
        for r in neardup._prefixes(df, common, 0.75).collect():
            prefix.setdefault(r.rep, set()).add(r.shingle)
        for a in range(60):
            for b in range(a):
                both = len(np.intersect1d(sets[a], sets[b]))
                if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                    assert prefix[a] & prefix[b], (a, b)


def test_sets_sent_grow_with_texts(spark, monkeypatch):
    sent = []
    joined = neardup._joined
    monkeypatch.setattr(neardup, "_joined", lambda blocks, *rest: (sent.append(blocks.count()), joined(blocks, *rest))[1])
    totals = []
    for n in (300, 1200):
        rng = random.Random(n)
        passage = " ".join(f"c{i}" for i in range(120))
        docs = [(i, passage + " " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(70))) for i in range(n)]
        sent.clear()
        rows = neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), block_rows=16)
        assert rows.where("NOT kept").count() == 0
        totals.append(sum(sent))
    assert totals[1] < 8 * totals[0] and totals[1] < 60 * 1200
