"""URL filters against plain loops over all rules, and odd rows."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quirework.llm import urlfilter

RULES = "host string, path string, verdict string"


def plain(url, rules):
    head, mark, rest = (url or "").partition("://")
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:][: min([rest[cut:].find(c) for c in "?#" if c in rest[cut:]], default=None)]
    found = {}
    for h, p, v in rules:
        p = p or ""
        if h and v and (not p or p[0] == "/") and (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(p):
            key = len(h) + len(p), len(h), h.lower() + p
            found[key] = "block" if "block" in (v, found.get(key)) else max(v, found.get(key, ""))
    best = max(found, default=None)
    return host, path, best and best[2], found.get(best, "allow")


def judged(spark, urls, rules, **options):
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rows = urlfilter.judged(pages, spark.createDataFrame(rules, RULES), **options).collect()
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows}


ODD = [
    None, "", "no scheme", "://", "http://", "http:///path", "HTTP://WWW.Example.COM/En/x", "http://example.com", "http://example.com?q=/en/", "http://example.com/en/", "http://xexample.com/en/", "http://a.b.c.example.com/en/x/y#z",
    "http://com/", "http://.com/", "http://a..com/a//b", "http://u:p@h.com:80/a", "x://y://z.com/a", "http://é.com/ü/ß?ü", "http://a.com/\n/x", "http://" + "a." * 2000 + "com/" + "p/" * 20_000, "http://net/es/", "http://b.net/es", "http://b.net/esx/",
]


def test_odd_addresses(spark):
    rules = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("Example.com", "/e", "allow"), ("net", "/es", "block"), (".com", "/", "block"), ("é.com", "/ü/", "block"), ("a.com", "/\n", "block"), ("y", None, "block"), ("", "/", "block"), (None, "/", "block"), ("com", "en", "block"), ("com", "/en/", None), ("h.com:80", "/a", "block"), ("h.com:80", "/a", "allow")]
    got = judged(spark, ODD, rules)
    assert got == {i: plain(u, rules) for i, u in enumerate(ODD)}
    assert got == judged(spark, ODD, rules, broadcast_rules=0) == judged(spark, ODD, rules, prefix_chars=1)
    assert {v[2:] for v in judged(spark, ODD, rules[:0]).values()} == {(None, "allow")}
    assert {v[2:] for v in judged(spark, ODD, [("q", "/", "block")], default="review").values()} == {(None, "review")}


def test_rows_stay(spark):
    rows = [(1, "http://a.com/x", "h", 7), (1, "http://a.com/x", "h", 7), (None, "http://a.com/y", None, 1), (2, "http://b.org/", "k", None), (3, None, "k", 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, `rule.verdict` int")
    rules = spark.createDataFrame([("a.com", "/x", "block")], RULES)
    assert sorted(map(tuple, urlfilter.judged(pages, rules).collect()), key=repr) == sorted([(1, "a.com", "/x", "a.com/x", "block")] * 2 + [(None, "a.com", "/y", None, "allow"), (2, "b.org", "/", None, "allow"), (3, "", "", None, "allow")], key=repr)
    kept = urlfilter.admitted(pages, rules)
    assert kept.columns == pages.columns and sorted(map(tuple, kept.collect()), key=repr) == sorted(rows[2:], key=repr)
    assert urlfilter.judged(pages.limit(0), rules).count() == 0


@settings(max_examples=8, deadline=None)
@given(st.integers(0, 10**9))
def test_against_loops(spark, seed):
    rng = random.Random(seed)
    host = lambda n: ".".join(rng.choice(["a", "b", "com", ""]) for _ in range(rng.randint(1, n)))
    path = lambda: "".join(rng.choice(["/", "/a", "/ab", "/a/", "b"]) for _ in range(rng.randint(0, 4)))
    rules = [(host(3), path(), rng.choice(["allow", "block"])) for _ in range(40)]
    urls = [f"http://{host(4)}{rng.choice(['', '/'])}{path()}{rng.choice(['', '?a', '#/b'])}" for _ in range(80)]
    assert judged(spark, urls, rules, broadcast_rules=rng.choice([0, 100])) == {i: plain(u, rules) for i, u in enumerate(urls)}


def test_collisions_are_no_matches(spark):
    """With one digit sixteen prefixes hold all rules: most meetings are false, and none decides."""
    urls = [f"http://h{i}.com/p{i}/" for i in range(200)]
    rules = [(f"h{i}.com", f"/p{i}/", "block") for i in range(0, 200, 2)]
    assert [v[3] for _, v in sorted(judged(spark, urls, rules, prefix_chars=1).items())] == ["block", "allow"] * 100


@pytest.mark.parametrize("most", [0, 500_000])
def test_one_rule_fits_all(spark, most):
    got = judged(spark, [f"http://x{i % 7}.com/{i % 11}" for i in range(3000)], [("com", "/", "block")], broadcast_rules=most)
    assert len(got) == 3000 and {v[2:] for v in got.values()} == {("com/", "block")}
