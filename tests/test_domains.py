"""Domains of any number against the expression over a few, and sketches of days against exact answers."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quirework import rules
from quirework.functions import urls
from quirework.operators import domains, sketches

LINKS = [
    "https://m.facebook.com/a", "//twitter.com/x", "https://old.www.reddit.com/", "https://acme.wordpress.com/post/", "HTTPS://WWW.LinkedIn.com/company/acme///", "https://facebook.com:443/a", "https://u:p@github.com/x",
    "https://notfacebook.com/a", "https://netflix.com/", "mailto:a@x.com", "/rel", "https://[bad/x", None, "", "https://x.com/a", "https://x.com/a", "https://.com/", "https://com/", "https://www.www.x.com/", "https://a..x.com/",
]


@pytest.mark.parametrize("most", [0, 1_000_000])
def test_same_as_the_expression(spark, most):
    links = spark.createDataFrame([(i, x, "d") for i, x in enumerate(LINKS)], "i int, link string, domain string")
    want = [r.i for r in links.where(F.size(urls.social_links(F.array("link"))) > 0).orderBy("i").collect()]
    listed = spark.createDataFrame([(d.upper() if k % 2 else d,) for k, d in enumerate(rules.SOCIAL_DOMAINS)] + [(None,), ("",), ("x.com",)], "domain string")
    got = domains.on_domains(links, "link", listed, most)
    assert got.columns == links.columns and [r.i for r in got.orderBy("i").collect()] == want
    assert domains.on_domains(links, "link", listed.limit(0), most).count() == 0


def test_a_million_domains(spark):
    """A long list joins by keys: no expression grows with it, and nothing is multiplied."""
    listed = spark.range(1_000_000).select(F.concat(F.lit("d"), F.col("id").cast("string"), F.lit(".test")).alias("domain"))
    links = spark.range(2_000).select(F.concat(F.lit("http://a.b.d"), (F.col("id") * 1_000).cast("string"), F.lit(".test/x")).alias("link"))
    got = domains.on_domains(links, "link", listed, 1_000)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert got.count() == 1_000 and "NestedLoop" not in plan and "Cartesian" not in plan


def test_sketches_merge_over_any_range(spark, tmp_path):
    rng = random.Random(1)
    start = dt.date(2024, 1, 1)
    rows = [(dt.datetime(2024, 1, 1) + dt.timedelta(hours=rng.randrange(20 * 24)), rng.choice(["a", "b", None]), rng.choice([None, *range(3_000)]), rng.choice([None, rng.random()])) for _ in range(20_000)] + [(None, "a", 1, 1.0)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, kind string, user long, value double")
    path = f"{tmp_path}/days"
    sketches.replace_days(sketches.daily(df, "ts", ["kind"], "user", "value"), path)
    again = df.where(F.to_date("ts") == F.lit(start))
    sketches.replace_days(sketches.daily(again, "ts", ["kind"], "user", "value"), path)  # a day that is made anew counts once
    ranges = spark.createDataFrame([("one", start, start), ("some", start + dt.timedelta(3), start + dt.timedelta(9)), ("all", start, start + dt.timedelta(99)), ("none", start, start - dt.timedelta(1))], "name string, first date, last date")
    got = {(r["name"], r.kind): r for r in sketches.over(spark.read.parquet(path), ranges, ["kind"], (0.1, 0.5)).collect()}
    assert len(got) == 9
    for (name, kind), r in got.items():
        low, high = {"one": (0, 0), "some": (3, 9), "all": (0, 99)}[name]
        own = [x for x in rows if x[0] and x[1] == kind and low <= (x[0].date() - start).days <= high]
        users = len({x[2] for x in own} - {None})
        values = sorted(x[3] for x in own if x[3] is not None)
        assert r.n == len(own) and abs(r["keys"] - users) <= 1 + sketches.DISTINCT_BOUND * users
        for share, value in zip((0.1, 0.5), r["values"], strict=True):
            assert abs(sum(v <= value for v in values) / len(values) - share) <= sketches.RANK_BOUND + 2 / len(values)
