"""Fixtures for operators: pages, patterns, stores, images."""

import datetime as dt
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirework.functions import signals, text, urls
from quirework.operators import breaker, jobs, pixels
from quirework.operators.insights import insights
from quirework.operators.parse import calls_to_action, parsed, walked
from quirework.plans.pages import HTML
from quirework.sources.pages import checked
from quirework.streaming import lifecycle


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").orderBy("i")


def got(df, c):
    return [r[0] for r in df.select(c).collect()]


def test_full_page(spark):
    page = spark.createDataFrame([("https://acme.test/", HTML)], "final_url string, html string")
    r = insights(page, 2026).first()
    assert r.seo.title == "Acme Dental" and r.seo.description == "Second" and r.seo.platform == "Custom/Unknown"
    assert r.leads.emails == ["a@b.co"] and r.leads.phones == ["555) 123-4567"]
    assert r.leads.social_links == ["https://www.linkedin.com/company/acme"] and r.leads.automation.booking_links == ["https://calendly.com/acme"]
    assert [(f.fields, f.field_count, f.likely_lead_capture) for f in r.leads.forms] == [(["your email", "phone"], 2, True)]
    assert r.leads.ctas == ["Book now", "Contact us today", "Learn more"]
    hooks = r.pitch_hooks.asDict()
    assert hooks.pop("outdated_copyright") and hooks.pop("missing_chat_automation") and not any(hooks.values())


def test_walk_survives_tag_soup(spark):
    assert walked(None, None)["links"] == []
    soup = "<p><b>one<p>two</b><script>var t='</p><a href=/x>'</script><a href='http://[bad'>b</a><nav><p>gone</nav>three"
    w = walked(soup, "http://h.test/")
    assert "gone" not in w["main_text"] and "three" in w["main_text"] and "var t" not in w["main_text"]
    df = parsed(spark.createDataFrame([(1, None, None), (2, "", "x"), (3, "<" * 3000, "http://a.b/")], "id int, html string, final_url string"))
    assert df.count() == 3 and df.where("size(links) = 0").count() == 3


def test_walk_of_many_unclosed_links():
    """A hundred thousand open links and buttons take about as long as closed ones; those whose text is too long have none."""
    began = time.time()
    w = walked("".join(f"<a class='c{i % 3}'>t{i:06d} " for i in range(100_000)), "")
    assert time.time() - began < 5 and len(w["actions"]) == 100_000
    texts = [a["text"] for a in w["actions"]]
    assert texts[0] == "" and texts[-1] == "t099999" and texts[-2] == "t099998t099999" and sum(t != "" for t in texts) == 62
    w = walked("<a>" * 50_000 + "Get it" + "</a>" * 10 + "x" * 490 + "y" * 9, "")
    assert [len(a["text"]) for a in w["actions"][-11:]] == [0] + [6] * 10
    assert [a["text"] for a in walked("<a>one<button>two</button><script>no</script>three</a>four<a>five", "")["actions"]] == ["onetwothree", "two", "five"]


def test_main_text_takes_the_first_long_place():
    long = "word " * 60
    assert walked(f"<article>short</article><main>{long}</main>", "")["main_text"] == long.strip()
    assert walked("<body>a<p>b</p></body>", "")["main_text"] == "a\nb"


def test_calls_are_capped_and_sorted(spark):
    html = "".join(f"<a>Get {i:02d}</a>" for i in range(20)) + "<a>one two three four five six seven</a><button class='BTN-x'>zz</button>"
    df = parsed(spark.createDataFrame([(html, "")], "html string, final_url string"))
    assert got(df, calls_to_action(F.col("actions"))) == [[f"Get {i:02d}" for i in range(15)]]


def test_pattern_edges(spark):
    df = column(spark, ["a@b.coé", "é5551234567", "٠١٢٣٤٥٦٧٨", "call +1 555-123-4567 now", "2024-01-01 12345678", None])
    assert got(df, text.emails(F.col("v"))) == [[], [], [], [], [], None]
    assert got(df, text.phones(F.col("v"))) == [[], [], ["٠١٢٣٤٥٦٧٨"], ["1 555-123-4567"], ["01-01 12345678"], None]


def test_clean_text(spark):
    df = column(spark, ["<p>a&amp;amp;b</p><!-- c --><style>x</style>d&#233;&lt;", "<i></i>" * 20_000 + "end", None, ""])
    assert got(df, F.trim(text.clean_text(F.col("v")))) == ["a&amp;b dé<", "end", None, ""]


def test_mission_statement(spark):
    lines = "Home\n\nWe build calm software for busy dental teams.\nAbout\nExactly thirty characters here\nTrusted by more than four hundred clinics.\nOnline booking, reminders and billing in one.\nA fourth substantive line that must be ignored."
    want = "We build calm software for busy dental teams.\nTrusted by more than four hundred clinics.\nOnline booking, reminders and billing in one."
    assert got(column(spark, [lines, ""]), text.mission_statement(F.col("v"))) == [want, ""]


def test_social_links(spark):
    links = ["https://m.facebook.com/a", "//twitter.com/x", "https://old.www.reddit.com/", "https://facebook.com:443/a", "https://u:p@github.com/x", "https://notfacebook.com/a", "https://[bad/x", None]
    df = column(spark, [links, None, []], "array<string>")
    assert got(df, urls.social_links(F.col("v"))) == [["//twitter.com/x", "https://m.facebook.com/a", "https://old.www.reddit.com"], [], []]


def test_viewport_is_matched_as_written(spark):
    df = column(spark, ['<meta name="viewport" content="x">', "<meta name=viewport>", '<meta name="Viewport">', ""])
    assert got(df, signals.mobile_ready(F.col("v"))) == [True, True, False, False]


def test_requests_are_split(spark):
    rows = [(["https://a.test/"], None, False, 1.0, 2.0), (["ftp://a"], None, False, 1.0, 2.0), (None, None, False, 1.0, 2.0)]
    good, bad = checked(spark.createDataFrame(rows, "urls array<string>, wait_selector string, allow_mixed boolean, delay_min double, delay_max double"))
    assert good.count() == 1 and sorted(r.error for r in bad.collect()) == ["url", "url count"]


def test_latest_ignores_order_of_versions(spark):
    rows = [("a", 1, "pending"), ("a", 3, "completed"), ("a", 2, "running"), ("b", 1, "pending")]
    for some in (rows, rows[::-1]):
        df = jobs.latest(spark.createDataFrame(some, "job_id string, version int, status string"), "job_id", ["version"])
        assert {(r.job_id, r.status) for r in df.collect()} == {("a", "completed"), ("b", "pending")}


def test_recent_rejects_negative_limits(spark):
    df = spark.range(200).select(F.col("id").cast("string").alias("job_id"), F.lit(0).alias("created_at"))
    assert jobs.recent(df, 500).count() == 100
    with pytest.raises(ValueError):
        jobs.recent(df, -1)


def test_expiry_is_strict(spark):
    now = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, now), (2, now - dt.timedelta(microseconds=1))], "id int, expires_at timestamp_ntz")
    assert [r.id for r in jobs.unexpired(df, F.lit(now).cast("timestamp_ntz")).collect()] == [1]


def test_png_round_trip_and_resize():
    rng = np.random.default_rng(0)
    for n in (1, 3, 4):
        image = rng.integers(0, 256, (5, 8, n), dtype=np.uint8)
        assert (pixels.decode_png(pixels.encode_png(image)) == image).all()
    flat = np.full((6, 6, 3), 77, np.uint8)
    assert (pixels.resize(flat, 3, 2) == 77).all() and (pixels.resize(flat, 12, 9) == 77).all()
    half = np.dstack([np.zeros((2, 2, 3), np.uint8), np.full((2, 2), 128, np.uint8)])
    assert (pixels.over_white(half) == 127).all()


def test_bad_images_are_rows(spark):
    files = spark.createDataFrame([("a.png", bytearray(b"nope")), ("b.png", bytearray(pixels.encode_png(np.zeros((2, 2, 3), np.uint8))))], "filename string, content binary")
    assert {r.filename: r.error is None for r in pixels.converted(files, "png", 50).collect()} == {"a.png": False, "b.png": True}
    assert all("unsupported" in r.error for r in pixels.converted(files, "webp", 50).collect())


def test_upsert_is_idempotent(spark, sf_dir, tmp_path):
    e = lifecycle.event_stream(spark, sf_dir).select(F.col("user_id").cast("string").alias("job_id"), "event_type", "ts")
    for _ in range(2):
        lifecycle.upsert_versions(e, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    users = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id").distinct().count()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1000 and lifecycle.current(spark, str(tmp_path / "out")).count() == users


def test_job_moves_follow_the_machine(spark, sf_dir):
    from quirework.plans.stores import stream_job_moves

    seen: dict[str, list[str]] = {}
    for r in stream_job_moves(spark, sf_dir).orderBy("ts_us").collect():
        seen.setdefault(r.job_id, []).append(r.status)
    for moves in seen.values():
        assert moves[0] == "pending" and all(b in lifecycle.JOB_MOVES[a] for a, b in zip(moves, moves[1:], strict=False))


def test_streams_of_many_shuffled_files(spark, sf_dir, tmp_path):
    """Twenty files in no order of time, with repeats over a day apart, give what one file gives; nothing passes the driver's memory sink."""
    from quirework.plans import stores

    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    e = e.unionByName(e.limit(50).withColumn("ts", F.col("ts") + F.expr("INTERVAL 3 DAYS")))
    e.coalesce(1).write.parquet(str(tmp_path / "one" / "events.parquet"))
    e.repartition(20, "event_id").write.option("maxRecordsPerFile", 40).parquet(str(tmp_path / "many" / "events.parquet"))
    for query in (stores.stream_distinct_events, stores.stream_job_moves, stores.stream_sessions):
        one, many = (query(spark, str(tmp_path / d)) for d in ("one", "many"))
        assert "MemoryPlan" not in many._jdf.queryExecution().analyzed().toString() and many.inputFiles()
        assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect())) and many.count() > 0
    assert stores.stream_distinct_events(spark, str(tmp_path / "many")).count() == e.select("event_id").distinct().count()


def test_breaker_on_odd_calls(spark):
    rows = [(k, t, n, bad) for n, (k, t, bad) in enumerate([("a", 0, True), ("a", 1, True), ("a", 30, False), ("a", 31, False), ("a", 32, True), ("a", 33, None), ("a", 34, True), (None, 0, True), (None, 1, True), ("b", 2, True), ("b", None, True)])]
    calls = spark.createDataFrame(rows, "k string, t int, n int, bad boolean").select("k", F.timestamp_seconds("t").alias("ts"), "n", "bad")
    got = {r.n: (r.outcome, r.is_open) for r in breaker.guarded(calls, "k", ["ts", "n"], F.col("bad"), 2, 30).collect()}
    first = [("failed", False), ("failed", True), ("refused", True), ("passed", False), ("failed", False), ("passed", False), ("failed", False)]
    assert [got[n] for n in range(7)] == first and got[8] == ("failed", True) and got[10] == ("failed", False) and got[9] == ("failed", True)
    assert breaker.guarded(calls.limit(0), "k", ["ts", "n"], F.col("bad")).count() == 0


def test_failed_probe_opens_again(spark):
    calls = spark.createDataFrame([(1, t, bad) for t, bad in ((0, True), (1, True), (31, True), (60, False), (61, False))], "k int, t int, bad boolean").select("k", F.timestamp_seconds("t").alias("ts"), "bad")
    assert [r.outcome for r in breaker.guarded(calls, "k", ["ts"], F.col("bad"), 2, 30).orderBy("ts").collect()] == ["failed", "failed", "failed", "refused", "passed"]


def test_callers_bring_codecs(spark):
    def plain(image, level):
        return b"RAW" + bytes([level, *image.shape]) + image.tobytes()

    codec = pixels.Codec(b"RAW", lambda raw: np.frombuffer(raw[7:], np.uint8).reshape(tuple(raw[4:7])), plain, alpha=False)
    half = pixels.encode_png(np.array([[[0, 200, 255, 128], [10, 20, 30, 255]]], np.uint8))
    files = spark.createDataFrame([("a.png", bytearray(half)), ("b.jpg", bytearray(b"RAW\x05\x01\x01\x03abc")), ("c.gif", bytearray(b"GIF89a"))], "filename string, content binary")
    rows = {r.filename: r for r in pixels.converted(files, "jpg", quality=50, codecs={"JPEG": codec}).collect()}
    assert list(rows["a.png"].content[7:]) == [127, 227, 255, 10, 20, 30] and rows["a.png"].name == "a.jpg" and rows["b.jpg"].content[7:] == b"abc"
    assert "unsupported image" in rows["c.gif"].error
    back = {r.filename: r for r in pixels.converted(files, "png", codecs={"JPEG": codec}).collect()}
    assert pixels.decode_png(bytes(back["b.jpg"].content)).ravel().tolist() == list(b"abc")


def test_formats_of_the_image_source(spark, tmp_path):
    """JPEG, BMP, GIF, TIFF and PNG files written by the JVM, and one that is no image."""
    jvm = spark._jvm
    kinds = ["jpg", "bmp", "gif", "tiff", "png"]
    for kind in kinds:
        image = jvm.java.awt.image.BufferedImage(8, 5, 1)
        for x in range(8):
            for y in range(5):
                image.setRGB(x, y, 0xC86432)
        assert jvm.javax.imageio.ImageIO.write(image, kind, jvm.java.io.File(f"{tmp_path}/one.{kind}"))
    (tmp_path / "none.jpg").write_bytes(b"\xff\xd8 no image")
    out = pixels.converted(pixels.readable(spark.read.format("image").load(str(tmp_path))), "png", width=4).collect()
    found = {r.filename: r for r in out}
    assert set(found) == {f"one.{k}" for k in kinds} | {"none.jpg"}
    assert found["none.jpg"].error and found["none.jpg"].content is None
    for kind in kinds:
        r = found[f"one.{kind}"]
        assert r.error is None and (r.width, r.height, r.name) == (4, 2, "one.png")
        shown = pixels.decode_png(bytes(r.content))
        assert np.abs(shown.astype(int) - [200, 100, 50]).max() <= 8, kind


def test_shared_folder(spark):
    """A local session without spark.checkpoint.dir gets one folder for all; a cluster without one fails."""
    from types import SimpleNamespace

    from quirework.shared import shared_dir

    def session(master, named=None):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, otherwise: named), sparkContext=SimpleNamespace(master=master))

    local = session("local[4]")
    assert shared_dir(local) == shared_dir(local)
    assert shared_dir(session("spark://host:7077", "hdfs:///shared/")) == "hdfs:///shared"
    with pytest.raises(ValueError):
        shared_dir(session("spark://host:7077"))
