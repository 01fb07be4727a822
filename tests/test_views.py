"""Views, settings, archives and the capture source."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from quirework.operators import views
from quirework.settings import settings
from quirework.sources.capture import CaptureSource


def test_lean_handles_nulls(spark):
    rows = [("a", "<p>", None, None, None), ("b", None, "abc", ["x"], [bytearray(b"1")])]
    got = views.lean(spark.createDataFrame(rows, "job_id string, html string, text string, links array<string>, screenshots array<binary>")).orderBy("job_id").collect()
    assert [tuple(r) for r in got] == [("a", 0, 0, False), ("b", 1, 3, True)]


def test_nested_keeps_batches_without_pages(spark):
    b = spark.createDataFrame([("x",), ("y",)], "batch_id string")
    p = spark.createDataFrame([("x", 1, "u1"), ("x", 0, "u0")], "batch_id string, page_idx int, url string")
    got = {r.batch_id: [q.url for q in r.pages] for r in views.nested(b, p).collect()}
    assert got == {"x": ["u0", "u1"], "y": []}


def test_envelope_and_names(spark):
    one = spark.range(1)
    null = F.lit(None).cast("string")
    assert one.select(views.envelope(F.lit("d"), null, F.lit("r"))).first()[0] == '{"status":"success","data":"d","request_id":"r"}'
    assert one.select(views.envelope(null, F.lit("e"), F.lit("r"))).first()[0] == '{"status":"error","error":"e","request_id":"r"}'
    assert tuple(one.select(views.page_id(F.lit("b"), F.lit(3)), views.session_name(F.lit(""), F.lit("b")), views.session_name(F.lit("s"), F.lit("b"))).first()) == ("b_page_3", "batch_b", "s")


def test_archive(spark):
    rows = [("a.png", "a.webp", bytearray(b"1"), None), ("a.jpg", "a.webp", bytearray(b"2"), None), ("bad", "bad.webp", None, "broken")]
    out = views.unique_names(spark.createDataFrame(rows, "filename string, name string, content binary, error string"))
    with zipfile.ZipFile(io.BytesIO(views.archive(out))) as z:
        assert {n: z.read(n) for n in z.namelist()} == {"a.webp": b"2", "a_1.webp": b"1"}
    with pytest.raises(ValueError):
        views.archive(out.where("error IS NOT NULL"))


def test_settings(spark):
    assert settings(spark).as_of_year == 2026 and settings(spark).allow_mixed_domains is False
    spark.conf.set("quirework.as_of_year", "2030")
    spark.conf.set("quirework.allow_mixed_domains", "true")
    try:
        assert settings(spark).as_of_year == 2030 and settings(spark).allow_mixed_domains is True
    finally:
        spark.conf.unset("quirework.as_of_year")
        spark.conf.unset("quirework.allow_mixed_domains")


def test_capture_source(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "https%3A%2F%2Fa.test%2F.html").write_text("<title>x</title>")
    (tmp_path / "b.html").write_bytes(b"\xff<p>")
    spark.dataSource.register(CaptureSource)
    got = {r.url: r.html for r in spark.read.format("capture").load(str(tmp_path)).collect()}
    assert got["https://a.test/"] == "<title>x</title>" and got["b"].endswith("<p>")


def test_capture_writer_and_stream(spark, tmp_path):
    """What is written comes back, as a batch and as a stream of steps; a failed write leaves nothing; groups of files are tasks."""
    spark.dataSource.register(CaptureSource)
    path = str(tmp_path / "pages")
    rows = [("https://a.test/@x?q=1", "<p>é</p>"), ("https://a.test/@x?q=1", "again"), ("b", None), (None, "lost")]
    spark.createDataFrame(rows, "url string, html string").repartition(2).write.format("capture").mode("append").save(path)
    want = sorted([("https://a.test/@x?q=1", "<p>é</p>"), ("https://a.test/@x?q=1", "again"), ("b", "")])
    assert sorted(map(tuple, spark.read.format("capture").load(path).collect())) == want
    assert spark.read.format("capture").option("files_per_task", "2").load(path).rdd.getNumPartitions() == 2

    def followed():
        out = spark.readStream.format("capture").load(path).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start(str(tmp_path / "out"))
        out.awaitTermination()
        return sorted(map(tuple, spark.read.schema("url string, html string").parquet(str(tmp_path / "out")).collect()))

    assert followed() == want
    spark.createDataFrame([("c", "new")], "url string, html string").write.format("capture").mode("append").save(path)
    assert followed() == sorted([*want, ("c", "new")]) == followed()
    bad = spark.range(4).select(F.col("id").cast("string").alias("url"), F.when(F.col("id") == 3, F.raise_error(F.lit("no"))).otherwise("x").alias("html"))
    with pytest.raises(Exception, match="no"):
        bad.write.format("capture").mode("append").save(path)
    assert sorted(map(tuple, spark.read.format("capture").load(path).collect())) == sorted([*want, ("c", "new")]) and not [p for p in (tmp_path / "pages").iterdir() if p.is_dir()]
    assert spark.read.format("capture").load(str(tmp_path / "nothing")).count() == 0
