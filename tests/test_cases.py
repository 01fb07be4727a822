"""Operators on hand-written rows, each against SQL over the same rows."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oracle import connected, same_rows
from quirework import rules
from quirework.functions import images, urls
from quirework.operators import pixels
from quirework.plans import pages
from quirework.plans.media import _RANGE
from quirework.plans.pages import _DOMAIN, _joined, _values

LINKS = (
    ("a", "https://m.facebook.com/a"), ("a", "//twitter.com/x"), ("a", "https://old.www.reddit.com/"), ("a", "https://acme.wordpress.com/post/"),
    ("a", "HTTPS://WWW.LinkedIn.com/company/acme///"), ("b", "https://facebook.com:443/a"), ("b", "https://u:p@github.com/x"), ("b", "https://notfacebook.com/a"),
    ("b", "https://netflix.com/"), ("b", "mailto:a@x.com"), ("b", "/rel"), ("b", "https://[bad/x"), ("c", "https://calendly.com/acme"), ("c", "https://Square.site/book/9"),
    ("c", "https://www.yelp.com/biz/a"), ("c", "https://www.google.com/maps/place/x"), ("c", "https://g.page/r"), ("c", "https://x.com/a/"), ("c", "https://x.com/a"),
)
REQUESTS = (
    (1, ["https://a.test/x"], "  #main ", False, 1.0, 3.0), (2, ["https://a.test/1", "https://www.a.test/2", "http://A.test/3", "https://a.test/4", "https://a.test/5"], " ", False, 0.0, 0.0),
    (3, ["https://a.test/", "https://b.test/"], None, True, 1.0, 1.0), (4, ["https://a.test/", "https://b.test/"], None, False, 1.0, 1.0), (5, ["ftp://a.test/"], None, False, 1.0, 1.0),
    (6, ["https://a.test/"], "a<b", False, 1.0, 1.0), (7, ["https://a.test/"], "JavaScript:x", False, 1.0, 1.0), (8, ["https://a.test/"], "x" * 501, False, 1.0, 1.0), (9, ["https://a.test/"], None, False, 3.0, 1.0),
    (10, ["https://a.test/"], None, False, -1.0, 1.0), (11, ["https://a.test/" + str(i) for i in range(6)], None, False, 1.0, 1.0), (12, ["https://a.test/"], "x onerror=", False, 1.0, 1.0),
)
SIZES = ((1920, 1080, 640, None), (1920, 1080, None, 333), (1920, 1080, 100, 100), (1920, 1080, 1, None), (1920, 1080, None, None), (1920, 1080, 0, 0), (8, 5, 16, None), (8, 5, 8, 5))
NAMES = (("my photo (1).JPG", "webp"), ("arch.tar.gz", "webp"), ("héllo.png", "webp"), (".hidden", "webp"), ("plain", "PNG"), ("a.", "png"))
IMAGE_REQUESTS = ((1, "jpeg", None, 50), (2, "JPG", None, 0), (3, "bmp", None, 50), (4, "png", 100, 50), (5, "png", None, None), (6, "tif", None, 101), (7, "avif", None, -1), (8, "webp", 100, None))
_CODEC = "CASE WHEN method <> 'auto' THEN method WHEN transparent THEN 'deflate' WHEN q * 0.95 >= 85 THEN 'deflate' WHEN q * 0.95 >= 75 THEN 'lzw' ELSE 'jpeg' END"

_SOCIAL = "|".join(d.replace(".", r"\.") for d in rules.SOCIAL_DOMAINS)


def _part_sql(sites: tuple[str, ...]) -> str:
    return "array_to_string(list_sort(list_distinct(list_filter(links, lambda x: " + " OR ".join(f"contains(lower(x), '{s}')" for s in sites) + "))), ',')"


def _links(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LINKS, "page string, link string").groupBy("page").agg(F.collect_list("link").alias("links"))


def image_quality_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = spark.range(0, 101).select(F.col("id").cast("int").alias("q"), F.explode(F.array(*[F.lit(f) for f, _, _ in rules.QUALITY_RANGES])).alias("fmt"))
    value = images.mapped_quality(F.col("fmt"), F.col("q"))
    return q.select("fmt", "q", value.cast("int").alias("quality"))


def image_tiff_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = F.explode(F.array(*[F.struct(F.lit(t).alias("transparent"), F.lit(m).alias("method")) for t, m in ((True, "auto"), (False, "auto"), (False, "zstd"))]))
    q = spark.range(0, 101).select(F.col("id").cast("int").alias("q"), cases.alias("c")).select("q", "c.*")
    return q.select("q", "transparent", "method", images.tiff_codec(images.mapped_quality(F.lit("TIFF"), F.col("q")), F.col("transparent"), F.col("method")).alias("codec"))


def image_target_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spark.createDataFrame(SIZES, "ow int, oh int, w int, h int")
    c = [F.col(x) for x in ("ow", "oh", "w", "h")]
    s = s.select(*c, images.target_width(*c).alias("tw"), images.target_height(*c).alias("th"))
    return s.select("*", F.coalesce(images.interpolation(c[0], c[1], F.col("tw"), F.col("th")), F.lit("none")).alias("how"))


def image_filenames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(NAMES, "filename string, fmt string").select("filename", images.output_name(F.col("filename"), F.col("fmt")).alias("name"))


def image_request_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = spark.createDataFrame(IMAGE_REQUESTS, "id int, fmt string, max_size int, quality int")
    error = images.request_error(F.col("fmt"), F.col("max_size"), F.col("quality"))
    return r.select("id", F.coalesce(error, F.lit("ok")).alias("outcome"))


def image_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    ramp = np.arange(8 * 5 * 3, dtype=np.uint8).reshape(5, 8, 3)
    files = [("ramp.png", pixels.encode_png(ramp)), ("broken.png", b"\x89PNG\r\n\x1a\nxx"), ("alpha.png", pixels.encode_png(np.full((4, 4, 4), 128, np.uint8)))]
    out = pixels.converted(spark.createDataFrame([(n, bytearray(c)) for n, c in files], "filename string, content binary"), "png", quality=50, width=4)
    return out.select("filename", "name", "width", "height", F.col("error").isNotNull().alias("failed"))


def link_detectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = F.col("links")
    return _links(spark).select("page", _joined(urls.social_links(links)).alias("social"), _joined(urls.booking_links(links)).alias("booking"), _joined(urls.review_links(links)).alias("review"))


def request_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = spark.createDataFrame(REQUESTS, "id int, urls array<string>, wait_selector string, allow_mixed boolean, delay_min double, delay_max double")
    error = urls.batch_error(F.col("urls"), F.col("allow_mixed"), F.col("delay_min"), F.col("delay_max"), F.col("wait_selector"))
    return r.select("id", urls.selector(F.col("wait_selector")).alias("selector"), F.coalesce(error, F.lit("ok")).alias("outcome"))


def status_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = spark.range(100, 600).select(F.col("id").cast("int").alias("code")).withColumn("error", urls.status_error(F.col("code")))
    return codes.select("code", F.coalesce("error", F.lit("ok")).alias("outcome"), F.coalesce(urls.retried(F.col("error")), F.lit(False)).alias("retried"))


def retry_backoff_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = spark.range(1, rules.MOST_ATTEMPTS + 5).select(F.col("id").cast("int").alias("attempt"))
    return n.select("attempt", urls.backoff_seconds(F.col("attempt")).alias("delay"))


SQL = {
    "image_quality_map": f"SELECT fmt, CAST(q AS INT) AS q, CAST(trunc(lo::DOUBLE + (hi - lo)::DOUBLE * q / 100.0::DOUBLE) AS INT) AS quality FROM range(0, 101) r(q), (VALUES {_RANGE}) f(fmt, lo, hi)",
    "image_tiff_codec": f"SELECT CAST(q AS INT) AS q, transparent, method, {_CODEC} AS codec FROM range(0, 101) r(q), (VALUES (true, 'auto'), (false, 'auto'), (false, 'zstd')) m(transparent, method)",
    "image_target_dims": """SELECT ow, oh, w, h, tw, th, CASE WHEN ow = tw AND oh = th THEN 'none' WHEN tw < ow OR th < oh THEN 'area' ELSE 'lanczos4' END AS how FROM (SELECT ow, oh, w, h,
        coalesce(nullif(w, 0), CAST(trunc(nullif(h, 0) * (ow::DOUBLE / oh)) AS INT), ow) AS tw, coalesce(nullif(h, 0), CAST(trunc(nullif(w, 0) / (ow::DOUBLE / oh)) AS INT), oh) AS th
        FROM (VALUES (1920, 1080, 640, NULL), (1920, 1080, NULL, 333), (1920, 1080, 100, 100), (1920, 1080, 1, NULL), (1920, 1080, NULL, NULL), (1920, 1080, 0, 0), (8, 5, 16, NULL), (8, 5, 8, 5)) s(ow, oh, w, h))""",
    "image_filenames": "SELECT * FROM (VALUES ('my photo (1).JPG', 'my_photo__1_.webp'), ('arch.tar.gz', 'arch.tar.webp'), ('héllo.png', 'h_llo.webp'), ('.hidden', '.hidden.webp'), ('plain', 'plain.png'), ('a.', 'a.png')) v(filename, name)",
    "image_request_validation": "SELECT * FROM (VALUES (1, 'ok'), (2, 'ok'), (3, 'format'), (4, 'either quality or size'), (5, 'either quality or size'), (6, 'quality range'), (7, 'quality range'), (8, 'unsupported: target size')) v(id, outcome)",
    "image_conversion": "SELECT * FROM (VALUES ('ramp.png', 'ramp.png', 4, 2, false), ('broken.png', 'broken.png', NULL, NULL, true), ('alpha.png', 'alpha.png', 4, 4, false)) v(filename, name, width, height, failed)",
    "link_detectors": f"""WITH l AS (SELECT page, list(link) AS links FROM (VALUES {_values(LINKS)}) v(page, link) GROUP BY page)
        SELECT page, array_to_string(list_sort(list_distinct(list_transform(list_filter(links, lambda x: regexp_matches({_DOMAIN.format("x")}, '^(?:.*\\.)?(?:{_SOCIAL})$')), lambda x: regexp_replace(x, '/+$', '')))), ',') AS social,
        {_part_sql(rules.BOOKING_SITES)} AS booking, {_part_sql(rules.REVIEW_SITES)} AS review FROM l""",
    "request_validation": f"""SELECT id, nullif(trim(s), '') AS selector, CASE WHEN len(u) NOT BETWEEN 1 AND 5 THEN 'url count' WHEN len(list_filter(u, lambda x: NOT regexp_matches(lower(x), '^https?://[^/?#\\s]+'))) > 0 THEN 'url'
        WHEN lo < 0 OR hi < 0 THEN 'negative delay' WHEN lo > hi THEN 'delay range' WHEN NOT mixed AND len(list_distinct(list_transform(u, lambda x: {_DOMAIN.format("x")}))) > 1 THEN 'mixed domains'
        WHEN nullif(trim(s), '') IS NOT NULL AND (regexp_matches(lower(s), '{"|".join(rules.BAD_SELECTOR)}') OR length(trim(s)) > 500) THEN 'selector' ELSE 'ok' END AS outcome
        FROM (VALUES {_values(REQUESTS)}) v(id, u, s, mixed, lo, hi)""",
    "status_classes": "SELECT CAST(code AS INT) AS code, CASE code WHEN 403 THEN 'Blocked' WHEN 404 THEN 'NotFound' WHEN 429 THEN 'RateLimit' ELSE 'ok' END AS outcome, code = 429 AS retried FROM range(100, 600) t(code)",
    "retry_backoff_schedule": "SELECT CAST(n AS INT) AS attempt, least(60.0::DOUBLE, 2.0::DOUBLE * pow(2.0::DOUBLE, n - 1)) AS delay FROM range(1, 10) t(n)",
}


@pytest.mark.parametrize("case", [image_quality_map, image_tiff_codec, image_target_dims, image_filenames, image_request_validation, image_conversion, link_detectors, request_validation, status_classes, retry_backoff_schedule])
def test_case(spark, sf_dir, case):
    same_rows(case(spark, sf_dir), connected(sf_dir), SQL[case.__name__])


def test_keys_that_spell_the_year(spark, tmp_path):
    """Keys stand in links and addresses of the pages written for part; one that holds 2026 must not make a copyright of 2019 look fresh."""
    rows = [(k, "large ring", f"Brand#{n + 1}", "SMALL", n) for n, k in enumerate((2026, 12026, 20262026, 120260, 202612026, 4, 2025, 226026))]
    spark.createDataFrame(rows + [(k + 10**10, *rest) for k, *rest in rows], "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    same_rows(pages.part_insights(spark, str(tmp_path)), con, pages.SQL["part_insights"])
