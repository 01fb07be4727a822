"""Queries over image requests: plans are pure arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import rules
from ..functions import images
from .tables import table

PART_FORMATS = ("jpeg", "JPG", "png", "webp", "avif", "tif", "bmp")


def part_image_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row of part as an image request: its check, name, size, way of resizing, quality and TIFF codec."""
    key, size = F.col("p_partkey").cast("int"), F.col("p_size")
    r = table(spark, sf_dir, "part").select(
        "p_partkey", F.concat("p_name", "p_brand", F.lit(".png")).alias("file"), F.element_at(F.array(*map(F.lit, PART_FORMATS)), key % len(PART_FORMATS) + 1).alias("fmt"),
        F.when(key % 5 != 0, size * 3 - 10).alias("q"), F.when((key % 5 == 0) | (key % 11 == 0), 100).alias("most"),
        (size * 7 + 100).alias("ow"), (key % 400 + 90).alias("oh"), F.when(key % 3 == 0, size * 11).alias("w"), F.when(key % 4 == 0, key % 700).alias("h"),
    )
    sides = [F.col(c) for c in ("ow", "oh", "w", "h")]
    r = r.select("*", images.canonical_format(F.col("fmt")).alias("format"), images.target_width(*sides).alias("tw"), images.target_height(*sides).alias("th"))
    quality = images.mapped_quality(F.col("format"), F.col("q"))
    return r.select(
        "p_partkey", F.coalesce(images.request_error(F.col("fmt"), F.col("most"), F.col("q")), F.lit("ok")).alias("outcome"), images.output_name(F.col("file"), F.col("fmt")).alias("name"), "tw", "th",
        F.coalesce(images.interpolation(F.col("ow"), F.col("oh"), F.col("tw"), F.col("th")), F.lit("none")).alias("how"), quality.cast("int").alias("quality"),
        F.when(F.col("format") == "TIFF", images.tiff_codec(F.coalesce(quality, F.lit(0.0)), key % 2 == 0, F.lit("auto"))).alias("codec"),
    )


QUERIES = {"part_image_plans": part_image_plans}

_RANGE = ", ".join(f"('{f}', {a}, {b})" for f, a, b in rules.QUALITY_RANGES)
SQL = {
    "part_image_plans": f"""
        WITH p AS (
            SELECT p_partkey, p_name || p_brand AS file, [{", ".join(f"'{f}'" for f in PART_FORMATS)}][p_partkey % {len(PART_FORMATS)} + 1] AS fmt, CASE WHEN p_partkey % 5 <> 0 THEN p_size * 3 - 10 END AS q,
                p_partkey % 5 = 0 OR p_partkey % 11 = 0 AS sized, CAST(p_size * 7 + 100 AS INT) AS ow, CAST(p_partkey % 400 + 90 AS INT) AS oh,
                nullif(CASE WHEN p_partkey % 3 = 0 THEN CAST(p_size * 11 AS INT) END, 0) AS w, nullif(CASE WHEN p_partkey % 4 = 0 THEN CAST(p_partkey % 700 AS INT) END, 0) AS h FROM part
        ), t AS (
            SELECT *, coalesce(w, CAST(trunc(h * (ow::DOUBLE / oh)) AS INT), ow) AS tw, coalesce(h, CAST(trunc(w / (ow::DOUBLE / oh)) AS INT), oh) AS th,
                CASE upper(fmt) WHEN 'JPG' THEN 'JPEG' WHEN 'TIF' THEN 'TIFF' ELSE upper(fmt) END AS format FROM p
        ), m AS (
            SELECT t.*, least(greatest(lo::DOUBLE + (hi - lo)::DOUBLE * q / 100.0::DOUBLE, least(lo, hi)::DOUBLE), greatest(lo, hi)::DOUBLE) AS v, lo FROM t LEFT JOIN (VALUES {_RANGE}) f(f, lo, hi) ON f.f = format
        )
        SELECT p_partkey, CASE WHEN fmt = 'bmp' THEN 'format' WHEN sized = (q IS NOT NULL) THEN 'either quality or size' WHEN q NOT BETWEEN 0 AND 100 THEN 'quality range' WHEN sized THEN 'unsupported: target size' ELSE 'ok' END AS outcome,
            regexp_replace(file, '[^a-zA-Z0-9_.-]', '_', 'g') || '.' || lower(fmt) AS name, tw, th, CASE WHEN ow = tw AND oh = th THEN 'none' WHEN tw < ow OR th < oh THEN 'area' ELSE 'lanczos4' END AS how,
            CASE WHEN q IS NOT NULL AND lo IS NOT NULL THEN CAST(trunc(v) AS INT) END AS quality,
            CASE WHEN format = 'TIFF' THEN CASE WHEN p_partkey % 2 = 0 OR (q IS NOT NULL AND v >= 85) THEN 'deflate' WHEN q IS NOT NULL AND v >= 75 THEN 'lzw' ELSE 'jpeg' END END AS codec FROM m""",
}
