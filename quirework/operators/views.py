"""What listings and lookups show of jobs, batches and outputs, and the archive sink."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules

_STRINGS = "array<string>"


def lean(jobs: DataFrame) -> DataFrame:
    """Jobs without their heavy parts: html, text, links and screenshots give way to sizes."""
    heavy = {"html", "text", "links", "screenshots"}
    size = lambda c: F.coalesce(F.size(c), F.lit(0))  # noqa: E731  size of null is null
    return jobs.select(
        *[c for c in jobs.columns if c not in heavy], size("links").alias("link_count"), F.coalesce(F.length("text"), F.lit(0)).alias("text_length"), (size("screenshots") > 0).alias("has_screenshot")
    )


def nested(batches: DataFrame, pages: DataFrame) -> DataFrame:
    """Batches with their pages in order; a batch without pages has an empty list. A batch holds five pages at most."""
    rest = [c for c in pages.columns if c not in ("batch_id", "page_idx")]
    listed = pages.groupBy("batch_id").agg(F.sort_array(F.collect_list(F.struct("page_idx", *rest))).alias("pages"))
    none = F.array().cast(listed.schema["pages"].dataType)
    return batches.join(listed, "batch_id", "left").withColumn("pages", F.coalesce("pages", none))


def lookup(rows: DataFrame, key: str, value: str) -> DataFrame:
    """The row of a key: a filter that reaches the scan."""
    return rows.where(F.col(key) == F.lit(value))


def page_id(batch_id: Column, page_idx: Column) -> Column:
    return F.concat(batch_id, F.lit("_page_"), page_idx.cast("string"))


def session_name(session_id: Column, batch_id: Column) -> Column:
    """An empty name counts as none."""
    return F.coalesce(F.nullif(session_id, F.lit("")), F.concat(F.lit("batch_"), batch_id))


def error_text(kind: Column, message: Column) -> Column:
    return F.concat_ws(": ", kind, message)


def envelope(data: Column, error: Column, request_id: Column) -> Column:
    """JSON of one answer; what is null is left out."""
    status = F.when(error.isNull(), "success").otherwise("error")
    return F.to_json(F.struct(status.alias("status"), data.alias("data"), error.alias("error"), request_id.alias("request_id")), {"ignoreNullFields": "true"})


def manifest(outputs: DataFrame, created: Column, seconds: int = rules.OUTPUT_SECONDS) -> DataFrame:
    """Outputs with the moment they expire."""
    return outputs.withColumn("expires_at", created + F.make_dt_interval(secs=F.lit(seconds)))


def unique_names(outputs: DataFrame, key: str = "filename", name: str = "name") -> DataFrame:
    """Outputs whose names repeat get a number before the extension, in the order of their sources."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy(name).orderBy(key)) - 1
    told = F.regexp_replace(F.col(name), r"(\.[^.]*)?$", "")
    return outputs.withColumn(name, F.when(n > 0, F.concat(told, F.lit("_"), n.cast("string"), F.regexp_extract(F.col(name), r"(\.[^.]*)$", 1))).otherwise(F.col(name)))


def archive(outputs: DataFrame, most_bytes: int = 256 << 20) -> bytes:
    """A zip of the successful outputs of one request (name, content, error). Requests are small; larger results belong in a table."""
    good = outputs.where("error IS NULL").select("name", "content")
    total = good.agg(F.coalesce(F.sum(F.length("content")), F.lit(0))).first()[0]
    if not total:
        raise ValueError("no output succeeded")
    if total > most_bytes:
        raise ValueError(f"{total} bytes are too many for an archive")
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for r in good.orderBy("name").collect():
            z.writestr(r["name"], bytes(r["content"]))
    return buffer.getvalue()
