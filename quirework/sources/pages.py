"""Captured pages and requests as tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls


def snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Captured pages of a Parquet table of page_id, url and html; the captured address is the final one."""
    return spark.read.parquet(path).select("page_id", "url", F.col("url").alias("final_url"), "html")


def checked(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Batch requests that hold the rules, and those that do not with the first rule they break (error)."""
    told = requests.withColumn("error", urls.batch_error(F.col("urls"), F.col("allow_mixed"), F.col("delay_min"), F.col("delay_max"), F.col("wait_selector")))
    return told.where("error IS NULL").drop("error"), told.where("error IS NOT NULL")


def image_files(spark: SparkSession, path: str) -> DataFrame:
    """path, content and length of the files of a folder."""
    return spark.read.format("binaryFile").load(path).select("path", "content", "length")
