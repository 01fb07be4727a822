from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def listed(*names: str) -> str:
    """Text constants of a list in SQL."""
    return ", ".join("'" + n.replace("'", "''") + "'" for n in names)
