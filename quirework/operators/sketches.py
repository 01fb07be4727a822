"""Mergeable sketches of days: distinct keys (HyperLogLog) and quantiles (KLL) kept as a small table, and merged for any range of days.

A day's sketches are made once, by partial aggregation; a range then reads a row for each of its days and group, however many rows the days have. Bounds, held in all but rare
cases: DISTINCT_BOUND as a share of the exact number of keys, RANK_BOUND as the distance of a quantile's rank. Null keys and values are not counted; rows without a time
have no day and are left out; days without rows have no sketches and change nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Three standard errors of 2^14 registers, and of KLL sketches of that size.
REGISTERS, KLL_SIZE = 14, 400
DISTINCT_BOUND, RANK_BOUND = 3 * 1.04 / 2 ** (REGISTERS / 2), 0.02


def daily(rows: DataFrame, at: str, by: list[str], key: str, value: str) -> DataFrame:
    """day, the columns of by, n, keys and quantiles: sketches of key and value of each day and group."""
    n = [F.count("*").alias("n"), F.hll_sketch_agg(key, REGISTERS).alias("keys"), F.kll_sketch_agg_double(F.col(value).cast("double"), KLL_SIZE).alias("quantiles")]
    return rows.where(F.col(at).isNotNull()).groupBy(F.to_date(at).alias("day"), *by).agg(*n)


def replace_days(sketches: DataFrame, path: str) -> None:
    """Write the days of sketches to a table partitioned by day; days that it already has are replaced, others stay."""
    sketches.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def over(sketches: DataFrame, ranges: DataFrame, by: list[str], quantiles: tuple[float, ...] = (0.5,)) -> DataFrame:
    """name, the columns of by, n, keys (estimated number) and values at quantiles, for each range (name, first, last; both days included)."""
    days = ranges.where("first <= last").select("name", F.explode(F.sequence("first", "last")).alias("day"))
    merged = sketches.join(F.broadcast(days), "day").groupBy("name", *by).agg(F.sum("n").alias("n"), F.hll_union_agg("keys").alias("keys"), F.kll_merge_agg_double("quantiles").alias("quantiles"))
    ranks = F.array(*map(F.lit, quantiles))
    return merged.select("name", *by, "n", F.hll_sketch_estimate("keys").alias("keys"), F.kll_sketch_get_quantile_double("quantiles", ranks).alias("values"))
