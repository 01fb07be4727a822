"""Histories of keys in order, in parts of time: a hot key's history is dealt to as many tasks as it has parts, and no task sorts all of it.

Windows run within a part. What a row needs of earlier parts is aggregated to one row a part (copies of hot parts combine before the shuffle), folded over
the parts of a key and joined back. Rows of one part stay together, so both the window and the join use one shuffle of the rows. Null keys are a key;
rows without a time are a part that comes first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Key and part of a row, and what earlier parts gave.
PLACE, EARLIER = "_place", "_earlier"


def with_earlier(rows: DataFrame, key: str, time: str, of_part: Column, fold: Callable[[Column], Column], part: Column | None = None) -> DataFrame:
    """rows with PLACE, and EARLIER: the fold of of_part (an aggregate) over the parts of their key before theirs, null in the first.

    A part is a day, or what a caller gives instead; it must not fall where time rises.
    """
    at = F.to_date(time) if part is None else part
    rows = rows.withColumn(PLACE, F.struct(F.col(key).alias("key"), at.alias("part")))
    before = Window.partitionBy(f"{PLACE}.key").orderBy(f"{PLACE}.part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy(PLACE).agg(of_part.alias("_of_part"))
    return rows.join(parts.select(PLACE, fold(F.col("_of_part")).over(before).alias(EARLIER)), PLACE)


def filled(rows: DataFrame, key: str, order: list[str], value: Column, name: str, part: Column | None = None) -> DataFrame:
    """rows with `name`: the last value of their key that is not null, up to the row itself in order; order[0] is the time."""
    columns = rows.columns
    newest = F.max_by("_value", F.when(F.col("_value").isNotNull(), F.struct(*order)))
    told = with_earlier(rows.withColumn("_value", value), key, order[0], newest, lambda v: F.last(v, ignorenulls=True), part)
    w = Window.partitionBy(PLACE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return told.select(*columns, F.coalesce(F.last("_value", ignorenulls=True).over(w), EARLIER).alias(name))
