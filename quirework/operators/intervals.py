"""Overlaps of intervals of any widths, by equal keys.

An interval's level is the first power of two above its length: on the grid of that width it lies in one or two bins. Two intervals are compared on the grid of the
longer one: it stands in its own bins there, and the shorter one is sent to its bins on every coarser grid that the other side uses. So a bin holds one side's intervals of its
own width, however many short ones fall into it each of them meets such a one at once or nearly, and long intervals are not cut into many bins. A pair that shares two
bins is told in the one where its overlap begins.

There are at most 64 levels; which of them are used is all that reaches the driver. Both joins are plain exchanges, whose hot keys Spark can split.
Defined results: both ends belong to an interval; intervals with a null end, or that end before they begin, overlap nothing, and neither do null keys; repeated rows are rows of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _level(low: Column, high: Column) -> Column:
    """0 for points, else the first power of two above the length; 63 (a bin of each sign) for lengths beyond a long number too."""
    return F.when(high == low, 0).otherwise(F.coalesce(F.length(F.bin(F.try_subtract(high, low))), F.lit(63)))


def _binned(rows: DataFrame, span: tuple[str, str], side: str, levels: list[int], home: bool) -> DataFrame:
    """rows with _level and _bin: of their own level, or of each of levels above it."""
    low, high = F.col(span[0]), F.col(span[1])
    own = F.col(f"_{side}")
    chosen = F.array(own) if home else F.filter(F.array(*map(F.lit, levels)) if levels else F.array().cast("array<int>"), lambda x: x > own)
    out = rows.select("*", F.explode(chosen).alias("_level")).withColumns({"_first": F.call_function("shiftright", low, F.col("_level")), "_last": F.call_function("shiftright", high, F.col("_level"))})
    return out.withColumn("_bin", F.explode(F.sequence("_first", "_last"))).drop("_first", "_last")


def overlapping(a: DataFrame, b: DataFrame, a_span: tuple[str, str], b_span: tuple[str, str], on: list[str]) -> DataFrame:
    """All pairs of rows of a and b with equal `on` whose intervals (long columns, both ends included) overlap. Other columns must differ in name."""
    def leveled(rows: DataFrame, span: tuple[str, str], side: str) -> DataFrame:
        return rows.where(F.col(span[0]) <= F.col(span[1])).withColumn(f"_{side}", _level(F.col(span[0]), F.col(span[1])))

    columns = [*on, *[c for c in (*a.columns, *b.columns) if c not in on]]
    a, b = leveled(a, a_span, "a"), leveled(b, b_span, "b")
    of = lambda rows, side: sorted(r[0] for r in rows.select(f"_{side}").distinct().collect())
    a_levels, b_levels = of(a, "a"), of(b, "b")
    start = F.greatest(F.col(a_span[0]), F.col(b_span[0]))
    meets = (start <= F.least(F.col(a_span[1]), F.col(b_span[1]))) & (F.col("_bin") == F.call_function("shiftright", start, F.col("_level")))
    keys = [*on, "_level", "_bin"]
    a_home, b_home = _binned(a, a_span, "a", [], True), _binned(b, b_span, "b", [], True)
    own = a_home.join(b_home.unionByName(_binned(b, b_span, "b", a_levels, False)), keys).where(meets)
    above = _binned(a, a_span, "a", b_levels, False).join(b_home, keys).where(meets)
    return own.select(columns).unionByName(above.select(columns))
