"""Rows in one order, however many a key holds: windows inside ranges, stitched at their edges.

A plain window sorts all rows of a key in one task. Here rows are range-partitioned by key and order and written
with the number of their range; windows run inside a range, and what crosses to the next one is a row a key and range.
The order must tell rows apart. Nulls of a key are a key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise

RANGE = "_range"


def ranged(df: DataFrame, keys: list[str], order: list[str], parts: int | None = None) -> DataFrame:
    """``df`` with ``_range``, which grows with (key, order). The rows are read twice, once to find the ranges'
    bounds: write costly ones first. ``parts``: so many ranges, else as the session's settings have it."""
    by = [*keys, *order]
    cut = df.repartitionByRange(parts, *by) if parts else df.repartitionByRange(*by)
    return materialise(cut.withColumn(RANGE, F.spark_partition_id()), "ranged")


def _with(rows: DataFrame, keys: list[str], edges: DataFrame, column: str) -> DataFrame:
    """``column`` of the row of ``edges`` for each row's key and range."""
    side = edges.select(*(F.col(k).alias(f"_k{n}") for n, k in enumerate(keys)), F.col(RANGE).alias("_kr"), column)
    same = [F.col(k).eqNullSafe(F.col(f"_k{n}")) for n, k in enumerate(keys)]
    met = rows.join(side, reduce(lambda a, b: a & b, same, F.col(RANGE) == F.col("_kr")), "left")
    return met.drop("_kr", *(f"_k{n}" for n in range(len(keys))))


def before(rows: DataFrame, keys: list[str], order: list[str], values: dict[str, Column]) -> DataFrame:
    """``values`` of the row before within the key, nulls for its first row. ``rows`` as ``ranged`` gives them."""
    held = F.struct(*(v.alias(n) for n, v in values.items()))
    inside = Window.partitionBy(*keys, RANGE).orderBy(*order)
    ends = rows.groupBy(*keys, RANGE).agg(F.max_by(held, F.struct(*order)).alias("_edge"))
    carried = ends.select(*keys, RANGE, F.lag("_edge").over(Window.partitionBy(*keys).orderBy(RANGE)).alias("_crossing"))
    near = _with(rows.withColumn("_inside", F.lag(held).over(inside)), keys, carried, "_crossing")
    one = F.coalesce("_inside", "_crossing")
    return near.withColumns({n: one[n] for n in values}).drop("_inside", "_crossing")


def so_far(rows: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """``name``: sum of ``value`` within the key up to and including the row."""
    inside = Window.partitionBy(*keys, RANGE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*keys).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*keys, RANGE).agg(F.sum(value).alias("_sum"))
    base = sums.select(*keys, RANGE, F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_base"))
    met = _with(rows.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0))), keys, base, "_base")
    return met.withColumn(name, F.col("_in") + F.col("_base")).drop("_in", "_base")
