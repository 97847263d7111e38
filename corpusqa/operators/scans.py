"""Scans over the rows of a part in order, however many one part has.

Rows are dealt out by cells of the order's number as well; windows run within a cell, each cell is summed
up in a row, and what the cells before hand over is found over these rows and joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A cell holds 2**16 numbers.
CELL_BITS = 16


def _cells(df: DataFrame, order: str, bits: int) -> DataFrame:
    return df.withColumn("_cell", F.shiftright(F.col(order).cast("bigint"), bits))


def _handed(cells: DataFrame, summed: DataFrame, part: list[str], name: str) -> DataFrame:
    """``cells`` with ``name`` of their cell's row."""
    keys = [*part, "_cell"]
    held = summed.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), name)
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return cells.join(held, same).drop(*(f"_k{i}" for i in range(len(keys))))


def previous(df: DataFrame, part: list[str], order: str, name: str = "before", bits: int = CELL_BITS) -> DataFrame:
    """``df`` with the number of the row before within its part (the first: null).  ``order`` is a whole number without nulls."""
    cells = _cells(df, order, bits)
    ends = cells.groupBy(*part, "_cell").agg(F.max(order).alias("_last"))
    ends = ends.withColumn("_carry", F.lag("_last").over(Window.partitionBy(*part).orderBy("_cell")))
    within = F.lag(order).over(Window.partitionBy(*part, "_cell").orderBy(order))
    return _handed(cells.withColumn(name, within), ends, part, "_carry").withColumn(name, F.coalesce(name, "_carry")).drop("_cell", "_carry")


def running_sum(df: DataFrame, part: list[str], order: str, value: Column, name: str, bits: int = CELL_BITS) -> DataFrame:
    """``df`` with the sum of ``value`` up to each row, itself included, within its part.  ``order`` is a whole number without nulls, unique in its part."""
    cells = _cells(df.withColumn("_value", value), order, bits)
    sums = cells.groupBy(*part, "_cell").agg(F.sum("_value").alias("_sum"))
    before = Window.partitionBy(*part).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_carry", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
    upto = Window.partitionBy(*part, "_cell").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return _handed(cells.withColumn(name, F.sum("_value").over(upto)), sums, part, "_carry").withColumn(name, F.col(name) + F.col("_carry")).drop("_cell", "_carry", "_value")
