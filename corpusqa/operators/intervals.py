"""Ranges that hold a number: an interval index of bins whose sizes are powers of two.

A range goes to the one or two bins of the smallest such size that isn't below its length; a number
is looked up in its bin of each size that any range has.  Bins meet by equality, whatever the
ranges, overlapping ones included, and the ends are verified.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ordinal(df: DataFrame, name: str) -> Column:
    """A whole number, or a date as one."""
    return F.unix_date(name) if df.schema[name].dataType.typeName() == "date" else F.col(name).cast("bigint")


def covering(points: DataFrame, ranges: DataFrame, point: str = "seq", lo: str = "lo", hi: str = "hi", keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, point, other columns of ``ranges``): each distinct point with each range of its keys that holds it, both ends included.

    Rows find their ranges by a join with it on keys and point.  Ranges without an end, or with a high end below the
    low one, hold nothing.
    """
    number = F.expr("shiftright(_at, _size)")
    length = "try_subtract(_b, _a)"
    cells = ranges.withColumns({"_a": ordinal(ranges, lo), "_b": ordinal(ranges, hi)}).where("_a <= _b")
    cells = cells.withColumn("_size", F.expr(f"CASE WHEN _a = _b THEN 0 WHEN {length} IS NULL THEN 63 ELSE length(bin({length})) END"))
    sizes = cells.agg(F.sort_array(F.collect_set("_size")).alias("sizes")).scalar()  # 64 at most
    cells = cells.withColumn("_bin", F.explode(F.expr("array_distinct(array(shiftright(_a, _size), shiftright(_b, _size)))")))
    looked = points.select(*keys, point).distinct().withColumn("_at", ordinal(points, point)).withColumn("_size", F.explode(sizes)).withColumn("_bin", number)
    found = looked.join(cells, [*keys, "_size", "_bin"]).where("_at BETWEEN _a AND _b")
    return found.select(*keys, point, *(c for c in ranges.columns if c not in (*keys, point)))


def until_next(starts: DataFrame, start: str = "start", keys: tuple[str, ...] = ()) -> DataFrame:
    """``starts`` as ranges (start, hi) that end before the next start of the same keys; the last is open.

    Without keys the next one is found by numbers, not in one window over all.
    """
    from pyspark.sql import Window

    from corpusqa.sources import numbered

    last = F.lit((1 << 63) - 1)
    if keys:
        return starts.withColumn("hi", F.coalesce(F.lead(start).over(Window.partitionBy(*keys).orderBy(start)) - 1, last))
    n = numbered(starts.withColumn("_all", F.lit(0)), "_all", start, "_n")
    after = n.select((F.col("_n") - 1).alias("_n"), (F.col(start) - 1).alias("_before"))
    return n.join(after, "_n", "left").withColumn("hi", F.coalesce("_before", last)).drop("_n", "_all", "_before")


def product(a: DataFrame, b: DataFrame) -> DataFrame:
    """Every row of ``a`` with every row of ``b``, where just that is the result: dealt out by parts of ``b``, neither side is sent to all tasks."""
    n = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = b.withColumn("_part", F.pmod(F.xxhash64(*b.columns), F.lit(n)))
    return a.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))).join(dealt, "_part").drop("_part")
