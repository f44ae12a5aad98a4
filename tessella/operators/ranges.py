"""Running sums and places over one global order, without one task that sees all rows.

Rows are dealt into ranges of the order; each range's total is one row, so what
lies before a range is a running sum over as many rows as there are ranges, and
a window within each range does the rest.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.runtime import materialise


def before(df: DataFrame, order: Sequence[Column], name: str, value: Column | None = None) -> DataFrame:
    """Adds the sum of a value (or the number) of the rows that come before; the order must be total for a definite result.

    Rows that are equal in the whole order fall into one range.
    """
    amount = (F.lit(1) if value is None else value).cast("long")
    # Written, since ranges are drawn from a sample and must not change between two reads.
    dealt = materialise(df.repartitionByRange(*order).withColumns({"_range": F.spark_partition_id(), "_amount": amount}))
    totals = dealt.groupBy("_range").agg(F.sum("_amount").alias("_total"))
    earlier = Window.orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.withColumnRenamed("_range", "_of").select("_of", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_start"))
    within = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    # One row a range.
    placed = dealt.join(F.broadcast(starts), F.col("_range") == F.col("_of"))
    return placed.withColumn(name, F.col("_start") + F.coalesce(F.sum("_amount").over(within), F.lit(0))).drop("_range", "_amount", "_of", "_start")


def tiles(df: DataFrame, order: Sequence[Column], n: int, name: str) -> DataFrame:
    """Adds the tile, 0 to n - 1, of each row: equal numbers, the first tiles one more."""
    rows = df.count()
    least, larger = divmod(rows, n)
    edge = larger * (least + 1)
    place = F.col("_place")
    tile = F.when(place < edge, F.floor(place / (least + 1))).otherwise(larger + F.floor((place - edge) / max(least, 1)))
    return before(df, order, "_place").withColumn(name, tile.cast("int")).drop("_place")
