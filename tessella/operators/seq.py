"""Order-dependent reducers: greedy keep-first dedup, budget fill with skips, pool-adjacent violators.

Groups are ordered arrays folded by a higher-order aggregate, so they stay in
the JVM; a group must fit in one row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import jaccard


def ordered(order: Sequence[str], *values: str) -> Column:
    """A group's rows as an array of structs in order; the order must be total."""
    return F.array_sort(F.collect_list(F.struct(*order, *values)))


def greedy_dedup(df: DataFrame, by: Sequence[str], order: Sequence[str], words: str, threshold: float = 0.8, most: int | None = None) -> DataFrame:
    """Keeps a row unless its word set is too like one already kept; at most so many rows of a group."""
    rows = df.groupBy(*by).agg(ordered(order, words).alias("_rows"))
    start = F.slice(F.col("_rows"), 1, 0)

    def step(kept: Column, row: Column) -> Column:
        seen = F.exists(kept, lambda k: jaccard(k[words], row[words]) >= threshold)
        return F.when(seen, kept).otherwise(F.concat(kept, F.array(row)))

    kept = F.aggregate("_rows", start, step)
    kept = F.slice(kept, 1, most) if most else kept
    return rows.select(*by, F.explode(kept).alias("r")).select(*by, *[F.col(f"r.{o}").alias(o) for o in order])


def budget_fill(df: DataFrame, by: Sequence[str], order: Sequence[str], weight: str, budget: int) -> DataFrame:
    """Takes rows in order as long as they fit; one that doesn't fit is skipped, and later ones may still fit."""
    rows = df.groupBy(*by).agg(ordered(order, weight).alias("_rows"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.slice(F.col("_rows"), 1, 0).alias("kept"))

    def step(acc: Column, row: Column) -> Column:
        fits = acc["used"] + row[weight] <= budget
        used = F.when(fits, acc["used"] + row[weight]).otherwise(acc["used"]).cast("long")
        return F.struct(used.alias("used"), F.when(fits, F.concat(acc["kept"], F.array(row))).otherwise(acc["kept"]).alias("kept"))

    filled = rows.select(*by, F.aggregate("_rows", start, step).alias("f"))
    return filled.select(*by, F.col("f.used").alias("used"), F.explode("f.kept").alias("r")).select(*by, *[F.col(f"r.{o}").alias(o) for o in order], F.col(f"r.{weight}").alias(weight), "used")


def spaced(df: DataFrame, by: Sequence[str], order: str, gap: int) -> DataFrame:
    """Takes rows in order whose place lies at least a gap after the last one taken."""
    rows = df.groupBy(*by).agg(F.array_sort(F.collect_list(order)).alias("_rows"))
    empty = F.slice(F.col("_rows"), 1, 0)
    taken = F.aggregate("_rows", empty, lambda kept, x: F.when((F.size(kept) == 0) | (x - F.try_element_at(kept, F.lit(-1)) >= gap), F.concat(kept, F.array(x))).otherwise(kept))
    return rows.select(*by, F.explode(taken).alias(order))
