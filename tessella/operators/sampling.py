"""Seeded draws by hash order: deterministic, without replacement, independent of partitioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators import ranges
from tessella.runtime import materialise


def lot(id_col: str, seed: int) -> Column:
    """A row's lot: the SHA-256 of the seed and the id."""
    return F.sha2(F.concat(F.lit(str(seed)), F.col(id_col).cast("string")), 256)


def draw(df: DataFrame, id_col: str, n: int, seed: int, name: str = "draw") -> DataFrame:
    """The n rows of lowest lot."""
    return df.withColumn(name, lot(id_col, seed)).orderBy(name, id_col).limit(n)


def quota(df: DataFrame, id_col: str, stratum: str, n: int, seed: int) -> DataFrame:
    """The n rows of lowest lot in each stratum, with their place."""
    w = Window.partitionBy(stratum).orderBy(lot(id_col, seed), F.col(id_col))
    return df.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


def rotation(df: DataFrame, id_col: str, seed: int) -> DataFrame:
    """Each id with the next one in lot order, the last with the first: nobody gets itself (with two ids or more)."""
    placed = ranges.before(df.select(id_col), [lot(id_col, seed), F.col(id_col)], "_place")
    n = placed.count()
    after = placed.select(F.pmod(F.col("_place") - 1, F.lit(max(n, 1))).alias("_place"), F.col(id_col).alias("imposter"))
    return placed.join(after, "_place").select(id_col, "imposter")


def interleave(df: DataFrame, first_list: str, order: str, run: int) -> DataFrame:
    """Rows of two lists in turn: a run of the first, then one of the second."""
    k = F.row_number().over(Window.partitionBy(first_list).orderBy(order)) - 1
    slot = F.when(F.col(first_list), F.floor(k / run) * (run + 1) + k % run).otherwise(k * (run + 1) + run)
    keyed = df.withColumn("_slot", slot)
    return ranges.before(keyed, [F.col("_slot"), F.desc(first_list), F.col(order)], "_before").withColumn("place", F.col("_before") + 1).drop("_slot", "_before")


def balanced(df: DataFrame, item: str, id_col: str, label: str, quotas: Sequence[tuple[str, int]], most: int, seed: int) -> DataFrame:
    """At most ``most`` rows of an item, pushed towards a quota of each label (the scarcest label first): adds the item's ``slot`` from 1.

    In each round over the items a label takes one row of every item that still
    has one and a free slot, until its quota is met; items are visited by name,
    rows by lot. Free slots are then filled with whatever the item has left. A
    label is one pass of windows within items and one order of (round, item).
    """
    rows = materialise(df.withColumn("_lot", lot(id_col, seed)))
    taken = rows.limit(0).select(item, id_col, F.lit(0).alias("_step"), "_lot")

    def fitting(of: DataFrame) -> DataFrame:
        """Rows that are not taken, within their item's free slots, by lot; with the round that would take them."""
        used = taken.groupBy(F.col(item).alias("_item")).agg(F.count("*").alias("_used"))
        left = of.join(taken.select(F.col(id_col).alias("_id")), F.col(id_col) == F.col("_id"), "left_anti").join(used, F.col(item) == F.col("_item"), "left")
        placed = left.withColumn("_round", F.row_number().over(Window.partitionBy(item).orderBy("_lot", id_col)))
        return placed.filter(F.col("_round") <= most - F.coalesce("_used", F.lit(0)))

    for step, (name, quota) in enumerate(quotas):
        able = ranges.before(fitting(rows.filter(F.col(label) == name)), [F.col("_round"), F.col(item)], "_before").filter(F.col("_before") < quota)
        taken = materialise(taken.unionByName(able.select(item, id_col, F.lit(step).alias("_step"), "_lot")))
    rest = fitting(rows).select(item, id_col, F.lit(len(quotas)).alias("_step"), "_lot")
    every = taken.unionByName(rest).withColumn("slot", F.row_number().over(Window.partitionBy(item).orderBy("_step", "_lot", id_col)))
    return every.select(F.col(id_col).alias("_id"), "slot").join(df, F.col("_id") == F.col(id_col)).drop("_id")
