"""Row rules: masks, independent drop counts, and sequential funnels."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def all_of(rules: Mapping[str, Column]) -> Column:
    return reduce(lambda a, b: a & b, [F.coalesce(r, F.lit(False)) for r in rules.values()], F.lit(True))


def clean(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Rows that satisfy every rule; a null counts as a failure."""
    return df.filter(all_of(rules))


def drop_counts(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Rows that each rule alone would drop, and rows that all keep, in one pass."""
    counts = [F.count_if(~F.coalesce(r, F.lit(False))).alias(n) for n, r in rules.items()]
    one = df.agg(*counts, F.count_if(all_of(rules)).alias("kept"))
    return one.select(F.explode(F.map_from_arrays(F.array(*[F.lit(n) for n in (*rules, "kept")]), F.array(*[F.col(n) for n in (*rules, "kept")]))).alias("rule", "n"))


def funnel(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Rows in, lost and out for each rule in order; a row is lost at the first rule that it fails."""
    first = F.lit(len(rules) + 1)
    for step, rule in reversed(list(enumerate(rules.values(), 1))):
        first = F.when(~F.coalesce(rule, F.lit(False)), step).otherwise(first)
    lost = df.groupBy(first.alias("step")).agg(F.count("*").alias("lost"))
    names = df.sparkSession.range(1).select(F.posexplode(F.array(*[F.lit(n) for n in (*rules, "kept")])).alias("_pos", "rule")).select((F.col("_pos") + 1).alias("step"), "rule")
    full = names.join(lost, "step", "left").select("step", "rule", F.coalesce("lost", F.lit(0)).alias("lost"))
    down = Window.orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, 0)
    rows_in = F.sum("lost").over(down)
    return full.select("step", "rule", rows_in.alias("rows_in"), F.when(F.col("rule") == "kept", F.lit(0).cast("long")).otherwise(F.col("lost")).alias("lost"), F.when(F.col("rule") == "kept", rows_in).otherwise(rows_in - F.col("lost")).alias("rows_out"))
