"""Chronological splits, cut-offs by budget, and the first usable row of each bin."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.dates import day_bin


def latest_split(clusters: DataFrame) -> DataFrame:
    """Each subject's latest cluster (largest id of equals) is the test; earlier ones ground it; others of its date are left out."""
    w = Window.partitionBy("subject").orderBy(F.desc("date"), F.desc("cluster"))
    test = F.first("date").over(w)
    return clusters.withColumns({"_n": F.row_number().over(w), "test_date": test}).select(
        "subject", "cluster", "date", "words", F.when(F.col("_n") == 1, "test").when(F.col("date") < F.col("test_date"), "grounding").otherwise("excluded").alias("side"), F.datediff("test_date", "date").alias("delta_days")
    )


def cutoffs(clusters: DataFrame, budget: int) -> DataFrame:
    """By subject and date: words up to that date, and whether they fill the budget."""
    daily = clusters.groupBy("subject", "date").agg(F.sum("words").alias("words"))
    w = Window.partitionBy("subject").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return daily.withColumn("cumulative", F.sum("words").over(w)).withColumn("fillable", F.col("cumulative") >= budget)


def first_per_bin(clusters: DataFrame, budget: int) -> DataFrame:
    """The newest fillable cut-off in each staleness bin of a subject."""
    split = latest_split(clusters)
    tests = split.filter("side = 'test'").select("subject", F.col("date").alias("test_date"))
    c = cutoffs(split.filter("side = 'grounding'"), budget).join(tests, "subject").withColumn("delta", F.datediff("test_date", "date"))
    w = Window.partitionBy("subject", "bin").orderBy("delta")
    return c.filter("fillable").withColumn("bin", day_bin(F.col("delta"))).withColumn("_n", F.row_number().over(w)).filter("_n = 1").select("subject", "bin", F.col("date").alias("cutoff"), "delta", "cumulative")
