"""Calibration bins and errors, agreement, internal consistency."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators import ranges


def equal_width(df: DataFrame, conf: str, n: int) -> DataFrame:
    """Adds ``bin`` 0 to n-1; a confidence of 1 belongs to the last one."""
    return df.withColumn("bin", F.least(F.floor(F.col(conf) * n), F.lit(n - 1)).cast("int"))


def equal_mass(df: DataFrame, conf: str, key: str, n: int) -> DataFrame:
    """Adds ``bin`` 0 to n-1 of equal size in the order of confidence and key, larger bins first; no task sorts all rows."""
    return ranges.tiles(df, [F.col(conf), F.col(key)], n, "bin")


def bins(binned: DataFrame, conf: str, hit: str) -> DataFrame:
    return binned.groupBy("bin").agg(F.count("*").alias("n"), F.round(F.avg(conf), 6).alias("mean_conf"), F.round(F.avg(F.col(hit).cast("int")), 6).alias("rate"))


def errors(binned: DataFrame, conf: str, hit: str) -> DataFrame:
    """Expected and largest calibration error over the bins, and the Brier score over the rows."""
    y = F.col(hit).cast("int")
    t = binned.groupBy("bin").agg(F.count("*").alias("n"), F.abs(F.avg(conf) - F.avg(y)).alias("gap"), F.sum((F.col(conf) - y) * (F.col(conf) - y)).alias("sq"))
    return t.agg(F.round(F.sum(F.col("n") * F.col("gap")) / F.sum("n"), 6).alias("ece"), F.round(F.max("gap"), 6).alias("mce"), F.round(F.sum("sq") / F.sum("n"), 6).alias("brier"))


def kappa(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Cohen's kappa of two raters' labels; from the table of label pairs, so rows are read once."""
    table = pairs.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    sides = table.select(F.inline(F.array(F.struct(F.col("a").alias("label"), F.col("n").alias("x"), F.lit(0).cast("long").alias("y")), F.struct(F.col("b").alias("label"), F.lit(0).cast("long").alias("x"), F.col("n").alias("y")))))
    margins = sides.groupBy("label").agg(F.sum("x").alias("x"), F.sum("y").alias("y")).agg(F.sum(F.col("x") * F.col("y")).alias("xy"))
    one = table.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same")).crossJoin(margins)
    po, pe = F.col("same") / F.col("n"), F.col("xy") / (F.col("n") * F.col("n"))
    return one.select("n", F.round(po, 6).alias("observed"), F.round(pe, 6).alias("expected"), F.round((po - pe) / (1 - pe), 6).alias("kappa"))


def alpha(wide: DataFrame, items: Sequence[str]) -> DataFrame:
    """Pairwise correlations and Cronbach's alpha of the items, in one pass."""
    k = len(items)
    total = sum((F.col(c) for c in items[1:]), F.col(items[0]))
    spread = sum((F.var_samp(c) for c in items[1:]), F.var_samp(items[0]))
    rs = [F.round(F.corr(x, y), 6).alias(f"r_{x}{y}") for x, y in combinations(items, 2)]
    return wide.agg(F.count("*").alias("n"), *rs, F.round(k / (k - 1) * (1 - spread / F.var_samp(total)), 6).alias("alpha"))
