"""Paired contrasts: sufficient statistics in Spark, p-values from a few numbers on the driver.

Resampling is done in Spark too: a row's weights in all replicates come from the
seed and the row's key, so results don't depend on partitioning. The driver
only ever sees one row of statistics.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.operators import ranges
from tessella.runtime import ship


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1 / max(abs(1 - (a + b) * x / (a + 1)), tiny) * math.copysign(1, 1 - (a + b) * x / (a + 1))
    h = d
    for m in range(1, 300):
        for numerator in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + numerator * d
            c = 1 + numerator / c
            d = 1 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_two_sided(t: float, df: float) -> float:
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def t_quantile(p: float, df: float) -> float:
    """By bisection of the distribution function."""
    lo, hi = -1e6, 1e6
    for _ in range(200):
        mid = (lo + hi) / 2
        below = t_two_sided(mid, df) / 2
        if (1 - below if mid > 0 else below) < p:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2


def mean_ci(mean: float | None, sd: float | None, n: int, confidence: float = 0.95) -> tuple[float, float, float]:
    """Mean with a two-sided t interval; no interval below two values, a point where all are equal."""
    if not n or mean is None:
        return (math.nan,) * 3
    if n < 2 or sd is None:
        return mean, math.nan, math.nan
    half = 0.0 if sd == 0 else t_quantile((1 + confidence) / 2, n - 1) * sd / math.sqrt(n)
    return mean, mean - half, mean + half


def contrast(diffs: DataFrame, diff: str) -> DataFrame:
    """One row: n, mean, median, sd, se, Cohen's dz, sign counts, t and Wilcoxon's W+, z and most ties (mid-ranks, zeros left out)."""
    d = F.col(diff)
    moved = diffs.filter(d != 0)
    sizes = moved.groupBy(F.abs(d).alias("size")).agg(F.count("*").alias("ties"), F.count_if(d > 0).alias("up"))
    ranked = ranges.before(sizes, [F.col("size")], "before", F.col("ties")).withColumn("rank", F.col("before") + (F.col("ties") + 1) / 2)
    n = F.sum("ties")
    t3 = F.sum(F.col("ties") * F.col("ties") * F.col("ties") - F.col("ties"))
    spread = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - t3 / 48)
    w = ranked.agg(F.sum(F.col("rank") * F.col("up")).alias("w_plus"), F.when(spread > 0, (F.sum(F.col("rank") * F.col("up")) - n * (n + 1) / 4) / spread).alias("w_z"), F.max("ties").alias("w_ties"))
    base = diffs.agg(
        F.count(diff).alias("n"),
        F.avg(diff).alias("mean"),
        F.median(diff).alias("median"),
        F.stddev_samp(diff).alias("sd"),
        (F.stddev_samp(diff) / F.sqrt(F.count(diff))).alias("se"),
        F.try_divide(F.avg(diff), F.stddev_samp(diff)).alias("dz"),
        F.count_if(d > 0).alias("n_up"),
        F.count_if(d < 0).alias("n_down"),
        F.count_if(d == 0).alias("n_zero"),
    )
    return base.crossJoin(w).withColumn("t", F.try_divide(F.col("mean"), F.col("se")))


#: Up to so many differences, none zero and none tied, Wilcoxon's p is exact.
EXACT = 50


def wilcoxon_exact(w_plus: float, n: int) -> float:
    """Two-sided p of a sum of positive ranks among 1 to n: by counting the subsets of each sum."""
    ways = [1]
    for rank in range(1, n + 1):
        ways = [(ways[i] if i < len(ways) else 0) + (ways[i - rank] if i >= rank else 0) for i in range(len(ways) + rank)]
    low = int(min(w_plus, n * (n + 1) / 2 - w_plus))
    return min(1.0, 2 * sum(ways[: low + 1]) / 2**n)


def with_p_values(one: DataFrame) -> DataFrame:
    """The contrast's row with p-values and the interval of its mean.

    Below two differences there is no p; Wilcoxon's is exact for few untied
    differences, else from the normal distribution, and missing where all are 0.
    """
    r = one.first()
    n, sd = r["n"], r["sd"]
    _, low, high = mean_ci(r["mean"], sd, n)
    p_t = t_two_sided(r["t"], n - 1) if r["t"] is not None and n > 1 else None
    if n > 1 and r["w_ties"] == 1 and not r["n_zero"] and n <= EXACT:
        p_w = wilcoxon_exact(r["w_plus"], n)
    else:
        p_w = math.erfc(abs(r["w_z"]) / math.sqrt(2)) if r["w_z"] is not None else None
    schema = T.StructType([*one.schema.fields, *[T.StructField(c, T.DoubleType()) for c in ("ci_low", "ci_high", "p_t", "p_wilcoxon")]])
    return one.sparkSession.createDataFrame([(*r, low, high, p_t, p_w)], schema)


_DRAWN = T.StructType([T.StructField("replicate", T.IntegerType()), T.StructField("total", T.DoubleType()), T.StructField("weight", T.DoubleType())])

#: Of 65,536 equally likely numbers, how many lie below each value's end in a Poisson distribution of mean 1.
POISSON = [int(65536 * sum(math.exp(-1) / math.factorial(j) for j in range(k + 1))) for k in range(8)]


def weights(seed: int, key: str, n: int, signs: bool) -> np.ndarray:
    """A row's weights in n replicates, from SHA-256 digests of seed, key and word, so that any engine can draw them.

    Signs: a bit each, the highest of a byte first, 1 for plus. Counts: two
    bytes each, the number of POISSON's ends that they reach.
    """
    words = -(-n // (256 if signs else 16))
    drawn = np.frombuffer(b"".join(hashlib.sha256(f"{seed}|{key}|{w}".encode()).digest() for w in range(words)), np.uint8)
    if signs:
        return np.unpackbits(drawn)[:n] * 2.0 - 1
    return np.searchsorted(POISSON, drawn.view(">u2")[:n], side="right").astype(float)


def _replicates(rows: DataFrame, value: str, size: str | None, key: str, n: int, seed: int, signs: bool) -> DataFrame:
    """(replicate, total, weight): sums of a value and a size over the rows, each with random weights of its own.

    Weights depend neither on partitions nor on other rows. A task sends one
    number of each kind a replicate.
    """
    ship(rows.sparkSession)
    base = rows.select(F.col(key).cast("string").alias("k"), F.col(value).cast("double").alias("x"), F.col(size).cast("double").alias("s") if size else F.lit(1.0).alias("s")).filter("x IS NOT NULL")

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, weight = np.zeros(n), np.zeros(n)
        for batch in batches:
            for k, x, s in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                w = weights(seed, k, n, signs)
                total += w * x
                weight += w * s
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n, dtype=np.int32)), pa.array(total), pa.array(weight)], names=["replicate", "total", "weight"])

    return base.mapInArrow(draw, _DRAWN).groupBy("replicate").agg(F.sum("total").alias("total"), F.sum("weight").alias("weight"))


def bootstrap(diffs: DataFrame, diff: str, key: str, replicates: int = 10_000, seed: int = 0, size: str | None = None) -> DataFrame:
    """One row: the 2.5 and 97.5 percentiles of resampled means; no rows for no subjects.

    Each subject counts a Poisson(1) number of times in a replicate, which is
    drawing with replacement whose total varies, so nothing is joined or
    numbered. With a ``size`` the statistic is the sum of ``diff`` over the sum
    of sizes: subjects are drawn, items are averaged.
    """
    means = _replicates(diffs, diff, size, key, replicates, seed, signs=False).filter("weight > 0").select((F.col("total") / F.col("weight")).alias("mean"))
    return means.agg(F.percentile("mean", F.lit(0.025)).alias("low"), F.percentile("mean", F.lit(0.975)).alias("high")).filter("low IS NOT NULL")


def signflip(diffs: DataFrame, diff: str, key: str, draws: int = 20_000, seed: int = 0) -> DataFrame:
    """One row: (1 + flipped means at least as far from 0 as the observed) / (draws + 1)."""
    flat = _replicates(diffs, diff, None, key, draws, seed, signs=True)
    # One row, so the cross join is one comparison a draw.
    observed = diffs.agg(F.abs(F.sum(diff)).alias("seen"))
    return flat.crossJoin(F.broadcast(observed)).agg(((1 + F.count_if(F.abs("total") >= F.col("seen") - 1e-12)) / (F.count("*") + 1)).alias("p"))
