"""Ranks, top-k per group, TF-IDF in long form and its joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators import ranges


def top_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def distinct_top(df: DataFrame, by: Sequence[str], donor: str, order: Sequence[Column], k: int) -> DataFrame:
    """The k best rows of each group, at most one of each donor."""
    best = top_per_group(df, [*by, donor], order, 1).drop("rank")
    return top_per_group(best, by, order, k)


def mid_rank(df: DataFrame, value: str, by: Sequence[str] = (), name: str = "mid_rank") -> DataFrame:
    """The average rank of equal values. Distinct values are counted first, so the ranking itself sees no ties."""
    keys = list(by)
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("_ties"))
    if keys:
        earlier = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("_before", F.coalesce(F.sum("_ties").over(earlier), F.lit(0)))
    else:
        counts = ranges.before(counts, [F.col(value)], "_before", F.col("_ties"))
    ranked = counts.withColumn(name, F.col("_before") + (F.col("_ties") + 1) / 2)
    return df.join(ranked.drop("_ties", "_before"), [*keys, value])


def tfidf(terms: DataFrame, doc: str = "doc", term: str = "term", max_df: float = 0.9) -> DataFrame:
    """(doc, term, w): tf x (ln((1 + n) / (1 + df)) + 1), of unit length by document; terms in more than max_df of documents go."""
    n = terms.agg(F.count_distinct(doc).alias("n"))
    tf = terms.groupBy(doc, term).agg(F.count("*").alias("tf"))
    df = tf.groupBy(term).agg(F.count("*").alias("df"))
    idf = df.crossJoin(F.broadcast(n)).filter(F.col("df") <= max_df * F.col("n")).select(term, (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    raw = tf.join(idf, term).select(doc, term, (F.col("tf") * F.col("idf")).alias("raw"))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(doc)))
    return raw.select(doc, term, (F.col("raw") / norm).alias("w"))


def sparse_cosine(a: DataFrame, b: DataFrame, doc: str = "doc", term: str = "term") -> DataFrame:
    """(a, b, cosine) of documents that share a term, within 0 to 1."""
    left = a.select(F.col(doc).alias("a"), term, F.col("w").alias("wa"))
    right = b.select(F.col(doc).alias("b"), term, F.col("w").alias("wb"))
    return left.join(right, term).groupBy("a", "b").agg(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.sum(F.col("wa") * F.col("wb")))).alias("cosine"))


def auc(df: DataFrame, score: str, positive: str, by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve by mid-ranks (Mann-Whitney)."""
    r = mid_rank(df, score, by)
    p = F.sum(F.when(F.col(positive), 1).otherwise(0))
    n = F.count("*") - p
    return r.groupBy(*by).agg(F.when((p > 0) & (n > 0), (F.sum(F.when(F.col(positive), F.col("mid_rank"))) - p * (p + 1) / 2) / (p * n)).alias("auc"), p.alias("n_pos"), n.alias("n_neg"))
