"""Pairing of two arms on shared keys, and guards on keyed tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def arm(df: DataFrame, keys: Sequence[str], values: Sequence[str], which: str, prefix: str, arm_col: str = "arm") -> DataFrame:
    return df.filter(F.col(arm_col) == which).select(*keys, *[F.col(v).alias(f"{prefix}_{v}") for v in values])


def pairs(df: DataFrame, keys: Sequence[str], values: Sequence[str], better: str, worse: str, how: str = "inner") -> DataFrame:
    """One row for each key with both arms' values as better_* and worse_*."""
    return arm(df, keys, values, better, "better").join(arm(df, keys, values, worse, "worse"), list(keys), how)


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The last row of each key; the order must be total, since equals are picked at random."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def completeness(expected: DataFrame, present: DataFrame, keys: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Expected, present and missing keys by group."""
    there = present.select(*keys).distinct().withColumn("_there", F.lit(1))
    joined = expected.join(there, list(keys), "left")
    return joined.groupBy(*by).agg(F.count("*").alias("expected"), F.count("_there").alias("present"), F.count_if(F.col("_there").isNull()).alias("missing"), F.bool_and(F.col("_there").isNotNull()).alias("complete"))


def join_or_fail(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A left join whose misses raise when the result is computed."""
    marked = left.join(right.withColumn("_hit", F.lit(True)), list(keys), "left")
    checked = F.when(F.col("_hit"), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("no match for key "), F.to_json(F.struct(*keys)))).cast("boolean"))
    return marked.withColumn("_hit", checked).filter("_hit").drop("_hit")


def answered(prompts: DataFrame, completions: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Prompts with their completion's text; what has none is null. The batch backend: completions are a table."""
    given = completions.select(F.col(key).alias("_key"), F.col(text).alias("completion"))
    return prompts.join(given, F.col(key) == F.col("_key"), "left").drop("_key")


def generated(prompts: DataFrame, key: str, prompt: str, generate: Callable[[list[str]], list[str]], batch: int = 256) -> DataFrame:
    """(key, completion) from a function over lists of prompts, which answers in their order. The live backend."""
    schema = T.StructType([T.StructField(key, prompts.schema[key].dataType), T.StructField("completion", T.StringType())])

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                yield pd.DataFrame({key: part[key].to_numpy(), "completion": generate(part[prompt].tolist())})

    return prompts.select(key, prompt).mapInPandas(answer, schema)


def indexed(meta: DataFrame, completions: DataFrame, key: str) -> DataFrame:
    """One row: how many completions have their row in the index, and how many are missing or extra."""
    both = meta.select(key, F.lit(1).alias("_m")).join(completions.select(key, F.lit(1).alias("_c")), key, "full")
    return both.agg(F.count_if(F.col("_m").isNotNull() & F.col("_c").isNotNull()).alias("matched"), F.count_if(F.col("_c").isNull()).alias("missing"), F.count_if(F.col("_m").isNull()).alias("extra"))
