"""Structured Streaming over the events table: windows, sessions, deduplication, running state.

Additions to the batch operators: every transformation takes a streaming or a
batch DataFrame alike, so results can be held against the batch form.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessella.runtime import ensure_checkpoint_dir, ship

LATE = "1 hour"


def read(spark: SparkSession, folder: str, files: int = 1) -> DataFrame:
    """The event files of a folder as a stream, so many files a micro-batch; times become zoned timestamps, as watermarks need them."""
    schema = spark.read.parquet(folder).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def arrivals(spark: SparkSession, events: DataFrame, batches: int) -> str:
    """A folder of the shared place with the events as files that arrive one after the other, in the order of time.

    Each file holds a range of times, so a stream of them keeps state from batch
    to batch. For tests and for holding streams against batch results.
    """
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"
    first, last = events.agg(F.min("ts"), F.max("ts")).first()
    edges = [first + (last - first) * i / batches for i in range(1, batches)] if first else []
    for lo, hi in zip([None, *edges], [*edges, None], strict=True):
        part = events.filter((F.lit(lo is None) if lo is None else F.col("ts") >= F.lit(lo)) & (F.lit(hi is None) if hi is None else F.col("ts") < F.lit(hi)))
        part.coalesce(1).write.mode("append").parquet(folder)
    return folder


def tumbling(events: DataFrame, width: str = "6 hours") -> DataFrame:
    return _flat(events.withWatermark("ts", LATE).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")))


def sliding(events: DataFrame, width: str = "12 hours", step: str = "6 hours") -> DataFrame:
    return _flat(events.withWatermark("ts", LATE).groupBy(F.window("ts", width, step)).agg(F.count("*").alias("n"), F.sum("value").alias("total")))


def sessions(events: DataFrame, gap: str = "4 hours") -> DataFrame:
    return _flat(events.withWatermark("ts", LATE).groupBy(F.session_window("ts", gap).alias("window"), "user_id").agg(F.count("*").alias("n")))


def _flat(df: DataFrame) -> DataFrame:
    rest = [c for c in df.columns if c != "window"]
    return df.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *rest)


def deduplicated(events: DataFrame) -> DataFrame:
    return events.withWatermark("ts", LATE).dropDuplicatesWithinWatermark(["event_id"])


def spend_guard(events: DataFrame, cap: float = 500.0) -> DataFrame:
    """A row for each user with the event that takes the spend so far past the cap; the state is one number a user.

    Events of a batch count in the order of time and id, so with batches in the
    order of time the result doesn't depend on where they are cut.
    """
    ship(events.sparkSession)

    def guard(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        spent, told = state.get if state.exists else (0.0, False)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        sums = spent + rows["value"].cumsum()
        past = rows[(sums > cap).to_numpy()]
        if len(past) and not told:
            told = True
            yield pd.DataFrame({"user_id": [key[0]], "event_id": [past["event_id"].iloc[0]], "spent": [sums[(sums > cap).to_numpy()].iloc[0]]})
        state.update((float(sums.iloc[-1]) if len(sums) else spent, told))

    return events.select("user_id", "event_id", "ts", "value").groupBy("user_id").applyInPandasWithState(guard, "user_id long, event_id long, spent double", "spent double, told boolean", "append", GroupStateTimeout.NoTimeout)


def run_to_table(spark: SparkSession, stream: DataFrame, mode: str = "append") -> DataFrame:
    """Process what is there (availableNow) with a checkpoint in the shared folder, and read what was written."""
    ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"
    if mode == "append":
        stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{base}/out")

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out")

    stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{base}/state").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


Transformation = Callable[[DataFrame], DataFrame]
