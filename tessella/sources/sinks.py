"""Writers. Targets are folders, as Spark writes them; every task writes its own file."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessella.functions.text import markdown_cell


def jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def sorted_csv(df: DataFrame, path: str, *order: Column | str) -> None:
    """Range-partitioned and sorted: part files in order are the sorted table; no single task holds it."""
    df.orderBy(*order).write.mode("overwrite").csv(path, header=True)


def markdown(df: DataFrame, path: str, *order: Column | str) -> None:
    """A table in Markdown, sorted: a header file, then part files of rows that follow each other by name."""
    spark = df.sparkSession
    line = lambda cells: F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    head = spark.createDataFrame([("| " + " | ".join(df.columns) + " |",), ("|" + " --- |" * len(df.columns),)], "value string")
    head.coalesce(1).write.mode("overwrite").text(f"{path}/0-header")
    df.orderBy(*order).select(line([markdown_cell(F.col(c)) for c in df.columns]).alias("value")).write.mode("overwrite").text(f"{path}/1-rows")


def chunked(df: DataFrame, path: str, chunk: str = "chunk") -> None:
    """A folder for each chunk; a chunk's rows are brought together first, so it has few files."""
    df.repartition(F.col(chunk)).write.mode("overwrite").partitionBy(chunk).json(path)


def append_missing(df: DataFrame, path: str, keys: Sequence[str]) -> int:
    """Append the rows whose key the target doesn't hold yet; returns how many. A run that is repeated adds nothing."""
    spark = df.sparkSession
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)
    new = df.join(spark.read.parquet(path).select(*keys).distinct(), list(keys), "left_anti") if there else df
    before = spark.read.parquet(path).count() if there else 0
    new.write.mode("append").parquet(path)
    return spark.read.parquet(path).count() - before


def ledger_stream(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append-only, exactly once: the file sink's log and the checkpoint survive a kill."""
    return stream.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
