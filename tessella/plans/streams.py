"""Streaming queries over events that arrive in several micro-batches, their results held against batch SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.plans.registry import query
from tessella.runtime import table
from tessella.streaming import events as ev

#: Files, and so micro-batches, that the events arrive in.
BATCHES = 4


def _arriving(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.read(spark, ev.arrivals(spark, table(spark, sf_dir, "events"), BATCHES))


@query("""
SELECT CAST(time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01') AS VARCHAR) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ev.run_to_table(spark, ev.tumbling(_arriving(spark, sf_dir)), "complete")
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""
WITH s AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL '4 hours' OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS first FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
     g AS (SELECT user_id, ts, sum(first) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM s)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS start, count(*) AS n FROM g GROUP BY user_id, k""")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ev.run_to_table(spark, ev.sessions(_arriving(spark, sf_dir)), "complete")
    return out.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("start"), "n")


@query("SELECT event_id, user_id, value FROM events")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third event arrives twice, some minutes apart, and may come in the next batch; each is kept once."""
    e = table(spark, sf_dir, "events")
    again = e.filter("event_id % 3 = 0").withColumn("ts", F.col("ts") + F.expr("INTERVAL 10 MINUTES"))
    stream = ev.read(spark, ev.arrivals(spark, e.unionByName(again), BATCHES))
    return ev.run_to_table(spark, ev.deduplicated(stream).select("event_id", "user_id", "value"))


@query("""
WITH m AS (SELECT event_id, ts, count(*) OVER (ORDER BY ts RANGE BETWEEN INTERVAL '10 minutes' PRECEDING AND CURRENT ROW) AS n FROM events)
SELECT CAST(time_bucket(INTERVAL '1 day', ts, TIMESTAMP '1970-01-01') AS VARCHAR) AS day, max(n) AS peak FROM m GROUP BY 1""")
def request_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most events of any ten minutes that end in a day: a sliding rate, by blocks of time that hold a little of the one before."""
    e = table(spark, sf_dir, "events").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    width, back = 86_400_000_000, 600_000_000
    day = F.floor(F.col("us") / width).cast("long")
    # Rows of a day's last minutes serve the next day too.
    copies = e.select("us", F.explode(F.sequence(day, F.floor((F.col("us") + back) / width).cast("long"))).alias("day"), day.alias("own"))
    w = Window.partitionBy("day").orderBy("us").rangeBetween(-back, Window.currentRow)
    rated = copies.withColumn("n", F.count("*").over(w)).filter("day = own")
    return rated.groupBy("day").agg(F.max("n").alias("peak")).select(F.date_format(F.timestamp_seconds(F.col("day") * 86400), "yyyy-MM-dd HH:mm:ss").alias("day"), "peak")


@query("""
WITH s AS (SELECT user_id, event_id, ts, sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS spent FROM events)
SELECT user_id, event_id, round(spent, 4) AS spent FROM s WHERE spent > 500 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1""")
def stream_spend_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event that takes each user's spend past a cap, with the state carried over micro-batches."""
    out = ev.run_to_table(spark, ev.spend_guard(_arriving(spark, sf_dir)))
    return out.select("user_id", "event_id", F.round("spent", 4).alias("spent"))
