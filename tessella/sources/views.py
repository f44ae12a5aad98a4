"""Conformed views: the engine's entities over the available tables, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.runtime import table

#: The scale of the seven-point items.
SCALE = range(1, 8)


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dialogue turns: user is the host, assistant the guest, anyone else other."""
    role = F.when(F.col("role") == "user", "host").when(F.col("role") == "assistant", "guest").otherwise("other")
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("tid"), F.col("turn").alias("turn_idx"), role.alias("role"), "text")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last prediction of each person, item and arm: expected value, argmax, truth, parse failure."""
    e = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("person_id"),
        F.col("event_type").alias("item"),
        F.when(F.col("event_id") % 2 == 0, "twin").otherwise("baseline").alias("arm"),
        "event_id",
        (1 + F.col("value") % 6).alias("ev"),
        (1 + F.col("user_id") % 7).alias("truth"),
        (F.col("event_id") % 23 == 0).alias("parse_failure"),
    )
    last = e.groupBy("person_id", "item", "arm").agg(F.max(F.struct("event_id", "ev", "truth", "parse_failure")).alias("r"))
    return last.select("person_id", "item", "arm", "r.ev", F.floor("r.ev").cast("int").alias("argmax"), "r.truth", "r.parse_failure")


def completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completion texts of several formats, made from event values."""
    v = F.floor(F.col("value")).cast("long")
    pairs = F.concat_ws(" ", *[F.concat(F.lit(f"{k}:0."), F.lpad(((v * k + F.col("event_id")) % 100).cast("string"), 2, "0")) for k in SCALE])
    kind = F.col("event_id") % 5
    text = (
        F.when(kind == 0, pairs)
        .when(kind == 1, F.concat(F.lit("I think the answer is\n"), (v % 10).cast("string")))
        .when(kind == 2, (1 + v % 7).cast("string"))
        .when(kind == 3, F.concat((v % 9).cast("string"), F.lit(" or "), (v % 7).cast("string")))
        .otherwise(F.concat(F.lit("A: 0."), (v % 10).cast("string"), F.lit(" B: 0.2 C: 0.3 D: 0.1")))
    )
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), text.alias("text"))


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Appearances of subjects in time: an order is a cluster, its price its words."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("subject"), F.col("o_orderkey").alias("cluster"), F.to_date("o_orderdate").alias("date"), F.floor("o_totalprice").cast("long").alias("words"), "o_orderpriority"
    )


SQL = {
    "turns": "SELECT conv_id AS tid, turn AS turn_idx, CASE role WHEN 'user' THEN 'host' WHEN 'assistant' THEN 'guest' ELSE 'other' END AS role, text FROM conversations",
    "predictions": """SELECT user_id AS person_id, event_type AS item, CASE WHEN event_id % 2 = 0 THEN 'twin' ELSE 'baseline' END AS arm,
        1 + value % 6 AS ev, CAST(floor(1 + value % 6) AS INTEGER) AS argmax, 1 + user_id % 7 AS truth, event_id % 23 = 0 AS parse_failure
        FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type, event_id % 2 ORDER BY event_id DESC) = 1""",
    "completions": """SELECT event_id AS id, CASE event_id % 5
        WHEN 0 THEN concat_ws(' ', """
    + ", ".join(f"'{k}:0.' || lpad(CAST((CAST(floor(value) AS BIGINT) * {k} + event_id) % 100 AS VARCHAR), 2, '0')" for k in SCALE)
    + """)
        WHEN 1 THEN 'I think the answer is' || chr(10) || CAST(CAST(floor(value) AS BIGINT) % 10 AS VARCHAR)
        WHEN 2 THEN CAST(1 + CAST(floor(value) AS BIGINT) % 7 AS VARCHAR)
        WHEN 3 THEN CAST(CAST(floor(value) AS BIGINT) % 9 AS VARCHAR) || ' or ' || CAST(CAST(floor(value) AS BIGINT) % 7 AS VARCHAR)
        ELSE 'A: 0.' || CAST(CAST(floor(value) AS BIGINT) % 10 AS VARCHAR) || ' B: 0.2 C: 0.3 D: 0.1' END AS text FROM events""",
    "clusters": "SELECT o_custkey AS subject, o_orderkey AS cluster, CAST(o_orderdate AS DATE) AS date, CAST(floor(o_totalprice) AS BIGINT) AS words, o_orderpriority FROM orders",
}
