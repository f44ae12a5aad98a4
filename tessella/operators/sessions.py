"""Dialogue turns into question-answer items, exchanges, segments, follow-up cases and chains.

Turns have tid, turn_idx, role (host, guest, other) and text. Every operator is
one window pass by tid; conversations stay bounded, so a partition key is never
hot beyond a conversation's length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def _in_turn() -> WindowSpec:
    return Window.partitionBy("tid").orderBy("turn_idx")


def _runs(turns: DataFrame) -> DataFrame:
    """Stripped texts, and the number of the run of guest turns or the single other turn."""
    return turns.withColumns({"text": F.trim(F.coalesce("text", F.lit(""))), "_before": F.lag("role").over(_in_turn())}).withColumn(
        "_run", F.sum(F.when((F.col("role") == "guest") & (F.col("_before") == "guest"), 0).otherwise(1)).over(_in_turn().rowsBetween(Window.unboundedPreceding, 0))
    )


def _joined(text: Column) -> Column:
    """Non-empty pieces of a run in turn order, joined by one space."""
    ordered = F.array_sort(F.collect_list(F.struct("turn_idx", text.alias("t"))))
    return F.array_join(F.filter(F.transform(ordered, lambda x: x["t"]), lambda t: t != ""), " ")


def _guest_runs(turns: DataFrame) -> DataFrame:
    """One row per guest run: its text, and the turn just before it."""
    runs = _runs(turns).withColumns({"_prev_idx": F.lag("turn_idx").over(_in_turn()), "_prev_text": F.lag("text").over(_in_turn())})
    return runs.filter("role = 'guest'").groupBy("tid", "_run").agg(
        F.min("turn_idx").alias("first_idx"),
        F.max("turn_idx").alias("last_idx"),
        _joined(F.col("text")).alias("answer"),
        F.min_by("_before", "turn_idx").alias("before_role"),
        F.min_by("_prev_idx", "turn_idx").alias("before_idx"),
        F.min_by("_prev_text", "turn_idx").alias("before_text"),
    )


def qa_items(turns: DataFrame) -> DataFrame:
    """Host turns whose next turn is a guest's, with the run of guest turns that follows."""
    r = _guest_runs(turns).filter("before_role = 'host'")
    return r.select("tid", F.col("before_idx").alias("q_turn_idx"), F.col("before_text").alias("question"), "answer")


def exchanges(turns: DataFrame) -> DataFrame:
    """Guest runs with text; the host text only if a host spoke just before, else empty."""
    r = _guest_runs(turns).filter("answer <> ''")
    return r.select("tid", F.col("first_idx").alias("answer_idx"), F.when(F.col("before_role") == "host", F.col("before_text")).otherwise("").alias("host"), "answer")


def segments(turns: DataFrame) -> DataFrame:
    """Every host turn with text, with the guest run that follows at once, which may be empty."""
    hosts = turns.withColumn("text", F.trim(F.coalesce("text", F.lit("")))).filter("role = 'host' AND text <> ''").select("tid", F.col("turn_idx").alias("q_turn_idx"), F.col("text").alias("question"))
    replies = qa_items(turns).select("tid", "q_turn_idx", "answer")
    return hosts.join(replies, ["tid", "q_turn_idx"], "left").select("tid", "q_turn_idx", "question", F.coalesce("answer", F.lit("")).alias("answer"))


def followups(turns: DataFrame) -> DataFrame:
    """Each host turn with text, with the last turn of the latest guest run before it and the host turn before that run.

    Host turns before any guest are NEW-TOPIC by rule. No as-of operator is
    needed: both look-ups are last non-null values over the turns so far.
    """
    spoken = turns.withColumn("text", F.trim(F.coalesce("text", F.lit("")))).filter("text <> ''")
    before = _in_turn().rowsBetween(Window.unboundedPreceding, -1)
    guest = F.last(F.when(F.col("role") == "guest", F.col("turn_idx")), ignorenulls=True).over(before)
    host_before = F.last(F.when(F.col("role") == "host", F.col("turn_idx")), ignorenulls=True).over(before)
    seen = spoken.withColumns({"guest_idx": guest, "_host_before": host_before})
    prior = F.last(F.when(F.col("role") == "guest", F.col("_host_before")), ignorenulls=True).over(before)
    out = seen.withColumn("prev_host_idx", prior).filter("role = 'host'")
    return out.select("tid", "turn_idx", "guest_idx", "prev_host_idx", F.when(F.col("guest_idx").isNull(), "NEW-TOPIC").alias("rule_label"))


def chains(labelled: DataFrame, by: str = "tid", order: str = "turn_idx", label: str = "label") -> DataFrame:
    """A root and the unbroken run of FOLLOW-UP rows after it: chain number, depth, and first and last place."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    root = F.when(F.coalesce(F.col(label) == "FOLLOW-UP", F.lit(False)), 0).otherwise(1)
    numbered = labelled.withColumn("chain", F.sum(root).over(w))
    return numbered.groupBy(by, "chain").agg(F.min(order).alias("first"), F.max(order).alias("last"), (F.count("*") - 1).alias("depth"))


def first_words_of_roles(turns: DataFrame) -> DataFrame:
    """The first host turn of a conversation, and whether a guest spoke before it."""
    return turns.groupBy("tid").agg(F.min(F.when(F.col("role") == "host", F.col("turn_idx"))).alias("first_host"), F.min(F.when(F.col("role") == "guest", F.col("turn_idx"))).alias("first_guest")).withColumn(
        "guest_first", F.coalesce(F.col("first_guest") < F.col("first_host"), F.col("first_guest").isNotNull())
    )
