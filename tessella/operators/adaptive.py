"""The adaptive round loop: score what is left, pick the best per person, reveal it, checkpoint.

Each round is a join, a window top-1 per person and a written table, so a
resumed run starts after the last complete round.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import dist
from tessella.functions.text import index_of
from tessella.runtime import materialise

#: Scores of a distribution by name; the larger is asked first. Rounded entropies tie whatever the order of their sums.
SCORERS: dict[str, Callable[[Column], Column]] = {"entropy": dist.entropy, "ev_variance": dist.variance, "entropy_9": lambda d: F.round(dist.entropy(d), 9)}


def pick(scored: DataFrame, person: str, item: str, score: str, seed: int | None = None, round_no: int = 0) -> DataFrame:
    """The best item of each person; ties go to the first item, or by a seeded digest of person and round."""
    w = Window.partitionBy(person)
    top = scored.withColumn("_top", F.max(score).over(w)).filter(F.col(score) == F.col("_top")).drop("_top")
    if seed is None:
        at = F.lit(1)
    else:
        at = index_of(F.concat_ws("|", F.lit(str(seed)), F.col(person).cast("string"), F.lit(str(round_no))), F.count("*").over(w)) + 1
    return top.withColumn("tied", F.count("*").over(w)).withColumns({"_n": F.row_number().over(w.orderBy(item)), "_at": at}).filter("_n = _at").drop("_n", "_at")


def rounds(beliefs: Callable[[DataFrame, int], DataFrame], items: DataFrame, most: int, person: str = "person_id", item: str = "item", scorer: str = "entropy", seed: int | None = None) -> DataFrame:
    """(person, round, item, score, tied). beliefs: from the remaining (person, item) rows and the round, adds a distribution ``d``."""
    left, shown = items.select(person, item), None
    for n in range(1, most + 1):
        scored = beliefs(left, n).withColumn("score", SCORERS[scorer](F.col("d"))).select(person, item, "score")
        best = materialise(pick(scored, person, item, "score", seed, n).select(person, F.lit(n).alias("round"), item, "score", "tied"))
        shown = best if shown is None else shown.unionByName(best)
        left = left.join(best.select(person, item), [person, item], "left_anti")
    return shown


def gain_rounds(
    beliefs: Callable[[DataFrame, int], DataFrame],
    shifted: Callable[[DataFrame, int], DataFrame],
    items: DataFrame,
    most: int,
    person: str = "person_id",
    item: str = "item",
    shortlist: int = 5,
    answers: tuple[int, ...] = (1, 3, 5),
    scorer: str = "entropy",
    seed: int | None = None,
) -> DataFrame:
    """(person, round, item, score, tied): in each round the item whose hypothetical answers would move beliefs most.

    beliefs: adds a distribution ``d`` over answers to the remaining (person,
    item) rows. Each person's ``shortlist`` of most uncertain items goes on,
    once for each hypothetical answer; shifted: adds a distribution ``before``
    and one ``after`` the answer to rows of (person, item, answer). An item's
    score is the total variation between both, averaged with the answers'
    masses in ``d`` (equal ones where it has none); null distributions move
    nothing.
    """
    left, shown = items.select(person, item), None
    for n in range(1, most + 1):
        scored = beliefs(left, n).withColumn("_uncertain", SCORERS[scorer](F.col("d")))
        near = scored.withColumn("_k", F.row_number().over(Window.partitionBy(person).orderBy(F.desc("_uncertain"), item))).filter(F.col("_k") <= shortlist)
        near = near.select(person, item, dist.hypothetical_weights(F.col("d"), answers).alias("_w"))
        asked = near.select(person, item, F.explode(F.array(*map(F.lit, answers))).alias("answer"))
        moved = shifted(asked, n).select(person, item, "answer", F.coalesce(dist.total_variation(F.col("before"), F.col("after")), F.lit(0.0)).alias("_shift"))
        shifts = moved.groupBy(person, item).agg(F.map_from_entries(F.collect_list(F.struct("answer", "_shift"))).alias("_s"))
        gains = near.join(shifts, [person, item]).withColumn("score", dist.expected_shift(F.col("_s"), F.col("_w"))).select(person, item, "score")
        best = materialise(pick(gains, person, item, "score", seed, n).select(person, F.lit(n).alias("round"), item, "score", "tied"))
        shown = best if shown is None else shown.unionByName(best)
        left = left.join(best.select(person, item), [person, item], "left_anti")
    return shown


def complete_rounds(log: DataFrame, person: str, round_col: str, persons: int) -> DataFrame:
    """The rows of the unbroken first rounds that every person has; a partial round and all after it go."""
    full = log.groupBy(round_col).agg(F.count_distinct(person).alias("n")).filter(F.col("n") == persons)
    unbroken = full.withColumn("k", F.row_number().over(Window.orderBy(round_col))).filter(F.col("k") == F.col(round_col)).select(round_col)
    return log.join(F.broadcast(unbroken), round_col)
