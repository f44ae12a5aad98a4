"""Composite steps: fuzzy names, donor matching, option ladders, evidence scores, prompts, chunks, allocation."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions import text as tx
from tessella.operators import linkage, ranges
from tessella.runtime import ship


@F.pandas_udf(T.DoubleType())
def _ratio(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for left, right in pairs:
        yield pd.Series([SequenceMatcher(None, a or "", b or "", autojunk=False).ratio() for a, b in zip(left, right, strict=True)], dtype="float64")


def ratio(a: Column, b: Column) -> Column:
    """Ratcliff-Obershelp similarity; Spark has no such function, so it runs in Arrow batches."""
    return _ratio(a, b)


def name_links(names: DataFrame, key: str, name: str, least: float = 0.7) -> DataFrame:
    """Pairs of keys whose names share a token or whose ratio reaches the least.

    Exact: a ratio is at most the Dice similarity of the names' letters, counted
    with repeats, so the pairs that reach it as a Jaccard of letter bags are
    all that can reach the least. Only they and names that share a token are
    compared. Empty names pair with nothing.
    """
    ship(names.sparkSession)
    n = names.select(F.col(key).alias("k"), tx.name_key(F.col(name)).alias("n")).filter("n <> ''")
    letters = F.transform(F.sequence(F.lit(1), F.length("n")), lambda i: F.substring("n", i, F.lit(1)))
    bag = F.transform(letters, lambda x, i: F.concat(x, F.size(F.filter(F.slice(letters, F.lit(1), i + 1), lambda y: y == x)).cast("string")))
    bags = n.select("n").distinct().select(F.lit(0).alias("all"), "n", bag.alias("bag"))
    alike = linkage.similar_pairs(bags, "all", "n", "bag", least / (2 - least) - 1e-9, expand=True).select(F.col("a").alias("x"), F.col("b").alias("y"))
    x, y = n.select(F.col("k").alias("i"), F.col("n").alias("x")), n.select(F.col("k").alias("j"), F.col("n").alias("y"))
    met = alike.join(x, "x").join(y, "y").filter("i <> j")
    first = F.col("i") < F.col("j")
    met = met.select(*[F.when(first, p).otherwise(F.col(q)).alias(c) for p, q, c in ((F.col("i"), "j", "a"), (F.col("j"), "i", "b"), (F.col("x"), "y", "name_a"), (F.col("y"), "x", "name_b"))], F.lit(False).alias("shares"))
    tokens = n.select("k", "n", F.explode(F.array_distinct(F.filter(F.split("n", " "), lambda t: t != ""))).alias("token"))
    a, b = tokens.select(F.col("k").alias("a"), F.col("n").alias("name_a"), "token"), tokens.select(F.col("k").alias("b"), F.col("n").alias("name_b"), "token")
    shared = a.join(b, "token").filter("a < b").select("a", "b", "name_a", "name_b", F.lit(True).alias("shares"))
    pairs = shared.unionByName(met).groupBy("a", "b", "name_a", "name_b").agg(F.bool_or("shares").alias("shares"))
    return pairs.withColumn("ratio", ratio(F.col("name_a"), F.col("name_b"))).filter(F.col("shares") | (F.col("ratio") >= least)).select("a", "b", "shares", "ratio")


def surname_registry(labels: DataFrame, by: str, order: str, name: str, has_role: str) -> DataFrame:
    """For each surname of a conversation its full name: the first spelling with a role, else the first; surnames of several names go."""
    n = labels.withColumn("surname", F.lower(F.element_at(F.split(F.trim(name), r"\s+"), -1)))
    full = F.size(F.split(F.trim(F.col(name)), r"\s+")) > 1
    g = n.groupBy(by, "surname").agg(F.min_by(name, F.struct(~F.col(has_role), F.col(order))).alias("full_name"), F.count_distinct(F.when(full, F.lower(F.trim(name)))).alias("several"))
    return g.filter("several <= 1").drop("several")


#: Rungs of the option ladder: tolerance of length, and whether neighbouring buckets serve too.
LADDER = ((0.20, False), (0.30, False), (0.30, True), (0.50, True))
_NEXT = {"Z": ("Z", "L"), "L": ("Z", "L", "H"), "H": ("L", "H")}


def ladder(items: DataFrame, bank: DataFrame, need: int) -> DataFrame:
    """For each item the candidates of the first rung that has enough distinct donors, or else of the last rung.

    few_donors: the last rung too has fewer than ``need``. An item without any
    candidate keeps one row whose candidate is null.

    items: item, subject, words, bucket; bank: cand, donor, words, bucket. The
    join is on (bucket, length band); every candidate gets its lowest rung, so
    one join counts the donors of all rungs. A second one finds the candidates,
    so that no candidate is shuffled.
    """
    step = 1.5
    band = lambda w: F.floor(F.log(F.greatest(w, F.lit(1.0))) / F.log(F.lit(step))).cast("long")
    widest, last = LADDER[-1][0], len(LADDER)
    near = F.create_map(*[x for b, ns in _NEXT.items() for x in (F.lit(b), F.array(*map(F.lit, ns)))])
    bk = bank.select("cand", "donor", F.col("words").cast("double").alias("cw"), "bucket", band(F.col("words").cast("double")).alias("band"))
    gap = F.abs(F.col("cw") - F.col("w")) / F.col("w")
    rung = F.lit(None).cast("int")
    for n, (tolerance, neighbours) in reversed(list(enumerate(LADDER, 1))):
        ok = gap <= tolerance if neighbours else (gap <= tolerance) & (F.col("bucket") == F.col("own"))
        rung = F.when(ok, n).otherwise(rung)

    def candidates(it: DataFrame) -> DataFrame:
        it = it.withColumn("bucket", F.explode(F.element_at(near, F.col("own")))).withColumn("band", F.explode(F.sequence(band(F.col("w") * (1 - widest)), band(F.col("w") * (1 + widest)))))
        return it.join(bk, ["bucket", "band"]).filter("donor <> subject").withColumn("rung", rung).filter("rung IS NOT NULL")

    it = items.select("item", "subject", F.col("words").cast("double").alias("w"), F.col("bucket").alias("own")).repartition("item")
    donors = candidates(it).groupBy("item", "donor").agg(F.min("rung").alias("rung"))
    counts = donors.groupBy("item").agg(*[F.count_if(F.col("rung") <= n).alias(f"r{n}") for n in range(1, last + 1)])
    first = F.coalesce(*[F.when(F.col(f"r{n}") >= need, n) for n in range(1, last + 1)], F.lit(last))
    served = counts.select(F.col("item").alias("_item"), first.alias("relax_rung"), (F.col(f"r{last}") < need).alias("few_donors"))
    it = it.join(served, F.col("item").eqNullSafe(F.col("_item")), "left")
    chosen = candidates(it.filter("relax_rung IS NOT NULL")).filter("rung <= relax_rung").select("item", "cand", "donor", "rung", "relax_rung", F.round(gap, 6).alias("gap"), "few_donors")
    none = it.filter("relax_rung IS NULL").select("item", F.lit(last).alias("relax_rung"), F.lit(True).alias("few_donors")).distinct()
    return chosen.unionByName(none, allowMissingColumns=True)


def evidence_score(counts: dict[str, Column]) -> Column:
    """3 a strong, 2 a medium and 1 a weak hit, each kind capped at four."""
    weight = {"strong": 3, "medium": 2, "weak": 1}
    return sum((weight[k] * F.least(c, F.lit(4)) for k, c in counts.items()), F.lit(0))


def best_quotes(quotes: DataFrame, subject: str, quote: str, weight: str, order: str) -> DataFrame:
    """One row for each quote's normal form (80 characters), the heaviest and then the latest."""
    normal = F.substring(F.regexp_replace(F.lower(quote), r"[^a-z0-9]+", " "), 1, 80)
    return quotes.withColumn("form", F.trim(normal)).groupBy(subject, "form").agg(F.max(F.struct(weight, order)).alias("b")).select(subject, "form", f"b.{weight}", f"b.{order}")


def render(template: Sequence[str | Column], separator: str = "\n") -> Column:
    """Fragments joined by a separator; null fragments and those that are empty leave no trace."""
    parts = [F.lit(p) if isinstance(p, str) else p for p in template]
    return F.concat_ws(separator, *[F.when(p != "", p) for p in parts])


def unique_prompts(rendered: DataFrame, prompt: str, order: Sequence[str]) -> DataFrame:
    """Adds the prompt's SHA-256, the row that renders it first, and whether this one repeats it."""
    keyed = rendered.withColumn("prompt_sha256", F.sha2(prompt, 256))
    first = keyed.groupBy("prompt_sha256").agg(F.min(F.struct(*order)).alias("first"))
    return keyed.join(first, "prompt_sha256").withColumn("repeats", F.struct(*order) != F.col("first"))


def chunked(sizes: DataFrame, subject: str, n: str, target: int) -> DataFrame:
    """A chunk number for each subject, whole subjects in order, about so many prompts a chunk.

    A subject goes where its first prompt falls.
    """
    return ranges.before(sizes, [F.col(subject)], "_before", F.col(n)).withColumn("chunk", F.floor(F.col("_before") / target).cast("long")).drop("_before")


def guarded(ranked: DataFrame, blocks: dict[str, Column], subject: str = "subject", order: str = "rank") -> DataFrame:
    """Each subject's first candidate in order that no rule blocks, with how many were passed over and why the first of them was.

    blocks: reasons in the order in which they are tried, each a condition over
    the candidate's row.
    """
    reason = F.coalesce(*[F.when(c, F.lit(r)) for r, c in blocks.items()])
    marked = ranked.withColumn("_reason", reason)
    free = F.min(F.when(F.col("_reason").isNull(), F.col(order)))
    first = marked.groupBy(subject).agg(free.alias("_first"), F.min_by("_reason", F.when(F.col("_reason").isNotNull(), F.col(order))).alias("passed_reason"))
    joined = marked.join(first, subject).filter(F.col(order) == F.col("_first"))
    return joined.withColumn("passed_over", (F.col("_first") - 1).cast("long")).drop("_reason", "_first")


def allocate(supply: dict[str, int], quota: int) -> dict[str, int]:
    """Even shares of a quota, capped by supply; what some can't give is shared among the others, by name."""
    given, left = dict.fromkeys(supply, 0), quota
    while left and (able := sorted(k for k in supply if given[k] < supply[k])):
        share = max(1, left // len(able))
        for k in able:
            take = min(share, supply[k] - given[k], left)
            given[k] += take
            left -= take
    return given
