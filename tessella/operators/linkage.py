"""Set-similarity joins within groups, leak scans by n-grams, co-occurrence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import gram_hash, hashed_ngrams, ngrams
from tessella.runtime import materialise

#: Near duplicates: Jaccard, or containment of a set of LEAST items or more; sets of fewer than SMALL items only if equal.
JACCARD, CONTAINMENT, LEAST, SMALL = 0.60, 0.80, 50, 20


#: So many shared items a candidate pair must show in its prefixes; more make prefixes longer and candidates fewer.
PROOFS = 8


def _classes(sets: DataFrame, by: str, doc: str, items: str) -> tuple[DataFrame, DataFrame]:
    """Rows with their set's hash ``h``, and one row a distinct set of a group: its smallest document ``k``, the set ``s``, its size ``n``."""
    full = sets.select(by, doc, F.array_sort(F.array_distinct(items)).alias("s")).filter(F.size("s") > 0)
    full = materialise(full.withColumn("h", F.sha2(F.to_json(F.struct("s")), 256)))
    one = full.groupBy(by, "h").agg(F.min(doc).alias("k"), F.first("s").alias("s"))
    return full, materialise(one.select(by, "h", "k", "s", F.size("s").alias("n")))


def _rare_first(one: DataFrame, by: str) -> DataFrame:
    """(by, item, k, n, at): items that several sets have, by their place in the order from rare to common.

    Items of one set alone come first and match nothing: they only count.
    """
    long = one.select(by, "k", "n", F.explode_outer("s").alias("item"))
    common = long.groupBy(by, "item").agg(F.count("*").alias("df")).filter("df > 1")
    shared = long.join(common, [by, "item"]).groupBy(by, "k", "n").agg(F.array_sort(F.collect_list(F.struct("df", "item"))).alias("o"))
    ranked = shared.select(by, "k", "n", F.posexplode_outer("o").alias("at", "e"), (F.col("n") - F.size("o")).alias("alone"))
    return ranked.select(by, F.col("e.item").alias("item"), "k", "n", (F.col("at") + F.col("alone")).alias("at"))


def _compared(near: DataFrame, one: DataFrame, by: str) -> DataFrame:
    """Candidate pairs (k_a, k_b) with their sizes, shared items, Jaccard and containment."""
    of_a, of_b = (one.select(by, F.col("k").alias(f"k_{x}"), F.col("s").alias(f"s_{x}")) for x in "ab")
    sized = near.join(of_a, [by, "k_a"]).join(of_b, [by, "k_b"]).withColumn("shared", F.size(F.array_intersect("s_a", "s_b")).cast("long"))
    return sized.withColumns({"jaccard": F.col("shared") / (F.col("n_a") + F.col("n_b") - F.col("shared")), "containment": F.col("shared") / F.least("n_a", "n_b")})


def _with_copies(pairs: DataFrame, full: DataFrame, one: DataFrame, by: str, doc: str) -> DataFrame:
    """Pairs of representatives, and each further document of a set with its representative, the set's smallest document."""
    reps = pairs.select(by, F.least("k_a", "k_b").alias("a"), F.greatest("k_a", "k_b").alias("b"), *[F.when(F.col("k_a") < F.col("k_b"), F.col(f"n_{x}")).otherwise(F.col(f"n_{y}")).alias(f"n_{x}") for x, y in ("ab", "ba")], "shared", "jaccard")
    copies = full.select(by, "h", F.col(doc).alias("b")).join(one.select(by, "h", F.col("k").alias("a"), "n"), [by, "h"]).filter("a <> b")
    return reps.unionByName(copies.select(by, "a", "b", F.col("n").alias("n_a"), F.col("n").alias("n_b"), F.col("n").cast("long").alias("shared"), F.lit(1.0).alias("jaccard")))


def _expanded(pairs: DataFrame, full: DataFrame, by: str, doc: str) -> DataFrame:
    """Pairs of representatives and members as pairs of all documents of their classes."""
    rep = full.groupBy(by, "h").agg(F.min(doc).alias("k"))
    member = full.select(by, "h", F.col(doc).alias("of")).join(rep, [by, "h"]).select(by, "k", "of")
    across = pairs.join(member.select(by, F.col("k").alias("a"), F.col("of").alias("x")), [by, "a"]).join(member.select(by, F.col("k").alias("b"), F.col("of").alias("y")), [by, "b"])
    across = across.select(by, F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "shared", "jaccard")
    sized = full.select(by, "h", F.col(doc).alias("of"), F.size("s").cast("long").alias("shared"))
    within = sized.select(by, "h", F.col("of").alias("a"), "shared").join(sized.select(by, "h", F.col("of").alias("b")), [by, "h"]).filter("a < b")
    return across.unionByName(within.select(by, "a", "b", "shared", F.lit(1.0).alias("jaccard")))


def similar_pairs(sets: DataFrame, by: str, doc: str, items: str, least: float, expand: bool = False) -> DataFrame:
    """Pairs of one group whose Jaccard reaches the least (above 0): a, b, sizes, shared items, Jaccard.

    Documents with equal sets are one class: pairs are between the classes'
    smallest documents, and every further document is paired with its class's.
    Exact at any set size: items are ordered from rare to common. A pair that
    reaches the least shares ``need`` items, so the first PROOFS of them (all,
    if it needs fewer) are among the first n - need + PROOFS items of both;
    only pairs with so many matches there are compared as sets. Empty and null
    sets pair with nothing. ``expand`` gives all pairs of all documents instead
    (a, b, shared items, Jaccard), for classes known to be small.
    """
    if not 0 < least <= 1:
        raise ValueError("least must be above 0 and at most 1")
    full, one = _classes(sets, by, doc, items)
    # The lenient 1e-9 keeps rounding from losing a pair; the last filter is exact.
    ranked = _rare_first(one, by).filter(F.col("at") < F.col("n") - F.ceil(F.col("n") * least - 1e-9) + PROOFS)
    a, b = (ranked.select(by, "item", F.col("k").alias(f"k_{x}"), F.col("n").alias(f"n_{x}"), F.col("at").alias(f"at_{x}")) for x in "ab")
    need = F.ceil((F.col("n_a") + F.col("n_b")) * (least / (1 + least)) - 1e-9)
    early = (F.col("at_a") < F.col("n_a") - need + PROOFS) & (F.col("at_b") < F.col("n_b") - need + PROOFS)
    met = a.join(b, [by, "item"]).filter((F.col("k_a") < F.col("k_b")) & (F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * least - 1e-9) & early)
    near = met.groupBy(by, "k_a", "k_b", "n_a", "n_b").agg(F.count("*").alias("proofs")).filter(F.col("proofs") >= F.least(need, F.lit(PROOFS)))
    found = _compared(near, one, by).filter(F.col("jaccard") >= least)
    if expand:
        return _expanded(found.select(by, F.least("k_a", "k_b").alias("a"), F.greatest("k_a", "k_b").alias("b"), "shared", "jaccard"), full, by, doc)
    return _with_copies(found, full, one, by, doc)


def near_pairs(sets: DataFrame, by: str, doc: str, items: str) -> DataFrame:
    """Near-duplicate pairs of one group, by the rule of near_duplicate(): a, b, sizes, shared items, Jaccard.

    Classes of equal sets as in similar_pairs(). Either rule asks that the
    smaller set shares 3/4 of its items, so it must show PROOFS of them among
    its rarest n - need + PROOFS; the larger set is looked up with all its items.
    """
    full, one = _classes(sets, by, doc, items)
    ranked = _rare_first(one.filter(F.col("n") >= SMALL), by)
    share = min(2 * JACCARD / (1 + JACCARD), CONTAINMENT)
    need = F.ceil(F.col("n") * share - 1e-9)
    probe = ranked.filter(F.col("at") < F.col("n") - need + PROOFS).select(by, "item", F.col("k").alias("k_a"), F.col("n").alias("n_a"))
    held = ranked.select(by, "item", F.col("k").alias("k_b"), F.col("n").alias("n_b"))
    larger = (F.col("n_a") < F.col("n_b")) | (F.col("n_a") == F.col("n_b")) & (F.col("k_a") < F.col("k_b"))
    # Too small for its containment to count, a set must be nearly as large as the other.
    fits = larger & ((F.col("n_a") >= LEAST) | (F.col("n_a") >= JACCARD * F.col("n_b") - 1e-9))
    met = probe.join(held, [by, "item"]).filter(fits).groupBy(by, "k_a", "k_b", "n_a", "n_b").agg(F.count("*").alias("proofs"))
    near = met.filter(F.col("proofs") >= F.least(F.ceil(F.col("n_a") * share - 1e-9), F.lit(PROOFS)))
    found = _compared(near, one, by).filter(near_duplicate(F.col("jaccard"), F.col("containment"), F.col("n_a"), F.col("n_b")))
    return _with_copies(found, full, one, by, doc)


def near_duplicate(jaccard: Column, containment: Column, n_a: Column, n_b: Column) -> Column:
    """High Jaccard, or high containment of a set that is large enough; a small set only if the other equals it."""
    smaller = F.least(n_a, n_b)
    return F.when(smaller < SMALL, jaccard == 1.0).otherwise((jaccard >= JACCARD) | ((containment >= CONTAINMENT) & (smaller >= LEAST)))


def leaks(docs: DataFrame, refs: DataFrame, doc: str, ref: str, tokens: str, n: int) -> DataFrame:
    """(doc, ref, shared, share, first): n-grams of a reference that occur in a document, their share of the reference's, the first by place.

    N-grams meet as 64-bit hashes. Those of the references are a table of known
    size: Spark broadcasts it up to its threshold, so that documents' n-grams
    are dropped where they are made; beyond it they are shuffled.
    """
    r = refs.select(ref, ngrams(F.col(tokens), n).alias("g")).select(ref, F.size(F.array_distinct("g")).alias("of"), F.posexplode("g").alias("pos", "gram"))
    r = materialise(r.groupBy(ref, "of", "gram").agg(F.min("pos").alias("pos")).withColumn("h", gram_hash(F.split("gram", " "))))
    d = docs.select(doc, F.explode_outer(F.array_distinct(hashed_ngrams(F.col(tokens), n))).alias("h"))
    return d.join(r, "h").groupBy(doc, ref).agg(F.count("*").alias("shared"), (F.count("*") / F.max("of")).alias("share"), F.min_by("gram", "pos").alias("first"))


def cooccurrence(members: DataFrame, group: str, name: str) -> DataFrame:
    """(a, b, n): names that share groups."""
    m = members.select(group, name).distinct()
    left, right = m.select(group, F.col(name).alias("a")), m.select(group, F.col(name).alias("b"))
    return left.join(right, group).filter("a < b").groupBy("a", "b").agg(F.count("*").alias("n"))
