"""Distributions over a scale, as map<int,double>, and dense vectors; Column to Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F



def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0).cast("double"), lambda a, v: a + v)


def expected_value(d: Column) -> Column:
    return total(F.transform(F.map_entries(d), lambda e: e["key"] * e["value"]))


def argmax(d: Column) -> Column:
    """The key of the largest mass, the lowest key of equals."""
    entries = F.map_entries(d)
    top = F.array_max(F.map_values(d))
    return F.array_min(F.transform(F.filter(entries, lambda e: e["value"] == top), lambda e: e["key"]))


def entropy(d: Column) -> Column:
    """In nats; -1 for a null distribution."""
    return F.when(d.isNull(), F.lit(-1.0)).otherwise(total(F.transform(F.map_values(d), lambda p: F.when(p > 0, -p * F.log(p)).otherwise(0.0))))


def variance(d: Column) -> Column:
    mean = expected_value(d)
    return F.when(d.isNull(), F.lit(-1.0)).otherwise(total(F.transform(F.map_entries(d), lambda e: e["value"] * (e["key"] - mean) * (e["key"] - mean))))


def total_variation(p: Column, q: Column) -> Column:
    """Half the absolute difference; a key that is missing on one side has no mass there."""
    gap = F.map_zip_with(p, q, lambda k, a, b: F.abs(F.coalesce(a, F.lit(0.0)) - F.coalesce(b, F.lit(0.0))))
    return total(F.map_values(gap)) / 2


def renormalised(d: Column) -> Column:
    mass = total(F.map_values(d))
    return F.transform_values(d, lambda k, v: v / mass)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Of two dense vectors; 0 if either has no length."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, F.lit(0.0)).otherwise(dot(a, b) / norm)


def margin(probs: Column, correct: Column) -> Column:
    """Mass of the correct option less that of its best rival."""
    rivals = F.filter(probs, lambda p, i: i != correct)
    return F.get(probs, correct) - F.array_max(rivals)


def round_half_up(ev: Column, low: int = 1, high: int = 7) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), F.floor(ev + 0.5).cast("int")))


def wilson(k: Column, n: Column, z: float = 1.96) -> Column:
    """Struct of the lower and upper end of Wilson's interval; null where n is 0."""
    p, zz = k / n, z * z
    centre = (p + zz / (2 * n)) / (1 + zz / n)
    half = z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n)) / (1 + zz / n)
    return F.when(n > 0, F.struct((centre - half).alias("low"), (centre + half).alias("high")))


def hypothetical_weights(d: Column, answers: tuple[int, ...] = (1, 3, 5)) -> Column:
    """The masses of some answers, renormalised; equal weights where they have none or the distribution is null."""
    keys = F.array(*map(F.lit, answers))
    mass = F.transform(keys, lambda k: F.coalesce(F.try_element_at(d, k), F.lit(0.0)))
    whole = total(mass)
    even = F.transform(keys, lambda k: F.lit(1.0 / len(answers)))
    return F.map_from_arrays(keys, F.when(whole > 0, F.transform(mass, lambda m: m / whole)).otherwise(even))


def expected_shift(shifts: Column, weights: Column) -> Column:
    """The mean of an answer's shift over the answers' weights; an answer without a shift moves nothing."""
    return total(F.transform(F.map_entries(weights), lambda e: e["value"] * F.coalesce(F.try_element_at(shifts, e["key"]), F.lit(0.0))))
