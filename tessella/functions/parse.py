"""Parsers of semi-structured completions; null where a text doesn't parse."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.dist import total


def strict_digit(x: Column, low: int = 1, high: int = 7) -> Column:
    """The only digit of the text, if it lies on the scale."""
    digits = F.regexp_extract_all(x, F.lit(r"\d"), F.lit(0))
    value = F.get(digits, F.lit(0)).cast("int")
    return F.when((F.size(digits) == 1) & value.between(low, high), value)


def last_digit(x: Column, low: int = 1, high: int = 7) -> Column:
    """The last digit of the scale that stands alone."""
    found = F.regexp_extract_all(x, F.lit(rf"(?<!\d)([{low}-{high}])(?!\d)"), F.lit(1))
    return F.try_element_at(found, F.lit(-1)).cast("int")


def scale_distribution(x: Column, low: int = 1, high: int = 7) -> Column:
    """map<int,double> of 'key:mass' pairs: every key once, no negative mass, some mass; renormalised."""
    pattern = F.lit(r"(?<![\d.])(\d+)\s*:\s*(-?\d*\.?\d+)")
    keys = F.transform(F.regexp_extract_all(x, pattern, F.lit(1)), lambda k: F.try_to_number(k, F.lit("999999")).cast("int"))
    mass = F.transform(F.regexp_extract_all(x, pattern, F.lit(2)), lambda m: m.cast("double"))
    whole = total(mass)
    good = (F.array_sort(keys) == F.array(*[F.lit(k) for k in range(low, high + 1)])) & ~F.exists(mass, lambda m: m < 0) & (whole > 0)
    return F.when(good, F.map_from_arrays(keys, F.transform(mass, lambda m: m / whole)))


def option_distribution(x: Column, options: int = 4, least: float = 0.8, most: float = 1.2) -> Column:
    """array<double> of masses by option letter: every label once, all in percent or none, mass within bounds; renormalised."""
    letters = [chr(65 + i) for i in range(options)]
    pattern = F.lit(rf"\b([A-{letters[-1]}])\s*[:=]\s*(\d*\.?\d+)\s*(%?)")
    labels = F.regexp_extract_all(x, pattern, F.lit(1))
    raw = F.transform(F.regexp_extract_all(x, pattern, F.lit(2)), lambda m: m.cast("double"))
    marks = F.array_distinct(F.regexp_extract_all(x, pattern, F.lit(3)))
    mass = F.when(F.get(marks, F.lit(0)) == "%", F.transform(raw, lambda m: m / 100)).otherwise(raw)
    whole = total(mass)
    good = (F.array_sort(labels) == F.array(*map(F.lit, letters))) & (F.size(marks) == 1) & whole.between(least, most)
    ordered = F.array(*[F.get(mass, (F.array_position(labels, c) - 1).cast("int")) for c in letters])
    return F.when(good, F.transform(ordered, lambda m: m / whole))


def label_line(x: Column, labels: list[str]) -> Column:
    """The only line that is one of the labels, whatever its case."""
    lines = F.filter(F.transform(F.split(x, "\n"), lambda s: F.upper(F.trim(s))), lambda s: s.isin(labels))
    return F.when(F.size(lines) == 1, F.get(lines, F.lit(0)))


def numbered_blocks(x: Column) -> Column:
    """array of (k, text) for blocks after '<<<k>>>', the first block of each k."""
    parts = F.slice(F.split(x, r"(?=<<<\d+>>>)"), 1, 1 << 20)
    blocks = F.transform(
        F.filter(parts, lambda p: p.rlike(r"^<<<\d+>>>")), lambda p: F.struct(F.regexp_extract(p, r"^<<<(\d+)>>>", 1).cast("int").alias("k"), F.trim(F.regexp_replace(p, r"(?s)^<<<\d+>>>\s*|\s+$", "")).alias("text"))
    )
    return F.filter(blocks, lambda b, i: ~F.exists(F.slice(blocks, F.lit(1), i), lambda o: o["k"] == b["k"]))


def elapsed_seconds(x: Column) -> Column:
    """Seconds of '[days-]hours:minutes:seconds'."""
    part = lambda k: F.coalesce(F.regexp_extract(x, r"^(?:(\d+)-)?(\d+):(\d+):(\d+)$", k).try_cast("long"), F.lit(0))
    return F.when(x.rlike(r"^(?:\d+-)?\d+:\d+:\d+$"), part(1) * 86400 + part(2) * 3600 + part(3) * 60 + part(4))


def failure_kind(x: Column) -> Column:
    """Why a completion gave no answer."""
    return F.when(F.coalesce(F.trim(x), F.lit("")) == "", "empty").when(~x.rlike(r"\d"), "no_digit").when(~F.rtrim(x).rlike(r"[\d.!?)%]$"), "truncated").otherwise("format")


PARSERS = {"v0": strict_digit, "v1": last_digit}


def widened_options(x: Column, options: int = 4) -> Column:
    """The whole text's distribution, else that of the last stretch, from a first label on, that parses."""
    parts = F.split(x, r"(?=\bA\s*[:=]\s*\d*\.?\d+)")
    stretches = F.transform(parts, lambda _, i: F.array_join(F.slice(parts, i + 1, 1 << 20), ""))
    parsed = F.filter(F.transform(stretches, lambda s: option_distribution(s, options)), lambda d: d.isNotNull())
    return F.coalesce(option_distribution(x, options), F.try_element_at(parsed, F.lit(-1)))


def many_distributions(x: Column, codes: list[str], low: int = 1, high: int = 7) -> Column:
    """map<code, map<int,double>> of lines 'CODE: key:mass ...' in any order: every code once and well-formed, or null.

    Bullets, numbering and emphasis in front are passed over, as are lines
    without any pair.
    """
    names = "|".join(sorted((c.upper() for c in codes), key=lambda c: (-len(c), c)))
    bare = F.transform(F.split(x, r"\R"), lambda s: F.regexp_replace(F.regexp_replace(s, r"[*`_]", ""), r"^[\s\-–—•+>#]*(?:\d+[.)]\s*)?", ""))
    heads = F.filter(bare, lambda s: F.upper(s).rlike(rf"^(?:{names})(?!\d)") & F.regexp_replace(F.upper(s), rf"^(?:{names})(?!\d)\W*", "").rlike(r"\d+\s*:\s*-?\d*\.?\d+"))
    found = F.transform(heads, lambda s: F.regexp_extract(F.upper(s), rf"^({names})(?!\d)", 1))
    masses = F.transform(heads, lambda s: scale_distribution(F.regexp_replace(F.upper(s), rf"^(?:{names})(?!\d)[\s:\-–—=)|.]*", ""), low, high))
    good = (F.array_sort(found) == F.array(*[F.lit(c) for c in sorted(c.upper() for c in codes)])) & ~F.exists(masses, lambda d: d.isNull())
    return F.when(good, F.map_from_arrays(found, masses))
