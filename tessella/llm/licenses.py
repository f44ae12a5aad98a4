"""Licence scan: sparse TF-IDF cosine to templates, and inheritance from the nearest directory.

Units are the lines of a file (headers) and the file as a whole (licence
files). Templates are the notices of licences (``TEMPLATES``), which lines and
whole files are held against, and their full texts (the files of the folder
``licences``), for whole files alone. A unit's vector is (1 + ln tf) x idf, with
idf = ln((1 + N) / (1 + df)) + 1 over all files; terms outside the templates'
vocabulary weigh as terms that no file has, so no vocabulary of the corpus is
ever built. A unit matches the template of highest cosine from ``threshold`` on.

Files without a match of their own inherit the licence of the nearest directory
on their path that holds a licence file with one.

Scale: DataFrame operations only. Document frequencies are partial counts of a
fixed vocabulary, the number of files one of them. A unit can only reach the
threshold if it has one of a notice's heaviest terms (by Cauchy-Schwarz the
lighter ones fall short), or enough different terms of a full text that are not
among its most frequent; only such units are cut into terms and shuffled. Equal texts of an id are one unit. Directories
are resolved once each, not per file; the joins of files to directories are
equi-joins that AQE splits for a hot directory. Tables of templates are
literals.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.runtime import materialise

THRESHOLD = 0.7

HEADER, FILE = "header", "file"

# Licence names with the wording of their notices.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)
LICENCE_FILE = r"(?i)^(licen[cs]e|copying|unlicense)([._-].*)?$"
_TERM = "[a-z0-9]+"


def terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: t != "")


@dataclass(frozen=True)
class Template:
    """A licence's wording: a notice (HEADER), or a full text that only whole files are held against (FILE)."""

    name: str
    kind: str
    text: str


@lru_cache(maxsize=1)
def templates() -> tuple[Template, ...]:
    """The notices, then the full texts by file name."""
    texts = sorted((Path(__file__).parent / "licences").glob("*.txt"))
    return (*(Template(n, HEADER, t) for n, t in TEMPLATES), *(Template(f.stem, FILE, f.read_text("utf-8")) for f in texts))


def _table(df: DataFrame, schema: str, rows: Sequence[Sequence]) -> DataFrame:
    """A small table as one literal."""
    names = [f.strip().split(" ")[0] for f in schema.split(";")]
    entries = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
    return df.sparkSession.range(1).select(F.inline(F.from_json(F.lit(entries), f"array<struct<{schema.replace(';', ',')}>>")))


def _words(found: Sequence[str]) -> Column:
    """A literal array of terms."""
    return F.split(F.lit(" ".join(found)), " ")


#: A text's different terms in SQL, where a long IN list is one hash set and quick to write.
_DISTINCT = "array_distinct(filter(split(lower({text}), '[^a-z0-9]+'), t -> t <> ''))"


def _known(terms_sql: str, found: Sequence[str]) -> str:
    """Those of distinct terms that are among some."""
    return f"filter({terms_sql}, t -> t IN ({', '.join(repr(w) for w in found)}))"


def _anchors(weights: dict[str, float], threshold: float) -> set[str]:
    """Terms of a unit vector without which the others cannot reach the threshold.

    Long terms come first, heaviest first: they tell more texts apart than
    short ones of the same weight.
    """
    left, found = 1.0, set()
    for term in sorted(weights, key=lambda t: (len(t) < 4, -weights[t], t)):
        if left < (threshold - 1e-6) ** 2:
            break
        found.add(term)
        left -= weights[term] ** 2
    return found


def _telling(weights: dict[str, float], idf: dict[str, float], threshold: float) -> tuple[list[str], int]:
    """Terms of a full text, and how many different ones of them a unit needs at least to reach the threshold.

    A unit's cosine is at most the root of the squared weights of the terms it
    shares. The most frequent terms, up to half of what the threshold asks, are
    given to it; the rest must come from the others, at best the heaviest.
    """
    asked, given, telling = (threshold - 1e-6) ** 2, 0.0, []
    for term in sorted(weights, key=lambda t: (idf[t], t)):
        if not telling and given + weights[term] ** 2 <= asked / 2:
            given += weights[term] ** 2
        else:
            telling.append(term)
    for n, w in enumerate(sorted((weights[t] for t in telling), reverse=True), 1):
        given += w * w
        if given >= asked:
            return telling, n
    return telling, len(telling)


def weigh(files: DataFrame, text_col: str, wordings: Sequence[str]) -> tuple[dict[str, float], float, list[dict[str, float]]]:
    """idf by template term, the idf of any other term, and each template's unit vector. The files are read once."""
    counts = [Counter(re.findall(_TERM, t.lower())) for t in wordings]
    vocabulary = sorted(set().union(*counts))
    present = F.coalesce(F.expr(_known(_DISTINCT.format(text=f"CAST({text_col} AS STRING)"), vocabulary)), F.array().cast("array<string>"))
    # The empty term stands for the file itself.
    df = {r["term"]: r["n"] for r in files.select(F.explode(F.concat(present, F.array(F.lit("")))).alias("term")).groupBy("term").agg(F.count("*").alias("n")).collect()}
    n = df.get("", 0)
    idf = {t: math.log((1 + n) / (1 + df.get(t, 0))) + 1 for t in vocabulary}
    vectors = []
    for c in counts:
        raw = {t: (1 + math.log(k)) * idf[t] for t, k in c.items()}
        norm = math.sqrt(sum(w * w for w in raw.values()))
        vectors.append({t: w / norm for t, w in raw.items()})
    return idf, math.log(1 + n) + 1, vectors


def _candidates(base: DataFrame, known: Sequence[Template], idf: dict[str, float], vectors: Sequence[dict[str, float]], threshold: float) -> DataFrame:
    """(_id, _key, _no, _terms): the units that can reach the threshold with some template."""
    anchors = sorted(set().union(*[_anchors(v, threshold) for t, v in zip(known, vectors, strict=True) if t.kind == HEADER]))
    full = [_telling(v, idf, threshold) for t, v in zip(known, vectors, strict=True) if t.kind == FILE and v]
    of_line = of_file = "false"
    if anchors:
        of_line = f"size({_known('ts', anchors)}) > 0"
    if full:
        # First against the words of all full texts, then of each.
        every, least = sorted(set().union(*[v for v, _ in full])), min(n for _, n in full)
        each = " OR ".join(f"size({_known('us', v)}) >= {n}" for v, n in full)
        of_file = f"exists(array({_known('ts', every)}), us -> size(us) >= {least} AND ({each}))"
    # Arrays of one bind a text's terms, so that they are made once and not once a test.
    flags = F.expr(f"transform(array({_DISTINCT.format(text='_text')}), ts -> named_struct('lines', {of_line}, 'file', {of_file}))[0]")
    may = base.filter("_text IS NOT NULL").withColumn("_flags", flags).filter("_flags.lines OR _flags.file").withColumns({"_lines": F.col("_flags.lines"), "_file": F.col("_flags.file")})
    lines = F.when(F.col("_lines"), F.transform(F.split("_text", "\n"), lambda x, i: F.struct((i + 1).alias("no"), x.alias("line")))).otherwise(F.array().cast("array<struct<no:int,line:string>>"))
    units = may.select("_id", F.xxhash64("_text").alias("_key"), "_file", F.explode(F.concat(F.array(F.struct(F.lit(0).alias("no"), F.col("_text").alias("line"))), lines)).alias("u"))
    cut = units.select("_id", "_key", F.col("u.no").alias("_no"), terms(F.col("u.line")).alias("_terms"), "_file")
    able = F.col("_file") & (F.col("_no") == 0) | F.arrays_overlap("_terms", _words(anchors)) if anchors else F.col("_file")
    return cut.filter(able).drop("_file").distinct()


def scan(
    files: DataFrame,
    *,
    id_col: str,
    path_col: str,
    text_col: str,
    known: Sequence[Template] | None = None,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """One row per file row: path, ``license``, ``origin`` (file, header, inherited, none), ``score`` and the ``from_dir`` it is inherited from.

    Edge cases: null and empty texts match nothing but inherit; a null path is
    in no directory; null ids and ids that repeat are files like others, each
    with its own match; equal cosines go to the name that sorts first, the
    whole file before a line; among licence files of one directory the higher
    cosine wins, then the first name; rows that repeat get equal results; texts
    and lines are read whole, whatever their length; no files give no rows.
    Further input columns are ignored.
    """
    known = templates() if known is None else known
    base = files.select(files[id_col].alias("_id"), files[path_col].cast("string").alias("_path"), files[text_col].cast("string").alias("_text"))
    idf, other, vectors = weigh(base, "_text", [t.text for t in known])
    cut = _candidates(base, known, idf, vectors, threshold)
    counted = cut.select("_id", "_key", "_no", F.explode("_terms").alias("term")).groupBy("_id", "_key", "_no", "term").agg(F.count("*").alias("tf"))
    weights = _table(base, "term string; idf double; shares array<double>", [(t, w, [v.get(t, 0.0) for v in vectors]) for t, w in idf.items()])
    # The templates' terms are a fixed table of some 2,000 rows.
    weighed = counted.join(F.broadcast(weights), "term", "left").withColumn("w", (1 + F.log("tf")) * F.coalesce("idf", F.lit(other)))
    sums = weighed.groupBy("_id", "_key", "_no").agg(
        F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"),
        *[F.sum(F.col("w") * F.coalesce(F.get("shares", F.lit(i)), F.lit(0.0))).alias(f"d{i}") for i in range(len(known))],
    )
    matches = [F.struct(F.round(F.col(f"d{i}") / F.col("norm"), 6).alias("score"), F.lit(t.name).alias("name"), F.lit(t.kind).alias("kind")) for i, t in enumerate(known)]
    scored = sums.select("_id", "_key", "_no", F.explode(F.array(*matches)).alias("m")).filter((F.col("m.score") >= threshold) & ((F.col("m.kind") == HEADER) | (F.col("_no") == 0)))
    hits = scored.select("_id", "_key", F.struct((-F.col("m.score")).alias("minus"), F.col("m.name").alias("name"), F.least("_no", F.lit(1)).alias("line")).alias("hit"))
    own = hits.groupBy("_id", "_key").agg(F.min("hit").alias("hit"))
    # Written once: the texts are tested and cut in one pass, and all that follows is narrow.
    own = materialise(own.select(F.col("_id").alias("_of_id"), F.col("_key").alias("_of_key"), F.col("hit.name").alias("_name"), (-F.col("hit.minus")).alias("_score"), (F.col("hit.line") == 0).alias("_whole")))
    placed = base.select("_id", F.xxhash64("_text").alias("_key"), "_path", F.regexp_extract("_path", "^(.*)/[^/]*$", 1).alias("_dir"), F.regexp_extract("_path", "([^/]*)$", 1).alias("_base"))
    matched = materialise(placed.join(own, (F.col("_key") == F.col("_of_key")) & F.col("_id").eqNullSafe(F.col("_of_id")), "left").drop("_key", "_of_id", "_of_key"))
    held = matched.filter(F.col("_name").isNotNull() & F.col("_base").rlike(LICENCE_FILE)).groupBy("_dir").agg(F.min(F.struct((-F.col("_score")).alias("minus"), F.col("_name").alias("name"))).alias("held"))
    held = held.select(F.col("_dir").alias("_from"), F.col("held.name").alias("_held"), (-F.col("held.minus")).alias("_held_score"))
    # Every directory with the directories above it, itself first; "" is the root.
    steps = F.split("_dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(steps) - 1), lambda k: F.struct(k.alias("up"), F.array_join(F.slice(steps, 1, F.size(steps) - k), "/").alias("dir")))
    up = placed.filter("_path IS NOT NULL").select("_dir").distinct().select("_dir", F.explode(above).alias("a")).select("_dir", F.col("a.up").alias("_up"), F.col("a.dir").alias("_from"))
    nearest = up.join(held, "_from").groupBy("_dir").agg(F.min(F.struct("_up", "_from", "_held", "_held_score")).alias("near"))
    nearest = nearest.select(F.col("_dir").alias("_of"), "near._from", "near._held", "near._held_score")
    joined = matched.join(nearest, F.col("_dir") == F.col("_of"), "left")
    mine = F.col("_name").isNotNull()
    inherits = ~mine & F.col("_path").isNotNull() & F.col("_held").isNotNull()
    return joined.select(
        F.col("_id").alias(id_col),
        F.col("_path").alias("path"),
        F.when(mine, F.col("_name")).when(inherits, F.col("_held")).alias("license"),
        F.when(mine & F.col("_whole"), "file").when(mine, "header").when(inherits, "inherited").otherwise("none").alias("origin"),
        F.when(mine, F.col("_score")).when(inherits, F.col("_held_score")).alias("score"),
        F.when(inherits, F.col("_from")).alias("from_dir"),
    )
