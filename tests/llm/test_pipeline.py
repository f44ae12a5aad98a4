"""The pipeline over the smallest tables against a plain Python version of its five stages."""

import os
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tessella.llm import langid, simhash
from tessella.llm.packing import tokenizer
from tessella.llm.queries import QUERIES, tokenizer_path
from tessella.runtime import table

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text)


def fingerprint(text):
    w = re.findall("[^\x20\x09-\x0d]+", lower(text))
    parts = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    hashes = np.array([xxhash.xxh64_intdigest(p.encode(), seed=42) for p in parts], np.uint64)
    return sum(1 << b for b in range(64) if len(hashes) and 2 * int((hashes >> np.uint64(b) & np.uint64(1)).sum()) > len(hashes))


def grams(text):
    """3-grams of lower-case letters, with one gap for whatever lies between words and at both ends."""
    words = "".join(c.lower()[0] if c.isalpha() else " " for c in text).split()
    symbols = " " + " ".join(words) + " "
    return Counter(symbols[i : i + 3] for i in range(len(symbols) - 2)) if words else None


def languages(docs):
    """The language of each text with a letter: bound and bundled vectors, one n-gram at a time."""
    letters, bound = {}, {}

    def vector(counts):
        out = np.zeros(langid.DIMENSIONS)
        for g, n in counts.items():
            if g not in bound:
                for c in g:
                    if c not in letters:
                        letters[c] = langid._letters(np.array([ord(c)]), langid.DIMENSIONS)[0].astype(int)
                bound[g] = letters[g[0]] * np.roll(letters[g[1]], 1) * np.roll(letters[g[2]], 2)
            out += n * bound[g]
        return out

    vectors, prototypes = {}, {}
    for i, (text, lang) in docs.items():
        counts = grams(text or "")
        if counts:
            vectors[i] = vector(counts)
            if lang is not None and zlib.crc32(str(i).encode()) % 4 != 2:
                prototypes[lang] = prototypes.get(lang, 0) + vectors[i] / np.sqrt(sum(counts.values()))
    names = sorted(prototypes)
    cosine = {i: [float(v @ prototypes[x] / (np.linalg.norm(v) or 1) / np.linalg.norm(prototypes[x])) for x in names] for i, v in vectors.items()}
    # Two languages within rounding of each other may both be right.
    return {i: {x for x, c in zip(names, cs, strict=True) if c > max(cs) - 1e-5} for i, cs in cosine.items()}


def near_dedup(docs):
    ids = sorted(docs)
    prints = {i: fingerprint(docs[i]) for i in ids}
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, i in enumerate(ids):
        for j in ids[:n]:
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: docs[i] for i in ids if find(i) == i}


def substring_dedup(docs, window=35):
    words = {i: re.findall("[^\x20\x09-\x0d]+", t) for i, t in docs.items()}
    counts = Counter(tuple(w[p : p + window]) for w in words.values() for p in range(len(w) - window + 1))
    out = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if counts[tuple(w[p : p + window])] > 1:
                gone[p : p + window] = [True] * window
        if not any(gone):
            out[i] = docs[i]
        elif not all(gone):
            out[i] = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
    return out


def decontaminate(docs, items):
    cut = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(t or ""))
    windows = {tuple(w[p : p + min(13, len(w))]) for w in map(cut, items) if w for p in range(max(1, len(w) - 12))}
    out = {}
    for i, t in docs.items():
        w = cut(t)
        hit = [False] * len(w)
        for n in {len(x) for x in windows}:
            for p in range(len(w) - n + 1):
                if tuple(w[p : p + n]) in windows:
                    hit[p : p + n] = [True] * n
        if not (any(hit) and 20 * sum(hit) >= len(w)):
            out[i] = t
    return out


def test_pipeline_matches_plain_python(spark):
    every = {r["doc_id"]: (r["text"], r["lang"]) for r in table(spark, SF, "documents").collect()}
    spoken = languages(every)
    docs = {i: every[i][0] for i in spoken}
    items = [r["text"] for r in table(spark, SF, "benchmark").collect()]
    left = decontaminate(substring_dedup(near_dedup(docs)), items)
    assert 0 < len(left) < len(docs)
    got: dict = {}
    rows = corpus_pipeline.run(spark, SF).collect()
    for r in rows:
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and r["length"] == len(r["ids"])
        assert r["lang"] in spoken[r["doc_id"]]
        got.setdefault(r["doc_id"], {})[r["start"]] = r["ids"]
    library = tokenizer(tokenizer_path()).library
    expected = {i: [*library.encode(t, add_special_tokens=False).ids, 2] for i, t in left.items()}
    assert {i: [x for s in sorted(p) for x in p[s]] for i, p in got.items()} == expected
    assert len({r["sequence_id"] for r in rows}) == len(rows)


def test_language_stage_decides(spark):
    """Each kept document has the predicted language, whatever it had; without languages to learn from those with a letter stay."""
    given = table(spark, SF, "documents")
    spoken = languages({r["doc_id"]: (r["text"], r["lang"]) for r in given.collect()})
    kept = corpus_pipeline.language_id(spark, given, SF).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(spoken) and all(r["lang"] in spoken[r["doc_id"]] for r in kept)
    assert sum(r["lang"] is not None for r in kept) > sum(1 for r in given.collect() if r["lang"] is not None) * 0.9
    none = corpus_pipeline.language_id(spark, given.withColumn("lang", F.lit(None).cast("string")), SF).collect()
    assert sorted(r["doc_id"] for r in none) == sorted(spoken)


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_stages_take_odd_rows(spark, name, stage):
    schema = "doc_id long, text string, lang string, source string, n_chars long, fp long, _text string, keeper string"
    odd = [(1, None, None, None, None, 1, "x", "y"), (2, "", "en", "s", 0, 1, "x", "y"), (3, "a", None, None, 1, 1, "x", "y"), (None, "word " * 50, "en", None, 250, 1, "x", "y"), (5, "word " * 50, "en", "s", 250, 1, "x", "y"), (5, "word " * 50, "en", "s", 250, 1, "x", "y"), (6, "b" * 100_000 + " c", "en", "s", 100_002, 1, "x", "y"), (7, "very long text of words " * 100_000, "en", "s", 2_400_000, 1, "x", "y")]
    df = spark.createDataFrame(odd, schema)
    out = stage(spark, df, SF)
    assert out.count() > 0
    assert stage(spark, df.limit(0), SF).count() == 0
    if name != "packing":
        assert out.columns == list(corpus_pipeline.COLUMNS)


def test_every_operator_is_registered_once():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 11))


def test_near_dedup_never_broadcasts_its_lookups(spark, monkeypatch):
    """Stage 2 at Spark's own broadcast threshold: the look-ups meet their buckets in a sort-merge join."""
    plans, write = [], simhash.materialise

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df)

    monkeypatch.setattr(simhash, "materialise", seen)
    kept = corpus_pipeline.near_dedup(spark, table(spark, SF, "documents"), SF)
    joins = [re.findall(r"(\w+Join) .*\bInner\b", p) for p in plans]
    assert sum(joins, []) and set(sum(joins, [])) == {"SortMergeJoin"}
    assert 0 < kept.count() < table(spark, SF, "documents").count()


def test_near_dedup_never_broadcasts_its_fingerprints(spark):
    """Stage 2 at Spark's own broadcast threshold, as it ran: a table with a row for each fingerprint meets the links and the documents in sort-merge joins."""
    kept = corpus_pipeline.near_dedup(spark, table(spark, SF, "documents"), SF)
    assert kept.collect()
    plan = kept._jdf.queryExecution().executedPlan().toString().partition("== Initial Plan ==")[0]
    joins = re.findall(r"(\w+Join)[^\[]*\[([^\]]*)\]", plan)
    assert {kind for kind, keys in joins if re.search(r"\b_?fp#", keys)} == {"SortMergeJoin"}
