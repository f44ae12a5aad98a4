"""Each operator against a brute-force version, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessella.llm import langid, licenses, simhash, toxicity
from tessella.llm.common import held_out
from tessella.llm.decontam import Automaton, decontaminate, words_of
from tessella.llm.html_extract import extract, parse, score
from tessella.llm.packing import pack, pieces_of, tokenizer
from tessella.llm.queries import tokenizer_path
from tessella.llm.sharding import difference, shard
from tessella.llm.simhash import fingerprint, links, near_duplicates
from tessella.llm.substrings import dedup_substrings
from tessella.llm.topk import BallTree, top_k

random.seed(5)
WORDS = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "Éta", "theta", "x1", "ß"]
PASSAGE = " ".join(f"p{i}" for i in range(60))


def prose(n, vocabulary=None):
    return " ".join(random.choice(vocabulary or [f"{a}{i}" for a in WORDS for i in range(40)]) for _ in range(n))


def texts():
    one, two = prose(120), prose(200)
    rows = [one, one, one + " tail", two.replace("alpha", "Alpha"), None, "", "  \n\t ", "one", "two words", PASSAGE + " " + prose(40), prose(30) + "\n" + PASSAGE, prose(9000), "the cat sat on the mat " * 30, "🙂 ünï cödé 日本語 テキスト", "A" * 5000]
    return rows + [prose(random.randint(1, 80)) for _ in range(15)]


@pytest.fixture(scope="module")
def docs(spark):
    """Extra columns have the names that operators use inside or return."""
    schema = "doc_id long, text string, _text string, fp string, n_words string, score string, _block int"
    rows = [(i, t, "x", "y", "z", "s", 1) for i, t in enumerate(texts())]
    return spark.createDataFrame([*rows, rows[3], (None, "null id here", "x", "y", "z", "s", 2)], schema).repartition(3).cache()


def rows_of(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def no_docs(docs):
    return docs.filter("1 = 0")


def test_automaton_finds_longest_suffixes():
    items = [("a", words_of(b"a b c a b d")), ("b", words_of(b"b c a b")), ("c", words_of(b"c"))]
    automaton = Automaton(items, window=3)
    runs = {tuple(w[i:j]) for _, w in items for i in range(len(w)) for j in range(i + 1, len(w) + 1)}
    stream = words_of(b"a b c a b c a b d d a b")
    state = matched = 0
    for i, w in enumerate(stream):
        state, matched = automaton.step(state, matched, automaton.vocabulary[w])
        longest = max((n for n in range(1, i + 2) if tuple(stream[i + 1 - n : i + 1]) in runs), default=0)
        assert matched == longest


def brute_hits(text, items, window):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    hit, names = [False] * len(words), set()
    for name, item in items:
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m.group().lower(), item or ""))
        n = min(window, len(w))
        for p in range(len(w) - n + 1 if w else 0):
            for q in range(len(words) - n + 1):
                if words[q : q + n] == w[p : p + n]:
                    hit[q : q + n] = [True] * n
                    if name is not None:
                        names.add(str(name))
    return len(words), sum(hit), sorted(names)


@pytest.mark.parametrize("block_words", [200_000, 20])
def test_decontaminate_matches_brute_force(spark, docs, block_words):
    items = [(1, PASSAGE), (2, "Two, WORDS!"), (3, PASSAGE[:80]), (None, "null id here"), (5, None), (6, ""), (1, PASSAGE), (7, "日本語")]
    found = decontaminate(docs, spark.createDataFrame(items, "item_id long, text string"), block_words=block_words)
    assert found.columns[0] == "doc_id"
    given = {(r["doc_id"], r["text"]) for r in rows_of(docs)}
    expected = {i: brute_hits(t, items, 13) for i, t in given}
    got = rows_of(found)
    assert len(got) == docs.count()
    for r in got:
        n, hit, names = expected[r["doc_id"]]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["item_ids"]) == (n, hit, len(names), names)
        assert r["contaminated"] == (hit > 0 and 20 * hit >= n)
        if r["contaminated"]:
            assert len(words_of(r["clean_text"].encode())) == n - hit


def test_decontaminate_empty_tables(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r["n_hit"] for r in rows_of(decontaminate(docs, none))} == {0}
    assert decontaminate(no_docs(docs), none).count() == 0


def brute_windows(given, window):
    split = [(i, re.findall("[^\x20\x09-\x0d]+", t or "")) for i, t in given]
    counts = Counter(tuple(w[p : p + window]) for _, w in split for p in range(len(w) - window + 1))
    out = []
    for i, w in split:
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if counts[tuple(w[p : p + window])] > 1:
                gone[p : p + window] = [True] * window
        out.append((str(i), len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return sorted(out)


@pytest.mark.parametrize(("window", "sizes"), [(35, {}), (5, {}), (5, {"BLOCK_BYTES": 1500, "BUCKET_BYTES": 700, "MOST_PARTS": 7, "LEAST_BLOCKS": 2})])
def test_substrings_match_brute_force(docs, window, sizes, monkeypatch):
    """Also with more buckets than a block sends to, so that hashes go on from ranges to buckets."""
    for name, value in sizes.items():
        monkeypatch.setattr(f"tessella.llm.substrings.{name}", value)
    given = [(r["doc_id"], r["text"]) for r in rows_of(docs)]
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_text"]) for r in rows_of(dedup_substrings(docs, window=window)))
    assert got == brute_windows(given, window)


def test_substrings_deal_equal_rows_apart(spark):
    """Rows that agree in everything, ids too, are dealt to many blocks, and each loses its words."""
    text = prose(50)
    df = spark.createDataFrame([(None, text)] * 300 + [(1, prose(50))], "doc_id long, text string").repartition(4)
    found = dedup_substrings(df)
    got = Counter((r["doc_id"], r["n_removed"]) for r in found.collect())
    assert got == {(None, 50): 300, (1, 0): 1}
    assert found._jdf.queryExecution().executedPlan().toString().count("ReusedExchange") == 1 or "ReusedExchange" in found._jdf.queryExecution().toString()


def test_substrings_keep_layout_and_empty(docs):
    for r in rows_of(dedup_substrings(docs, rejoin=False, carry=["text"]).filter("n_removed = 0")):
        assert r["kept_text"] == (r["text"] or "")
    assert dedup_substrings(no_docs(docs)).count() == 0


def brute_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(p.encode(), seed=42) for p in parts]
    return sum(1 << b for b in range(64) if hashes and 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_match_brute_force():
    for t in texts():
        assert fingerprint(t.encode() if t is not None else None) == brute_fingerprint(t)


def test_near_duplicates_match_brute_force(spark, docs):
    base = prose(400).split()
    more = [(1000 + i, " ".join(w if k != 7 * i else "changed" for k, w in enumerate(base)), *["x"] * 4, 0) for i in range(40)]
    every = docs.unionByName(spark.createDataFrame(more, docs.schema))
    given = [(r["doc_id"], brute_fingerprint(r["text"])) for r in rows_of(every)]
    parent = list(range(len(given)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(given)):
        for j in range(i):
            if (given[i][1] ^ given[j][1]).bit_count() <= 2:
                parent[find(i)] = find(j)
    groups = {}
    for i, (doc, _) in enumerate(given):
        groups.setdefault(find(i), []).append(doc)
    expected = sorted((str(doc), str(min((d for d in groups[find(i)] if d is not None), default=None))) for i, (doc, _) in enumerate(given))
    got = rows_of(near_duplicates(every))
    assert sorted((str(r["doc_id"]), str(r["component_id"])) for r in got) == expected
    assert sum(r["keeper"] for r in got) == len(groups)
    assert near_duplicates(no_docs(docs)).count() == 0


def brute_links(fps, distance):
    return {(a, b) for a in fps for b in fps if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= distance}


@pytest.mark.parametrize(("hot", "distance"), [(32, 2), (3, 2), (1, 2), (2, 1), (2, 0)])
def test_links_with_hot_segments_match_brute_force(spark, hot, distance):
    """Segments that many share are split by further segments; no pair is lost and no bucket is left out."""
    pick = random.Random(hot)
    fps = {pick.getrandbits(64) for _ in range(200)}
    centre = pick.getrandbits(64)
    # A cloud around one value: most share its low half, many its low 48 bits.
    fps |= {centre ^ sum(1 << b for b in pick.sample(range(64), pick.randint(0, 3))) for _ in range(300)}
    fps |= {centre ^ (pick.getrandbits(5) << 32) for _ in range(40)} | {centre ^ (pick.getrandbits(4) << 60) for _ in range(40)} | {0, 1, 3, (1 << 64) - 1, 1 << 63}
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    got = links(spark.createDataFrame([(x,) for x in signed], "fp long").repartition(3), distance, hot)
    assert {(r["a"], r["b"]) for r in got.collect()} == brute_links(signed, distance)


def test_lookups_are_never_broadcast(spark, monkeypatch):
    """About 36 rows a fingerprint, which Spark takes for as small as the file they come from: a broadcast of them fills the driver."""
    plans, write = [], simhash.materialise

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df)

    monkeypatch.setattr(simhash, "materialise", seen)
    fps = [(random.Random(i).getrandbits(63),) for i in range(300)] + [(i,) for i in range(300)]
    links(spark.createDataFrame(fps, "fp long"), hot=4).count()
    joins = [re.findall(r"(\w+Join) .*\bInner\b", p) for p in plans]
    assert sum(joins, []) == ["SortMergeJoin"] * 3


def test_tokens_agree_with_the_library():
    model = tokenizer(tokenizer_path())
    plain = [chr(i) for i in range(0x250)] + list("‐–—‘’“”… \t\n")
    odd = ["".join(random.choices(plain + list("aeiounrst  ''.,") * 30, k=random.randint(1, 80))) for _ in range(500)]
    cases = [t for t in texts() if t] + odd + ["it's WE'LL 's't <|endoftext|> x", "½ ² İstanbul ΑΣ Σ", "a" * 300]
    for t, ids in zip(cases, model.encode([t.encode() for t in cases]), strict=True):
        assert ids.tolist() == model.library.encode(t, add_special_tokens=False).ids


def test_pieces():
    assert pieces_of(1, 8) == [(0, 1)]
    assert pieces_of(21, 8) == [(0, 8), (8, 8), (16, 4), (20, 1)]


def test_packing_round_trip(docs):
    model = tokenizer(tokenizer_path())
    got = rows_of(pack(docs, tokenizer_path(), most=64, carry=["text"]))
    assert len({r["sequence_id"] for r in got}) == len(got)
    by_text = {}
    for r in got:
        assert r["length"] == len(r["ids"]) and r["length"] & (r["length"] - 1) == 0 and r["length"] <= 64 and r["sequence_offset"] == 0
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        assert r["length"] == 1 << r["bucket"]
        by_text.setdefault((r["doc_id"], r["text"]), {}).setdefault(r["start"], []).append(r)
    batches = {}
    for r in got:
        batches.setdefault(r["batch_id"], []).append(r)
    unfilled = 0
    for members in batches.values():
        assert len({r["bucket"] for r in members}) == 1 and sorted(r["batch_row"] for r in members) == list(range(len(members)))
        tokens = sum(r["length"] for r in members)
        assert tokens <= 64
        unfilled += tokens < 64
    assert unfilled <= 7 * docs.rdd.getNumPartitions(), "a partition leaves at most one batch of a bucket unfilled"
    assert len(by_text) == docs.select("doc_id", "text").distinct().count()
    for (_, text), pieces in by_text.items():
        ids = [x for start in sorted(pieces) for x in pieces[start][0]["ids"]]
        assert ids == [*model.library.encode(text or "", add_special_tokens=False).ids, 2]
        assert {r["doc_tokens"] for p in pieces.values() for r in p} == {len(ids)}
    assert pack(no_docs(docs), tokenizer_path()).count() == 0


def test_language_vectors_match_brute_force(spark):
    letters = langid._letters(np.arange(200, dtype=np.uint64), 256)
    assert set(np.unique(letters)) == {-1, 1} and abs(letters.mean()) < 0.05
    text = "Abc, déf 12 ab"
    keys, table, has = langid.counts([text.encode(), b"", b"12 !"], 3)
    assert has.tolist() == [True, False, False]
    symbols = " abc déf ab "
    expected = Counter(symbols[i : i + 3] for i in range(len(symbols) - 2))
    assert table[0].sum() == sum(expected.values()) and len(expected) == (table[0] > 0).sum()
    one = langid.Grams(3, 256)
    whole = one.bundled(table, keys)[0]
    brute = sum(n * np.roll(langid._letters(np.array([ord(g[0])]), 256)[0], 0) * np.roll(langid._letters(np.array([ord(g[1])]), 256)[0], 1) * np.roll(langid._letters(np.array([ord(g[2])]), 256)[0], 2) for g, n in expected.items())
    assert np.allclose(whole, brute)


@pytest.mark.parametrize("size", [1, 2, 3, 7, 50, 10_000])
def test_long_texts_count_like_short_ones(size):
    pick = random.Random(size)
    cases = ["", " ", "a", "ab", " a", "a ", "..a..", "1 2 3", "a 1 b", "Éa  ß--x", "日本 語", "a" * 9, "x y  z", "  12 ab\t\tcd  "] + ["".join(pick.choices("abÉß語 .1\n🙂", k=pick.randint(1, 60))) for _ in range(150)]
    for t in cases:
        keys, table, has = langid.counts([t.encode()], 3)
        got = Counter()
        for each, times in langid.long_counts(t.encode(), 3, size):
            got.update(dict(zip(each.tolist(), times[0].tolist(), strict=True)))
        if has[0]:
            assert got == Counter(dict(zip(keys.tolist(), table[0].tolist(), strict=True))), repr(t)
        assert langid._has_letter(t.encode(), size) == has[0]


def test_language_id_of_very_long_texts(spark, monkeypatch):
    """Learnt and predicted in pieces or at once, vectors and results agree."""
    rows = [(i, " ".join(random.choices(words.split(), k=4000)), lang) for i, (lang, words) in enumerate([("xx", "abra cadabra abacus é"), ("yy", "tolo molo polo voto ü")] * 4)]
    rows += [(100, "1 " * 300_000, None), (101, "1 " * 300_000 + "abra", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    once = langid.learn(d, F.lit(True))
    whole = rows_of(langid.identify(d, once).orderBy("doc_id"))
    monkeypatch.setattr(langid, "_PIECE", 1000)
    pieces = langid.learn(d, F.lit(True))
    assert all(np.allclose(once[x], pieces[x], rtol=1e-4, atol=1e-2) for x in ("xx", "yy"))
    cut = rows_of(langid.identify(d, once).orderBy("doc_id"))
    assert [r["lang_pred"] for r in whole] == [r["lang_pred"] for r in cut] and np.allclose([r["score"] for r in whole], [r["score"] for r in cut], atol=1e-5)
    assert whole[-2]["lang_pred"] == "und" and whole[-1]["lang_pred"] == "xx"


def test_language_id(spark, docs):
    sample = {"xx": "abra cadabra abacus", "yy": "tolo molo polo voto", "zz": "shkr vrtk pltz"}
    rows = [(i, " ".join(random.choices(sample[lang].split(), k=8)), lang) for i, lang in enumerate(list(sample) * 40)]
    d = spark.createDataFrame([*rows, (500, None, "xx"), (501, "12 ...", None), (502, "abra", None)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in rows_of(langid.identify(d, langid.learn(d, ~held_out(d.doc_id))))}
    assert all(got[i]["lang_pred"] == lang for i, _, lang in rows)
    assert got[500]["lang_pred"] == got[501]["lang_pred"] == "und" and got[502]["lang_pred"] == "xx"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert {r["lang_pred"] for r in rows_of(langid.identify(docs, {}))} == {"und"}
    assert langid.learn(d.limit(0), F.lit(True)) == {} and langid.identify(no_docs(docs), {}).count() == 0


def test_toxicity_learns_from_labels(spark):
    vocabulary = [f"w{a}" for a in "abcdefghij"] + ["clean", "plain"]
    rows = []
    for i in range(400):
        bad = i % 5 == 0
        words = random.choices(vocabulary, k=40) + random.choices(["villain", "villainous", "rotter"], k=6) * bad
        rows.append((i, " ".join(random.sample(words, len(words))), int(bad)))
    d = spark.createDataFrame([*rows, (900, None, None), (901, "", 0)], "doc_id long, text string, toxic int")
    model = toxicity.learn(d.select("doc_id", "text"), d.select("doc_id", "toxic"), ~held_out(F.col("doc_id")))
    got = {r["doc_id"]: r for r in rows_of(toxicity.classify(d.select("doc_id", "text"), model))}
    assert all(got[i]["predicted"] == bad for i, _, bad in rows)
    assert got[900]["predicted"] == got[901]["predicted"] == 0 and all(0 <= r["score"] <= 1 for r in got.values())
    assert toxicity.learn(d, d.filter("toxic = 0").select("doc_id", "toxic"), F.lit(True)) is None
    assert {r["score"] for r in rows_of(toxicity.classify(d, None))} == {0.0}


def test_toxicity_takes_odd_rows(spark):
    rows = [(i, ("rotten vermin " if i % 4 == 0 else "") + prose(30), "x", 1.0, "y") for i in range(200)]
    odd = [(300, "plain " * 400_000 + "rotten vermin", "x", 1.0, "y"), (None, "rotten vermin", "x", 1.0, "y"), (0, "rotten", "x", 1.0, "y"), (4, rows[4][1], "x", 1.0, "y"), (4, rows[4][1], "x", 1.0, "y")]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, _text string, score double, _label string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)] + [(4, 0), (None, 1), (999, 1), (7, None)], "doc_id long, toxic int").withColumn("text", F.lit("clash"))
    model = toxicity.learn(df, labels, F.lit(True), most_rows=150)
    got = rows_of(toxicity.classify(df, model, carry=["_text"]))
    assert len(got) == 205 and {r["_text"] for r in got} == {"x"}
    assert all(r["predicted"] == int(r["doc_id"] % 4 == 0) for r in got if r["doc_id"] is not None and r["doc_id"] < 200)
    same = [(r["score"], r["predicted"]) for r in got if r["doc_id"] == 4]
    assert len(same) == 3 and len(set(same)) == 1
    assert next(r for r in got if r["doc_id"] is None)["predicted"] == 1
    assert toxicity.learn(df.limit(0), labels, F.lit(True)) is None and toxicity.learn(df, labels.limit(0), F.lit(True)) is None
    assert toxicity.classify(df.limit(0), model).count() == 0


def test_one_voter_a_root():
    assert toxicity.separate([(b"vill*", 9), (b"villain", 9), (b"villa*", 9), (b"rotter", 5), (b"rott*", 5), (b"rotte*", 7), (b"cur", 4)], 9) == [b"vill*", b"rotter", b"rotte*", b"cur"]
    assert toxicity.separate([(b"a", 3), (b"b", 3)], 1) == [b"a"]


def test_label_model_discounts_correlated_voters():
    rng = np.random.default_rng(3)
    y = rng.random(4000) < 0.3
    good = (rng.random(4000) < np.where(y, 0.9, 0.05)).astype(float)
    free = (rng.random(4000) < np.where(y, 0.8, 0.1)).astype(float)
    hits = np.column_stack((good, good, good, free, 1 - np.maximum(good, free)))
    post, toxic_rate, clean_rate, share = toxicity.label_model(hits, 0.3)
    assert ((post > 0.5) == y).mean() > 0.85 and toxic_rate[3] > clean_rate[3]
    assert share[0] < 0.5 < share[3]


def test_licence_scan(spark):
    notice = dict(licenses.TEMPLATES)
    clash = [(30, None, notice["Apache-2.0"]), (30, None, "the quick brown fox " * 9), (None, None, notice["ISC"]), (None, None, "x"), (31, None, "plain words " * 200_000 + "\n" + notice["BSD-3-Clause"])]
    files = [
        (1, "/a/LICENSE", "Released under the MIT License."),
        (2, "/a/b/c/x.py", "code\n more code"),
        (3, "/a/b/y.py", "import x\n# Licensed under the Apache License, Version 2.0.\ncode"),
        (4, "/z/q.py", None),
        (5, None, "nothing"),
        (6, "/a/b/d/COPYING.txt", notice["GPL-3.0"]),
        (7, "/a/b/d/e/w.py", ""),
        (8, "LICENSE", "no licence at all"),
        (2, "/a/b/c/x.py", "code\n more code"),
    ]
    df = spark.createDataFrame(files, "doc_id long, path string, text string").withColumn("license", F.lit("clash"))
    got = {r["doc_id"]: (r["license"], r["origin"], r["from_dir"]) for r in rows_of(licenses.scan(df, id_col="doc_id", path_col="path", text_col="text"))}
    assert got == {1: ("MIT", "file", None), 2: ("MIT", "inherited", "/a"), 3: ("Apache-2.0", "header", None), 4: (None, "none", None), 5: (None, "none", None), 6: ("GPL-3.0", "file", None), 7: ("GPL-3.0", "inherited", "/a/b/d"), 8: (None, "none", None)}
    assert licenses.scan(df.limit(0), id_col="doc_id", path_col="path", text_col="text").count() == 0
    found = rows_of(licenses.scan(spark.createDataFrame(clash, df.drop("license").schema), id_col="doc_id", path_col="path", text_col="text"))
    assert Counter((r["doc_id"], r["license"], r["origin"]) for r in found) == Counter([(30, "Apache-2.0", "file"), (30, None, "none"), (None, "ISC", "file"), (None, None, "none"), (31, "BSD-3-Clause", "header")]), "files of one id have their own matches"


def test_licence_texts_are_found_as_files(spark):
    """Full texts, with own names, other layout and something around them; and prose that isn't one."""
    full = {t.name: t.text for t in licenses.templates() if t.kind == licenses.FILE}
    files = [(i, f"/{name}/LICENSE", f"Project {name}\nCopyright 2020 Jo Doe and others\n" + re.sub(r"\s+", " ", text) + "\nThanks to all.") for i, (name, text) in enumerate(full.items())]
    files += [(100, "/own/x.txt", "the work that such a person may copy or use in any form " * 30), (101, "/MIT/sub/a.py", "pass")]
    found = {r["path"]: (r["license"], r["origin"]) for r in rows_of(licenses.scan(spark.createDataFrame(files, "doc_id long, path string, text string"), id_col="doc_id", path_col="path", text_col="text"))}
    assert {p: o for p, o in found.items() if p.endswith("LICENSE")} == {f"/{name}/LICENSE": (name, "file") for name in full}
    assert found["/own/x.txt"] == (None, "none") and found["/MIT/sub/a.py"] == ("MIT", "inherited")


def test_ball_tree_skips_and_is_exact():
    rng = np.random.default_rng(1)
    vectors = np.concatenate([rng.integers(-40, 40, (10, 3)).repeat(200, axis=0) * 5 + rng.integers(-3, 3, (2000, 3)), np.zeros((500, 3), int)])
    ids = rng.permutation(2500)
    tree = BallTree(np.arange(2500), ids, vectors.astype(float))
    asked = np.arange(0, 1500, 50)
    scores, found, scored = tree.search(asked, vectors[asked].astype(float), np.full(30, -np.inf), 5)
    for q, s, i in zip(asked, scores, found, strict=True):
        order = sorted((-int(x), int(n)) for r, (x, n) in enumerate(zip(vectors @ vectors[q], ids, strict=True)) if r != q)[:5]
        assert [(-int(a), int(b)) for a, b in zip(s, i, strict=True)] == order
    assert scored < 30 * 1250
    alike = BallTree(np.arange(1000), np.arange(1000), np.ones((1000, 3)))
    _, found, scored = alike.search(np.array([7]), np.ones((1, 3)), np.array([-np.inf]), 3)
    assert found.tolist() == [[0, 1, 2]] and scored <= 128, "ties beyond the kth id are skipped"


def brute_top_k(vectors, k=5):
    """Whole-number scores of any size; every row but the query's own."""
    good = [(r, i, [math.floor(256 * x) for x in v]) for r, (i, v) in enumerate(vectors) if i is not None and v is not None and all(x is not None and math.isfinite(x * 256) for x in v)]
    out = []
    for r, q, v in good:
        if q % 50 == 0:
            scores = [(-min(max(sum(a * b for a, b in zip(v, w, strict=True)), -(2**63)), 2**63 - 1), i) for s, i, w in good if s != r and len(w) == len(v)]
            out += [(q, rank, i, -s) for rank, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("sizes", [{"shard_rows": 64, "block_queries": 3, "next_shards": 1}, {}])
def test_top_k_matches_brute_force(spark, sizes, monkeypatch):
    if sizes:
        monkeypatch.setattr("tessella.llm.topk.SAMPLE", 100)
        monkeypatch.setattr("tessella.llm.topk.MOST_CELLS", 30)
    rng = np.random.default_rng(2)
    vectors = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(300)]
    vectors += [(i, [0.5, 0.5, 0.5, 0.5]) for i in range(300, 500)]
    vectors += [(600, None), (601, [1.0, None, 0.0, 0.0]), (602, [float("nan"), 0.0, 0.0, 0.0]), (603, [float("inf"), 0.0, 0.0, 0.0]), (650, [1.0, 2.0]), (651, [3.0, 1.0]), (None, [0.1] * 4), (300, [0.5, 0.5, 0.5, 0.5])]
    # Ids that repeat with other vectors, also a query's own; components beyond exact doubles and beyond longs; empty vectors.
    vectors += [(7, [9.0, 0.0, 0.0, 0.0]), (0, [3.0, 0.0, 0.0, 1.0]), (0, [3.0, 0.0, 0.0, 1.0]), (700, [1e17, 0.0, 1.0]), (701, [1e300, 0.0, -1.0]), (702, [1.0, 0.0, 5.0]), (703, [1e306, 1.0, 1.0]), (750, []), (751, [])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash")).repartition(5)
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in rows_of(top_k(df, F.col("vec_id") % 50 == 0, **sizes)))
    assert got == brute_top_k(vectors)
    assert top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_top_k_on_long_vectors_and_probe(spark):
    vectors = [(i, [math.sin(i * 31 + j) for j in range(3000)]) for i in range(60)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in rows_of(top_k(df, F.col("vec_id") % 50 == 0))) == brute_top_k(vectors)
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [3.0, 0.0]), (2, [0.5, 0.0])], "vec_id long, embedding array<double>")
    assert [(r["vec_id"], r["score"]) for r in rows_of(top_k(few, F.col("vec_id") == 0).orderBy("rank"))] == [(1, 196608), (1, 65536), (2, 32768)]


def test_html_blocks():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no";</script></head><body>
    <header>Top</header><nav><ul><li><a href="/">Menu</a></ul></nav><div class="cookie-notice">We use cookies</div>
    <div class="content post-12"><h1>Head &amp; line</h1><p>First <b>bold</b>
      text<p>Second &eacute;&#33; <a href=x>link</a><br>more<!-- no --><div class="ad">Buy</div><aside>Side</aside><ul><li>One<li>Two</ul>
      <form><input value=1>Name</form><p style="display: none">hidden</p><table><tr><td>a<td>b</table></div>
    <section id="comments"><p>Great post, I like it very much indeed, thank you all</p></section><footer>&copy; X</footer>"""
    blocks, boxes = parse(page)
    best = max(boxes, key=score)
    assert blocks[best.start : best.end] == ["Head & line", "First bold text", "Second é! link more", "One", "Two", "a", "b"]
    assert best.path.endswith("div.content.post-")


def test_html_articles():
    page = "<main class='page-header'><article class='post share-on'><p>Kept text of the post</article><article class='comment'><p>Nice post</article></main>"
    blocks, _ = parse(page)
    assert blocks == ["Kept text of the post"]


def test_html_consensus(spark):
    body = "<div class='main c%d'><p>%s</p></div><div class='side'><p>%s</p></div>"
    pages = [(i, f"http://h.example/{i}", body % (i, prose(40), prose(10))) for i in range(12)]
    small, long = prose(30), prose(60)
    # A second template of the host: the first one's path holds next to nothing there.
    other = [(20 + i, f"http://h.example/b{i}", f"<div class='main c{i}'><p>by us</p></div><div class='story'><p>{long} {i}</p></div>") for i in range(3)]
    pages += [*other, (50, "http://h.example/50", body % (50, small, long)), (51, None, None), (52, "x", ""), (53, "http://other.example/", "<p>loose &lt;text"), (0, *pages[0][1:]), (None, "http://h.example/n", body % (1, small, "x"))]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {r["page_id"]: r for r in rows_of(extract(df))}
    assert got[50]["text"] == got[None]["text"] == small, "the host's path wins over the page's own longest container"
    assert all(got[20 + i]["text"] == f"{long} {i}" for i in range(3)), "a winner that doesn't fit the page gives way"
    assert got[51]["text"] == got[52]["text"] == "" and got[53]["text"] == "loose <text" and got[53]["n_chars"] == 11
    assert extract(df).count() == len(pages) and extract(df.limit(0)).count() == 0
    named = extract(df.selectExpr("concat('p', page_id) AS page_id", "url", "html"))
    assert "p50" in {r["page_id"] for r in rows_of(named)}, "ids keep their type"


#: Layouts around an article; %(art)s is its markup, %(more)s longer text that is no part of it.
LAYOUTS = {
    "plain": "<html><body><nav><a href=/>Home</a></nav><article>%(art)s</article><footer>&copy; us</footer></body></html>",
    "with-sidebar": "<body><div class='layout with-sidebar'><article>%(art)s</article><div class='sidebar'><p>aside text here</p></div></div>",
    "has-sidebar": "<body class=has-sidebar><div class='has-sidebar wide'><div class=post>%(art)s</div></div><div id=cookie-consent>We use cookies</div>",
    "legal-news": "<body><div class='legal-news'>%(art)s</div><div class='legal'><p>Imprint and such</p></div>",
    "alert-box": "<body><div class=alert>Down today</div><div class='entry-content search-news'>%(art)s</div>",
    "form": "<body><form id='aspnetForm'><div class=nav><a href=x>y</a></div><div id=content>%(art)s</div><input name=q><label>Find</label></form>",
    "comments": "<body><div class=post>%(art)s</div><div id=comments><div class=comment><p>%(more)s</p></div><article class=comment><p>%(more)s</p></article></div>",
    "wrapped-comments": "<body><main><div class='post-with-comments'><div class=text>%(art)s</div><section class='comment-list'><p>%(more)s</p></section></div></main>",
    "camel": "<body><div class=siteHeader>Brand</div><div class=Story>%(art)s</div><div class=shareButtons>Share it</div><div class=relatedPosts><p>Other things</p></div>",
    "quote": "<body><div class=post data-x=\"it's\" title='a > b'>%(art)s</div><p class=\"footer\">End",
    "state": "<body><div class='wrap nav-open'><div class='page-body'>%(art)s</div></div><div class='ad'>Buy now</div>",
    "notices": "<body><div class='notice'>Read me</div><section id=x1>%(art)s</section><div role=dialog>Join</div><div hidden>secret</div><aside>By the way</aside>",
}


@pytest.mark.parametrize("layout", LAYOUTS)
def test_html_whole_pages(spark, layout):
    """Whole pages of known articles, in a host of their own for each layout."""
    pages, expected = [], {}
    for i in range(5):
        blocks = [prose(6), *[prose(random.randint(15, 40)) for _ in range(4)], prose(8) + " & <tag> é"]
        markup = [b.replace("&", "&amp;").replace("<", "&lt;").replace(" ", random.choice([" ", "\n  ", " \t"])) for b in blocks]
        header = f"<div class='article-header'><h1>{markup[0]}</h1></div>" if layout != "alert-box" else f"<header><h1>{markup[0]}</h1></header>"
        if layout in ("alert-box", "comments"):
            header = f"<h1>{markup[0]}</h1>"
        art = header + "".join(f"<p>{m}" + random.choice(["</p>", ""]) for m in markup[1:-1]) + f"<ul><li><b>{markup[-1]}</b></ul><script>var x='<p>';</script><!-- <p>no</p> -->"
        pages.append((i, f"https://{layout}.example:80/{i}", LAYOUTS[layout] % {"art": art, "more": prose(150)}))
        expected[i] = "\n".join(blocks)
    got = {r["page_id"]: r for r in rows_of(extract(spark.createDataFrame(pages, "page_id long, url string, html string")))}
    assert {i: r["text"] for i, r in got.items()} == expected
    assert all(r["n_chars"] == len(expected[i]) for i, r in got.items())


def test_html_hostile_pages_are_linear(spark):
    n = 100_000
    hostile = ["<a \"" * n, "<div>a" * n, "<a x='<b y=\"" * n, "<div>" + "<b>" * n + "<li></li>" * n, "<td>a" * n, "<!--" * n, "<p>" * n + "</b>" * n, "<div class='ad'>a" * n, "< " * n, "<i class='" + "c " * n + "'>x</i>", "word " * n * 4]
    began = time.time()
    for page in hostile:
        _, boxes = parse(page)
        assert all(len(c.path) <= 700 for c in boxes)
    assert time.time() - began < 60
    got = {r["page_id"]: r for r in rows_of(extract(spark.createDataFrame([(i, "http://h/", p) for i, p in enumerate(hostile)], "page_id long, url string, html string")))}
    assert len(got) == len(hostile) and got[len(hostile) - 1]["text"] == ("word " * n * 4).strip()
    assert got[1]["text"] == "\n".join("a" * n)


def test_differencing_balances():
    sizes = [random.randint(1, 1000) for _ in range(300)]
    parts = difference(sizes, 8)
    sums = [sum(s for s, p in zip(sizes, parts, strict=True) if p == k) for k in range(8)]
    assert max(sums) - min(sums) <= 3
    giant = difference([10_000, *[10] * 70], 8)
    assert sum(p == giant[0] for p in giant) == 1
    assert difference([], 3) == [] and set(difference([5, 5, 5], 3)) == {0, 1, 2}


def plain_difference(sizes, parts):
    """Differencing in its plainest form: sorted lists of (sum, members), the two of largest spread combined; ties to the one made first."""
    partial = [(i, [(s, [i])] + [(0, [])] * (parts - 1)) for i, s in enumerate(sizes)]
    made = len(sizes)
    while len(partial) > 1:
        partial.sort(key=lambda x: (-(x[1][0][0] - x[1][-1][0]), x[0]))
        (_, a), (_, b) = partial[:2]
        combined = sorted(((p[0] + q[0], p[1] + q[1]) for p, q in zip(a, reversed(b), strict=True)), key=lambda x: -x[0])
        partial = [(made, combined), *partial[2:]]
        made += 1
    return [sorted(members) for _, members in partial[0][1]] if partial else [[]] * parts


@pytest.mark.parametrize("parts", [1, 2, 3, 8])
def test_differencing_matches_a_plain_version(parts):
    for trial in range(12):
        pick = random.Random(trial)
        sizes = [pick.choice([1, 5, 5, pick.randint(1, 400)]) for _ in range(pick.choice([0, 1, 5, 60]))]
        found = difference(sizes, parts)
        expected = plain_difference(sizes, parts)
        assert [[i for i, p in enumerate(found) if p == k] for k in range(parts)] == expected


def test_shards_match_a_plain_version(spark):
    """Through Spark: bundles that hold one group each, so the items are the groups in the order of their bundles."""
    texts = [prose(random.randint(1, 60)) + f" {i}" for i in range(40)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts + texts[:9] * 3 + [None, ""])], "doc_id long, text string")
    bundles = 1 << 20
    of = {r["text"]: r["b"] for r in df.selectExpr("coalesce(text, '') AS text", f"pmod(xxhash64(coalesce(text, '')), {bundles}) AS b").distinct().collect()}
    assert len(set(of.values())) == len(of)
    sizes = Counter()
    for r in df.collect():
        sizes[r["text"] or ""] += len((r["text"] or "").encode()) + 1
    order = sorted(of, key=of.get)
    expected = [sorted(order[i] for i in members) for members in plain_difference([sizes[t] for t in order], 4)]
    got = shard(df, shards=4, bundles=bundles).collect()
    # Every group is heavy here, so items are ordered by their hashes; sums must agree whatever the order of equals.
    sums = Counter()
    for r in got:
        sums[r["shard"]] += r["size"]
    assert sorted(sums.values()) == sorted(sum(sizes[t] for t in members) for members in expected)


def test_sharding_many_equal_rows(spark):
    df = spark.createDataFrame([(None, "same")] * 5000 + [(1, "other"), (1, "other")], "doc_id long, text string")
    got = shard(df, shards=2).collect()
    for k in (0, 1):
        assert sorted(r["slot"] for r in got if r["shard"] == k) == list(range(sum(r["shard"] == k for r in got)))
    assert len(got) == 5002
    with pytest.raises(ValueError, match="clash"):
        shard(df.withColumn("size", F.lit(1)), carry=["size"])


def test_heavy_groups_that_share_a_bundle_are_told_apart(spark):
    texts = ["a" * 5000, "b" * 5000, "c" * 5000, "d" * 5000, *[f"{i}" for i in range(300)]]
    df = spark.createDataFrame(list(enumerate(texts)) + [(999, "a" * 5000)], "doc_id long, text string")
    got = shard(df, shards=4, bundles=2).collect()
    assert sorted(r["doc_id"] for r in got) == [*range(304), 999]
    assert len({r["shard"] for r in got if r["size"] > 5000}) == 4
    assert len({r["shard"] for r in got if r["text"][0] == "a"}) == 1


def test_sharding(spark, docs):
    got = rows_of(shard(docs, carry=["score"]))
    assert len(got) == docs.count()
    assert len({(r["text"] or "") for r in got}) == len({((r["text"] or ""), r["shard"]) for r in got}), "equal texts stay together"
    for k in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == k) == list(range(sum(r["shard"] == k for r in got)))
    for r in got:
        raw = (r["text"] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))
    assert shard(no_docs(docs)).count() == 0
