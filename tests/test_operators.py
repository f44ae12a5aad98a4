"""Relational operators on small hand-made rows."""

import math
import random
from collections import Counter
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella import plans
from tessella.functions import text as tx
from tessella.operators import adaptive, compose, filters, linkage, models, pairing, rank, sampling, seq, sessions, split, stats
from tessella.operators.components import components


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


PREDICTIONS = [(1, "twin", "T1", 5.0, 5), (1, "twin", "T2", 4.0, 6), (1, "baseline", "T1", 3.0, 5), (1, "baseline", "T2", 3.0, 6), (2, "twin", "T1", 7.0, 7), (2, "twin", "T2", 2.0, 1), (2, "baseline", "T1", 4.0, 7), (2, "baseline", "T2", 4.0, 1)]


def test_paired_lift(spark):
    p = spark.createDataFrame(PREDICTIONS, "person long, arm string, item string, ev double, truth int")
    pairs = pairing.pairs(p, ["person", "item"], ["ev", "truth"], "twin", "baseline")
    err = lambda s: F.avg(F.abs(F.col(f"{s}_ev") - F.col(f"{s}_truth")))
    m = pairs.groupBy("person").agg(err("better").alias("t"), err("worse").alias("b")).agg(F.avg("t"), F.avg("b"), F.avg(F.col("b") - F.col("t"))).first()
    assert tuple(m) == (0.75, 2.75, 2.0)


def test_funnel_and_drops(spark):
    d = spark.createDataFrame([(1, 1), (None, 1), (2, None), (9, 9)], "a int, b int")
    rules = {"a": F.col("a") < 5, "b": F.col("b") < 5}
    assert rows(filters.funnel(d, rules), "step", "rule", "rows_in", "lost", "rows_out") == [(1, "a", 4, 2, 2), (2, "b", 2, 1, 1), (3, "kept", 1, 0, 1)]
    assert dict(rows(filters.drop_counts(d, rules), "rule", "n")) == {"a": 2, "b": 2, "kept": 1}
    assert filters.clean(d, rules).count() == 1


def test_guards(spark):
    a = spark.createDataFrame([(1,), (2,)], "k int")
    assert pairing.join_or_fail(a, a.withColumn("v", F.lit(1)), ["k"]).count() == 2
    with pytest.raises(Exception, match="no match for key"):
        pairing.join_or_fail(a, a.filter("k = 1"), ["k"]).collect()


TURNS = [(1, 0, "guest", "hi"), (1, 1, "host", "Why now?"), (1, 2, "guest", "Because"), (1, 3, "guest", " of it "), (1, 4, "other", "noise"), (1, 5, "guest", "late"), (1, 6, "host", ""), (1, 7, "host", "And?"), (1, 8, "host", "So?"), (1, 9, "guest", "")]


def test_turn_pairing(spark):
    t = spark.createDataFrame(TURNS, "tid long, turn_idx long, role string, text string")
    assert rows(sessions.qa_items(t), "q_turn_idx", "question", "answer") == [(1, "Why now?", "Because of it"), (8, "So?", "")]
    assert rows(sessions.exchanges(t), "answer_idx", "host", "answer") == [(0, "", "hi"), (2, "Why now?", "Because of it"), (5, "", "late")]
    assert rows(sessions.segments(t), "q_turn_idx", "answer") == [(1, "Because of it"), (7, ""), (8, "")]
    got = sorted((r["turn_idx"], r["guest_idx"], r["prev_host_idx"]) for r in sessions.followups(t).collect())
    assert got == [(1, 0, None), (7, 5, 1), (8, 5, 1)]


def test_chains(spark):
    t = spark.createDataFrame([(1, i, label) for i, label in enumerate(["NEW", "FOLLOW-UP", "FOLLOW-UP", None, "FOLLOW-UP"])], "tid int, turn_idx int, label string")
    assert rows(sessions.chains(t), "first", "last", "depth") == [(0, 2, 2), (3, 4, 1)]


def test_greedy_dedup_matches_loop(spark):
    random.seed(4)
    data = [(g, i, random.sample("abcdefgh", random.randint(0, 4))) for g in range(3) for i in range(15)]
    got = rows(seq.greedy_dedup(spark.createDataFrame(data, "g int, i int, w array<string>"), ["g"], ["i"], "w", 0.5, most=6), "g", "i")
    expected = []
    for g in range(3):
        kept = []
        for _, i, w in (r for r in data if r[0] == g):
            like = lambda a, b: 1.0 if not a and not b else len(set(a) & set(b)) / len(set(a) | set(b))
            if all(like(w, k) < 0.5 for _, k in kept):
                kept.append((i, w))
        expected += [(g, i) for i, _ in kept[:6]]
    assert got == sorted(expected)


def test_budget_fill_skips(spark):
    d = spark.createDataFrame([("g", 1, 600), ("g", 2, 900), ("g", 3, 300)], "g string, i int, w int")
    assert rows(seq.budget_fill(d, ["g"], ["i"], "w", 1000), "i", "w", "used") == [(1, 600, 900), (3, 300, 900)]


def test_spacing(spark):
    d = spark.createDataFrame([("g", x) for x in (1, 3, 6, 7, 12)], "g string, at int")
    assert rows(seq.spaced(d, ["g"], "at", 5), "at") == [(1,), (6,), (12,)]


def test_ranks_and_auc(spark):
    d = spark.createDataFrame([(0.1, False), (0.4, False), (0.4, True), (0.9, True)], "s double, hit boolean")
    assert rows(rank.mid_rank(d, "s"), "s", "mid_rank") == [(0.1, 1.0), (0.4, 2.5), (0.4, 2.5), (0.9, 4.0)]
    assert rank.auc(d, "s", "hit").first()["auc"] == 0.875


def test_distinct_donors(spark):
    d = spark.createDataFrame([("q", "x", 9), ("q", "x", 8), ("q", "y", 7), ("q", "z", 1)], "q string, donor string, sim int")
    assert rows(rank.distinct_top(d, ["q"], "donor", [F.desc("sim")], 2), "rank", "donor") == [(1, "x"), (2, "y")]


def test_tfidf_closed_form(spark):
    t = spark.createDataFrame([(0, "bb"), (0, "cc"), (1, "bb"), (1, "dd")], "doc int, term string")
    v = rank.tfidf(t, max_df=1.0)
    norm = math.sqrt(1 + (math.log(3 / 2) + 1) ** 2)
    assert dict(((d, w), x) for d, w, x in rows(v, "doc", "term", "w"))[(0, "bb")] == pytest.approx(1 / norm)
    assert rank.sparse_cosine(v, v).filter("a = 0 AND b = 1").first()["cosine"] == pytest.approx(1 / norm**2)
    assert rank.tfidf(t, max_df=0.9).filter("term = 'bb'").count() == 0


def test_components_match_union_find(spark):
    random.seed(9)
    edges = [(random.randint(0, 300), random.randint(0, 300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1040)] + [(2000, x) for x in range(2001, 2060)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    linked = {x for a, b in edges if a != b for x in (a, b)}
    df = spark.createDataFrame([*edges, (None, 5)], "a long, b long")
    assert rows(components(df), "node", "root") == sorted((x, find(x)) for x in linked)
    assert components(df.limit(0)).count() == 0


def set_data():
    draw = random.Random(5)
    data = []
    for i in range(160):
        base = draw.choice(data)[2] if data and draw.random() < 0.6 else []
        kept = [x for x in base if draw.random() < draw.choice([0.5, 0.9, 1.0])]
        fresh = [f"w{int(400 * draw.random() ** 2)}" for _ in range(draw.choice([0, 2, 5, 40, 120]))]
        data.append((draw.choice("gh"), i, list(dict.fromkeys(kept + fresh))))
    return data + [("g", 500 + i, ["a", "b"]) for i in range(4)] + [("g", 600, None), ("g", 601, []), ("g", 602, [])] + [("h", 700, list(draw.choice(data)[2])) for _ in range(1)]


def expected_pairs(data, rule):
    """Pairs of classes of equal sets by their smallest document, and each other document with its class's."""
    classes = {}
    for g, i, x in data:
        if x:
            classes.setdefault((g, frozenset(x)), []).append(i)
    out = []
    for (g, x), members in classes.items():
        out += [(g, min(members), i, len(x), 1.0) for i in members if i != min(members)]
        for (h, y), others in classes.items():
            if g == h and min(members) < min(others) and x & y:
                both = len(x & y)
                if rule(both / len(x | y), both / min(len(x), len(y)), min(len(x), len(y))):
                    out.append((g, min(members), min(others), both, both / len(x | y)))
    return sorted(out)


def test_near_pairs_match_brute_force(spark):
    data = set_data()
    draw = random.Random(8)
    long = next(x for _, _, x in data if x and len(x) > 100)
    # Parts of a larger set, on either side of the bounds, and small sets that are nearly equal.
    data += [("g", 800 + i, draw.sample(long, n) + [f"z{i}{j}" for j in range(m)]) for i, (n, m) in enumerate([(49, 0), (50, 0), (60, 14), (60, 16), (48, 12), (19, 0), (20, 1)])]
    data += [("g", 900, [f"q{i}" for i in range(19)]), ("g", 901, [f"q{i}" for i in range(18)]), ("g", 902, [f"q{i}" for i in range(19)][::-1])]
    d = spark.createDataFrame(data, "g string, id long, s array<string>")
    wanted = expected_pairs(data, lambda j, c, n: n >= 20 and (j >= 0.6 or c >= 0.8 and n >= 50))
    assert rows(linkage.near_pairs(d, "g", "id", "s"), "g", "a", "b", "shared", "jaccard") == wanted
    assert any(j < 0.6 for *_, j in wanted) and ("g", 900, 902, 19, 1.0) in wanted


@pytest.mark.parametrize("least", [0.1, 0.3, 0.5, 1.0])
def test_similar_pairs_match_brute_force(spark, least):
    data = set_data()
    wanted = expected_pairs(data, lambda j, c, n: j >= least)
    assert len(wanted) > 5 and max(len(x[2] or []) for x in data) > 100
    d = spark.createDataFrame(data, "g string, id long, s array<string>")
    assert rows(linkage.similar_pairs(d, "g", "id", "s", least), "g", "a", "b", "shared", "jaccard") == wanted


def test_similar_pairs_of_long_texts(spark):
    words = [f"w{i}" for i in range(200)]
    d = spark.createDataFrame([(1, "s", " ".join(words)), (2, "s", " ".join(words[:150]))], "doc_id long, source string, text string")
    s = d.select("source", "doc_id", tx.word_set(F.col("text")).alias("w"))
    assert rows(linkage.similar_pairs(s, "source", "doc_id", "w", 0.3), "a", "b", "shared", "jaccard") == [(1, 2, 150, 0.75)]


def test_range_join_serves_every_part(spark, tmp_path):
    draw = random.Random(3)
    parts = [(i, draw.choice([1, 2]), draw.choice("xy"), round(draw.uniform(50, 150), 2)) for i in range(1, 80)]
    spark.createDataFrame(parts, "p_partkey long, p_size int, p_type string, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    wanted = [(i, j, round(abs(w - v), 4)) for i, s, t, v in parts for j, z, u, w in parts if i != j and (s, t) == (z, u) and v * 0.9 <= w <= v * 1.1]
    assert len({x[0] for x in wanted}) > 70
    assert rows(plans.QUERIES["range_join_ladder"](spark, str(tmp_path)), "target", "candidate", "gap") == sorted(wanted)


def test_ladder_falls_back_to_the_last_rung(spark):
    bank = spark.createDataFrame([(1, "a", 100, "L"), (2, "b", 100, "L"), (3, "b", 140, "H"), (4, "c", 125, "L"), (5, "d", 9000, "Z")], "cand long, donor string, words int, bucket string")
    items = bank.select(F.col("cand").alias("item"), F.col("donor").alias("subject"), "words", "bucket").filter("item IN (1, 5)")
    got = lambda need: rows(compose.ladder(items.filter("item = 1"), bank, need), "cand", "rung", "relax_rung", "few_donors")
    assert got(1) == [(2, 1, 1, False)]
    assert got(2) == [(2, 1, 2, False), (4, 2, 2, False)]
    assert got(3) == [(2, 1, 4, True), (3, 4, 4, True), (4, 2, 4, True)]
    assert rows(compose.ladder(items.filter("item = 5"), bank, 1), "item", "cand", "relax_rung", "few_donors") == [(5, None, 4, True)]


def test_every_part_has_a_ladder(spark, tmp_path):
    parts = [(i, f"b{i % 24}", 100.0 + i % 7, i % 3) for i in range(1, 150)] + [(999, "b1", 90000.0, 1)]
    spark.createDataFrame(parts, "p_partkey long, p_brand string, p_retailprice double, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    got = plans.QUERIES["option_ladder"](spark, str(tmp_path))
    assert {r["item"] for r in got.select("item").distinct().collect()} == {p[0] for p in parts}
    assert rows(got.filter("item = 999"), "item", "cand", "few_donors") == [(999, None, True)]


def test_name_links_match_brute_force(spark):
    draw = random.Random(11)
    names = ["cathy jonson", "kathy janson", "Dr. Jon Smith", "jon smith", "listen abc", "silent abc", "silent", "listen", "anna lee", "", "ève ünal", "eve unal"]
    for _ in range(60):
        x = list(draw.choice(names[:9]) if draw.random() < 0.6 else "".join(draw.choices("abcdeilnost ", k=draw.randint(2, 14))))
        for _ in range(draw.randint(1, 3)):
            x[draw.randrange(len(x))] = draw.choice("abeiklnos")
        names.append("".join(x))
    d = spark.createDataFrame(list(enumerate(names)), "k long, n string")
    plain = [r["n"] for r in d.orderBy("k").select(tx.name_key(F.col("n")).alias("n")).collect()]
    wanted = []
    for i, x in enumerate(plain):
        for j, y in enumerate(plain[:i] if x else []):
            r = SequenceMatcher(None, y, x, autojunk=False).ratio()
            shares = bool({*x.split()} & {*y.split()})
            if y and (shares or r >= 0.7):
                wanted.append((j, i, shares, r))
    assert (0, 1) in {w[:2] for w in wanted}
    assert rows(compose.name_links(d, "k", "n"), "a", "b", "shares", "ratio") == sorted(wanted)


def test_chronological_split(spark):
    data = [("s", 1, "2000-01-01", 10), ("s", 2, "2001-01-01", 5), ("s", 3, "2001-01-01", 7)]
    c = spark.createDataFrame(data, "subject string, cluster int, date string, words long").withColumn("date", F.to_date("date"))
    assert rows(split.latest_split(c), "cluster", "side", "delta_days") == [(1, "grounding", 366), (2, "excluded", 0), (3, "test", 0)]
    assert rows(split.first_per_bin(c, 10), "bin", "delta") == [("12-24m", 366)]


def test_draws(spark):
    d = spark.range(5000).toDF("id")
    one, two = rows(sampling.draw(d, "id", 100, 1), "id"), rows(sampling.draw(d.repartition(7), "id", 100, 1), "id")
    assert one == two and len(set(one)) == 100 and one != rows(sampling.draw(d, "id", 100, 2), "id")
    pairs = rows(sampling.rotation(d.limit(50), "id", 3), "id", "imposter")
    assert all(a != b for a, b in pairs) and len({b for _, b in pairs}) == 50


def test_t_distribution():
    assert stats.t_two_sided(2.2281388519649385, 10) == pytest.approx(0.05, abs=1e-10)
    assert stats.t_quantile(0.975, 4) == pytest.approx(2.7764451051977987, abs=1e-8)
    assert stats.t_two_sided(1.0, 1) == pytest.approx(0.5)
    assert stats.mean_ci(1.0, 0.0, 5) == (1.0, 1.0, 1.0) and math.isnan(stats.mean_ci(1.0, None, 1)[1]) and math.isnan(stats.mean_ci(None, None, 0)[0])


def test_contrast(spark):
    values = [1.0, 2.0, -1.0, 0.0, 3.0, 2.0]
    d = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, d double")
    r = stats.with_p_values(stats.contrast(d, "d")).first()
    assert (r["n"], r["n_up"], r["n_down"], r["n_zero"], r["w_plus"]) == (6, 4, 1, 1, 13.5)
    assert r["mean"] == pytest.approx(np.mean(values)) and r["sd"] == pytest.approx(np.std(values, ddof=1)) and 0 < r["p_t"] < 1
    ci = stats.bootstrap(d, "d", "id", 500, 7).first()
    assert ci["low"] < r["mean"] < ci["high"]
    same = spark.createDataFrame([(i, 1.0) for i in range(12)], "id int, d double")
    assert stats.signflip(same, "d", "id", 1024, 3).first()["p"] < 0.02


def test_models(spark):
    x = np.linspace(0, 1, 200)
    y = (np.sin(np.arange(200) * 7.3) * 0.5 + 0.5 < x).astype(float)
    a, b = models.platt(x, y)
    assert a > 0
    ends, levels = models.isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]))
    assert ends.tolist() == [1, 3, 4] and levels.tolist() == [0.0, 0.5, 1.0]
    assert models.step_at(ends, levels, np.array([0.0, 2.5, 9.0])).tolist() == [0.0, 0.5, 1.0]


def plain_ridge_error(x, y, penalty, folds):
    """Mean absolute out-of-fold error of a ridge with a free intercept, from the rows."""
    errors = []
    for f in np.unique(folds):
        test = folds == f
        mean_x, mean_y = x[~test].mean(axis=0), y[~test].mean(axis=0)
        a, b = x[~test] - mean_x, y[~test] - mean_y
        beta = np.linalg.solve(a.T @ a + penalty * np.eye(x.shape[1]), a.T @ b)
        errors.append(np.abs((x[test] - mean_x) @ beta + mean_y - y[test]).ravel())
    return float(np.concatenate(errors).mean())


def test_forward_selection_matches_a_plain_version(spark):
    rng = np.random.default_rng(0)
    data = rng.normal(size=(90, 4))
    rows_in = [(i, *map(float, r), float(3 * r[2] + r[0] + 0.1 * r[3]), float(r[1])) for i, r in enumerate(data)]
    df = spark.createDataFrame(rows_in, "id int, a double, b double, c double, d double, y double, z double")
    folds = np.array([r["f"] for r in df.select("id", F.pmod(F.xxhash64("id"), F.lit(5)).alias("f")).orderBy("id").collect()])
    y, chosen, expected = np.array([r[5:] for r in rows_in]), [], []
    for _ in range(3):
        errors = {i: plain_ridge_error(data[:, [*chosen, i]], y, 1.0, folds) for i in range(4) if i not in chosen}
        chosen.append(min(errors, key=lambda i: (errors[i], i)))
        expected.append(("abcd"[chosen[-1]], errors[chosen[-1]]))
    got = models.greedy_order(df.repartition(5), "id", ["a", "b", "c", "d"], ["y", "z"], 3).orderBy("place").collect()
    assert [r["feature"] for r in got] == [f for f, _ in expected]
    assert np.allclose([r["mae"] for r in got], [e for _, e in expected])


@pytest.mark.parametrize("kind", ["platt", "isotonic"])
def test_calibration_matches_fits_on_the_rows(spark, kind):
    rng = np.random.default_rng(4)
    data = [(i, int(i % 23), float(np.round(x, 2)), bool(rng.random() < x**2)) for i, x in enumerate(rng.random(700))]
    df = spark.createDataFrame(data, "id int, subject int, conf double, hit boolean").repartition(6)
    own = {r["id"]: r["f"] for r in df.select("id", F.pmod(F.xxhash64("subject"), F.lit(5)).alias("f")).collect()}
    got = {r["key"]: r["calibrated"] for r in models.calibrated(df, "id", "subject", "conf", "hit", kind).collect()}
    for f in range(5):
        train = [(x, float(h)) for i, _, x, h in data if own[i] != f]
        xs, ys = (np.array(v) for v in zip(*train, strict=True))
        for i, _, x, _ in data:
            if own[i] == f:
                if kind == "platt":
                    a, b = models.platt(xs, ys)
                    assert got[i] == pytest.approx(1 / (1 + math.exp(-(a * x + b))), abs=1e-6)
                else:
                    assert got[i] == pytest.approx(models.step_at(*models.isotonic(xs, ys), np.array([x]))[0])
                    continue
    assert models.calibrated(df.limit(0), "id", "subject", "conf", "hit", kind).count() == 0


def test_exact_signed_ranks():
    assert stats.wilcoxon_exact(0, 5) == pytest.approx(2 / 32) and stats.wilcoxon_exact(15, 5) == pytest.approx(2 / 32)
    assert stats.wilcoxon_exact(7.0, 5) == 1.0 and stats.wilcoxon_exact(3, 4) == pytest.approx(10 / 16)


def test_global_order_without_one_task(spark):
    from tessella.operators import calib, ranges

    draw = random.Random(2)
    data = [(i, draw.randint(0, 9), draw.randint(0, 5)) for i in range(200)]
    df = spark.createDataFrame(data, "id int, v int, w int").repartition(7)
    got = {r["id"]: r["p"] for r in ranges.before(df, [F.desc("v"), F.col("id")], "p", F.col("w")).collect()}
    expected, seen = {}, 0
    for i, _, w in sorted(data, key=lambda x: (-x[1], x[0])):
        expected[i], seen = seen, seen + w
    assert got == expected
    tiles = {r["id"]: r["bin"] for r in calib.equal_mass(df, "v", "id", 7).collect()}
    order = [i for i, _, _ in sorted(data, key=lambda x: (x[1], x[0]))]
    assert [tiles[i] for i in order] == sorted(tiles.values()) and sorted(Counter(tiles.values()).values()) == [28] * 3 + [29] * 4
    assert ranges.before(df.limit(0), [F.col("id")], "p").count() == 0


def test_weights_come_from_digests():
    import hashlib

    signs = stats.weights(5, "k", 300, signs=True)
    bits = "".join(f"{int.from_bytes(hashlib.sha256(f'5|k|{w}'.encode()).digest(), 'big'):0256b}" for w in (0, 1))
    assert signs.tolist() == [1.0 if b == "1" else -1.0 for b in bits[:300]]
    counts = stats.weights(5, "k", 50_000, signs=False)
    first = int(hashlib.sha256(b"5|k|0").hexdigest()[:4], 16) / 65536
    assert counts[0] == next(k for k in range(9) if first < sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) - 1e-4 or k == 8)
    assert abs(counts.mean() - 1) < 0.02 and abs(counts.var() - 1) < 0.03


def test_cluster_bootstrap_averages_items(spark):
    d = spark.createDataFrame([(i, float(i % 3), 2) for i in range(60)], "s int, total double, items int")
    ci = stats.bootstrap(d, "total", "s", 1000, 5, size="items").first()
    assert 0.35 < ci["low"] < 0.5 < ci["high"] < 0.65
    again = stats.bootstrap(d.repartition(5), "total", "s", 1000, 5, size="items").first()
    assert ci["low"] == pytest.approx(again["low"])
    assert stats.bootstrap(d.limit(0), "total", "s", 100, 5).count() == 0


def test_adaptive_rounds(spark):
    items = spark.createDataFrame([(p, i) for p in (1, 2) for i in "abc"], "person_id int, item string")

    def beliefs(left, n):
        sharp = F.when(F.col("item") == "b", 0.5).when(F.col("item") == "a", 0.9).otherwise(0.99)
        return left.withColumn("d", F.create_map(F.lit(1), sharp, F.lit(2), 1 - sharp))

    assert rows(adaptive.rounds(beliefs, items, 2), "person_id", "round", "item") == [(1, 1, "b"), (1, 2, "a"), (2, 1, "b"), (2, 2, "a")]
    log = spark.createDataFrame([(1, 1), (2, 1), (1, 2), (1, 3), (2, 3)], "person int, round int")
    assert rows(adaptive.complete_rounds(log, "person", "round", 2), "person", "round") == [(1, 1), (2, 1)]


def test_gain_rounds_match_a_plain_version(spark):
    """Three rounds of hypothetical answers, with null beliefs and ties."""
    people, names = range(1, 7), "abcdefg"
    items = [(p, i) for p in people for i in names]

    def mass(seed):
        raw = [1 + seed * k % 11 for k in range(1, 6)]
        return [x / sum(raw) for x in raw]

    def column(seed):
        raw = F.transform(F.sequence(F.lit(1), F.lit(5)), lambda k: (1 + seed * k % 11).cast("double"))
        return F.map_from_arrays(F.sequence(F.lit(1), F.lit(5)), F.transform(raw, lambda m: m / F.aggregate(raw, F.lit(0.0), lambda a, x: a + x)))

    h = lambda i, n: ord(i) % 4 * 3 + n
    code = F.ascii("item") % 4 * 3
    beliefs = lambda left, n: left.withColumn("d", F.when(F.col("item") != "g", column(F.col("person_id") + code + n)))
    shifted = lambda asked, n: asked.withColumns({"before": column(F.col("person_id") * 2 + n), "after": F.when((F.col("item") != "f") | (F.col("answer") != 3), column(F.col("person_id") * F.col("answer") + code + n))})
    expected = []
    for p in people:
        left = list(names)
        for n in (1, 2, 3):
            d = {i: mass(p + h(i, n)) if i != "g" else None for i in left}
            uncertain = {i: -1.0 if v is None else sum(-x * math.log(x) for x in v) for i, v in d.items()}
            gains = {}
            for i in sorted(left, key=lambda i: (-round(uncertain[i], 9), i))[:4]:
                w = [1 / 3] * 3 if d[i] is None else [d[i][a - 1] for a in (1, 3, 5)]
                shifts = [0.0 if i == "f" and a == 3 else sum(abs(x - y) for x, y in zip(mass(p * 2 + n), mass(p * a + h(i, n)), strict=True)) / 2 for a in (1, 3, 5)]
                gains[i] = sum(x * y for x, y in zip(w, shifts, strict=True)) / sum(w)
            best = min(gains, key=lambda i: (-round(gains[i], 9), i))
            expected.append((p, n, best, pytest.approx(gains[best])))
            left.remove(best)
    adaptive.SCORERS["rounded"] = lambda d: F.round(adaptive.dist.entropy(d), 9)
    got = adaptive.gain_rounds(beliefs, shifted, spark.createDataFrame(items, "person_id int, item string"), 3, shortlist=4, scorer="rounded")
    assert rows(got, "person_id", "round", "item", "score") == expected


def test_balanced_sample_matches_a_loop(spark):
    import hashlib

    draw = random.Random(6)
    data = [(i, draw.randint(0, 7), draw.choice(["SAME"] * 6 + ["DIFFERENT", "UNCLEAR", "UNCLEAR"])) for i in range(60)]
    quotas = [("DIFFERENT", 4), ("SAME", 5), ("UNCLEAR", 3)]
    lots = {i: hashlib.sha256(f"9{i}".encode()).hexdigest() for i, _, _ in data}
    chosen = {item: [] for _, item, _ in data}
    for label, quota in quotas:
        for _ in range(3):
            for item in sorted(chosen):
                free = [i for i, x, y in data if x == item and y == label and i not in chosen[item]]
                if quota and free and len(chosen[item]) < 3:
                    chosen[item].append(min(free, key=lots.get))
                    quota -= 1
    for item, taken in chosen.items():
        rest = sorted((i for i, x, _ in data if x == item and i not in taken), key=lots.get)
        taken += rest[: 3 - len(taken)]
    d = spark.createDataFrame(data, "id int, item int, label string")
    assert rows(sampling.balanced(d, "item", "id", "label", quotas, 3, 9), "item", "id") == sorted((item, i) for item, taken in chosen.items() for i in taken)


def test_backends(spark):
    d = spark.createDataFrame([(i, f"p{i}") for i in range(10)], "id int, prompt string").repartition(3)
    assert rows(pairing.generated(d, "id", "prompt", lambda ps: [p[::-1] for p in ps], batch=2), "id", "completion") == [(i, f"{i}p") for i in range(10)]
    done = spark.createDataFrame([(1, "x"), (99, "y")], "id int, text string")
    assert [r["completion"] for r in pairing.answered(d, done, "id").orderBy("id").collect()] == [None, "x"] + [None] * 8
    assert tuple(pairing.indexed(d, done, "id").first()) == (1, 9, 1)


def test_ties_go_by_digest(spark):
    import hashlib

    scored = spark.createDataFrame([(71, str(i), 1.0) for i in range(7)], "person_id int, item string, score double")
    digest = int(hashlib.sha256(b"71|71|3").hexdigest()[:16], 16) % 7
    assert adaptive.pick(scored, "person_id", "item", "score", seed=71, round_no=3).first()["item"] == str(digest)
