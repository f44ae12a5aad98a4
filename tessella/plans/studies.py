"""Study steps: contrasts by arm and decoding, meters, cells, gates, rounds and their diagnostics."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions import dist
from tessella.functions import text as tx
from tessella.operators import adaptive, models, pairing, ranges, rank, stats
from tessella.plans.inference import _DIFF, _diffs
from tessella.plans.registry import query
from tessella.runtime import table
from tessella.sources import views


def _r(name: str, digits: int = 6) -> Column:
    return F.round(name, digits).alias(name)


_METER = "SELECT person_id, avg(CASE WHEN arm = 'twin' THEN hit END) - avg(CASE WHEN arm = 'baseline' THEN hit END) AS meter FROM (SELECT person_id, arm, CAST(argmax = truth AS INT) AS hit FROM {predictions} WHERE NOT parse_failure) GROUP BY person_id"


def _meters(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.predictions(spark, sf_dir).filter("NOT parse_failure").withColumn("hit", (F.col("argmax") == F.col("truth")).cast("int"))
    side = lambda arm: F.avg(F.when(F.col("arm") == arm, F.col("hit")))
    return p.groupBy("person_id").agg((side("twin") - side("baseline")).alias("meter"))


_MID = "rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0"


@query(f"""
WITH d AS ({_DIFF}), m AS ({_METER}), j AS (SELECT round(diff, 9) AS diff, round(meter, 9) AS meter FROM d JOIN m USING (person_id) WHERE meter IS NOT NULL), r AS (SELECT *, {_MID.format("diff")} AS a, {_MID.format("meter")} AS b FROM j)
SELECT count(*) AS n, round(corr(diff, meter), 5) AS pearson, round(corr(a, b), 5) AS spearman FROM r""")
def lift_meter_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How a subject's lift goes with its contamination meter."""
    j = _diffs(spark, sf_dir).join(_meters(spark, sf_dir).filter("meter IS NOT NULL"), "person_id").select("person_id", F.round("diff", 9).alias("diff"), F.round("meter", 9).alias("meter"))
    ranked = rank.mid_rank(rank.mid_rank(j, "diff", name="a"), "meter", name="b")
    return ranked.agg(F.count("*").alias("n"), F.round(F.corr("diff", "meter"), 5).alias("pearson"), F.round(F.corr("a", "b"), 5).alias("spearman"))


@query(f"""
WITH d AS ({_DIFF}), m AS ({_METER}), j AS (SELECT diff, meter FROM d JOIN m USING (person_id) WHERE meter IS NOT NULL), c AS (SELECT quantile_cont(meter, 0.9) AS cut FROM j)
SELECT round(any_value(cut), 6) AS cut, count_if(meter >= cut) AS n_top, round(avg(CASE WHEN meter >= cut THEN diff END), 6) AS lift_top, round(avg(CASE WHEN meter < cut THEN diff END), 6) AS lift_rest FROM j, c""")
def meter_top_decile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lift of the subjects whose meter is among the largest tenth, and of the others."""
    j = _diffs(spark, sf_dir).join(_meters(spark, sf_dir).filter("meter IS NOT NULL"), "person_id")
    cut = j.agg(F.percentile("meter", F.lit(0.9)).alias("cut"))
    top = F.col("meter") >= F.col("cut")
    out = j.crossJoin(F.broadcast(cut)).agg(F.first("cut").alias("cut"), F.count_if(top).alias("n_top"), F.avg(F.when(top, F.col("diff"))).alias("lift_top"), F.avg(F.when(~top, F.col("diff"))).alias("lift_rest"))
    return out.select(_r("cut"), "n_top", _r("lift_top"), _r("lift_rest"))


_BOTH = "SELECT t.person_id, t.item, abs(b.{v} - b.truth) - abs(t.{v} - t.truth) AS d FROM {predictions} t JOIN {predictions} b ON t.person_id = b.person_id AND t.item = b.item AND t.arm = 'twin' AND b.arm = 'baseline' WHERE NOT t.parse_failure AND NOT b.parse_failure"
_CELL = "SELECT '{v}' AS decoding, item, count(*) AS n, round(avg(d), 6) AS lift, round(stddev_samp(d), 6) AS sd, round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 5) AS t FROM (" + _BOTH + ") GROUP BY item"


@query(" UNION ALL ".join(_CELL.replace("{v}", v) for v in ("ev", "argmax")))
def contrast_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lift of every item under both decodings, in one pass."""
    p = pairing.pairs(views.predictions(spark, sf_dir), ["person_id", "item"], ["ev", "argmax", "truth", "parse_failure"], "twin", "baseline").filter("NOT better_parse_failure AND NOT worse_parse_failure")
    gap = lambda v: F.abs(F.col(f"worse_{v}") - F.col("worse_truth")) - F.abs(F.col(f"better_{v}") - F.col("better_truth"))
    long = p.select("item", F.inline(F.array(*[F.struct(F.lit(v).alias("decoding"), gap(v).cast("double").alias("d")) for v in ("ev", "argmax")])))
    c = long.groupBy("decoding", "item").agg(F.count("*").alias("n"), F.avg("d").alias("lift"), F.stddev_samp("d").alias("sd"))
    return c.select("decoding", "item", "n", _r("lift"), _r("sd"), F.round(F.col("lift") / (F.col("sd") / F.sqrt("n")), 5).alias("t"))


@query(f"""
WITH d AS ({_BOTH.replace("{v}", "ev")}), i AS (SELECT item, row_number() OVER (ORDER BY item) AS k FROM (SELECT DISTINCT item FROM d)), s AS (SELECT i.k, d.person_id, avg(d.d) AS m FROM d JOIN i ON d.item <= i.item WHERE person_id % 2 = 0 GROUP BY ALL)
SELECT k, count(*) AS n, round(avg(m), 6) AS lift FROM s GROUP BY k""")
def lift_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lift after the first k items, over a subset of persons."""
    p = pairing.pairs(views.predictions(spark, sf_dir), ["person_id", "item"], ["ev", "truth", "parse_failure"], "twin", "baseline").filter("NOT better_parse_failure AND NOT worse_parse_failure")
    d = p.withColumn("d", F.abs(F.col("worse_ev") - F.col("worse_truth")) - F.abs(F.col("better_ev") - F.col("better_truth")))
    # Items are a handful: one row of them, sorted.
    order = d.agg(F.array_sort(F.collect_set("item")).alias("order"))
    placed = d.filter("person_id % 2 = 0").crossJoin(F.broadcast(order)).select("person_id", "d", F.explode(F.sequence(F.array_position("order", F.col("item")), F.size("order").cast("long"))).alias("k"))
    return placed.groupBy("k", "person_id").agg(F.avg("d").alias("m")).groupBy("k").agg(F.count("*").alias("n"), F.round(F.avg("m"), 6).alias("lift"))


@query("""
WITH t AS (SELECT person_id, count_if(arm = 'twin') AS a, count_if(arm = 'baseline') AS b, count(*) AS n FROM {predictions} WHERE NOT parse_failure GROUP BY 1), p AS (SELECT person_id, item, count(DISTINCT arm) AS arms FROM {predictions} WHERE NOT parse_failure GROUP BY ALL)
SELECT t.person_id, t.a AS twin, t.b AS baseline, count_if(arms = 2) AS shared, t.a - count_if(arms = 2) AS only_twin, t.b - count_if(arms = 2) AS only_baseline FROM t JOIN p USING (person_id) GROUP BY t.person_id, t.a, t.b""")
def shared_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that both arms scored, by subject, and those that one arm has alone."""
    i = views.predictions(spark, sf_dir).filter("NOT parse_failure").groupBy("person_id", "item").agg(F.bool_or(F.col("arm") == "twin").alias("t"), F.bool_or(F.col("arm") == "baseline").alias("b"))
    return i.groupBy("person_id").agg(F.count_if("t").alias("twin"), F.count_if("b").alias("baseline"), F.count_if(F.col("t") & F.col("b")).alias("shared"), F.count_if(F.col("t") & ~F.col("b")).alias("only_twin"), F.count_if(F.col("b") & ~F.col("t")).alias("only_baseline"))


_SLOPES = "SELECT user_id AS s, regr_slope(value, event_id / 1000.0) AS d FROM events GROUP BY 1 HAVING count(DISTINCT event_id) >= 2"


@query(f"""
WITH d AS ({_SLOPES}), r AS (SELECT *, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0 AS k FROM d WHERE d <> 0)
SELECT count(*) AS n, round(avg(d), 6) AS mean, round(quantile_cont(d, 0.5), 6) AS median, round(stddev_samp(d), 6) AS sd, count_if(d > 0) AS n_up, count_if(d < 0) AS n_down, round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 5) AS t, (SELECT round(sum(k), 1) FROM r WHERE d > 0) AS w_plus FROM d""")
def one_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjects' slopes against zero."""
    e = table(spark, sf_dir, "events")
    slopes = e.groupBy(F.col("user_id").alias("s")).agg(F.regr_slope("value", F.col("event_id") / 1000.0).alias("d"), F.count_distinct("event_id").alias("n")).filter("n >= 2")
    c = stats.contrast(slopes.select("s", "d"), "d")
    return c.select("n", _r("mean"), _r("median"), _r("sd"), "n_up", "n_down", _r("t", 5), _r("w_plus", 1))


_GRAMS = "list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"


@query(f"""
WITH x AS (SELECT item_id AS doc, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}') AS w FROM benchmark), t AS (SELECT doc, unnest({_GRAMS}) AS term FROM x), n AS (SELECT count(DISTINCT doc) AS n FROM t), tf AS (SELECT doc, term, count(*) AS tf FROM t GROUP BY ALL),
     df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), r AS (SELECT doc, term, tf * (ln((1 + n) / (1 + df)) + 1) AS raw FROM tf JOIN df USING (term), n), v AS (SELECT doc, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc)) AS w FROM r),
     c AS (SELECT x.doc AS a, y.doc AS b, round(least(1.0, greatest(0.0, sum(x.w * y.w))), 6) AS cosine FROM v x JOIN v y ON x.term = y.term AND x.doc <> y.doc GROUP BY ALL)
SELECT a, b, cosine, CAST(row_number() OVER (PARTITION BY a ORDER BY cosine DESC, b) AS INT) AS rank FROM c QUALIFY rank <= 3""")
def bigram_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with the most similar vectors of words and word pairs."""
    w = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc"), tx.tokens(F.col("text")).alias("w"))
    v = rank.tfidf(w.select("doc", F.explode(F.concat("w", tx.ngrams(F.col("w"), 2))).alias("term")), max_df=1.0)
    c = rank.sparse_cosine(v, v).filter("a <> b").withColumn("cosine", F.round("cosine", 6))
    return rank.top_per_group(c, ["a"], [F.desc("cosine"), F.col("b")], 3)


@query("""
WITH s AS (SELECT event_type AS instrument, value, event_id % 3 = 0 AS hit FROM events), r AS (SELECT *, rank() OVER (PARTITION BY instrument ORDER BY value) + (count(*) OVER (PARTITION BY instrument, value) - 1) / 2.0 AS k FROM s),
     a AS (SELECT instrument, (sum(CASE WHEN hit THEN k END) - count_if(hit) * (count_if(hit) + 1) / 2.0) / (count_if(hit) * count_if(NOT hit)) AS auc FROM r GROUP BY 1)
SELECT instrument, round(auc, 6) AS auc, row_number() OVER (ORDER BY round(abs(auc - 0.5), 6) DESC, instrument) = 1 AS chosen FROM a""")
def instrument_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The instrument that tells both groups best apart; equals go to the first name."""
    s = table(spark, sf_dir, "events").select(F.col("event_type").alias("instrument"), "value", (F.col("event_id") % 3 == 0).alias("hit"))
    a = rank.auc(s, "value", "hit", ["instrument"]).select("instrument", F.round("auc", 6).alias("auc"), F.round(F.abs(F.col("auc") - 0.5), 6).alias("gap"))
    best = a.agg(F.min(F.struct((-F.col("gap")).alias("g"), "instrument")).alias("b")).select(F.col("b.instrument").alias("best"))
    return a.crossJoin(F.broadcast(best)).select("instrument", "auc", (F.col("instrument") == F.col("best")).alias("chosen"))


@query("""
WITH b AS (SELECT event_id, event_type AS label FROM events ORDER BY event_id LIMIT 10), n AS (SELECT event_id, CASE WHEN event_id % 50 = 3 THEN 'changed' ELSE event_type END AS label FROM events)
SELECT count(*) AS canaries, count_if(b.label = n.label) AS agree, bool_and(b.label = n.label) AS passes FROM b JOIN n USING (event_id)""")
def canary_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten rows judged again must agree with their first labels, else the run stops; ten is the gate's own size."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type")
    first = e.orderBy("event_id").limit(10)
    again = e.select(F.col("event_id").alias("i"), F.when(F.col("event_id") % 50 == 3, "changed").otherwise(F.col("event_type")).alias("label"))
    same = F.col("event_type") == F.col("label")
    return first.join(again, F.col("event_id") == F.col("i")).agg(F.count("*").alias("canaries"), F.count_if(same).alias("agree"), F.bool_and(same).alias("passes"))


_EIG_ITEMS = "SELECT DISTINCT user_id AS p, length(event_type) * 7 + ascii(event_type) AS h, event_type AS item FROM events"


def _mass(seed: Column, n: int) -> Column:
    """A distribution over 1 to 5 from numbers."""
    mass = F.transform(F.sequence(F.lit(1), F.lit(5)), lambda k: (1 + F.pmod(seed * (k + n), F.lit(11))).cast("double"))
    return F.map_from_arrays(F.sequence(F.lit(1), F.lit(5)), F.transform(mass, lambda m: m / dist.total(mass)))


@query(f"""
WITH i AS ({_EIG_ITEMS}), b AS (SELECT p, item, h, list_transform(range(1, 6), lambda k: 1.0 + (p + h) * (k + 1) % 11) AS m FROM i), d AS (SELECT p, item, h, list_transform(m, lambda x: x / list_sum(m)) AS d FROM b),
     u AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY round(list_sum(list_transform(d, lambda x: -x * ln(x))), 9) DESC, item) AS r FROM d QUALIFY r <= 3),
     a AS (SELECT p, item, d, x.a, list_transform(range(1, 6), lambda k: 1.0 + (p * x.a + h) * (k + 1) % 11) AS am, list_transform(range(1, 6), lambda k: 1.0 + p * (k + 1) % 11) AS bm FROM u, (VALUES (1), (3), (5)) AS x(a)),
     s AS (SELECT p, item, a, d[a] AS w, list_sum(list_transform(range(1, 6), lambda k: abs(am[k] / list_sum(am) - bm[k] / list_sum(bm)))) / 2 AS v FROM a), g AS (SELECT p, item, round(sum(w * v) / sum(w), 6) AS score FROM s GROUP BY ALL)
SELECT p AS person_id, item, score FROM g QUALIFY row_number() OVER (PARTITION BY p ORDER BY score DESC, item) = 1""")
def information_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One round of asking the item whose answers would move beliefs most, of each person's three most uncertain ones."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("person_id"), F.col("event_type").alias("item")).distinct()
    h = F.length("item") * 7 + F.ascii("item")
    p = F.col("person_id")

    def shifted(asked: DataFrame, n: int) -> DataFrame:
        return asked.withColumns({"before": _mass(p, n), "after": _mass(p * F.col("answer") + h, n)})

    def beliefs(left: DataFrame, n: int) -> DataFrame:
        return left.withColumn("d", _mass(p + h, n))

    shown = adaptive.gain_rounds(beliefs, lambda a, n: shifted(a, n), e, 1, shortlist=3, scorer="entropy_9")
    return shown.withColumn("score", F.round("score", 6)).select("person_id", "item", "score")


@query("""
WITH c AS (SELECT user_id AS subject, event_id * 5 // 10000 % 5 AS bin, event_type AS item, avg(value) AS twin FROM events WHERE event_id % 2 = 0 GROUP BY ALL), i AS (SELECT user_id AS subject, event_type AS item, avg(value) AS imposter FROM events WHERE event_id % 2 = 1 GROUP BY ALL)
SELECT subject, bin, count(*) AS items, round(avg(twin), 8) AS twin, round(avg(imposter), 8) AS imposter FROM c JOIN i USING (subject, item) GROUP BY ALL""")
def imposter_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An item's imposter score serves every bin that its subject filled, over the same items only."""
    e = table(spark, sf_dir, "events").withColumns({"subject": F.col("user_id"), "item": F.col("event_type"), "bin": F.expr("event_id * 5 div 10000 % 5")})
    twin = e.filter("event_id % 2 = 0").groupBy("subject", "bin", "item").agg(F.avg("value").alias("twin"))
    other = e.filter("event_id % 2 = 1").groupBy("subject", "item").agg(F.avg("value").alias("imposter"))
    return twin.join(other, ["subject", "item"]).groupBy("subject", "bin").agg(F.count("*").alias("items"), F.round(F.avg("twin"), 8).alias("twin"), F.round(F.avg("imposter"), 8).alias("imposter"))


@query("""
WITH c AS (SELECT user_id AS subject, min(CASE WHEN value > 95 THEN event_id END) IS NOT NULL AS crosses, avg(value) AS level, count(*) AS n, count(DISTINCT event_type) AS kinds, max(value) - min(value) AS span FROM events GROUP BY 1),
     u AS (SELECT crosses, 'level' AS covariate, level AS v FROM c UNION ALL SELECT crosses, 'n', n FROM c UNION ALL SELECT crosses, 'kinds', kinds FROM c UNION ALL SELECT crosses, 'span', span FROM c)
SELECT crosses, covariate, count(*) AS subjects, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.5), 6) AS median FROM u GROUP BY ALL""")
def crossing_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjects that cross a level against those that don't: mean and median of four covariates."""
    v = F.col("value")
    c = table(spark, sf_dir, "events").groupBy("user_id").agg((F.count_if(v > 95) > 0).alias("crosses"), F.avg(v).alias("level"), F.count("*").cast("double").alias("n"), F.count_distinct("event_type").cast("double").alias("kinds"), (F.max(v) - F.min(v)).alias("span"))
    u = c.unpivot(["crosses"], ["level", "n", "kinds", "span"], "covariate", "v")
    return u.groupBy("crosses", "covariate").agg(F.count("*").alias("subjects"), F.round(F.avg("v"), 6).alias("mean"), F.round(F.percentile("v", F.lit(0.5)), 6).alias("median"))


@query("""
SELECT event_type AS model, event_id % 2 AS arm, count(*) AS n, count_if(event_id % 23 = 0) AS failed, round(count_if(event_id % 23 = 0) / count(*), 6) AS failed_share, count_if(value < 1) AS empty, round(avg(value), 6) AS mean_tokens, max(value) AS most_tokens, count_if(value > 90) AS truncated FROM events GROUP BY ALL""")
def generation_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of failures, empty and cut completions and their lengths, by model and arm."""
    v, failed = F.col("value"), F.count_if(F.col("event_id") % 23 == 0)
    g = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("model"), (F.col("event_id") % 2).alias("arm"))
    return g.agg(F.count("*").alias("n"), failed.alias("failed"), F.round(failed / F.count("*"), 6).alias("failed_share"), F.count_if(v < 1).alias("empty"), F.round(F.avg(v), 6).alias("mean_tokens"), F.max(v).alias("most_tokens"), F.count_if(v > 90).alias("truncated"))


@query("""
WITH w AS (SELECT len(list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda w: w <> '')) AS n FROM documents)
SELECT count(*) AS prompts, CAST(sum(n) AS BIGINT) AS words, CAST(ceil(sum(n) * 1.35) AS BIGINT) AS tokens, round(sum(n) * 1.35 / 2000 / 3600, 6) AS node_hours, CAST(count(*) * 48 AS BIGINT) AS calls FROM w""")
def projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run over all texts would take, from their lengths."""
    n = table(spark, sf_dir, "documents").select(tx.word_count(F.col("text")).alias("n"))
    tokens = F.sum("n") * 1.35
    return n.agg(F.count("*").alias("prompts"), F.sum("n").alias("words"), F.ceil(tokens).cast("long").alias("tokens"), F.round(tokens / 2000 / 3600, 6).alias("node_hours"), (F.count("*") * 48).alias("calls"))


@query("""
WITH k AS (SELECT id, CASE WHEN id % 5 = 2 THEN CAST(text AS INT) END AS said FROM {completions}), r AS (SELECT event_id AS id, CAST(1 + CAST(floor(value) AS BIGINT) % 7 AS INT) AS recorded FROM events WHERE event_id % 10 <> 7)
SELECT said, count(*) AS n, count(recorded) AS recorded, count_if(said = recorded) AS agree FROM k LEFT JOIN r USING (id) WHERE said IS NOT NULL GROUP BY said""")
def bench_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A histogram of answers, and how many agree with what was recorded under their index."""
    k = views.completions(spark, sf_dir).filter("id % 5 = 2").select("id", F.col("text").try_cast("int").alias("said"))
    r = table(spark, sf_dir, "events").filter("event_id % 10 <> 7").select(F.col("event_id").alias("id"), (1 + F.floor("value").cast("long") % 7).cast("int").alias("recorded"))
    return k.join(r, "id", "left").groupBy("said").agg(F.count("*").alias("n"), F.count("recorded").alias("recorded"), F.count_if(F.col("said") == F.col("recorded")).alias("agree"))


@query("""
SELECT event_type AS probe, count(*) AS n, round(stddev_samp(value), 6) AS spread, round(regr_slope(value, user_id), 6) AS slope, round(corr(value, user_id), 6) AS r, count(DISTINCT user_id % 10) AS seeds FROM events GROUP BY 1""")
def mechanism_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spread, slope and correlation of a probe's answers with its seeds."""
    g = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("probe"))
    return g.agg(F.count("*").alias("n"), F.round(F.stddev_samp("value"), 6).alias("spread"), F.round(F.regr_slope("value", "user_id"), 6).alias("slope"), F.round(F.corr("value", "user_id"), 6).alias("r"), F.count_distinct(F.col("user_id") % 10).alias("seeds"))


@query()
def split_half_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the greedy orders of two halves of the subjects agree (iterative fits)."""
    wide = table(spark, sf_dir, "events").groupBy("user_id").pivot("event_type").agg(F.avg("value")).na.fill(0.0)
    kinds = [c for c in wide.columns if c != "user_id"]
    t = wide.withColumn("target", F.col(kinds[0]) * 0.5 + F.col(kinds[-1]) * 0.2 + F.col("user_id") % 7)
    halves = [models.greedy_order(t.filter(F.col("user_id") % 2 == h), "user_id", kinds, ["target"], 3).select("feature", F.col("place").alias(f"place_{h}")) for h in (0, 1)]
    return halves[0].join(halves[1], "feature", "full")


@query("""
WITH r AS (SELECT user_id AS person_id, event_type AS item, count(*) AS n FROM events GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY n DESC, item) AS k FROM r),
     d AS (SELECT user_id AS person_id, lead(user_id) OVER (ORDER BY user_id) AS nxt, first_value(user_id) OVER (ORDER BY user_id) AS fst FROM (SELECT DISTINCT user_id FROM events)), f AS (SELECT person_id, coalesce(nxt, fst) AS donor FROM d),
     t AS (SELECT o.person_id, f.donor, c.k AS depth, o.k, o.item, x.n AS said FROM o JOIN f USING (person_id) JOIN (VALUES (1), (2), (4)) AS c(k) ON o.k <= c.k LEFT JOIN r x ON x.person_id = f.donor AND x.item = o.item)
SELECT person_id, donor, depth, string_agg(item || '=' || coalesce(CAST(said AS VARCHAR), '-'), ' ' ORDER BY k) AS shown FROM t GROUP BY ALL""")
def imposter_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks at several depths: the items that a person would show first, with a donor's answers to them."""
    r = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("person_id"), F.col("event_type").alias("item")).agg(F.count("*").alias("n"))
    own = r.groupBy("person_id").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "item"))), lambda s: s["item"]).alias("order"))
    placed = ranges.before(own.select("person_id"), [F.col("person_id")], "place")
    n = placed.count()
    donors = placed.join(placed.select(F.pmod(F.col("place") - 1, F.lit(max(n, 1))).alias("place"), F.col("person_id").alias("donor")), "place").select("person_id", "donor")
    said = r.groupBy(F.col("person_id").alias("donor")).agg(F.map_from_entries(F.collect_list(F.struct("item", F.col("n").cast("string")))).alias("said"))
    t = own.join(donors, "person_id").join(said, "donor").withColumn("depth", F.explode(F.array(F.lit(1), F.lit(2), F.lit(4))))
    shown = F.transform(F.slice("order", F.lit(1), F.col("depth")), lambda i: F.concat(i, F.lit("="), F.coalesce(F.try_element_at("said", i), F.lit("-"))))
    return t.select("person_id", "donor", "depth", F.array_join(shown, " ").alias("shown"))


@query("""
WITH i AS (SELECT DISTINCT user_id AS person_id, event_type AS item FROM events), f AS (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY item) % 2 AS fold FROM i)
SELECT person_id, t.fold, t.item AS target, coalesce((SELECT string_agg(s.item, ' ' ORDER BY s.item) FROM f s WHERE s.person_id = t.person_id AND s.fold <> t.fold), '') AS seen FROM f t""")
def known_answer_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item is asked with the other fold's answers seen."""
    i = table(spark, sf_dir, "events").select(F.col("user_id").alias("person_id"), F.col("event_type").alias("item")).distinct()
    every = i.groupBy("person_id").agg(F.array_sort(F.collect_list("item")).alias("all"))
    t = every.select("person_id", "all", F.posexplode("all").alias("at", "target"))
    seen = F.filter("all", lambda x, k: (k + 1) % 2 != (F.col("at") + 1) % 2)
    return t.select("person_id", ((F.col("at") + 1) % 2).cast("long").alias("fold"), "target", F.array_join(seen, " ").alias("seen"))


@query("""
SELECT person_id, item, arm, ev FROM {predictions} p WHERE NOT EXISTS (SELECT 1 FROM {predictions} b WHERE b.person_id = p.person_id AND b.item = p.item AND b.arm = 'baseline' AND NOT b.parse_failure AND b.argmax = b.truth)""")
def adversarial_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions without the items that the floor arm solved."""
    p = views.predictions(spark, sf_dir)
    solved = p.filter("arm = 'baseline' AND NOT parse_failure AND argmax = truth").select("person_id", "item")
    return p.join(solved, ["person_id", "item"], "left_anti").select("person_id", "item", "arm", "ev")


@query("SELECT person_id, item, arm, argmax FROM {predictions}")
def shipped_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What leaves the house: every column but the truth and what is derived from it."""
    hidden = {"truth", "ev", "parse_failure"}
    p = views.predictions(spark, sf_dir)
    return p.select(*[c for c in p.columns if c not in hidden])


@query("""
SELECT CASE arm WHEN 'twin' THEN 'model@ev' ELSE 'floor@argmax' END AS label, item, count(*) AS n, round(avg(CASE arm WHEN 'twin' THEN ev ELSE argmax END), 6) AS prediction FROM {predictions} WHERE person_id % 3 <> 0 GROUP BY ALL""")
def arm_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A slice of persons with arms under new names, each decoded its own way."""
    twin = F.col("arm") == "twin"
    p = views.predictions(spark, sf_dir).filter("person_id % 3 <> 0")
    return p.groupBy(F.when(twin, "model@ev").otherwise("floor@argmax").alias("label"), "item").agg(F.count("*").alias("n"), F.round(F.avg(F.when(twin, F.col("ev")).otherwise(F.col("argmax"))), 6).alias("prediction"))


@query("""
SELECT person_id, count(*) AS attempted, count_if(parse_failure) AS failed, count_if(NOT parse_failure) AS parsed, round(avg(CASE WHEN NOT parse_failure THEN CAST(argmax = truth AS INT) END), 6) AS accuracy FROM {predictions} GROUP BY 1""")
def accuracy_attempted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy over what parsed, beside what was tried."""
    bad = F.col("parse_failure")
    return views.predictions(spark, sf_dir).groupBy("person_id").agg(F.count("*").alias("attempted"), F.count_if(bad).alias("failed"), F.count_if(~bad).alias("parsed"), F.round(F.avg(F.when(~bad, (F.col("argmax") == F.col("truth")).cast("int"))), 6).alias("accuracy"))


@query("""
WITH l AS (SELECT user_id AS subject, event_id * 5 // 10000 % 5 AS bin, event_id % 2 AS arm, event_type = 'error' AS same FROM events), b AS (SELECT arm, bin, count(*) AS n, count_if(same) AS same FROM l GROUP BY ALL), r AS (SELECT arm, bin, n, same / n AS rate FROM b)
SELECT x.arm, x.bin, x.n, round(x.rate, 6) AS rate, round(x.rate - y.rate, 6) AS gap, round(x.rate - (SELECT sum(same) / sum(n) FROM b z WHERE z.arm = x.arm AND z.bin > 0), 6) AS over_rest FROM r x JOIN r y ON y.bin = x.bin AND y.arm <> x.arm""")
def label_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label's rate by bin and arm, its gap to the other arm, and to the arm's later bins together."""
    l = table(spark, sf_dir, "events").groupBy((F.col("event_id") % 2).alias("arm"), F.expr("event_id * 5 div 10000 % 5").alias("bin")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("same"))  # noqa: E741
    later = l.filter("bin > 0").groupBy(F.col("arm").alias("a")).agg((F.sum("same") / F.sum("n")).alias("rest"))
    other = l.select((1 - F.col("arm")).alias("arm"), "bin", (F.col("same") / F.col("n")).alias("theirs"))
    mine = F.col("same") / F.col("n")
    return l.join(other, ["arm", "bin"]).join(later, F.col("arm") == F.col("a"), "left").select("arm", "bin", "n", F.round(mine, 6).alias("rate"), F.round(mine - F.col("theirs"), 6).alias("gap"), F.round(mine - F.col("rest"), 6).alias("over_rest"))


@query("""
SELECT l_returnflag AS label, count(*) AS n, count_if(l_returnflag <> CASE WHEN l_quantity < 17 THEN 'A' WHEN l_quantity < 34 THEN 'N' ELSE 'R' END) AS overturned, round(count_if(l_returnflag <> CASE WHEN l_quantity < 17 THEN 'A' WHEN l_quantity < 34 THEN 'N' ELSE 'R' END) / count(*), 6) AS share FROM lineitem GROUP BY 1""")
def overturn_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the second rater overturns each label of the first."""
    second = F.when(F.col("l_quantity") < 17, "A").when(F.col("l_quantity") < 34, "N").otherwise("R")
    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("label")).agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") != second).alias("overturned"))
    return g.withColumn("share", F.round(F.col("overturned") / F.col("n"), 6))


@query("""
WITH w AS (SELECT l_orderkey, max(CASE WHEN l_linenumber = 1 THEN l_quantity END) AS a, max(CASE WHEN l_linenumber = 2 THEN l_quantity END) AS b, max(CASE WHEN l_linenumber = 3 THEN l_quantity END) AS c, max(CASE WHEN l_linenumber = 4 THEN l_quantity END) AS d FROM lineitem WHERE l_linenumber <= 4 GROUP BY 1),
     k AS (SELECT * FROM w WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL AND d IS NOT NULL), r AS (SELECT corr(a + c, b + d) AS r, (corr(a, b) + corr(a, c) + corr(a, d) + corr(b, c) + corr(b, d) + corr(c, d)) / 6 AS m, greatest(abs(corr(a, b)), abs(corr(a, c)), abs(corr(a, d)), abs(corr(b, c)), abs(corr(b, d)), abs(corr(c, d))) AS x FROM k)
SELECT round(r, 6) AS halves, round(2 * r / (1 + r), 6) AS spearman_brown, round(m, 6) AS mean_r, round(x, 6) AS largest FROM r""")
def split_half(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd against even items, corrected for length, and the items' correlations."""
    w = table(spark, sf_dir, "lineitem").filter("l_linenumber <= 4").groupBy("l_orderkey").pivot("l_linenumber", [1, 2, 3, 4]).agg(F.max("l_quantity")).toDF("person", "a", "b", "c", "d").na.drop()
    pairs = [F.corr(x, y) for x, y in combinations("abcd", 2)]
    one = w.agg(F.corr(F.col("a") + F.col("c"), F.col("b") + F.col("d")).alias("r"), (sum(pairs[1:], pairs[0]) / len(pairs)).alias("m"), F.greatest(*[F.abs(x) for x in pairs]).alias("x"))
    return one.select(F.round("r", 6).alias("halves"), F.round(2 * F.col("r") / (1 + F.col("r")), 6).alias("spearman_brown"), F.round("m", 6).alias("mean_r"), F.round("x", 6).alias("largest"))


@query("SELECT event_type, quantile_disc(value, 0.05) AS p5, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY 1")
def nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles that are values of the data."""
    at = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY value)")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(at(0.05).alias("p5"), at(0.5).alias("p50"), at(0.95).alias("p95"))


@query("SELECT event_id AS id, CASE WHEN value = 0 THEN 0 ELSE round(value / 7e5 * power(10, 3 - floor(log10(value / 7e5)))) END AS digits FROM events")
def significant_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four significant digits of small numbers."""
    v = F.col("value") / 7e5
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.when(F.col("value") == 0, 0.0).otherwise(F.round(v * F.pow(F.lit(10.0), 3 - F.floor(F.log10(v))))).alias("digits"))


@query("""
WITH c AS (SELECT subject, date, lag(date) OVER (PARTITION BY subject ORDER BY date, cluster) AS before, max(date) OVER (PARTITION BY subject) AS last FROM {clusters})
SELECT subject, count(*) AS clusters, max(date_diff('day', before, date)) AS longest_gap, date_diff('day', min(date), max(date)) AS span_days, count(DISTINCT CASE WHEN date_diff('day', date, last) >= 183 THEN least(date_diff('day', date, last) // 365, 3) END) AS bins, date_diff('day', min(date), max(date)) >= 365 AND count(*) >= 5 AS eligible FROM c GROUP BY 1""")
def chronology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each subject's gaps, span and filled bins."""
    w = Window.partitionBy("subject")
    c = views.clusters(spark, sf_dir).withColumns({"before": F.lag("date").over(w.orderBy("date", "cluster")), "last": F.max("date").over(w)})
    age = F.datediff("last", "date")
    span = F.datediff(F.max("date"), F.min("date")).cast("long")
    return c.groupBy("subject").agg(F.count("*").alias("clusters"), F.max(F.datediff("date", "before")).cast("long").alias("longest_gap"), span.alias("span_days"), F.count_distinct(F.when(age >= 183, F.least(F.floor(age / 365), F.lit(3)))).alias("bins"), ((span >= 365) & (F.count("*") >= 5)).alias("eligible"))
