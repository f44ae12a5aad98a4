"""Contrasts, resampling, calibration, selection and the adaptive loop."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import dist
from tessella.operators import adaptive, calib, models, pairing, stats
from tessella.plans.registry import query
from tessella.runtime import table
from tessella.sources import views

_DIFF = """SELECT t.person_id, avg(abs(b.ev - b.truth)) - avg(abs(t.ev - t.truth)) AS diff FROM {predictions} t JOIN {predictions} b ON t.person_id = b.person_id AND t.item = b.item AND t.arm = 'twin' AND b.arm = 'baseline'
     WHERE NOT t.parse_failure AND NOT b.parse_failure GROUP BY t.person_id"""


def _diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pairing.pairs(views.predictions(spark, sf_dir), ["person_id", "item"], ["ev", "truth", "parse_failure"], "twin", "baseline").filter("NOT (better_parse_failure OR worse_parse_failure)")
    err = lambda side: F.avg(F.abs(F.col(f"{side}_ev") - F.col(f"{side}_truth")))
    return p.groupBy("person_id").agg((err("worse") - err("better")).alias("diff"))


@query(f"""
WITH d AS ({_DIFF}), r AS (SELECT *, rank() OVER (ORDER BY abs(diff)) + (count(*) OVER (PARTITION BY abs(diff)) - 1) / 2.0 AS k FROM d WHERE diff <> 0)
SELECT count(*) AS n, round(avg(diff), 6) AS mean, round(quantile_cont(diff, 0.5), 6) AS median, round(stddev_samp(diff), 6) AS sd, round(avg(diff) / stddev_samp(diff), 6) AS dz, count_if(diff > 0) AS n_up, count_if(diff < 0) AS n_down,
       round(avg(diff) / (stddev_samp(diff) / sqrt(count(*))), 5) AS t, (SELECT round(sum(k), 1) FROM r WHERE diff > 0) AS w_plus FROM d""")
def contrast_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = stats.contrast(_diffs(spark, sf_dir), "diff")
    r = lambda x, k=6: F.round(x, k).alias(x)
    return c.select("n", r("mean"), r("median"), r("sd"), r("dz"), "n_up", "n_down", r("t", 5), r("w_plus", 1))


#: Simpson's rule over 2,000 steps from 0 to a bound: the area under Student's density with f degrees of freedom, and under the normal one.
_SIMPSON = "sum((CASE WHEN k IN (0, 2000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) * {density}) * ({bound}) / 6000"
_T_AREA = _SIMPSON.replace("{density}", "exp(lgamma((f + 1) / 2) - lgamma(f / 2)) / sqrt(f * pi()) * pow(1 + pow(({bound}) * k / 2000, 2) / f, -(f + 1) / 2)")
_Z_AREA = _SIMPSON.replace("{density}", "exp(-pow(({bound}) * k / 2000, 2) / 2) / sqrt(2 * pi())")


@query(f"""
WITH RECURSIVE d AS ({_DIFF}), r AS (SELECT *, rank() OVER (ORDER BY abs(diff)) + (count(*) OVER (PARTITION BY abs(diff)) - 1) / 2.0 AS k, count(*) OVER (PARTITION BY abs(diff)) AS ties FROM d WHERE diff <> 0),
     w AS (SELECT count(*) AS m, sum(CASE WHEN diff > 0 THEN k END) AS w_plus, sum(ties * ties - 1) AS t3 FROM r), o AS (SELECT count(*) AS n, avg(diff) AS mean, stddev_samp(diff) AS sd, stddev_samp(diff) / sqrt(count(*)) AS se, CAST(count(*) - 1 AS DOUBLE) AS f FROM d),
     s AS (SELECT unnest(range(0, 2001)) AS k), z AS (SELECT abs((w_plus - m * (m + 1) / 4.0) / sqrt(m * (m + 1) * (2 * m + 1) / 24.0 - t3 / 48.0)) AS z FROM w),
     q(i, lo, hi) AS (SELECT 0, 0.0::DOUBLE, 60.0::DOUBLE UNION ALL SELECT i + 1, CASE WHEN area < 0.475 THEN (lo + hi) / 2 ELSE lo END, CASE WHEN area < 0.475 THEN hi ELSE (lo + hi) / 2 END
         FROM (SELECT i, lo, hi, {_T_AREA.replace("{bound}", "(lo + hi) / 2")} AS area FROM q, o, s WHERE i < 45 GROUP BY i, lo, hi)),
     c AS (SELECT hi AS half FROM q WHERE i = 45), pt AS (SELECT 1 - 2 * ({_T_AREA.replace("{bound}", "abs(mean / se)")}) AS p FROM o, s GROUP BY mean, se), pz AS (SELECT 1 - 2 * ({_Z_AREA.replace("{bound}", "z")}) AS p FROM z, s GROUP BY z),
     x AS (SELECT m, w_plus, t3 = 0 AND m = n AND n <= 50 AS exact FROM w, o), y(r, ways) AS (SELECT 0, [1.0::DOUBLE] UNION ALL SELECT r + 1, list_transform(range(0, len(ways) + r + 1), lambda i: CASE WHEN i < len(ways) THEN ways[i + 1] ELSE 0 END + CASE WHEN i > r THEN ways[i - r] ELSE 0 END) FROM y, x WHERE exact AND r < m),
     e AS (SELECT least(1.0, 2 * list_sum(ways[1 : CAST(least(w_plus, m * (m + 1) / 2 - w_plus) AS INT) + 1]) / pow(2, m)) AS p FROM y, x WHERE r = m)
SELECT n, round(mean, 6) AS mean, round(mean - half * se, 5) AS ci_low, round(mean + half * se, 5) AS ci_high, round(pt.p, 5) AS p_t, round(CASE WHEN exact THEN (SELECT p FROM e) ELSE pz.p END, 5) AS p_wilcoxon FROM o, c, pt, pz, x""")
def contrast_p_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contrast with its interval and p-values; the SQL finds areas by Simpson's rule and counts subsets of ranks where these are few."""
    r = stats.with_p_values(stats.contrast(_diffs(spark, sf_dir), "diff"))
    return r.select("n", F.round("mean", 6).alias("mean"), *[F.round(c, 5).alias(c) for c in ("ci_low", "ci_high", "p_t", "p_wilcoxon")])


SEED = 20260728

#: A subject's number of draws in each replicate, and its sign in each, from hexadecimal digests of 16 numbers and 256 bits.
_COUNTS = f"SELECT s, x, n, word * 16 + i AS replicate, list_sum(list_transform({stats.POISSON}, lambda t: CAST(('0x' || h[4 * i + 1 : 4 * i + 4])::INT >= t AS INT))) AS w FROM (SELECT s, x, n, word, sha256('{SEED}|' || s || '|' || word) AS h FROM d, (SELECT unnest(range(0, 625)) AS word)), (SELECT unnest(range(0, 16)) AS i)"
_MEANS = f"c AS ({_COUNTS}), m AS (SELECT replicate, sum(w * x) / sum(w * n) AS mean FROM c GROUP BY replicate HAVING sum(w * n) > 0) SELECT round(quantile_cont(mean, 0.025), 6) AS low, round(quantile_cont(mean, 0.975), 6) AS high FROM m"


@query(f"WITH d AS (SELECT person_id AS s, diff AS x, 1 AS n FROM ({_DIFF})), {_MEANS}")
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentile interval of the mean lift over 10,000 replicates."""
    ci = stats.bootstrap(_diffs(spark, sf_dir), "diff", "person_id", seed=SEED)
    return ci.select(F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


_BOTH = "SELECT t.person_id, t.item, abs(b.ev - b.truth) - abs(t.ev - t.truth) AS d FROM {predictions} t JOIN {predictions} b ON t.person_id = b.person_id AND t.item = b.item AND t.arm = 'twin' AND b.arm = 'baseline' WHERE NOT t.parse_failure AND NOT b.parse_failure"


@query(f"WITH d AS (SELECT person_id AS s, sum(d) AS x, count(*) AS n FROM ({_BOTH}) GROUP BY 1), {_MEANS}")
def cluster_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval of a mean over items where subjects are drawn."""
    p = pairing.pairs(views.predictions(spark, sf_dir), ["person_id", "item"], ["ev", "truth", "parse_failure"], "twin", "baseline").filter("NOT better_parse_failure AND NOT worse_parse_failure")
    d = p.withColumn("d", F.abs(F.col("worse_ev") - F.col("worse_truth")) - F.abs(F.col("better_ev") - F.col("better_truth")))
    ci = stats.bootstrap(d.groupBy("person_id").agg(F.sum("d").alias("total"), F.count("*").alias("items")), "total", "person_id", seed=SEED, size="items")
    return ci.select(F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query(f"""
WITH d AS ({_DIFF}), h AS (SELECT diff, word, sha256('{SEED}|' || person_id || '|' || word) AS h FROM d, (SELECT unnest(range(0, 79)) AS word)),
     b AS (SELECT word * 256 + i AS draw, sum(CASE WHEN (('0x' || h[i // 4 + 1])::INT >> (3 - i % 4)) & 1 = 1 THEN diff ELSE -diff END) AS total FROM h, (SELECT unnest(range(0, 256)) AS i) GROUP BY ALL), o AS (SELECT abs(sum(diff)) AS seen FROM d)
SELECT round((1 + count_if(abs(total) >= seen - 1e-12)) / 20001, 6) AS p FROM b, o WHERE draw < 20000""")
def signflip_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign-flip permutation p over 20,000 draws."""
    return stats.signflip(_diffs(spark, sf_dir), "diff", "person_id", seed=SEED).select(F.round("p", 6).alias("p"))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    conf = F.least(F.lit(1.0), F.floor("value") / 100)
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("subject"), conf.alias("conf"), ((F.col("event_id") % 3 == 0) | (F.col("value") > 60)).alias("hit"))


def _refit(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    s = _scored(spark, sf_dir)
    fitted = models.calibrated(s, "id", "subject", "conf", "hit", kind, fold=F.col("subject") % 5)
    # Rounded before it is put into bins, so that a value on an edge falls on one side.
    j = s.join(fitted.withColumnRenamed("key", "id"), "id").withColumn("calibrated", F.round("calibrated", 6))
    return calib.errors(calib.equal_width(j, "calibrated", 10), "calibrated", "hit")


_SCORED = "WITH s AS (SELECT event_id AS id, user_id % 5 AS own, least(1.0, floor(value) / 100) AS x, CAST(event_id % 3 = 0 OR value > 60 AS INT) AS y FROM events), c AS (SELECT own, x, CAST(count(*) AS DOUBLE) AS n, CAST(sum(y) AS DOUBLE) AS up FROM s GROUP BY ALL), f AS (SELECT unnest(range(0, 5)) AS fold)"
_ERRORS = """, b AS (SELECT least(floor(p * 10), 9) AS bin, count(*) AS n, abs(avg(p) - avg(y)) AS gap, sum((p - y) * (p - y)) AS sq FROM j GROUP BY 1)
SELECT round(sum(n * gap) / sum(n), 6) AS ece, round(max(gap), 6) AS mce, round(sum(sq) / sum(n), 6) AS brier FROM b"""


def _newton(rounds: int) -> str:
    """Newton steps of a logistic curve in one table expression each."""
    steps = []
    for i in range(rounds):
        steps.append(f"""z{i} AS (SELECT fold, a, b, x, n * (1 / (1 + exp(-greatest(least(a * x + b, 30), -30)))) AS np, n * (1 / (1 + exp(-greatest(least(a * x + b, 30), -30)))) * (1 - 1 / (1 + exp(-greatest(least(a * x + b, 30), -30)))) AS v, up * hi + (n - up) * lo AS t FROM b{i} JOIN w USING (fold)),
     g{i} AS (SELECT fold, a, b, sum((t - np) * x) AS g1, sum(t - np) AS g2, sum(v * x * x) + 1e-9 AS h11, sum(v * x) AS h12, sum(v) + 1e-9 AS h22 FROM z{i} GROUP BY ALL),
     b{i + 1} AS (SELECT fold, a + (h22 * g1 - h12 * g2) / (h11 * h22 - h12 * h12) AS a, b + (h11 * g2 - h12 * g1) / (h11 * h22 - h12 * h12) AS b FROM g{i})""")
    return ", ".join(steps)


@query(f"""
{_SCORED}, k AS (SELECT fold, sum(n) AS n, sum(up) AS up FROM f JOIN c ON c.own <> f.fold GROUP BY fold), w AS (SELECT f.fold, x, c.n, c.up, (k.up + 1) / (k.up + 2) AS hi, 1 / (k.n - k.up + 2) AS lo FROM f JOIN c ON c.own <> f.fold JOIN k ON k.fold = f.fold),
     b0 AS (SELECT fold, 0.0::DOUBLE AS a, ln((up + 1) / (n - up + 1)) AS b FROM k), {_newton(12)}, j AS (SELECT s.y, round(1 / (1 + exp(-(b12.a * s.x + b12.b))), 6) AS p FROM s JOIN b12 ON b12.fold = s.own){_ERRORS}""")
def platt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibration errors after a cross-fitted logistic map; the SQL spells out its Newton steps."""
    return _refit(spark, sf_dir, "platt")


@query(f"""
{_SCORED}, t AS (SELECT fold, x, sum(n) AS n, sum(up) AS up FROM f JOIN c ON c.own <> f.fold GROUP BY ALL), r AS (SELECT *, sum(n) OVER w AS cn, sum(up) OVER w AS cu, row_number() OVER w AS i FROM t WINDOW w AS (PARTITION BY fold ORDER BY x)),
     m AS (SELECT j.fold, j.i AS j, k.i AS k, (k.cu - j.cu + j.up) / (k.cn - j.cn + j.n) AS avg FROM r j JOIN r k ON k.fold = j.fold AND k.i >= j.i), l AS (SELECT m.fold, r.i, m.j, min(m.avg) AS low FROM m JOIN r ON r.fold = m.fold AND m.j <= r.i AND m.k >= r.i GROUP BY ALL),
     g AS (SELECT l.fold, r.x, max(low) AS level FROM l JOIN r ON r.fold = l.fold AND r.i = l.i GROUP BY l.fold, r.x), u AS (SELECT own, x, coalesce((SELECT arg_min(level, g.x) FROM g WHERE g.fold = c.own AND g.x >= c.x), (SELECT arg_max(level, g.x) FROM g WHERE g.fold = c.own)) AS p FROM c),
     j AS (SELECT s.y, round(u.p, 6) AS p FROM s JOIN u ON u.own = s.own AND u.x = s.x){_ERRORS}""")
def isotonic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibration errors after a cross-fitted rising step map; the SQL takes the largest of the least averages."""
    return _refit(spark, sf_dir, "isotonic")


@query()
def ridge_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order in which event types best predict a customer-sized target (greedy, iterative)."""
    wide = table(spark, sf_dir, "events").groupBy("user_id").pivot("event_type").agg(F.avg("value")).na.fill(0.0)
    kinds = [c for c in wide.columns if c != "user_id"]
    t = wide.withColumn("target", F.col(kinds[0]) * 0.5 + F.col(kinds[-1]) * 0.2 + F.col("user_id") % 7)
    return models.greedy_order(t, "user_id", kinds, ["target"], 4)


def _round(n: int) -> str:
    """A round in SQL: entropies of what is left, the largest, and of equals the one that a digest names."""
    shown = " UNION ALL ".join(f"SELECT p, item FROM r{i}" for i in range(1, n))
    left = f"SELECT * FROM i WHERE (p, item) NOT IN ({shown})" if shown else "SELECT * FROM i"
    return f"""l{n} AS ({left}), m{n} AS (SELECT p, item, list_transform(range(1, 6), lambda k: 1.0 + (p + h) * (k + {n}) % 11) AS m FROM l{n}),
     e{n} AS (SELECT p, item, round(list_sum(list_transform(m, lambda x: -(x / list_sum(m)) * ln(x / list_sum(m)))), 9) AS score FROM m{n}), x{n} AS (SELECT * FROM e{n} QUALIFY score = max(score) OVER (PARTITION BY p)),
     q{n} AS (SELECT *, count(*) OVER (PARTITION BY p) AS tied, row_number() OVER (PARTITION BY p ORDER BY item) AS k FROM x{n}), r{n} AS (SELECT p, {n} AS round, item, score, tied FROM q{n} WHERE k = CAST(('0x' || sha256('71|' || p || '|{n}')[1:16])::UBIGINT % tied AS INT) + 1)"""


@query(f"""
WITH i AS (SELECT DISTINCT user_id AS p, event_type AS item, length(event_type) * 7 + ascii(event_type) AS h FROM events), {", ".join(_round(n) for n in (1, 2, 3))}
SELECT p AS person_id, round, item, score, tied FROM (SELECT * FROM r1 UNION ALL SELECT * FROM r2 UNION ALL SELECT * FROM r3)""")
def adaptive_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three rounds of asking each person the item of highest entropy, ties by a seeded digest."""
    items = table(spark, sf_dir, "events").select(F.col("user_id").alias("person_id"), F.col("event_type").alias("item")).distinct()

    def beliefs(left: DataFrame, n: int) -> DataFrame:
        seed = F.col("person_id") + F.length("item") * 7 + F.ascii("item")
        mass = F.transform(F.sequence(F.lit(1), F.lit(5)), lambda k: (1 + F.pmod(seed * (k + n), F.lit(11))).cast("double"))
        return left.withColumn("d", F.map_from_arrays(F.sequence(F.lit(1), F.lit(5)), F.transform(mass, lambda m: m / dist.total(mass))))

    return adaptive.rounds(beliefs, items, 3, scorer="entropy_9", seed=71)


@query("""
WITH s AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), full_rounds AS (SELECT event_type, count(DISTINCT user_id) AS n FROM s GROUP BY 1)
SELECT event_type, n AS persons, n = (SELECT count(DISTINCT user_id) FROM events) AS complete FROM full_rounds""")
def resume_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    every = e.agg(F.count_distinct("user_id").alias("n_all"))
    per = e.groupBy("event_type").agg(F.count_distinct("user_id").alias("persons"))
    return per.crossJoin(F.broadcast(every)).select("event_type", "persons", (F.col("persons") == F.col("n_all")).alias("complete"))
