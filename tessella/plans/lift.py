"""Paired lift: pair joins, histograms, item tables, exclusions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import pairing, rank
from tessella.plans.registry import query
from tessella.sources import views


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.pairs(views.predictions(spark, sf_dir), ["person_id", "item"], ["ev", "argmax", "truth", "parse_failure"], "twin", "baseline")


_PAIRS = "SELECT t.person_id, t.item, t.ev AS t_ev, b.ev AS b_ev, t.argmax AS t_arg, b.argmax AS b_arg, t.truth, t.parse_failure OR b.parse_failure AS failed FROM {predictions} t JOIN {predictions} b ON t.person_id = b.person_id AND t.item = b.item AND t.arm = 'twin' AND b.arm = 'baseline'"


@query(f"""
WITH p AS ({_PAIRS}),
     m AS (SELECT person_id, avg(abs(t_ev - truth)) AS t, avg(abs(b_ev - truth)) AS b, avg(CAST(abs(t_ev - truth) <= 1 AS INT)) AS tw, avg(CAST(abs(b_ev - truth) <= 1 AS INT)) AS bw,
                  avg(CAST(t_arg = truth AS INT)) AS te, avg(CAST(b_arg = truth AS INT)) AS be FROM p WHERE NOT failed GROUP BY person_id)
SELECT count(*) AS n_persons, round(avg(t), 6) AS twin_mae, round(avg(b), 6) AS baseline_mae, round(avg(b - t), 6) AS lift, round(stddev_samp(b - t), 6) AS lift_sd,
       round(stddev_samp(b - t) / sqrt(count(*)), 6) AS lift_se, round(avg(tw - bw), 6) AS within_one_lift, round(avg(te - be), 6) AS exact_lift FROM m""")
def paired_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pairs(spark, sf_dir).filter("NOT (better_parse_failure OR worse_parse_failure)")
    err = lambda side: F.abs(F.col(f"{side}_ev") - F.col("better_truth"))
    hit = lambda side: (F.col(f"{side}_argmax") == F.col("better_truth")).cast("int")
    m = p.groupBy("person_id").agg(
        F.avg(err("better")).alias("t"),
        F.avg(err("worse")).alias("b"),
        (F.avg((err("better") <= 1).cast("int")) - F.avg((err("worse") <= 1).cast("int"))).alias("within"),
        (F.avg(hit("better")) - F.avg(hit("worse"))).alias("exact"),
    )
    d = F.col("b") - F.col("t")
    r = lambda c: F.round(c, 6)
    return m.agg(
        F.count("*").alias("n_persons"),
        r(F.avg("t")).alias("twin_mae"),
        r(F.avg("b")).alias("baseline_mae"),
        r(F.avg(d)).alias("lift"),
        r(F.stddev_samp(d)).alias("lift_sd"),
        r(F.stddev_samp(d) / F.sqrt(F.count("*"))).alias("lift_se"),
        r(F.avg("within")).alias("within_one_lift"),
        r(F.avg("exact")).alias("exact_lift"),
    )


@query("""
WITH v AS (SELECT unnest(range(1, 8)) AS value), a AS (SELECT unnest(['twin', 'baseline']) AS arm),
     n AS (SELECT arm, least(7, greatest(1, CAST(floor(ev + 0.5) AS INT))) AS value, count(*) AS n FROM {predictions} WHERE NOT parse_failure GROUP BY ALL),
     t AS (SELECT arm, truth AS value, count(*) AS n FROM {predictions} WHERE NOT parse_failure GROUP BY ALL)
SELECT a.arm, CAST(v.value AS INT) AS value, coalesce(n.n, 0) AS predicted, coalesce(t.n, 0) AS actual FROM a CROSS JOIN v LEFT JOIN n ON n.arm = a.arm AND n.value = v.value LEFT JOIN t ON t.arm = a.arm AND t.value = v.value""")
def lift_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.functions.dist import round_half_up

    p = views.predictions(spark, sf_dir).filter("NOT parse_failure")
    both = p.select("arm", F.explode(F.array(F.struct(round_half_up(F.col("ev")).alias("value"), F.lit(1).alias("p"), F.lit(0).alias("t")), F.struct(F.col("truth").cast("int").alias("value"), F.lit(0).alias("p"), F.lit(1).alias("t")))).alias("x"))
    counts = both.groupBy("arm", "x.value").agg(F.sum("x.p").alias("predicted"), F.sum("x.t").alias("actual"))
    grid = spark.range(1).select(F.explode(F.array(F.lit("twin"), F.lit("baseline"))).alias("arm"), F.lit(0)).select("arm", F.explode(F.sequence(F.lit(1), F.lit(7))).alias("value"))
    return grid.join(counts, ["arm", "value"], "left").select("arm", "value", F.coalesce("predicted", F.lit(0)).alias("predicted"), F.coalesce("actual", F.lit(0)).alias("actual"))


@query(f"""
WITH p AS ({_PAIRS}) SELECT item, count(*) AS n, round(avg(abs(t_ev - truth)), 6) AS twin_mae, round(avg(abs(b_ev - truth)), 6) AS baseline_mae FROM p WHERE NOT failed GROUP BY item""")
def item_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pairs(spark, sf_dir).filter("NOT (better_parse_failure OR worse_parse_failure)")
    mae = lambda side: F.round(F.avg(F.abs(F.col(f"{side}_ev") - F.col("better_truth"))), 6)
    return p.groupBy("item").agg(F.count("*").alias("n"), mae("better").alias("twin_mae"), mae("worse").alias("baseline_mae")).orderBy("item")


@query("""
WITH t AS (SELECT * FROM {predictions} WHERE arm = 'twin'), b AS (SELECT * FROM {predictions} WHERE arm = 'baseline')
SELECT count(*) AS n_keys, count_if(t.person_id IS NULL OR b.person_id IS NULL) AS incomplete, count_if(t.parse_failure OR b.parse_failure) AS excluded,
       count_if(t.person_id IS NOT NULL AND b.person_id IS NOT NULL AND NOT t.parse_failure AND NOT b.parse_failure) AS kept
FROM t FULL JOIN b ON t.person_id = b.person_id AND t.item = b.item""")
def full_outer_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pairing.pairs(views.predictions(spark, sf_dir).withColumn("here", F.lit(True)), ["person_id", "item"], ["here", "parse_failure"], "twin", "baseline", how="full")
    both = F.col("better_here").isNotNull() & F.col("worse_here").isNotNull()
    failed = F.coalesce(F.col("better_parse_failure") | F.col("worse_parse_failure"), F.lit(False))
    return p.agg(F.count("*").alias("n_keys"), F.count_if(~both).alias("incomplete"), F.count_if(failed).alias("excluded"), F.count_if(both & ~F.col("better_parse_failure") & ~F.col("worse_parse_failure")).alias("kept"))


@query("""
SELECT person_id, round(max(CASE WHEN arm = 'twin' THEN m END), 6) AS twin, round(max(CASE WHEN arm = 'baseline' THEN m END), 6) AS baseline,
       round(max(CASE WHEN arm = 'twin' THEN m END) - max(CASE WHEN arm = 'baseline' THEN m END), 6) AS meter
FROM (SELECT person_id, arm, avg(CAST(argmax = truth AS INT)) AS m FROM {predictions} WHERE NOT parse_failure GROUP BY ALL) GROUP BY person_id""")
def contamination_meter(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.predictions(spark, sf_dir).filter("NOT parse_failure")
    m = p.groupBy("person_id").pivot("arm", ["twin", "baseline"]).agg(F.avg((F.col("argmax") == F.col("truth")).cast("int")))
    return m.select("person_id", F.round("twin", 6).alias("twin"), F.round("baseline", 6).alias("baseline"), F.round(F.col("twin") - F.col("baseline"), 6).alias("meter"))


@query("""
WITH p AS (SELECT * FROM {predictions} WHERE NOT parse_failure)
SELECT arm, count(*) AS n, round(avg(ev), 6) AS mean, round(stddev_samp(ev), 6) AS sd, round(min(ev), 6) AS least, round(max(ev), 6) AS most, round(stddev_pop(ev), 6) AS dispersion,
       count_if(abs(ev - truth) < abs(argmax - truth)) AS ev_closer, count_if(abs(ev - truth) > abs(argmax - truth)) AS argmax_closer FROM p GROUP BY arm""")
def arm_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.predictions(spark, sf_dir).filter("NOT parse_failure")
    e, a = F.abs(F.col("ev") - F.col("truth")), F.abs(F.col("argmax") - F.col("truth"))
    r = lambda c: F.round(c, 6)
    return p.groupBy("arm").agg(
        F.count("*").alias("n"), r(F.avg("ev")).alias("mean"), r(F.stddev_samp("ev")).alias("sd"), r(F.min("ev")).alias("least"), r(F.max("ev")).alias("most"), r(F.stddev_pop("ev")).alias("dispersion"), F.count_if(e < a).alias("ev_closer"), F.count_if(e > a).alias("argmax_closer")
    )


@query("""
WITH p AS (SELECT person_id, arm, ev, CAST(truth AS DOUBLE) + CAST(length(item) AS DOUBLE) AS x FROM {predictions}),
     r AS (SELECT *, rank() OVER (PARTITION BY person_id, arm ORDER BY ev) + (count(*) OVER (PARTITION BY person_id, arm, ev) - 1) / 2.0 AS re,
                  rank() OVER (PARTITION BY person_id, arm ORDER BY x) + (count(*) OVER (PARTITION BY person_id, arm, x) - 1) / 2.0 AS rx FROM p)
SELECT person_id, arm, round(CASE WHEN count(DISTINCT ev) > 1 AND count(DISTINCT x) > 1 THEN corr(re, rx) END, 5) AS spearman FROM r GROUP BY ALL""")
def corr_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.predictions(spark, sf_dir).withColumn("x", F.col("truth").cast("double") + F.length("item"))
    r = rank.mid_rank(rank.mid_rank(p, "ev", ["person_id", "arm"], "re"), "x", ["person_id", "arm"], "rx")
    varied = (F.count_distinct("ev") > 1) & (F.count_distinct("x") > 1)
    return r.groupBy("person_id", "arm").agg(F.round(F.when(varied, F.corr("re", "rx")), 5).alias("spearman"))
