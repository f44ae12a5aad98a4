"""Aggregation queries: rollups, pivots, bins, agreement, grouping sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions import dist
from tessella.operators import calib, rank
from tessella.plans.registry import query
from tessella.runtime import table
from tessella.sources import views


@query("""
WITH g AS (SELECT subject, date, count(*) AS n, CAST(sum(words) AS BIGINT) AS words FROM {clusters} GROUP BY ALL)
SELECT subject, CAST(sum(n) AS BIGINT) AS clusters, CAST(sum(words) AS BIGINT) AS words, min(date) AS first_date, max(date) AS last_date, date_diff('day', min(date), max(date)) AS span, count(*) AS dates, count_if(words >= 200000) AS substantive FROM g GROUP BY subject""")
def guest_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = views.clusters(spark, sf_dir).groupBy("subject", "date").agg(F.count("*").alias("n"), F.sum("words").alias("words"))
    return g.groupBy("subject").agg(
        F.sum("n").alias("clusters"),
        F.sum("words").alias("words"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        F.datediff(F.max("date"), F.min("date")).cast("long").alias("span"),
        F.count("*").alias("dates"),
        F.count_if(F.col("words") >= 200000).alias("substantive"),
    )


@query("SELECT l_partkey AS part, count(DISTINCT l_orderkey) AS orders FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_orderkey) <= 28")
def having_catchall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("part")).agg(F.count_distinct("l_orderkey").alias("orders")).filter("orders <= 28")


@query("SELECT CASE WHEN n < 5 THEN CAST(n AS VARCHAR) ELSE '5+' END AS bucket, count(*) AS orders FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) GROUP BY 1")
def open_bucket_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return n.groupBy(F.when(F.col("n") < 5, F.col("n").cast("string")).otherwise("5+").alias("bucket")).agg(F.count("*").alias("orders"))


@query("""
SELECT o_custkey AS subject, array_to_string(list_sort(list_distinct(list(o_orderpriority))), ';') AS priorities, array_to_string(list_sort(list_distinct(list(o_orderpriority)))[1:3], ';') AS top_three,
       string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderdate, o_orderkey) AS provenance FROM orders GROUP BY 1""")
def group_concat_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array_sort(F.collect_set("o_orderpriority"))
    ordered = F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey")))
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("subject")).agg(
        F.array_join(names, ";").alias("priorities"), F.array_join(F.slice(names, 1, 3), ";").alias("top_three"), F.array_join(F.transform(ordered, lambda s: s["o_orderkey"].cast("string")), ",").alias("provenance")
    )


@query("SELECT l_suppkey AS supplier, count(*) - count(DISTINCT l_partkey) AS collapsed, round(avg(CAST(l_returnflag = 'R' AS INT)), 6) AS returned FROM lineitem GROUP BY 1")
def distinct_minus_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("supplier")).agg((F.count("*") - F.count_distinct("l_partkey")).alias("collapsed"), F.round(F.avg((F.col("l_returnflag") == "R").cast("int")), 6).alias("returned"))


@query("""
SELECT l_linestatus AS arm, count_if(l_returnflag = 'A') AS n_same, count_if(l_returnflag = 'R') AS n_different, count_if(l_returnflag = 'N') AS n_unclear,
       round(count_if(l_returnflag = 'A') / nullif(count_if(l_returnflag IN ('A', 'R')), 0), 6) AS same_rate, round(count_if(l_returnflag = 'N') / count(*), 6) AS unclear_rate FROM lineitem GROUP BY 1""")
def label_pivot_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linestatus").alias("arm")).pivot("l_returnflag", ["A", "R", "N"]).count().na.fill(0)
    rate = lambda a, b: F.round(F.try_divide(a, b), 6)
    return p.select("arm", F.col("A").alias("n_same"), F.col("R").alias("n_different"), F.col("N").alias("n_unclear"), rate(F.col("A"), F.col("A") + F.col("R")).alias("same_rate"), rate(F.col("N"), F.col("A") + F.col("R") + F.col("N")).alias("unclear_rate"))


@query("""
SELECT event_type, CAST(floor(value / 25) AS BIGINT) AS bin, count(*) AS n, round(avg(value), 6) AS mean, grouping(event_type) AS g_type, grouping(CAST(floor(value / 25) AS BIGINT)) AS g_bin
FROM events GROUP BY GROUPING SETS ((event_type, CAST(floor(value / 25) AS BIGINT)), (event_type), ())""")
def grouping_sets_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_type", F.floor(F.col("value") / 25).cast("long").alias("bin"), "value")
    sets = e.groupingSets([["event_type", "bin"], ["event_type"], []], "event_type", "bin")
    return sets.agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.grouping("event_type").cast("long").alias("g_type"), F.grouping("bin").cast("long").alias("g_bin"))


@query("SELECT l_returnflag AS flag, l_linestatus AS status, grouping(l_returnflag, l_linestatus) AS level, count(*) AS n, CAST(sum(l_quantity) AS DOUBLE) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), "l_quantity").cube("flag", "status").agg(F.grouping_id().alias("level"), F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


@query("SELECT r_name AS region, n_name AS nation, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")
def rollup_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return c.rollup(F.col("r_name").alias("region"), F.col("n_name").alias("nation")).agg(F.count("*").alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


_CONF = "SELECT event_id AS id, user_id AS subject, least(1.0, value / 100) AS conf, event_id % 3 = 0 OR value > 60 AS hit FROM events"


def _conf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("subject"), F.least(F.lit(1.0), F.col("value") / 100).alias("conf"), ((F.col("event_id") % 3 == 0) | (F.col("value") > 60)).alias("hit"))


@query(f"SELECT CAST(least(floor(conf * 10), 9) AS INT) AS bin, count(*) AS n, round(avg(conf), 6) AS mean_conf, round(avg(CAST(hit AS INT)), 6) AS rate FROM ({_CONF}) GROUP BY 1")
def reliability_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calib.bins(calib.equal_width(_conf(spark, sf_dir), "conf", 10), "conf", "hit")


@query(f"""
WITH b AS (SELECT *, ntile(10) OVER (ORDER BY conf, id) - 1 AS bin FROM ({_CONF})), t AS (SELECT bin, count(*) AS n, avg(conf) AS c, avg(CAST(hit AS INT)) AS r FROM b GROUP BY bin)
SELECT (SELECT round(sum(n * abs(c - r)) / sum(n), 6) FROM t) AS ece, (SELECT round(max(abs(c - r)), 6) FROM t) AS mce, (SELECT round(avg((conf - CAST(hit AS INT)) ** 2), 6) FROM b) AS brier""")
def ece_equal_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calib.errors(calib.equal_mass(_conf(spark, sf_dir), "conf", "id", 10), "conf", "hit")


@query(f"""
WITH r AS (SELECT subject, hit, rank() OVER (PARTITION BY subject ORDER BY conf) + (count(*) OVER (PARTITION BY subject, conf) - 1) / 2.0 AS k FROM ({_CONF}))
SELECT subject, round(CASE WHEN count_if(hit) > 0 AND count_if(NOT hit) > 0 THEN (sum(CASE WHEN hit THEN k END) - count_if(hit) * (count_if(hit) + 1) / 2.0) / (count_if(hit) * count_if(NOT hit)) END, 6) AS auc, count_if(hit) AS n_pos, count_if(NOT hit) AS n_neg FROM r GROUP BY subject""")
def midrank_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.auc(_conf(spark, sf_dir), "conf", "hit", ["subject"]).withColumn("auc", F.round("auc", 6))


@query("""
WITH p AS (SELECT l_returnflag AS a, CASE WHEN l_quantity < 17 THEN 'A' WHEN l_quantity < 34 THEN 'N' ELSE 'R' END AS b FROM lineitem), n AS (SELECT count(*) AS n, avg(CAST(a = b AS INT)) AS po FROM p),
     m AS (SELECT l, sum(x) AS x, sum(y) AS y FROM (SELECT a AS l, 1 AS x, 0 AS y FROM p UNION ALL SELECT b, 0, 1 FROM p) GROUP BY l), e AS (SELECT sum(x * y) / any_value(n * n) AS pe FROM m, n)
SELECT n, round(po, 6) AS observed, round(pe, 6) AS expected, round((po - pe) / (1 - pe), 6) AS kappa FROM n, e""")
def kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("a"), F.when(F.col("l_quantity") < 17, "A").when(F.col("l_quantity") < 34, "N").otherwise("R").alias("b"))
    return calib.kappa(p, "a", "b")


@query("""
WITH q AS (SELECT 0.0 AS lo, min(value) AS a, max(value) AS b FROM events UNION ALL SELECT 0.05, quantile_cont(value, 0.05), quantile_cont(value, 0.95) FROM events UNION ALL SELECT 0.1, quantile_cont(value, 0.1), quantile_cont(value, 0.9) FROM events)
SELECT CAST(lo AS DOUBLE) AS lo, event_type, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.9), 6) AS p90 FROM events JOIN q ON value BETWEEN a AND b GROUP BY lo, event_type""")
def percentile_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_type", "value")
    ends = e.agg(*[F.percentile("value", F.lit(p)).alias(f"q{i}") for i, p in enumerate((0.0, 0.05, 0.1, 0.9, 0.95, 1.0))])
    rules = ends.select(F.inline(F.array(*[F.struct(F.lit(lo).alias("lo"), F.col(a).alias("a"), F.col(b).alias("b")) for lo, a, b in ((0.0, "q0", "q5"), (0.05, "q1", "q4"), (0.1, "q2", "q3"))])))
    return e.join(F.broadcast(rules), F.col("value").between(F.col("a"), F.col("b"))).groupBy("lo", "event_type").agg(F.count("*").alias("n"), F.round(F.percentile("value", F.lit(0.5)), 6).alias("median"), F.round(F.percentile("value", F.lit(0.9)), 6).alias("p90"))


@query("""
SELECT event_type, count(*) AS calls, round(sum(CASE WHEN event_id % 2 = 0 THEN value END), 2) AS spend_a, round(sum(CASE WHEN event_id % 2 = 1 THEN value END), 2) AS spend_b, count(DISTINCT user_id) AS people, CAST(sum(CAST(props->>'$.k' AS BIGINT)) AS BIGINT) AS tokens FROM events GROUP BY 1""")
def cost_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    spend = lambda r: F.round(F.sum(F.when(F.col("event_id") % 2 == r, F.col("value"))), 2)
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("calls"), spend(0).alias("spend_a"), spend(1).alias("spend_b"), F.count_distinct("user_id").alias("people"), F.sum(k).alias("tokens"))


@query("SELECT CAST(props->>'$.k' AS BIGINT) AS k, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = F.from_json("props", "k BIGINT")
    return table(spark, sf_dir, "events").select(parsed["k"].alias("k"), "value").groupBy("k").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query("""
SELECT user_id AS subject, round(CASE WHEN count(DISTINCT event_id % 5) >= 2 THEN regr_slope(value, event_id % 5) END, 5) AS slope, round(regr_intercept(value, event_id % 5), 5) AS intercept, round(corr(value, event_id % 5), 5) AS r FROM events GROUP BY 1""")
def regr_slope_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("event_id") % 5
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("subject")).agg(
        F.round(F.when(F.count_distinct(x) >= 2, F.regr_slope("value", x)), 5).alias("slope"), F.round(F.regr_intercept("value", x), 5).alias("intercept"), F.round(F.corr("value", x.cast("double")), 5).alias("r")
    )


@query("""
WITH s AS (SELECT user_id, count_if(event_type = 'click') AS k, count(*) AS n FROM events GROUP BY 1)
SELECT user_id, k, n, round((CAST(k AS DOUBLE) / n + 1.96 * 1.96 / (2 * n)) / (1 + 1.96 * 1.96 / n) - 1.96 * sqrt(CAST(k AS DOUBLE) / n * (1 - CAST(k AS DOUBLE) / n) / n + 1.96 * 1.96 / (4 * n * n)) / (1 + 1.96 * 1.96 / n), 6) AS low,
       round((CAST(k AS DOUBLE) / n + 1.96 * 1.96 / (2 * n)) / (1 + 1.96 * 1.96 / n) + 1.96 * sqrt(CAST(k AS DOUBLE) / n * (1 - CAST(k AS DOUBLE) / n) / n + 1.96 * 1.96 / (4 * n * n)) / (1 + 1.96 * 1.96 / n), 6) AS high FROM s""")
def wilson(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "click").alias("k"), F.count("*").alias("n"))
    w = dist.wilson(F.col("k"), F.col("n"))
    return s.select("user_id", "k", "n", F.round(w["low"], 6).alias("low"), F.round(w["high"], 6).alias("high"))


@query("""
SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(min(value), 6) AS least, round(quantile_cont(value, 0.5), 6) AS median, round(avg(value), 6) AS mean, round(max(value), 6) AS most,
       round(list_sort(list(value))[CAST(floor(0.9 * (count(*) - 1) + 0.5) AS BIGINT) + 1], 6) AS nearest_p90 FROM events GROUP BY 1""")
def value_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_type", "user_id", "value")
    w = Window.partitionBy("event_type")
    ranked = e.withColumns({"k": F.row_number().over(w.orderBy("value")) - 1, "n": F.count("*").over(w)}).withColumn("at", F.floor(0.9 * (F.col("n") - 1) + 0.5))
    return ranked.groupBy("event_type").agg(
        F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.round(F.min("value"), 6).alias("least"), F.round(F.median("value"), 6).alias("median"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.max("value"), 6).alias("most"), F.round(F.max(F.when(F.col("k") == F.col("at"), F.col("value"))), 6).alias("nearest_p90")
    )


@query("""
WITH f AS (SELECT unnest([0.2, 0.4, 0.6, 0.8]) AS floor), s AS (SELECT l_suppkey AS subject, l_discount * 10 AS sim FROM lineitem)
SELECT CAST(floor AS DOUBLE) AS floor, subject, count_if(sim >= floor) AS items FROM s CROSS JOIN f GROUP BY ALL""")
def floor_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("subject"), (F.col("l_discount") * 10).alias("sim"))
    # One pass: a conditional count for each threshold, then long form.
    floors = (0.2, 0.4, 0.6, 0.8)
    wide = s.groupBy("subject").agg(*[F.count_if(F.col("sim") >= x).alias(f"f{i}") for i, x in enumerate(floors)])
    return wide.select("subject", F.inline(F.array(*[F.struct(F.lit(x).alias("floor"), F.col(f"f{i}").alias("items")) for i, x in enumerate(floors)])))


@query("""
WITH w AS (SELECT l_orderkey AS person, max(CASE WHEN l_linenumber = 1 THEN l_quantity END) AS a, max(CASE WHEN l_linenumber = 2 THEN l_quantity END) AS b, max(CASE WHEN l_linenumber = 3 THEN l_quantity END) AS c FROM lineitem GROUP BY 1),
     k AS (SELECT * FROM w WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL)
SELECT count(*) AS n, round(corr(a, b), 6) AS r_ab, round(corr(a, c), 6) AS r_ac, round(corr(b, c), 6) AS r_bc, round(1.5 * (1 - (var_samp(a) + var_samp(b) + var_samp(c)) / var_samp(a + b + c)), 6) AS alpha FROM k""")
def factor_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "lineitem").filter("l_linenumber <= 3").groupBy("l_orderkey").pivot("l_linenumber", [1, 2, 3]).agg(F.max("l_quantity")).toDF("person", "a", "b", "c").na.drop()
    return calib.alpha(w, ["a", "b", "c"])
