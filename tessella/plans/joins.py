"""Filters, joins and set operations over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import dist
from tessella.operators import filters, pairing, rank, sampling
from tessella.plans.registry import query
from tessella.runtime import table
from tessella.sources import views

_RULES = {
    "priced": "l_extendedprice BETWEEN 1000 AND 80000",
    "discounted": "l_discount > 0",
    "few": "l_quantity <= 45",
    "open": "l_linestatus = 'O'",
}


@query("SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS rule, count_if(NOT ({r})) AS n FROM lineitem" for n, r in _RULES.items()) + " UNION ALL SELECT 'kept', count_if(" + " AND ".join(f"({r})" for r in _RULES.values()) + ") FROM lineitem)")
def drop_counts_by_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.drop_counts(table(spark, sf_dir, "lineitem"), {n: F.expr(r) for n, r in _RULES.items()})


_STEP = "CASE " + " ".join(f"WHEN NOT ({r}) THEN {i}" for i, r in enumerate(_RULES.values(), 1)) + f" ELSE {len(_RULES) + 1} END"


@query(f"""
WITH s AS (SELECT {_STEP} AS step, count(*) AS n FROM lineitem GROUP BY 1),
     names AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{n}')" for i, n in enumerate([*_RULES, "kept"], 1))}) AS v(step, rule)),
     f AS (SELECT names.step, rule, coalesce(n, 0) AS n, CAST(sum(coalesce(n, 0)) OVER (ORDER BY names.step DESC) AS BIGINT) AS rows_in FROM names LEFT JOIN s USING (step))
SELECT step, rule, rows_in, CASE WHEN rule = 'kept' THEN 0 ELSE n END AS lost, CASE WHEN rule = 'kept' THEN rows_in ELSE rows_in - n END AS rows_out FROM f""")
def clean_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.funnel(table(spark, sf_dir, "lineitem"), {n: F.expr(r) for n, r in _RULES.items()})


@query("SELECT c_custkey, n_name AS nation, r_name AS region, CASE c_mktsegment WHEN 'BUILDING' THEN 'Building' WHEN 'MACHINERY' THEN 'Machinery' END AS segment FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def decode_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = F.create_map(*[F.lit(x) for x in ("BUILDING", "Building", "MACHINERY", "Machinery")])
    c = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    c = c.join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return c.select("c_custkey", F.col("n_name").alias("nation"), F.col("r_name").alias("region"), F.try_element_at(segments, F.col("c_mktsegment")).alias("segment"))


_POOL = """SELECT c_custkey AS subject, c_mktsegment AS segment, coalesce(n, 0) AS n_orders, coalesce(days, 0) AS n_dates, coalesce(span, 0) AS span_days, coalesce(words, 0) AS words,
       coalesce(n, 0) >= 3 AND coalesce(span, 0) >= 180 AND coalesce(days, 0) >= 3 AS qualifies,
       concat_ws('; ', CASE WHEN coalesce(n, 0) < 3 THEN 'few' END, CASE WHEN coalesce(span, 0) < 180 THEN 'short' END, CASE WHEN c_acctbal < 0 THEN 'debt' END) AS note
FROM customer LEFT JOIN (SELECT subject, count(*) AS n, count(DISTINCT date) AS days, date_diff('day', min(date), max(date)) AS span, CAST(sum(words) AS BIGINT) AS words FROM {clusters} GROUP BY subject) a ON a.subject = c_custkey"""


def _pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = views.clusters(spark, sf_dir).groupBy("subject").agg(F.count("*").alias("n"), F.count_distinct("date").alias("days"), F.datediff(F.max("date"), F.min("date")).cast("long").alias("span"), F.sum("words").alias("w"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    j = table(spark, sf_dir, "customer").join(a, F.col("c_custkey") == F.col("subject"), "left")
    flags = (zero("n") >= 3) & (zero("span") >= 180) & (zero("days") >= 3)
    note = F.concat_ws("; ", F.when(zero("n") < 3, "few"), F.when(zero("span") < 180, "short"), F.when(F.col("c_acctbal") < 0, "debt"))
    return j.select(F.col("c_custkey").alias("subject"), F.col("c_mktsegment").alias("segment"), zero("n").alias("n_orders"), zero("days").alias("n_dates"), zero("span").alias("span_days"), zero("w").alias("words"), flags.alias("qualifies"), note.alias("note"))


@query(_POOL)
def pool_left_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pool(spark, sf_dir)


@query(f"WITH p AS ({_POOL}) SELECT subject, n_orders FROM p WHERE n_orders > (SELECT min(n_orders) FROM (SELECT n_orders FROM p ORDER BY n_orders DESC LIMIT 100))")
def head_cutoff_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pool(spark, sf_dir).select("subject", "n_orders")
    cut = p.orderBy(F.desc("n_orders")).limit(100).agg(F.min("n_orders").alias("cut"))
    return p.crossJoin(F.broadcast(cut)).filter("n_orders > cut").drop("cut")


@query(f"""
WITH p AS ({_POOL}), r AS (SELECT subject, segment, words, row_number() OVER (PARTITION BY segment ORDER BY words DESC, subject) AS k FROM p WHERE qualifies),
     a AS (SELECT subject, segment, words, 'quota' AS why FROM r WHERE k <= 10),
     b AS (SELECT subject, segment, words, 'fill' AS why FROM p WHERE qualifies AND subject NOT IN (SELECT subject FROM a) ORDER BY words DESC, subject LIMIT 20)
SELECT * FROM a UNION ALL SELECT * FROM b""")
def shortlist_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pool(spark, sf_dir).filter("qualifies").select("subject", "segment", "words")
    quota = rank.top_per_group(p, ["segment"], [F.desc("words"), F.col("subject")], 10).drop("rank").withColumn("why", F.lit("quota"))
    fill = p.join(quota.select("subject"), "subject", "left_anti").orderBy(F.desc("words"), "subject").limit(20).select("subject", "segment", "words").withColumn("why", F.lit("fill"))
    return quota.unionByName(fill)


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def anti_join_unused(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(used, "c_custkey", "left_anti")


@query("SELECT p_partkey, p_brand FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_discount >= 0.09)")
def semi_join_used(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R' AND l_discount >= 0.09").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, sf_dir, "part").select("p_partkey", "p_brand").join(used, "p_partkey", "left_semi")


@query("""
WITH p AS (SELECT p_partkey, p_size, p_type, p_retailprice AS w FROM part)
SELECT a.p_partkey AS target, b.p_partkey AS candidate, round(abs(b.w - a.w), 4) AS gap FROM p a JOIN p b ON a.p_type = b.p_type AND a.p_size = b.p_size AND b.w BETWEEN a.w * 0.9 AND a.w * 1.1 AND a.p_partkey <> b.p_partkey""")
def range_join_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every part those of equal type and size within a tenth of its price; the range is also an equi-join on bands, so no nested loop is planned."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_type", F.col("p_retailprice").alias("w"))
    band = lambda c: F.floor(F.log(c) / F.log(F.lit(1.25))).cast("long")
    a = p.select(F.col("p_partkey").alias("target"), "p_size", "p_type", F.col("w").alias("wa"))
    a = a.withColumn("band", F.explode(F.sequence(band(F.col("wa") * 0.9), band(F.col("wa") * 1.1))))
    b = p.select(F.col("p_partkey").alias("candidate"), "p_size", "p_type", F.col("w").alias("wb"), band(F.col("w")).alias("band"))
    return a.join(b, ["p_type", "p_size", "band"]).filter("wb BETWEEN wa * 0.9 AND wa * 1.1 AND target <> candidate").select("target", "candidate", F.round(F.abs(F.col("wb") - F.col("wa")), 4).alias("gap"))


@query("""
WITH v AS (SELECT vec_id, label, embedding AS e FROM embeddings),
     d AS (SELECT label, i, avg(CAST(e[i] AS DOUBLE)) AS m FROM v, range(1, 65) AS r(i) GROUP BY label, i),
     s AS (SELECT v.vec_id, d.label AS other, sum(CAST(v.e[d.i] AS DOUBLE) * d.m) / (sqrt(sum(CAST(v.e[d.i] AS DOUBLE) ** 2)) * sqrt(sum(d.m ** 2))) AS c FROM v, d GROUP BY v.vec_id, d.label)
SELECT vec_id, other AS nearest, round(c, 5) AS cosine FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(c, 5) DESC, other) = 1""")
def cosine_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector's nearest label centroid. The centroids, a row a label, travel as one row, so that no pair is ever a row."""
    v = table(spark, sf_dir, "embeddings")
    d = v.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    centre = d.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centre"))
    every = centre.agg(F.collect_list(F.struct("label", "centre")).alias("centres"))
    near = F.transform("centres", lambda c: F.struct((-F.round(dist.cosine(F.col("embedding"), c["centre"]), 5)).alias("c"), c["label"].alias("nearest")))
    best = v.select("vec_id", "embedding").crossJoin(every).select("vec_id", F.array_min(near).alias("b"))
    return best.select("vec_id", F.col("b.nearest").alias("nearest"), (-F.col("b.c")).alias("cosine"))


@query("""
SELECT a.e AS a, b.e AS b, count(*) AS n FROM (SELECT DISTINCT user_id, event_type AS e FROM events WHERE value > 40) a JOIN (SELECT DISTINCT user_id, event_type AS e FROM events WHERE value > 40) b ON a.user_id = b.user_id AND a.e < b.e GROUP BY ALL""")
def cooccurrence_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.operators.linkage import cooccurrence

    return cooccurrence(table(spark, sf_dir, "events").filter("value > 40"), "user_id", "event_type")


@query("SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderpriority = '1-URGENT' UNION SELECT c_custkey FROM customer WHERE c_acctbal < 0")
def setop_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("k"))
    return a.union(table(spark, sf_dir, "customer").filter("c_acctbal < 0").select("c_custkey")).distinct()


@query("SELECT o_custkey AS k FROM orders WHERE o_orderpriority = '1-URGENT' INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal < 0")
def setop_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("k"))
    return a.intersect(table(spark, sf_dir, "customer").filter("c_acctbal < 0").select("c_custkey"))


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def setop_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("k"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).subtract(a)


@query("SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1")
def first_by_key_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min(F.struct("event_id", "value")).alias("f"))
    return first.select("user_id", "event_type", "f.event_id", "f.value")


@query("SELECT user_id, event_type, max(event_id) AS event_id, max_by(value, event_id) AS value FROM events GROUP BY ALL")
def last_write_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max("event_id").alias("event_id"), F.max_by("value", "event_id").alias("value"))


@query("""
WITH e AS (SELECT DISTINCT p_brand AS brand, l_returnflag AS flag FROM part CROSS JOIN (SELECT DISTINCT l_returnflag FROM lineitem)),
     h AS (SELECT DISTINCT p_brand AS brand, l_returnflag AS flag FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity = 50 AND l_discount >= 0.09)
SELECT e.brand, count(*) AS expected, count(h.flag) AS present, count_if(h.flag IS NULL) AS missing, bool_and(h.flag IS NOT NULL) AS complete FROM e LEFT JOIN h ON e.brand = h.brand AND e.flag = h.flag GROUP BY e.brand""")
def completeness_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, parts = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    expected = parts.select(F.col("p_brand").alias("brand")).distinct().crossJoin(lines.select(F.col("l_returnflag").alias("flag")).distinct())
    present = lines.filter("l_quantity = 50 AND l_discount >= 0.09").join(parts, F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_brand").alias("brand"), F.col("l_returnflag").alias("flag"))
    return pairing.completeness(expected, present, ["brand", "flag"], ["brand"])


@query("SELECT c_custkey AS id, sha256('48' || CAST(c_custkey AS VARCHAR)) AS draw FROM customer ORDER BY 2, 1 LIMIT 200")
def hash_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.draw(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), "id", 200, 48, "draw")


@query("""
WITH r AS (SELECT c_custkey AS id, c_mktsegment AS stratum, row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256('7' || CAST(c_custkey AS VARCHAR)), c_custkey) AS place FROM customer WHERE c_custkey % 5 <> 0)
SELECT id, stratum, CAST(place AS INT) AS place FROM r WHERE place <= 12""")
def stratified_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("stratum"))
    burned = c.filter("id % 5 = 0").select("id")
    return sampling.quota(c.join(burned, "id", "left_anti"), "id", "stratum", 12, 7)


@query("""
WITH d AS (SELECT n_nationkey AS id, row_number() OVER (ORDER BY sha256('3' || CAST(n_nationkey AS VARCHAR)), n_nationkey) AS k, count(*) OVER () AS n FROM nation)
SELECT a.id, b.id AS imposter FROM d a JOIN d b ON b.k = a.k % a.n + 1""")
def derangement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.rotation(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id")), "id", 3)


@query("""
WITH r AS (SELECT s_suppkey AS id, s_acctbal >= 0 AS a, row_number() OVER (PARTITION BY s_acctbal >= 0 ORDER BY s_suppkey) AS k FROM supplier)
SELECT id, a AS first_list, row_number() OVER (ORDER BY CASE WHEN a THEN (k - 1) // 3 * 4 + (k - 1) % 3 ELSE (k - 1) * 4 + 3 END, a DESC, id) AS place FROM r""")
def interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_acctbal") >= 0).alias("first_list"))
    return sampling.interleave(s, "first_list", "id", 3)
