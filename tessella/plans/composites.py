"""Composite pipelines: linkage, ladders, donors, evidence, prompts, sweeps, verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import dist
from tessella.functions import text as tx
from tessella.operators import compose, rank
from tessella.plans.registry import query
from tessella.runtime import table
from tessella.sources import views


@query()
def fuzzy_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers and brands whose names are alike; SQL has no Ratcliff-Obershelp ratio."""
    names = table(spark, sf_dir, "part").select("p_name").distinct().select(F.xxhash64("p_name").alias("k"), F.col("p_name").alias("n"))
    return compose.name_links(names, "k", "n").withColumn("ratio", F.round("ratio", 6))


@query("""
WITH l AS (SELECT o_custkey AS tid, o_orderkey AS pos, CASE o_orderkey % 4 WHEN 0 THEN 'Smith' WHEN 1 THEN 'John Smith' WHEN 2 THEN 'Mary Jones' ELSE 'JONES' END AS name, o_orderkey % 3 = 0 AS role FROM orders),
     s AS (SELECT *, lower(split_part(name, ' ', len(string_split(name, ' ')))) AS surname FROM l)
SELECT tid, surname, first(name ORDER BY NOT role, pos) AS full_name FROM s GROUP BY tid, surname HAVING count(DISTINCT CASE WHEN contains(name, ' ') THEN lower(name) END) <= 1""")
def surname_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 4
    name = F.when(k == 0, "Smith").when(k == 1, "John Smith").when(k == 2, "Mary Jones").otherwise("JONES")
    labels = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("tid"), F.col("o_orderkey").alias("at"), name.alias("name"), (F.col("o_orderkey") % 3 == 0).alias("role"))
    return compose.surname_registry(labels, "tid", "at", "name", "role")


@query("""
WITH b AS (SELECT p_partkey AS cand, p_brand AS donor, p_retailprice AS w, CASE p_size % 3 WHEN 0 THEN 'Z' WHEN 1 THEN 'L' ELSE 'H' END AS bucket FROM part),
     c AS (SELECT i.cand AS item, b.cand, b.donor, abs(b.w - i.w) / i.w AS gap, b.bucket = i.bucket AS same FROM b i LEFT JOIN b ON b.donor <> i.donor AND (b.bucket = i.bucket OR b.bucket = 'L' OR i.bucket = 'L') AND abs(b.w - i.w) / i.w <= 0.5),
     r AS (SELECT *, CASE WHEN same AND gap <= 0.2 THEN 1 WHEN same AND gap <= 0.3 THEN 2 WHEN gap <= 0.3 THEN 3 WHEN gap <= 0.5 THEN 4 END AS rung FROM c),
     d AS (SELECT item, donor, min(rung) AS rung FROM r GROUP BY ALL),
     f AS (SELECT item, CASE WHEN count_if(rung <= 1) >= 20 THEN 1 WHEN count_if(rung <= 2) >= 20 THEN 2 WHEN count_if(rung <= 3) >= 20 THEN 3 ELSE 4 END AS relax_rung, count_if(rung <= 4) < 20 AS few_donors FROM d GROUP BY item),
     o AS (SELECT item, cand, donor, rung, relax_rung, round(gap, 6) AS gap, few_donors FROM r JOIN f USING (item) WHERE rung <= relax_rung OR cand IS NULL),
     z AS (SELECT * FROM o QUALIFY cand IS NULL OR row_number() OVER (PARTITION BY item, donor ORDER BY gap, cand) = 1)
SELECT *, CAST(CASE WHEN cand IS NOT NULL THEN row_number() OVER (PARTITION BY item ORDER BY gap, cand) END AS INT) AS rank FROM z QUALIFY cand IS NULL OR row_number() OVER (PARTITION BY item ORDER BY gap, cand) <= 5""")
def option_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distractors for every part: of the rung that it needs, the nearest of each donor, and the five nearest of these."""
    k = F.col("p_size") % 3
    bank = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("cand"), F.col("p_brand").alias("donor"), F.col("p_retailprice").alias("words"), F.when(k == 0, "Z").when(k == 1, "L").otherwise("H").alias("bucket"))
    items = bank.select(F.col("cand").alias("item"), F.col("donor").alias("subject"), "words", "bucket")
    found = compose.ladder(items, bank, 20)
    # The nearest of each donor is a minimum, summed before the shuffle.
    nearest = found.filter("cand IS NOT NULL").groupBy("item", "donor").agg(F.min(F.struct("gap", "cand", "rung", "relax_rung", "few_donors")).alias("b")).select("item", "donor", "b.*")
    best = rank.top_per_group(nearest, ["item"], [F.col("gap"), F.col("cand")], 5)
    return best.unionByName(found.filter("cand IS NULL"), allowMissingColumns=True)


@query("""
WITH t AS (SELECT label AS doc, CAST(vec_id % 40 AS VARCHAR) AS term FROM embeddings WHERE vec_id % 3 <> label % 3), n AS (SELECT count(DISTINCT doc) AS n FROM t), tf AS (SELECT doc, term, count(*) AS tf FROM t GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
     r AS (SELECT doc, term, tf * (ln((1 + n) / (1 + df)) + 1) AS raw FROM tf JOIN df USING (term), n WHERE df <= 0.9 * n), v AS (SELECT doc, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc)) AS w FROM r),
     c AS (SELECT a.doc AS subject, b.doc AS donor, round(least(1.0, greatest(0.0, sum(a.w * b.w))), 6) AS similarity FROM v a JOIN v b USING (term) WHERE a.doc <> b.doc AND abs(a.doc - b.doc) <> 1 GROUP BY ALL)
SELECT subject, donor, similarity, CAST(row_number() OVER (PARTITION BY subject ORDER BY similarity DESC, donor) AS INT) AS rank FROM c QUALIFY rank <= 6""")
def donor_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each subject's most similar donor and five runners-up, after a guard against conflicting pairs."""
    t = table(spark, sf_dir, "embeddings").filter("vec_id % 3 <> label % 3").select(F.col("label").alias("doc"), (F.col("vec_id") % 40).cast("string").alias("term"))
    v = rank.tfidf(t)
    c = rank.sparse_cosine(v, v).filter("a <> b AND abs(a - b) <> 1").select(F.col("a").alias("subject"), F.col("b").alias("donor"), F.round("cosine", 6).alias("similarity"))
    return rank.top_per_group(c, ["subject"], [F.desc("similarity"), F.col("donor")], 6)


@query("""
SELECT user_id AS subject, 3 * least(count_if(value > 60), 4) + 2 * least(count_if(value > 30 AND value <= 60), 4) + least(count_if(value <= 30), 4) AS score,
       CASE WHEN count_if(value > 60) >= 1 THEN 'staff' WHEN count_if(value > 30) >= 2 THEN 'review' ELSE 'clear' END AS tier FROM events WHERE event_type = 'error' GROUP BY 1""")
def evidence_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    e = table(spark, sf_dir, "events").filter("event_type = 'error'").groupBy(F.col("user_id").alias("subject")).agg(F.count_if(v > 60).alias("s"), F.count_if((v > 30) & (v <= 60)).alias("m"), F.count_if(v <= 30).alias("w"))
    score = compose.evidence_score({"strong": F.col("s"), "medium": F.col("m"), "weak": F.col("w")})
    return e.select("subject", score.cast("long").alias("score"), F.when(F.col("s") >= 1, "staff").when(F.col("s") + F.col("m") >= 2, "review").otherwise("clear").alias("tier"))


@query("""
WITH r AS (SELECT c_custkey AS person, arm, 'Person of ' || n_name || CASE WHEN arm = 'twin' THEN chr(10) || 'Segment: ' || c_mktsegment ELSE '' END || chr(10) || 'Rate from 1 to 7.' AS prompt FROM customer JOIN nation ON n_nationkey = c_nationkey, (VALUES ('twin'), ('baseline')) AS a(arm)),
     s AS (SELECT *, sha256(prompt) AS prompt_sha256, row_number() OVER (PARTITION BY prompt ORDER BY person, arm) > 1 AS repeats FROM r),
     n AS (SELECT person, count(*) AS n FROM s WHERE NOT repeats GROUP BY person), c AS (SELECT person, n, CAST(floor(coalesce(sum(n) OVER (ORDER BY person ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 50) AS BIGINT) AS chunk FROM n)
SELECT s.person, s.arm, s.prompt_sha256, s.repeats, c.chunk FROM s LEFT JOIN c ON c.person = s.person AND NOT s.repeats""")
def render_dedup_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts for every person and arm, repeated ones marked, whole persons dealt into chunks."""
    people = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("n_nationkey") == F.col("c_nationkey"))
    tasks = people.withColumn("arm", F.explode(F.array(F.lit("twin"), F.lit("baseline"))))
    prompt = compose.render([F.concat(F.lit("Person of "), F.col("n_name")), F.when(F.col("arm") == "twin", F.concat(F.lit("Segment: "), F.col("c_mktsegment"))), "Rate from 1 to 7."])
    s = compose.unique_prompts(tasks.select(F.col("c_custkey").alias("person"), "arm", prompt.alias("prompt")), "prompt", ["person", "arm"]).select("person", "arm", "prompt_sha256", "repeats")
    chunks = compose.chunked(s.filter("NOT repeats").groupBy("person").agg(F.count("*").alias("n")), "person", "n", 50).select(F.col("person").alias("_p"), "chunk")
    return s.join(chunks, (F.col("person") == F.col("_p")) & ~F.col("repeats"), "left").drop("_p")


@query("""
SELECT p.id, k.k, k.w AS weight FROM (SELECT n_nationkey AS id FROM nation) p, (VALUES (1, CAST(0.5 AS DOUBLE)), (2, 0.25), (4, 0.125)) AS k(k, w)""")
def static_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People by checkpoints: a cross product of a table with a list of three."""
    checkpoints = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(w).alias("weight")) for k, w in ((1, 0.5), (2, 0.25), (4, 0.125))])
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.inline(checkpoints))


@query("""
WITH s AS (SELECT l_suppkey AS subject, l_returnflag AS arm, avg(l_discount) AS m FROM lineitem GROUP BY ALL), p AS (SELECT subject, max(CASE WHEN arm = 'A' THEN m END) AS a, max(CASE WHEN arm = 'R' THEN m END) AS r FROM s GROUP BY subject)
SELECT count(*) AS n, round(avg(a - r), 6) AS effect, round(avg(a - r) / (stddev_samp(a - r) / sqrt(count(*))), 5) AS t, abs(avg(a - r)) > 0.05 AS past_bar, CASE WHEN count(*) >= 80 THEN 'full' WHEN count(*) >= 30 THEN 'reduced' ELSE 'stop' END AS branch FROM p WHERE a IS NOT NULL AND r IS NOT NULL""")
def verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").pivot("l_returnflag", ["A", "R"]).agg(F.avg("l_discount")).na.drop()
    d = F.col("A") - F.col("R")
    one = s.agg(F.count("*").alias("n"), F.avg(d).alias("e"), (F.avg(d) / (F.stddev_samp(d) / F.sqrt(F.count("*")))).alias("t"))
    return one.select("n", F.round("e", 6).alias("effect"), F.round("t", 5).alias("t"), (F.abs("e") > 0.05).alias("past_bar"), F.when(F.col("n") >= 80, "full").when(F.col("n") >= 30, "reduced").otherwise("stop").alias("branch"))


@query("""
WITH n AS (SELECT user_id, event_type AS k, count(*) AS n FROM events GROUP BY ALL), d AS (SELECT user_id, k, n / sum(n) OVER (PARTITION BY user_id) AS p FROM n), m AS (SELECT k, sum(n) AS n FROM n GROUP BY k), g AS (SELECT k, n / sum(n) OVER () AS p FROM m),
     f AS (SELECT u.user_id, g.k, g.p AS gp, coalesce(d.p, 0) AS p FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN g LEFT JOIN d ON d.user_id = u.user_id AND d.k = g.k)
SELECT user_id, round(sum(abs(p - gp)) / 2, 6) AS divergence FROM f GROUP BY user_id""")
def divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each person's mix of events lies from everyone's."""
    e = table(spark, sf_dir, "events")
    mix = lambda df: dist.renormalised(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))))
    own = e.groupBy("user_id", "event_type").agg(F.count("*").cast("double").alias("n")).groupBy("user_id").agg(mix(e).alias("d"))
    whole = e.groupBy("event_type").agg(F.count("*").cast("double").alias("n")).agg(mix(e).alias("g"))
    return own.crossJoin(F.broadcast(whole)).select("user_id", F.round(dist.total_variation(F.col("d"), F.col("g")), 6).alias("divergence"))


@query("""
SELECT doc_id, CASE WHEN regexp_matches(text, '(^|[^a-zA-Z0-9_])(19|20)[0-9][0-9]([^a-zA-Z0-9_]|$)') THEN true ELSE false END AS has_year FROM documents""")
def era_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.col("text").rlike(r"(^|[^a-zA-Z0-9_])(19|20)[0-9][0-9]([^a-zA-Z0-9_]|$)"), F.lit(False)).alias("has_year"))


@query("SELECT conv_id AS tid, count_if(role = 'user') AS host, count_if(role = 'assistant') AS guest, count_if(role NOT IN ('user', 'assistant')) AS other, count_if(role = 'user') > 0 AND count_if(role = 'assistant') > 0 AND count_if(role NOT IN ('user', 'assistant')) = 0 AS one_on_one FROM conversations GROUP BY 1")
def one_on_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = views.turns(spark, sf_dir).groupBy("tid").pivot("role", ["host", "guest", "other"]).count().na.fill(0)
    return t.withColumn("one_on_one", (F.col("host") > 0) & (F.col("guest") > 0) & (F.col("other") == 0))


@query("SELECT lower(trim(text)) AS question, count(*) AS n FROM conversations WHERE role = 'user' GROUP BY 1 HAVING count(*) > 1")
def duplicate_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").filter("role = 'user'").groupBy(F.lower(F.trim("text")).alias("question")).agg(F.count("*").alias("n")).filter("n > 1")


@query("""
WITH e AS (SELECT user_id, value FROM events), f AS (SELECT unnest([20, 40, 60]) AS floor), s AS (SELECT floor, user_id, count_if(value >= floor) >= 10 AS ok FROM e, f GROUP BY ALL),
     p AS (SELECT floor, count_if(ok) AS k, count(*) AS n, count_if(ok) / count(*) AS p FROM s GROUP BY floor)
SELECT floor, k AS eligible, n AS subjects, round(p, 6) AS share, round((p + 3.8416 / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 6) AS low, round((p + 3.8416 / (2 * n) + 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 6) AS high FROM p""")
def eligibility_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    floors = (20, 40, 60)
    per = table(spark, sf_dir, "events").groupBy("user_id").agg(*[(F.count_if(F.col("value") >= x) >= 10).alias(f"f{x}") for x in floors])
    one = per.agg(F.count("*").alias("subjects"), *[F.count_if(f"f{x}").alias(f"f{x}") for x in floors])
    long = one.select("subjects", F.inline(F.array(*[F.struct(F.lit(x).alias("floor"), F.col(f"f{x}").alias("eligible")) for x in floors])))
    ends = long.withColumn("w", dist.wilson(F.col("eligible"), F.col("subjects")))
    return ends.select("floor", "eligible", "subjects", F.round(F.col("eligible") / F.col("subjects"), 6).alias("share"), F.round("w.low", 6).alias("low"), F.round("w.high", 6).alias("high"))


@query("""
WITH w AS (SELECT item_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS n, text FROM benchmark)
SELECT item_id, CAST(n AS INT) AS words, CASE WHEN n < 20 THEN 'short' WHEN n > 40 THEN 'long' ELSE 'kept' END AS reason FROM w""")
def first_failing_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = tx.word_count(F.col("text"))
    return table(spark, sf_dir, "benchmark").select("item_id", n.alias("words"), F.when(n < 20, "short").when(n > 40, "long").otherwise("kept").alias("reason"))
