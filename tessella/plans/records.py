"""Records and links: keys and blocks of names, guarded donors, quota walks, bands, evidence and report rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import dist, names
from tessella.functions import text as tx
from tessella.operators import compose, rank, sampling
from tessella.plans.registry import query
from tessella.runtime import ensure_checkpoint_dir, table
from tessella.sources import sinks


@query("""
WITH e AS (SELECT vec_id, label, vec_id // 2 AS pair, vec_id % 2 AS side, embedding AS v FROM embeddings), p AS (SELECT a.label, a.pair % 2 AS arm, list_sum(list_transform(list_zip(a.v, b.v), lambda z: CAST(z[1] AS DOUBLE) * z[2])) / (sqrt(list_sum(list_transform(a.v, lambda x: CAST(x AS DOUBLE) * x))) * sqrt(list_sum(list_transform(b.v, lambda x: CAST(x AS DOUBLE) * x)))) AS c FROM e a JOIN e b ON a.pair = b.pair AND a.side = 0 AND b.side = 1)
SELECT label, arm, count(*) AS n, round(avg(c), 5) AS mean_cosine FROM p GROUP BY ALL""")
def mean_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean cosine of paired vectors, by subject and arm."""
    e = table(spark, sf_dir, "embeddings").withColumn("pair", F.floor(F.col("vec_id") / 2))
    a = e.filter("vec_id % 2 = 0").select("pair", "label", F.col("embedding").alias("a"))
    b = e.filter("vec_id % 2 = 1").select("pair", F.col("embedding").alias("b"))
    return a.join(b, "pair").groupBy("label", (F.col("pair") % 2).alias("arm")).agg(F.count("*").alias("n"), F.round(F.avg(dist.cosine(F.col("a"), F.col("b"))), 5).alias("mean_cosine"))


_SPELT = "CASE s_suppkey % 4 WHEN 0 THEN 'J.J. Stone' WHEN 1 THEN 'JJ Stone' WHEN 2 THEN 'Jo Stone' ELSE 'J. Stone' END || CAST(s_nationkey AS VARCHAR)"


@query(f"""
WITH n AS (SELECT s_suppkey AS id, {_SPELT} AS name, s_nationkey FROM supplier), k AS (SELECT *, upper(regexp_replace(name, '[^A-Za-z]', '', 'g')) || s_nationkey AS punct, string_split(name, ' ')[2] AS rest, upper(name[1:1]) AS initial FROM n)
SELECT a.id AS a, b.id AS b, a.punct = b.punct AS same_spelling FROM k a JOIN k b ON a.id < b.id AND ((a.punct = b.punct) OR (a.rest = b.rest AND a.initial = b.initial AND (a.id % 4 = 3 OR b.id % 4 = 3)))""")
def linkage_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that may be one person's: equal but for punctuation, or an initial with the same rest of the name."""
    n = F.expr(_SPELT.replace("VARCHAR", "STRING"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), n.alias("name"), F.col("s_nationkey").cast("string").alias("nation"))
    k = s.select("id", F.concat(names.punct_key(F.col("name")), "nation").alias("punct"), F.get(names.parts(F.col("name")), F.lit(1)).alias("rest"), F.upper(F.substring("name", 1, 1)).alias("initial"), (names.initial_form(F.col("name")) & (F.col("id") % 4 == 3)).alias("short"))
    a, b = (k.select(*[F.col(c).alias(f"{c}_{x}") for c in k.columns]) for x in "ab")
    spelt = a.join(b, F.col("punct_a") == F.col("punct_b"))
    rest = a.join(b, (F.col("rest_a") == F.col("rest_b")) & (F.col("initial_a") == F.col("initial_b")) & (F.col("punct_a") != F.col("punct_b"))).filter("short_a OR short_b")
    both = spelt.unionByName(rest).filter("id_a < id_b")
    return both.select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), (F.col("punct_a") == F.col("punct_b")).alias("same_spelling"))


@query("""
WITH t AS (SELECT user_id AS u, event_type || event_id % 9 AS term, count(*) AS n FROM events GROUP BY ALL), s AS (SELECT a.u AS subject, b.u AS donor, sum(a.n * b.n) AS sim FROM t a JOIN t b ON a.term = b.term AND a.u <> b.u GROUP BY ALL),
     r AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY sim DESC, donor) AS rank FROM s QUALIFY rank <= 12), m AS (SELECT *, CASE WHEN subject % 7 = donor % 7 THEN 'name conflict' WHEN (subject + donor) % 3 = 0 THEN 'shared transcript' WHEN donor % 5 = 0 THEN 'named in text' END AS reason FROM r),
     f AS (SELECT subject, min(CASE WHEN reason IS NULL THEN rank END) AS first, arg_min(reason, rank) FILTER (WHERE reason IS NOT NULL) AS passed_reason FROM m GROUP BY subject)
SELECT m.subject, m.donor, m.rank, f.first - 1 AS passed_over, f.passed_reason FROM m JOIN f ON f.subject = m.subject AND m.rank = f.first""")
def guarded_donor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most similar donor that no guard blocks, of a dozen."""
    t = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("u"), F.concat("event_type", (F.col("event_id") % 9).cast("string")).alias("term")).agg(F.count("*").alias("n"))
    a, b = t.select(F.col("u").alias("subject"), "term", F.col("n").alias("x")), t.select(F.col("u").alias("donor"), "term", F.col("n").alias("y"))
    s = a.join(b, "term").filter("subject <> donor").groupBy("subject", "donor").agg(F.sum(F.col("x") * F.col("y")).alias("sim"))
    r = rank.top_per_group(s, ["subject"], [F.desc("sim"), F.col("donor")], 12)
    rules = {"name conflict": F.col("subject") % 7 == F.col("donor") % 7, "shared transcript": (F.col("subject") + F.col("donor")) % 3 == 0, "named in text": F.col("donor") % 5 == 0}
    return compose.guarded(r, rules).select("subject", "donor", F.col("rank").cast("long").alias("rank"), "passed_over", "passed_reason")


@query("""
WITH c AS (SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'Dr. ' WHEN 1 THEN 'SENATOR ' ELSE '' END || upper(c_name) || CASE c_custkey % 2 WHEN 0 THEN ', HOST' ELSE ', a guest' END AS label FROM customer)
SELECT id, CASE id % 2 WHEN 0 THEN 'host' ELSE 'guest' END AS kind, 'Customer#' || lpad(CAST(id AS VARCHAR), 9, '0') AS name, CASE id % 3 WHEN 0 THEN 'dr' WHEN 1 THEN 'senator' END AS honorific FROM c""")
def speaker_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speaker labels with their titles."""
    k = F.col("c_custkey")
    label = F.concat(F.when(k % 3 == 0, "Dr. ").when(k % 3 == 1, "SENATOR ").otherwise(""), F.upper("c_name"), F.when(k % 2 == 0, ", HOST").otherwise(", a guest"))
    return table(spark, sf_dir, "customer").select(k.alias("id"), tx.titled_speaker(label, ["DR", "SENATOR", "MR"]).alias("s")).select("id", "s.kind", "s.name", "s.honorific")


@query("""
SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'jo o doe ' || c_custkey WHEN 1 THEN 'jane doesmith ' || c_custkey ELSE 'éva doe' END AS key FROM customer""")
def name_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names without titles, punctuation and case."""
    k, n = F.col("c_custkey"), F.col("c_custkey").cast("string")
    name = F.when(k % 3 == 0, F.concat(F.lit("Prof. Dr.  Jo O. Doe "), n)).when(k % 3 == 1, F.concat(F.lit("Mrs Jane Doe-Smith, "), n)).otherwise("Gov. ÉVA  (Doe)")
    return table(spark, sf_dir, "customer").select(k.alias("id"), tx.name_key(name).alias("key"))


@query("""
WITH o AS (SELECT o_orderkey AS id, year(o_orderdate) AS y, 'Since 1995 and 2031, not 19955 nor x1999; maybe ' || (year(o_orderdate) + o_orderkey % 3) || '.' AS t FROM orders)
SELECT id, array_to_string(list_filter(regexp_extract_all(t, '\\b(?:19|20)[0-9]{2}\\b'), lambda s: CAST(s AS INT) > y), ',') AS violations FROM o""")
def era_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years in a text that lie after the test's year."""
    y = F.year("o_orderdate")
    said = F.concat(F.lit("Since 1995 and 2031, not 19955 nor x1999; maybe "), (y + F.col("o_orderkey") % 3).cast("string"), F.lit("."))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.array_join(tx.era_violations(said, y), ",").alias("violations"))


@query("""
WITH p AS (SELECT c_custkey AS id, c_mktsegment AS stratum, c_custkey % 37 = 0 AS retained FROM customer WHERE c_custkey % 5 <> 0), r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY NOT retained, sha256('7' || CAST(id AS VARCHAR)), id) AS place FROM p)
SELECT id, stratum, retained, CAST(place AS INT) AS place FROM r WHERE place <= 20""")
def quota_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quota in each stratum: what is retained first, then by lot, past what is burned."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("stratum"), (F.col("c_custkey") % 37 == 0).alias("retained"))
    burned = c.filter("id % 5 = 0").select("id")
    r = rank.top_per_group(c.join(burned, "id", "left_anti"), ["stratum"], [F.asc(~F.col("retained")), sampling.lot("id", 7), F.col("id")], 20)
    return r.withColumnRenamed("rank", "place").select("id", "stratum", "retained", "place")


@query("""
WITH b AS (SELECT least(floor(value / 10), 9) AS band, count(*) AS n, count_if(event_type = 'error') AS strict, count_if(event_type IN ('error', 'click')) AS lenient FROM events GROUP BY 1)
SELECT CAST(band AS INT) AS band, n, strict, lenient, CAST(sum(n) OVER w AS BIGINT) AS n_from, CAST(sum(strict) OVER w AS BIGINT) AS strict_from, CAST(sum(lenient) OVER w AS BIGINT) AS lenient_from FROM b WINDOW w AS (ORDER BY band DESC)""")
def band_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fuzzy rule by band of its ratio, and by threshold: strict and lenient hits from each band up."""
    e = table(spark, sf_dir, "events")
    b = e.groupBy(F.least(F.floor(F.col("value") / 10), F.lit(9)).cast("int").alias("band")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("strict"), F.count_if(F.col("event_type").isin("error", "click")).alias("lenient"))
    # Ten bands at most: their rows are turned to one and back.
    up = b.select("*").join(b.select(*[F.col(c).alias(f"{c}_up") for c in b.columns]), F.col("band") <= F.col("band_up"))
    return up.groupBy("band", "n", "strict", "lenient").agg(*[F.sum(f"{c}_up").alias(f"{c}_from") for c in ("n", "strict", "lenient")])


@query("""
WITH c AS (SELECT user_id AS subject, event_id % 2 = 0 AS staff, count_if(value > 60) AS s, count_if(value > 30 AND value <= 60) AS m, count_if(value <= 30) AS w FROM events WHERE event_type = 'error' GROUP BY ALL), x AS (SELECT subject, staff, 3 * least(s, 4) + 2 * least(m, 4) + least(w, 4) AS score FROM c)
SELECT subject, coalesce(max(CASE WHEN staff THEN score END), 0) AS staff, coalesce(max(CASE WHEN NOT staff THEN score END), 0) AS guest, coalesce(max(CASE WHEN staff THEN score END), 0) > coalesce(max(CASE WHEN NOT staff THEN score END), 0) AS is_staff FROM x GROUP BY subject""")
def evidence_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence for both sides, each kind of hit capped, and the side that wins."""
    v, staff = F.col("value"), F.col("event_id") % 2 == 0
    e = table(spark, sf_dir, "events").filter("event_type = 'error'")
    hit = lambda side, c: F.count_if(side & c)
    score = lambda side: compose.evidence_score({"strong": hit(side, v > 60), "medium": hit(side, (v > 30) & (v <= 60)), "weak": hit(side, v <= 30)}).cast("long")
    return e.groupBy(F.col("user_id").alias("subject")).agg(score(staff).alias("staff"), score(~staff).alias("guest")).withColumn("is_staff", F.col("staff") > F.col("guest"))


@query("""
WITH q AS (SELECT user_id AS subject, trim(substring(regexp_replace(lower(CASE event_id % 2 WHEN 0 THEN upper(event_type) || '! No ' ELSE event_type || ' no. ' END || event_id % 4), '[^a-z0-9]+', ' ', 'g'), 1, 80)) AS form, floor(value / 25) AS weight, event_id AS place FROM events)
SELECT subject, form, max(weight) AS weight, CAST(arg_max(place, weight * 100000000 + place) AS BIGINT) AS place FROM q GROUP BY subject, form""")
def best_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each quote of a subject, however it is spelt: the heaviest, then the latest."""
    kind, n = F.col("event_type"), (F.col("event_id") % 4).cast("string")
    quote = F.when(F.col("event_id") % 2 == 0, F.concat(F.upper(kind), F.lit("! No "), n)).otherwise(F.concat(kind, F.lit(" no. "), n))
    q = table(spark, sf_dir, "events").select(F.col("user_id").alias("subject"), quote.alias("quote"), F.floor(F.col("value") / 25).cast("double").alias("weight"), F.col("event_id").alias("place"))
    return compose.best_quotes(q, "subject", F.col("quote"), "weight", "place")


@query("""
WITH t AS (SELECT conv_id, count_if(role = 'user') AS host, count_if(role = 'assistant') AS guest, count_if(role NOT IN ('user', 'assistant')) AS other, sum(len(list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda w: w <> ''))) AS words FROM conversations GROUP BY 1)
SELECT reason, count(*) AS n FROM (SELECT CASE WHEN other > 0 THEN 'other speakers' WHEN host = 0 THEN 'no host' WHEN guest = 0 THEN 'no guest' WHEN words < 100 THEN 'too short' ELSE 'kept' END AS reason FROM t) GROUP BY reason""")
def drop_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many transcripts fail at which test first."""
    role = lambda r: F.count_if(F.col("role") == r)
    other = F.count_if(~F.col("role").isin("user", "assistant"))
    t = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(role("user").alias("host"), role("assistant").alias("guest"), other.alias("other"), F.sum(tx.word_count(F.col("text"))).alias("words"))
    reason = F.when(F.col("other") > 0, "other speakers").when(F.col("host") == 0, "no host").when(F.col("guest") == 0, "no guest").when(F.col("words") < 100, "too short").otherwise("kept")
    return t.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("""
SELECT '| id | name | note |' AS line UNION ALL SELECT '| --- | --- | --- |' UNION ALL SELECT '| ' || n_nationkey || ' | ' || n_name || ' | ' || CASE WHEN n_nationkey % 2 = 0 THEN 'a \\| b c' ELSE '' END || ' |' FROM nation""")
def markdown_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report's table in Markdown, as it stands in its files."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"
    note = F.when(F.col("n_nationkey") % 2 == 0, "a | b\n c")
    sinks.markdown(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), note.alias("note")), folder, "id")
    return spark.read.text(f"{folder}/0-header").union(spark.read.text(f"{folder}/1-rows")).withColumnRenamed("value", "line")


@query("""
SELECT event_type AS kind, least(CAST(floor(value / 10) AS INT), 9) AS bin, count(*) AS n, round(avg(value), 4) AS mean FROM events GROUP BY ALL""")
def summary_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A summary written as sorted CSV and read back."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"
    s = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("kind"), F.least(F.floor(F.col("value") / 10), F.lit(9)).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean"))
    sinks.sorted_csv(s, folder, "kind", "bin")
    return spark.read.csv(folder, header=True, schema="kind string, bin int, n long, mean double")


@query("""
SELECT 'R' || n_nationkey AS item, 'Land of ' || n_name AS text, n_nationkey % 2 = 0 AS reversed FROM nation""")
def html_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scoring key from a page's table rows: item, text, and a sign for reversed items."""
    k = F.col("n_nationkey")
    html = F.concat(F.lit("<tr class='i'><td>R"), k.cast("string"), F.lit("</td> <td><b>Land&nbsp;of "), F.col("n_name"), F.lit("</b>"), F.when(k % 2 == 0, "</td><td>&minus;").otherwise("</td><td>+"), F.lit("</td></tr>"))
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(html, r"</td>\s*<td>", "\t"), "<[^>]*>", ""), "&nbsp;", " ")
    cells = F.split(plain, "\t")
    return table(spark, sf_dir, "nation").select(F.get(cells, F.lit(0)).alias("item"), tx.squeeze(F.get(cells, F.lit(1))).alias("text"), F.get(cells, F.lit(2)).isin("&minus;", "-").alias("reversed"))
