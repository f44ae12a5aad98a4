"""Dialogue and time: islands, follow-ups, chains, splits, budgets, sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions import text as tx
from tessella.functions.dates import day_bin, tolerant_date
from tessella.operators import rank, seq, sessions, split
from tessella.plans.registry import query
from tessella.plans.texts import _SET
from tessella.runtime import table
from tessella.sources import views

_RUNS = """
WITH t AS (SELECT tid, turn_idx, role, trim(coalesce(text, '')) AS text, lag(role) OVER w AS before, lag(turn_idx) OVER w AS prev_idx, lag(trim(coalesce(text, ''))) OVER w AS prev_text FROM {turns} WINDOW w AS (PARTITION BY tid ORDER BY turn_idx)),
     r AS (SELECT *, sum(CASE WHEN role = 'guest' AND before = 'guest' THEN 0 ELSE 1 END) OVER (PARTITION BY tid ORDER BY turn_idx) AS run FROM t),
     g AS (SELECT tid, run, min(turn_idx) AS first_idx, coalesce(string_agg(text, ' ' ORDER BY turn_idx) FILTER (WHERE text <> ''), '') AS answer, min_by(before, turn_idx) AS before, arg_min(coalesce(prev_idx, -1), turn_idx) AS prev_idx, arg_min(coalesce(prev_text, ''), turn_idx) AS prev_text
           FROM r WHERE role = 'guest' GROUP BY tid, run)"""
_RUNS = _RUNS.replace("min_by(before, turn_idx) AS before", "arg_min(coalesce(before, ''), turn_idx) AS before")


@query(_RUNS + "SELECT tid, prev_idx AS q_turn_idx, prev_text AS question, answer FROM g WHERE before = 'host'")
def qa_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.qa_items(views.turns(spark, sf_dir))


@query(_RUNS + "SELECT tid, first_idx AS answer_idx, CASE WHEN before = 'host' THEN prev_text ELSE '' END AS host, answer FROM g WHERE answer <> ''")
def exchanges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.exchanges(views.turns(spark, sf_dir))


@query(_RUNS + "SELECT h.tid, h.turn_idx AS q_turn_idx, h.text AS question, coalesce(g.answer, '') AS answer FROM t h LEFT JOIN g ON g.tid = h.tid AND g.prev_idx = h.turn_idx AND g.before = 'host' WHERE h.role = 'host' AND h.text <> ''")
def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.segments(views.turns(spark, sf_dir))


@query("""
WITH s AS (SELECT tid, turn_idx, role FROM {turns} WHERE trim(coalesce(text, '')) <> ''),
     g AS (SELECT h.tid, h.turn_idx, max(p.turn_idx) AS guest_idx FROM s h LEFT JOIN s p ON p.tid = h.tid AND p.turn_idx < h.turn_idx AND p.role = 'guest' WHERE h.role = 'host' GROUP BY ALL)
SELECT g.tid, g.turn_idx, g.guest_idx, max(q.turn_idx) AS prev_host_idx, CASE WHEN g.guest_idx IS NULL THEN 'NEW-TOPIC' END AS rule_label FROM g LEFT JOIN s q ON q.tid = g.tid AND q.role = 'host' AND q.turn_idx < g.guest_idx GROUP BY g.tid, g.turn_idx, g.guest_idx""")
def followup_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.followups(views.turns(spark, sf_dir))


@query("""
WITH l AS (SELECT conv_id AS tid, turn AS turn_idx, length(text) % 2 = 0 AS f FROM conversations), c AS (SELECT *, sum(CASE WHEN coalesce(f, false) THEN 0 ELSE 1 END) OVER (PARTITION BY tid ORDER BY turn_idx) AS chain FROM l)
SELECT tid, CAST(chain AS BIGINT) AS chain, min(turn_idx) AS first, max(turn_idx) AS last, count(*) - 1 AS depth FROM c GROUP BY ALL""")
def chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = views.turns(spark, sf_dir).select("tid", "turn_idx", F.when(F.length("text") % 2 == 0, "FOLLOW-UP").otherwise("NEW-TOPIC").alias("label"))
    return sessions.chains(labelled)


@query("""
SELECT tid, min(CASE WHEN role = 'host' THEN turn_idx END) AS first_host, min(CASE WHEN role = 'guest' THEN turn_idx END) AS first_guest,
       coalesce(min(CASE WHEN role = 'guest' THEN turn_idx END) < min(CASE WHEN role = 'host' THEN turn_idx END), min(CASE WHEN role = 'guest' THEN turn_idx END) IS NOT NULL) AS guest_first FROM {turns} GROUP BY tid""")
def first_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.first_words_of_roles(views.turns(spark, sf_dir))


_SPLIT = """
WITH s AS (SELECT subject, cluster, date, words, row_number() OVER w AS n, first_value(date) OVER w AS test_date FROM {clusters} WINDOW w AS (PARTITION BY subject ORDER BY date DESC, cluster DESC)),
     p AS (SELECT subject, cluster, date, words, CASE WHEN n = 1 THEN 'test' WHEN date < test_date THEN 'grounding' ELSE 'excluded' END AS side, CAST(date_diff('day', date, test_date) AS INT) AS delta_days, test_date FROM s)"""


@query(_SPLIT + "SELECT subject, cluster, date, words, side, delta_days FROM p")
def latest_cluster_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.latest_split(views.clusters(spark, sf_dir))


@query("""
WITH d AS (SELECT subject, date, CAST(sum(words) AS BIGINT) AS words FROM {clusters} GROUP BY ALL)
SELECT subject, date, words, CAST(sum(words) OVER (PARTITION BY subject ORDER BY date) AS BIGINT) AS cumulative, sum(words) OVER (PARTITION BY subject ORDER BY date) >= 500000 AS fillable FROM d""")
def running_budget_cutoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.cutoffs(views.clusters(spark, sf_dir), 500_000)


_BIN = "CASE WHEN {0} >= 1095 THEN '36m+' WHEN {0} >= 730 THEN '24-36m' WHEN {0} >= 365 THEN '12-24m' WHEN {0} >= 183 THEN '6-12m' ELSE '<6m' END"


@query(
    _SPLIT
    + """, d AS (SELECT subject, date, any_value(test_date) AS test_date, sum(words) AS words FROM p WHERE side = 'grounding' GROUP BY ALL),
     c AS (SELECT subject, date, CAST(date_diff('day', date, test_date) AS INT) AS delta, CAST(sum(words) OVER (PARTITION BY subject ORDER BY date) AS BIGINT) AS cumulative FROM d)
SELECT subject, """
    + _BIN.format("delta")
    + " AS bin, date AS cutoff, delta, cumulative FROM c WHERE cumulative >= 300000 QUALIFY row_number() OVER (PARTITION BY subject, "
    + _BIN.format("delta")
    + " ORDER BY delta) = 1"
)
def first_per_bin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.first_per_bin(views.clusters(spark, sf_dir), 300_000)


@query(_SPLIT + ", c AS (SELECT subject, " + _BIN.format("delta_days") + " AS bin, avg(words) AS m FROM p WHERE side = 'grounding' GROUP BY ALL) SELECT bin, count(*) AS subjects, round(avg(m), 4) AS mean, round(stddev_samp(m), 4) AS sd FROM c GROUP BY bin")
def cells_by_bin(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = split.latest_split(views.clusters(spark, sf_dir)).filter("side = 'grounding'")
    c = g.groupBy("subject", day_bin(F.col("delta_days")).alias("bin")).agg(F.avg("words").alias("m"))
    return c.groupBy("bin").agg(F.count("*").alias("subjects"), F.round(F.avg("m"), 4).alias("mean"), F.round(F.stddev_samp("m"), 4).alias("sd"))


_CELLS = "SELECT user_id AS subject, CAST(event_id * 5 // 10000 % 5 AS INT) AS bin, avg(CASE WHEN event_id % 2 = 0 THEN value END) AS twin, avg(CASE WHEN event_id % 2 = 1 THEN value END) AS imposter FROM events GROUP BY ALL"


@query(f"WITH c AS ({_CELLS}) SELECT subject, min(CASE WHEN imposter >= twin THEN bin END) AS crossover, count(*) AS bins FROM c GROUP BY subject")
def crossover_bin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first bin in which the imposter reaches the twin, by subject."""
    e = table(spark, sf_dir, "events")
    side = lambda r: F.avg(F.when(F.col("event_id") % 2 == r, F.col("value")))
    c = e.groupBy(F.col("user_id").alias("subject"), F.expr("cast(event_id * 5 div 10000 % 5 as int)").alias("bin")).agg(side(0).alias("twin"), side(1).alias("imposter"))
    return c.groupBy("subject").agg(F.min(F.when(F.col("imposter") >= F.col("twin"), F.col("bin"))).alias("crossover"), F.count("*").alias("bins"))


@query("""
SELECT l_suppkey AS item, l_partkey AS donor, l_orderkey AS tid, CAST(rank AS INT) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_partkey, l_orderkey, l_linenumber) AS rank FROM (
    SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_extendedprice DESC, l_partkey, l_orderkey, l_linenumber) = 1)) WHERE rank <= 6""")
def topk_distinct_donor(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.desc("l_extendedprice"), F.col("l_partkey"), F.col("l_orderkey"), F.col("l_linenumber")]
    best = rank.distinct_top(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_partkey", order, 6)
    return best.select(F.col("l_suppkey").alias("item"), F.col("l_partkey").alias("donor"), F.col("l_orderkey").alias("tid"), "rank")


@query("""
WITH t AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), r AS (SELECT *, rank() OVER (PARTITION BY user_id ORDER BY n DESC) AS k FROM t), u AS (SELECT user_id, count(*) AS tied FROM r WHERE k = 1 GROUP BY user_id)
SELECT count(*) AS subjects, round(avg(CAST(tied > 1 AS INT)), 6) AS share_tied, round(avg(tied), 6) AS mean_tied, max(tied) AS most_tied FROM u""")
def tie_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    top = t.withColumn("k", F.rank().over(Window.partitionBy("user_id").orderBy(F.desc("n")))).filter("k = 1").groupBy("user_id").agg(F.count("*").alias("tied"))
    return top.agg(F.count("*").alias("subjects"), F.round(F.avg((F.col("tied") > 1).cast("int")), 6).alias("share_tied"), F.round(F.avg("tied"), 6).alias("mean_tied"), F.max("tied").alias("most_tied"))


@query("SELECT p_type, p_partkey, ntile(10) OVER (PARTITION BY p_type ORDER BY p_retailprice, p_partkey) AS decile FROM part")
def ntile_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("p_type").orderBy("p_retailprice", "p_partkey")
    return table(spark, sf_dir, "part").select("p_type", "p_partkey", F.ntile(10).over(w).cast("long").alias("decile"))


@query("""
SELECT o_custkey AS subject, min(o_orderdate::DATE) AS earliest, max(CASE WHEN k = (n + 1) // 2 THEN o_orderdate::DATE END) AS middle, max(o_orderdate::DATE) AS latest FROM (
  SELECT o_custkey, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) GROUP BY 1""")
def three_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey")
    o = table(spark, sf_dir, "orders").select("o_custkey", F.to_date("o_orderdate").alias("d"), F.row_number().over(w.orderBy("o_orderdate", "o_orderkey")).alias("k"), F.count("*").over(w).alias("n"))
    middle = F.max(F.when(F.col("k") == F.floor((F.col("n") + 1) / 2), F.col("d")))
    return o.groupBy(F.col("o_custkey").alias("subject")).agg(F.min("d").alias("earliest"), middle.alias("middle"), F.max("d").alias("latest"))


@query("""
WITH RECURSIVE o AS (SELECT o_custkey AS subject, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS k, o_orderkey AS cluster, CAST(floor(o_totalprice) AS BIGINT) AS words FROM orders),
  f(subject, k, cluster, words, used, taken) AS (SELECT subject, CAST(0 AS BIGINT), CAST(-1 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), false FROM o WHERE k = 1
    UNION ALL SELECT o.subject, o.k, o.cluster, o.words, CASE WHEN f.used + o.words <= 1000000 THEN f.used + o.words ELSE f.used END, f.used + o.words <= 1000000 FROM f JOIN o ON o.subject = f.subject AND o.k = f.k + 1)
SELECT subject, cluster, words, max(used) OVER (PARTITION BY subject) AS used FROM f WHERE k > 0 QUALIFY taken""")
def budget_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest orders first, as long as they fit a budget; what doesn't fit is skipped."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("subject"), (-F.unix_date(F.to_date("o_orderdate"))).alias("age"), F.col("o_orderkey").alias("cluster"), F.floor("o_totalprice").cast("long").alias("words"))
    return seq.budget_fill(o, ["subject"], ["age", "cluster"], "words", 1_000_000).select("subject", "cluster", "words", "used")


@query("""
WITH RECURSIVE e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
  f(user_id, k, event_id, last, taken) AS (SELECT user_id, k, event_id, event_id, true FROM e WHERE k = 1
    UNION ALL SELECT e.user_id, e.k, e.event_id, CASE WHEN e.event_id - f.last >= 500 THEN e.event_id ELSE f.last END, e.event_id - f.last >= 500 FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1)
SELECT user_id, event_id FROM f WHERE taken""")
def spaced_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seq.spaced(table(spark, sf_dir, "events"), ["user_id"], "event_id", 500)


@query(f"""
WITH RECURSIVE t AS (SELECT conv_id AS tid, turn AS turn_idx, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, {_SET} AS w FROM conversations),
  f(tid, k, turn_idx, kept, taken) AS (SELECT tid, k, turn_idx, [w], true FROM t WHERE k = 1
    UNION ALL SELECT t.tid, t.k, t.turn_idx, CASE WHEN x.alike THEN f.kept ELSE list_append(f.kept, t.w) END, NOT x.alike FROM f JOIN t ON t.tid = f.tid AND t.k = f.k + 1,
    LATERAL (SELECT len(list_filter(f.kept, lambda o: CASE WHEN len(o) = 0 AND len(t.w) = 0 THEN true ELSE len(list_intersect(o, t.w)) / len(list_distinct(list_concat(o, t.w))) >= 0.5 END)) > 0 AS alike) AS x)
SELECT tid, turn_idx FROM f WHERE taken QUALIFY row_number() OVER (PARTITION BY tid ORDER BY turn_idx) <= 20""")
def dedupe_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation kept first to last unless too like one already kept."""
    t = views.turns(spark, sf_dir).select("tid", "turn_idx", tx.word_set(F.col("text")).alias("w"))
    return seq.greedy_dedup(t, ["tid"], ["turn_idx"], "w", threshold=0.5, most=20)


@query("""
WITH d AS (SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%-m-%-d') WHEN 2 THEN '' WHEN 3 THEN '1997-13-05' WHEN 4 THEN 'June 1997' ELSE '0012-01-02' END AS s, o_orderdate FROM orders)
SELECT id, CASE WHEN id % 6 IN (0, 1) THEN CAST(o_orderdate AS DATE) END AS date,
       CASE id % 6 WHEN 0 THEN 'ok' WHEN 1 THEN CASE WHEN regexp_full_match(s, '\\d{4}-\\d\\d-\\d\\d') THEN 'ok' ELSE 'ok_padding_fixed' END WHEN 2 THEN 'missing' WHEN 3 THEN 'invalid_calendar' WHEN 4 THEN 'unparseable' ELSE 'implausible_year' END AS quality FROM d""")
def date_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 6
    plain = F.concat_ws("-", F.year(d).cast("string"), F.month(d).cast("string"), F.dayofmonth(d).cast("string"))
    s = F.when(k == 0, F.date_format(d, "yyyy-MM-dd")).when(k == 1, plain).when(k == 2, "").when(k == 3, "1997-13-05").when(k == 4, "June 1997").otherwise("0012-01-02")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), tolerant_date(s).alias("p")).select("id", "p.date", "p.quality")


@query("""
WITH w AS (SELECT user_id, event_id, ts, sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS spent FROM events)
SELECT user_id, event_id, round(spent, 4) AS spent FROM w WHERE spent > 500 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1""")
def spend_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event at which a user's running spend passes the cap."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").withColumn("spent", F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("spent > 500")
    return e.withColumn("k", F.row_number().over(w)).filter("k = 1").select("user_id", "event_id", F.round("spent", 4).alias("spent"))
