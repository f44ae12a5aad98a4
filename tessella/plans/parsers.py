"""Parsed completions of every format, over texts made from events; and what is computed from parsed distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import dist, parse
from tessella.functions import text as tx
from tessella.plans.registry import query
from tessella.runtime import table
from tessella.sources import views


def _events(spark: SparkSession, sf_dir: str, text: str, *more: str) -> DataFrame:
    """(id, text): a text made from each event, in SQL that both engines read."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.expr(text).alias("text"), *[F.expr(m) for m in more])


@query("""
WITH p AS (SELECT id, id % 2 AS v, regexp_extract_all(text, '[0-9]+') AS n, len(regexp_extract_all(text, '\\d')) AS digits FROM {completions})
SELECT id, CASE WHEN v = 1 THEN CAST(list_filter(n, lambda x: length(x) = 1 AND x BETWEEN '1' AND '7')[-1] AS INT) WHEN digits = 1 AND CAST(n[1] AS INT) BETWEEN 1 AND 7 THEN CAST(n[1] AS INT) END AS parsed FROM p""")
def parse_by_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each completion by the parser of its variant."""
    c = views.completions(spark, sf_dir)
    parsed = F.when(F.col("id") % 2 == 0, parse.PARSERS["v0"](F.col("text"))).otherwise(parse.PARSERS["v1"](F.col("text")))
    return c.select("id", parsed.alias("parsed"))


_FIVE = "concat_ws(' ', " + ", ".join(f"concat('{k}:0.', cast((event_id * {k} + 3) % 10 as {{t}}))" for k in range(1, 6)) + ", CASE WHEN event_id % 4 = 0 THEN '6:0.1' END)"


@query(f"""
WITH c AS (SELECT event_id AS id, {_FIVE.format(t="VARCHAR")} AS text FROM events), m AS (SELECT id, list_transform(regexp_extract_all(text, ':(\\d*\\.?\\d+)', 1), lambda x: CAST(x AS DOUBLE)) AS m FROM c WHERE id % 4 <> 0)
SELECT id, round(list_sum(list_transform(range(1, 6), lambda i: i * m[i])) / list_sum(m), 6) AS ev FROM m WHERE list_sum(m) > 0""")
def parse_five(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distributions over five answers; a sixth key fails the text."""
    d = _events(spark, sf_dir, _FIVE.format(t="string")).select("id", parse.scale_distribution(F.col("text"), 1, 5).alias("d")).filter("d IS NOT NULL")
    return d.select("id", F.round(dist.expected_value(F.col("d")), 6).alias("ev"))


_MANY = "concat('Here they are', chr(10), '- **T2**: 1:0.', cast(event_id % 7 + 1 as {t}), ' 2:0.3', chr(10), CASE WHEN event_id % 5 = 0 THEN 'T3' ELSE '1. t1' END, ' - 1:0.5 2:0.', cast(event_id % 9 as {t}), CASE WHEN event_id % 3 = 0 THEN concat(chr(10), 'T1: 1:1 2:0') ELSE '' END)"


@query("""
SELECT event_id AS id, code, CAST(k AS INT) AS k, round(m / sum(m) OVER (PARTITION BY event_id, code), 6) AS p FROM events, (VALUES ('T1', 1), ('T1', 2), ('T2', 1), ('T2', 2)) AS v(code, k),
     LATERAL (SELECT CASE WHEN code = 'T1' AND event_id % 15 = 0 THEN 2 - k WHEN code = 'T1' THEN CASE k WHEN 1 THEN 0.5 ELSE (event_id % 9) / 10.0 END ELSE CASE k WHEN 1 THEN (event_id % 7 + 1) / 10.0 ELSE 0.3 END END AS m) AS x WHERE (event_id % 5 = 0) = (event_id % 3 = 0)""")
def parse_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several targets in one completion, all or none: a missing or repeated code fails it, a strange one is passed over."""
    d = _events(spark, sf_dir, _MANY.format(t="string")).select("id", parse.many_distributions(F.col("text"), ["T1", "T2"], 1, 2).alias("d")).filter("d IS NOT NULL")
    long = d.select("id", F.explode("d").alias("code", "one")).select("id", "code", F.explode("one").alias("k", "p"))
    return long.select("id", "code", "k", F.round("p", 6).alias("p"))


_WIDE = "concat('I thought A: 0.9 at first. ', CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'Rather A: 0.4 B: 0.3 C: 0.2 D: 0.1' ELSE concat('A: 40% B: 30% C: 20% D: ', cast(event_id % 7 as {t}), '%. So A: 0.25 B: 0.25 C: 0.', cast(event_id % 4 + 1 as {t}), ' D: 0.25') END)"


@query("""
SELECT event_id AS id, round(CASE WHEN event_id % 3 = 1 THEN 0.4 ELSE 0.25 / (0.75 + (event_id % 4 + 1) / 10.0) END, 6) AS p_first FROM events WHERE event_id % 3 = 1 OR (event_id % 3 = 2 AND 0.75 + (event_id % 4 + 1) / 10.0 >= 0.8)""")
def parse_widened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stretch of a completion that parses, where the whole doesn't."""
    d = _events(spark, sf_dir, _WIDE.format(t="string")).select("id", parse.widened_options(F.col("text")).alias("d")).filter("d IS NOT NULL")
    return d.select("id", F.round(F.get("d", F.lit(0)), 6).alias("p_first"))


_LABELLED = "concat('Some thoughts', chr(10), CASE event_id % 4 WHEN 0 THEN ' same ' WHEN 1 THEN 'DIFFERENT' WHEN 2 THEN concat('Same', chr(10), 'different') ELSE 'It is the same' END, chr(10))"


@query("SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN 'SAME' WHEN 1 THEN 'DIFFERENT' END AS label FROM events")
def parse_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The only line that is a label."""
    return _events(spark, sf_dir, _LABELLED).select("id", parse.label_line(F.col("text"), ["SAME", "DIFFERENT", "UNCLEAR"]).alias("label"))


_BLOCKED = "concat('intro <<<2>>> two ', cast(event_id as {t}), chr(10), '<<<1>>>', chr(10), 'one', CASE WHEN event_id % 2 = 0 THEN ' <<<2>>> again' ELSE '' END)"


@query("SELECT event_id AS id, 2 AS k, 'two ' || event_id AS block FROM events UNION ALL SELECT event_id, 1, 'one' FROM events")
def parse_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered blocks, the first of each number."""
    b = _events(spark, sf_dir, _BLOCKED.format(t="string")).select("id", F.explode(parse.numbered_blocks(F.col("text"))).alias("b"))
    return b.select("id", "b.k", F.col("b.text").alias("block"))


_ELAPSED = "CASE event_id % 4 WHEN 0 THEN concat(cast(event_id % 3 as {t}), '-0', cast(event_id % 10 as {t}), ':10:05') WHEN 1 THEN concat(cast(event_id % 24 as {t}), ':00:', cast(10 + event_id % 50 as {t})) WHEN 2 THEN '05:10' ELSE 'UNLIMITED' END"


@query("SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN event_id % 3 * 86400 + event_id % 10 * 3600 + 605 WHEN 1 THEN event_id % 24 * 3600 + 10 + event_id % 50 END AS seconds FROM events")
def parse_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds of a scheduler's elapsed times."""
    return _events(spark, sf_dir, _ELAPSED.format(t="string")).select("id", parse.elapsed_seconds(F.col("text")).alias("seconds"))


@query("""
WITH c AS (SELECT id, CASE WHEN id % 11 = 0 THEN '' WHEN id % 7 = 0 THEN 'no idea' WHEN id % 13 = 0 THEN text || ' and so' ELSE text END AS t FROM {completions})
SELECT id, CASE WHEN trim(t) = '' THEN 'empty' WHEN NOT regexp_matches(t, '[0-9]') THEN 'no_digit' WHEN NOT regexp_matches(rtrim(t), '[0-9.!?)%]$') THEN 'truncated' ELSE 'format' END AS kind FROM c""")
def failure_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a completion gave no answer."""
    i, t = F.col("id"), F.col("text")
    said = F.when(i % 11 == 0, "").when(i % 7 == 0, "no idea").when(i % 13 == 0, F.concat(t, F.lit(" and so"))).otherwise(t)
    return views.completions(spark, sf_dir).select("id", parse.failure_kind(said).alias("kind"))


def _belief(seed: Column) -> Column:
    """A distribution over 1 to 5 from a number."""
    mass = F.transform(F.sequence(F.lit(1), F.lit(5)), lambda k: (F.pmod(seed * k, F.lit(7))).cast("double"))
    return F.map_from_arrays(F.sequence(F.lit(1), F.lit(5)), mass)


@query("""
WITH w AS (SELECT event_id AS id, list_transform([1, 3, 5], lambda k: CAST(event_id * k % 7 AS DOUBLE)) AS m, list_transform([1, 3, 5], lambda k: event_id % (k + 1) / 4.0) AS s FROM events),
     n AS (SELECT id, s, CASE WHEN list_sum(m) > 0 THEN list_transform(m, lambda x: x / list_sum(m)) ELSE [1 / 3.0, 1 / 3.0, 1 / 3.0] END AS w FROM w)
SELECT id, round(w[1], 6) AS w1, round(w[3], 6) AS w5, round(s[1] * w[1] + s[2] * w[2] + s[3] * w[3], 6) AS shift FROM n""")
def hypothetical_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of hypothetical answers, and the mean shift over them."""
    i = F.col("event_id")
    e = table(spark, sf_dir, "events").select(i.alias("id"), dist.hypothetical_weights(_belief(i)).alias("w"), F.create_map(*[x for k in (1, 3, 5) for x in (F.lit(k), i % (k + 1) / 4.0)]).alias("s"))
    return e.select("id", F.round(F.element_at("w", F.lit(1)), 6).alias("w1"), F.round(F.element_at("w", F.lit(5)), 6).alias("w5"), F.round(dist.expected_shift(F.col("s"), F.col("w")), 6).alias("shift"))


@query("""
WITH t AS (SELECT conv_id, turn, len(list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda w: w <> '')) AS words, regexp_matches(text, '[0-9]') AS digit FROM conversations)
SELECT conv_id, turn, CASE WHEN words / 200.0 <= 0.02 THEN 'Z' WHEN words / 200.0 <= 0.08 THEN 'L' ELSE 'H' END AS bucket FROM t""")
def density_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buckets of a share, both edges in the lower one."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.density_bucket(tx.word_count(F.col("text")) / 200.0).alias("bucket"))


@query("""
WITH c AS (SELECT id, text, CASE WHEN id % 5 = 2 THEN CAST(text AS INT) + CASE WHEN id % 10 = 7 THEN 1 ELSE 0 END END AS stored FROM {completions}), p AS (SELECT *, CASE WHEN len(regexp_extract_all(text, '\\d')) = 1 AND regexp_extract(text, '\\d') BETWEEN '1' AND '7' THEN CAST(regexp_extract(text, '\\d') AS INT) END AS again FROM c)
SELECT id % 5 AS kind, count(*) AS n, count_if(again IS NOT NULL) AS parsed, count_if(stored IS NOT NULL AND (again IS NULL OR abs(again - stored) > 1e-9)) AS mismatches, count_if(stored IS NULL AND again IS NOT NULL) AS unstored FROM p GROUP BY 1""")
def decoding_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored answers against what their texts parse to now."""
    i = F.col("id")
    c = views.completions(spark, sf_dir).withColumn("stored", F.when(i % 5 == 2, F.col("text").try_cast("int") + F.when(i % 10 == 7, 1).otherwise(0))).withColumn("again", parse.strict_digit(F.col("text")))
    wrong = F.col("stored").isNotNull() & (F.col("again").isNull() | (F.abs(F.col("again") - F.col("stored")) > 1e-9))
    return c.groupBy((i % 5).alias("kind")).agg(F.count("*").alias("n"), F.count("again").alias("parsed"), F.count_if(wrong).alias("mismatches"), F.count_if(F.col("stored").isNull() & F.col("again").isNotNull()).alias("unstored"))
