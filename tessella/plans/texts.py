"""Texts: counts, sets, shingles, leaks, TF-IDF, parsed completions, pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import dist, parse
from tessella.functions import text as tx
from tessella.operators import linkage, rank
from tessella.operators.components import components as connected
from tessella.plans.registry import query
from tessella.runtime import table
from tessella.sources import views

_W = "list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda w: w <> '')"
_SET = f"list_distinct(list_filter(list_transform({_W}, lambda w: lower(regexp_replace(w, '^[^\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+$', '', 'g'))), lambda w: w <> ''))"


@query(f"SELECT doc_id, CAST(len({_W}) AS INT) AS words, CAST(length(text) AS INT) AS chars, CAST(len({_SET}) AS INT) AS distinct_words FROM documents")
def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", tx.word_count(t).alias("words"), F.length(t).alias("chars"), F.size(tx.word_set(t)).alias("distinct_words"))


@query("""
SELECT conv_id, turn, lower(regexp_replace(coalesce(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')[1], ''), '^[^\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+$', '', 'g')) AS first_word,
       array_to_string(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')[1:5], ' ') || CASE WHEN len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) > 5 THEN ' ...' ELSE '' END AS head,
       NOT right(trim(text), 1) IN ('.', '!', '?', ')', '"', '''', '”', '’') AS truncated, sha256(text) AS sha FROM conversations""")
def text_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.first_word(t).alias("first_word"), tx.first_words(t, 5).alias("head"), tx.looks_truncated(t).alias("truncated"), F.sha2(t, 256).alias("sha"))


#: Classes of equal sets by their smallest document, and every further document with its class's.
_CLASSES = "c AS (SELECT source, list_sort(g) AS g, min(doc_id) AS k, list(doc_id) AS members FROM s WHERE len(g) > 0 GROUP BY source, list_sort(g)), l AS (SELECT source, k, len(g) AS n, unnest(g) AS x FROM c), p AS (SELECT a.source, a.k AS a, b.k AS b, a.n AS n_a, b.n AS n_b, count(*) AS shared FROM l a JOIN l b ON a.source = b.source AND a.x = b.x AND a.k < b.k GROUP BY ALL), m AS (SELECT source, k AS a, unnest(members) AS b, len(g) AS n FROM c)"


@query(f"""
WITH s AS (SELECT doc_id, source, {_SET} AS g FROM documents), {_CLASSES}
SELECT source, a, b, shared, round(shared / (n_a + n_b - shared), 6) AS jaccard FROM p WHERE shared / (n_a + n_b - shared) >= 0.6 UNION ALL SELECT source, a, b, n, 1.0 FROM m WHERE a <> b""")
def jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of one source with similar word sets; copies are paired with the first of them only."""
    s = table(spark, sf_dir, "documents").select("source", "doc_id", tx.word_set(F.col("text")).alias("w"))
    found = linkage.similar_pairs(s, "source", "doc_id", "w", linkage.JACCARD)
    return found.select("source", "a", "b", "shared", F.round("jaccard", 6).alias("jaccard"))


_SHINGLES = f"list_distinct(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i : i + 4], ' ')))"


_NEAR = f"""d AS (SELECT doc_id, source, {_W} AS w FROM documents), s AS (SELECT doc_id, source, CASE WHEN len(w) = 0 THEN [] ELSE {_SHINGLES} END AS g FROM d), {_CLASSES},
     near AS (SELECT a, b, n_a, n_b, shared FROM p WHERE least(n_a, n_b) >= 20 AND (shared / (n_a + n_b - shared) >= 0.6 OR (shared / least(n_a, n_b) >= 0.8 AND least(n_a, n_b) >= 50)) UNION ALL SELECT a, b, n, n, n FROM m WHERE a <> b)"""


@query(f"WITH {_NEAR} SELECT * FROM near")
def shingle_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates of one source by 5-word shingles; copies are paired with the first of them only."""
    p = _shingle_pairs(spark, sf_dir)
    return p.select("a", "b", F.col("n_a").cast("long").alias("n_a"), F.col("n_b").cast("long").alias("n_b"), "shared")


def _shingle_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "documents").select("source", "doc_id", tx.shingles(tx.words(F.col("text")), 5).alias("s"))
    return linkage.near_pairs(s, "source", "doc_id", "s")


@query(f"""
WITH RECURSIVE {_NEAR}, e AS (SELECT a, b FROM near UNION SELECT b, a FROM near), r(x, y) AS (SELECT a, a FROM e UNION SELECT r.x, e.b FROM r JOIN e ON e.a = r.y), g AS (SELECT x, min(y) AS root FROM r GROUP BY x)
SELECT root, count(*) AS size FROM g GROUP BY root""")
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near-duplicates: their links' transitive closure."""
    return connected(_shingle_pairs(spark, sf_dir)).groupBy("root").agg(F.count("*").alias("size"))


@query("""
WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}') AS w FROM documents), b AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}') AS w FROM benchmark),
     dg AS (SELECT DISTINCT doc_id, array_to_string(w[p : p + 9], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 8)) AS p FROM t)),
     bg AS (SELECT item_id, g, count(*) OVER (PARTITION BY item_id) AS n FROM (SELECT DISTINCT item_id, array_to_string(w[p : p + 9], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 8)) AS p FROM b)))
SELECT doc_id, item_id, count(*) AS shared, round(count(*) / any_value(n), 6) AS share FROM dg JOIN bg USING (g) GROUP BY doc_id, item_id""")
def ngram_leak_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", tx.tokens(F.col("text")).alias("w"))
    b = table(spark, sf_dir, "benchmark").select("item_id", tx.tokens(F.col("text")).alias("w"))
    return linkage.leaks(d, b, "doc_id", "item_id", "w", 10).select("doc_id", "item_id", "shared", F.round("share", 6).alias("share"))


_TERMS = "SELECT item_id AS doc, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')) AS term FROM benchmark"
_TFIDF = f"""WITH t AS ({_TERMS}), n AS (SELECT count(DISTINCT doc) AS n FROM t), tf AS (SELECT doc, term, count(*) AS tf FROM t GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
     r AS (SELECT doc, term, tf * (ln((1 + n) / (1 + df)) + 1) AS raw FROM tf JOIN df USING (term), n WHERE df <= 0.9 * n), v AS (SELECT doc, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc)) AS w FROM r)"""


def _benchmark_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.tfidf(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc"), F.explode(tx.tokens(F.col("text"))).alias("term")))


@query(_TFIDF + "SELECT doc, term, round(w, 6) AS w, CAST(row_number() OVER (PARTITION BY doc ORDER BY round(w, 6) DESC, term) AS INT) AS rank FROM v QUALIFY rank <= 5")
def tfidf_top_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _benchmark_vectors(spark, sf_dir).withColumn("w", F.round("w", 6))
    return rank.top_per_group(v, ["doc"], [F.desc("w"), F.col("term")], 5)


@query(_TFIDF + ", c AS (SELECT x.doc AS a, y.doc AS b, round(least(1.0, greatest(0.0, sum(x.w * y.w))), 6) AS cosine FROM v x JOIN v y ON x.term = y.term AND x.doc <> y.doc GROUP BY ALL) SELECT a, b, cosine, CAST(row_number() OVER (PARTITION BY a ORDER BY cosine DESC, b) AS INT) AS rank FROM c QUALIFY rank <= 6")
def tfidf_cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item's most similar other items, with runners-up."""
    v = _benchmark_vectors(spark, sf_dir)
    c = rank.sparse_cosine(v, v).filter("a <> b").withColumn("cosine", F.round("cosine", 6))
    return rank.top_per_group(c, ["a"], [F.desc("cosine"), F.col("b")], 6)


@query("""
WITH c AS (SELECT id, regexp_extract_all(text, '(?:^|[^\\d.])(\\d+)\\s*:\\s*(-?\\d*\\.?\\d+)', 1) AS k, list_transform(regexp_extract_all(text, '(?:^|[^\\d.])(\\d+)\\s*:\\s*(-?\\d*\\.?\\d+)', 2), lambda x: CAST(x AS DOUBLE)) AS m FROM {completions}),
     d AS (SELECT id, unnest(k)::INT AS k, unnest(m) AS m FROM c WHERE list_sort(k) = ['1', '2', '3', '4', '5', '6', '7'] AND list_sum(m) > 0)
SELECT id, round(sum(k * m) / sum(m), 6) AS ev, min(CASE WHEN m = top THEN k END) AS argmax, round(sum(CASE WHEN m > 0 THEN -m / total * ln(m / total) ELSE 0 END), 5) AS entropy FROM (SELECT *, max(m) OVER (PARTITION BY id) AS top, sum(m) OVER (PARTITION BY id) AS total FROM d) GROUP BY id""")
def parse_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = views.completions(spark, sf_dir).select("id", parse.scale_distribution(F.col("text")).alias("d")).filter("d IS NOT NULL")
    return d.select("id", F.round(dist.expected_value(F.col("d")), 6).alias("ev"), dist.argmax(F.col("d")).alias("argmax"), F.round(dist.entropy(F.col("d")), 5).alias("entropy"))


@query("""
WITH p AS (SELECT id, regexp_extract_all(text, '[0-9]+') AS n, len(regexp_extract_all(text, '\\d')) AS digits, text FROM {completions})
SELECT id, CAST(list_filter(n, lambda x: length(x) = 1 AND x BETWEEN '1' AND '7')[-1] AS INT) AS last_digit, CASE WHEN digits = 1 AND CAST(n[1] AS INT) BETWEEN 1 AND 7 THEN CAST(n[1] AS INT) END AS strict FROM p""")
def parse_last_digit(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return views.completions(spark, sf_dir).select("id", parse.last_digit(t).alias("last_digit"), parse.strict_digit(t).alias("strict"))


@query("""
WITH c AS (SELECT id, list_transform(regexp_extract_all(text, '\\b([A-D])\\s*[:=]\\s*(\\d*\\.?\\d+)', 2), lambda x: CAST(x AS DOUBLE)) AS m, regexp_extract_all(text, '\\b([A-D])\\s*[:=]\\s*(\\d*\\.?\\d+)', 1) AS l FROM {completions})
SELECT id, round(m[1] / list_sum(m), 6) AS p_first, round(m[1] / list_sum(m) - list_max(m[2:4]) / list_sum(m), 6) AS margin FROM c WHERE l = ['A', 'B', 'C', 'D'] AND list_sum(m) BETWEEN 0.8 AND 1.2""")
def parse_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = views.completions(spark, sf_dir).select("id", parse.option_distribution(F.col("text")).alias("d")).filter("d IS NOT NULL")
    return d.select("id", F.round(F.get("d", F.lit(0)), 6).alias("p_first"), F.round(dist.margin(F.col("d"), F.lit(0)), 6).alias("margin"))


@query("""
WITH p AS (SELECT user_id % 2 AS g, event_type AS k, count(*) AS n FROM events GROUP BY ALL), q AS (SELECT g, k, n / sum(n) OVER (PARTITION BY g) AS p FROM p)
SELECT round(sum(abs(coalesce(a.p, 0) - coalesce(b.p, 0))) / 2, 6) AS tvd FROM (SELECT * FROM q WHERE g = 0) a FULL JOIN (SELECT * FROM q WHERE g = 1) b ON a.k = b.k""")
def entropy_tvd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Total variation between the event mixes of two groups of users."""
    p = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 2).alias("g"), "event_type").agg(F.count("*").cast("double").alias("n"))
    maps = p.groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("d")).withColumn("d", dist.renormalised(F.col("d")))
    both = maps.agg(F.max_by("d", -F.col("g")).alias("a"), F.max_by("d", "g").alias("b"))
    return both.select(F.round(dist.total_variation(F.col("a"), F.col("b")), 6).alias("tvd"))


@query("""
WITH x AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', '', 'g'), '<[^>]*>', chr(10), 'g') AS t FROM pages),
     l AS (SELECT page_id, list_filter(list_transform(string_split(t, chr(10)), lambda s: trim(s)), lambda s: s <> '') AS l FROM x)
SELECT page_id, CAST(len(l) AS INT) AS lines, l[1] AS first_line, sha256(array_to_string(l, chr(10))) AS sha FROM l""")
def html_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)[^>]*>.*?</(script|style)>", ""), r"<[^>]*>", "\n")
    lines = F.filter(F.transform(F.split(plain, "\n"), lambda s: F.trim(s)), lambda s: s != "")
    return table(spark, sf_dir, "pages").select("page_id", lines.alias("l")).select("page_id", F.size("l").alias("lines"), F.get("l", F.lit(0)).alias("first_line"), F.sha2(F.array_join("l", "\n"), 256).alias("sha"))


@query("""
WITH c AS (SELECT c_custkey AS id, upper(c_name) || CASE c_custkey % 3 WHEN 0 THEN ', HOST' WHEN 1 THEN ', guest of the show' ELSE ' (ANNOUNCER)' END AS label FROM customer)
SELECT id, CASE id % 3 WHEN 0 THEN 'host' WHEN 1 THEN 'guest' ELSE 'other' END AS kind, 'Customer#' || split_part(label[10:], CASE WHEN id % 3 = 2 THEN ' ' ELSE ',' END, 1) AS name FROM c""")
def speaker_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey") % 3
    label = F.concat(F.upper("c_name"), F.when(k == 0, ", HOST").when(k == 1, ", guest of the show").otherwise(" (ANNOUNCER)"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), tx.speaker(label).alias("s")).select("id", "s.kind", "s.name")


@query("""
WITH c AS (SELECT o_custkey AS subject, list(o_orderkey ORDER BY o_orderkey) AS ids FROM orders GROUP BY 1)
SELECT subject, CAST(len(ids) AS INT) AS cells, ids[1] AS first_id, CAST(len(list_filter(ids, lambda i: i % 2 = 0)) AS INT) AS substantive FROM c""")
def transcript_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells are written as text and parsed again; programs hold the separator."""
    cell = F.concat(F.lit("T-"), F.col("o_orderkey").cast("string"), F.lit("|"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("|A; B|cl1|"), F.when(F.col("o_orderkey") % 2 == 0, "S").otherwise("-"))
    joined = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("subject")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", cell.alias("c")))), lambda s: s["c"]), ";").alias("cell"))
    p = joined.select("subject", tx.transcript_cells(F.col("cell")).alias("p"))
    first = F.regexp_extract(F.get("p", F.lit(0))["transcript_id"], r"-(\d+)", 1).cast("long")
    return p.select("subject", F.size("p").alias("cells"), first.alias("first_id"), F.size(F.filter("p", lambda s: s["substantive"])).alias("substantive"))


@query("SELECT p_partkey AS id, CAST(('0x' || sha256(p_name)[1:8])::BIGINT AS BIGINT) AS seed, trim(regexp_replace(lower(p_name || ' / ' || p_brand), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part")
def hashed_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), tx.seed_of(F.col("p_name")).alias("seed"), tx.slug(F.concat_ws(" / ", "p_name", "p_brand")).alias("slug"))
