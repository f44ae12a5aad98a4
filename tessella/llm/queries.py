"""The registered queries of this subpackage, with their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import licenses, toxicity
from tessella.llm.common import held_out
from tessella.llm.decontam import decontaminate
from tessella.llm.html_extract import extract
from tessella.llm.langid import identify, learn
from tessella.llm.packing import pack, sequence_columns
from tessella.llm.sharding import shard
from tessella.llm.simhash import hex_of, near_duplicates
from tessella.llm.substrings import dedup_substrings
from tessella.llm.topk import top_k
from tessella.runtime import table


def tokenizer_path() -> str:
    """The public vocabulary that the packing query uses; a cluster names its own copy to the operator."""
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = table(spark, sf_dir, "documents"), held_out(F.col("doc_id"))
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"), ~out)
    return toxicity.classify(docs, model).select("doc_id", out.alias("held_out"), "score", "predicted")


#: Documents have no path: by source and id, every tenth one a licence file by name.
_PATH = "concat('/', coalesce(source, 'unknown'), '/', cast(cast((doc_id - doc_id % 1000) / 1000 as bigint) as {text}), '/', CASE WHEN doc_id % 10 = 0 THEN 'LICENSE' ELSE concat('d', cast(cast((doc_id - doc_id % 100) / 100 as bigint) as {text}), '/', cast(doc_id as {text}), '.txt') END)"


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "documents").select("doc_id", "text", F.expr(_PATH.format(text="string")).alias("path"))
    return licenses.scan(files, id_col="doc_id", path_col="path", text_col="text")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = held_out(F.col("doc_id"))
    return identify(docs, learn(docs, ~out)).select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(table(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False)
    return pieces.select("doc_id", *sequence_columns())


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", hex_of(F.col("fp")).alias("fingerprint"), "component_id")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard(table(spark, sf_dir, "documents"), with_text=False)
    return placed.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    listed = F.array_join(F.array_sort("item_ids"), ",")
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(listed, 256).alias("items_sha256"), "contaminated")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = dedup_substrings(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_license_scan, op3_language_id, op4_exact_top_k, op5_html_extraction, op6_packing, op7_simhash_near_dedup, op8_sharding, op9_benchmark_decontamination, op10_substring_dedup)}

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_TEMPLATES = ", ".join("({}, '{}', '{}', '{}')".format(i, t.name, t.kind, t.text.replace("'", "''")) for i, t in enumerate(licenses.templates()))

SQL = {
    "op2_license_scan": f"""
WITH f AS (SELECT row_number() OVER () AS r, doc_id, text, {_PATH.format(text="VARCHAR")} AS path FROM documents),
     n AS (SELECT count(*) AS n FROM f),
     t AS (SELECT i, name, kind, unnest(regexp_extract_all(lower(body), '[a-z0-9]+')) AS term FROM (VALUES {_TEMPLATES}) AS v(i, name, kind, body)),
     tf AS (SELECT i, name, kind, term, 1 + ln(count(*)) AS k FROM t GROUP BY ALL),
     dt AS (SELECT r, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS term FROM f),
     idf AS (SELECT term, ln((1 + any_value(n)) / (1 + count(r))) + 1 AS idf FROM (SELECT DISTINCT term FROM tf) LEFT JOIN dt USING (term), n GROUP BY term),
     tw AS (SELECT i, name, kind, term, k * idf / sqrt(sum(k * idf * k * idf) OVER (PARTITION BY i)) AS weight FROM tf JOIN idf USING (term)),
     u AS (SELECT r, 0 AS no, text AS line FROM f UNION ALL SELECT r, unnest(range(1, len(string_split(text, chr(10))) + 1)), unnest(string_split(text, chr(10))) FROM f),
     ut AS (SELECT r, no, term, 1 + ln(count(*)) AS k FROM (SELECT r, no, unnest(regexp_extract_all(lower(line), '[a-z0-9]+')) AS term FROM u) GROUP BY ALL),
     uw AS (SELECT r, no, term, k * coalesce(idf, ln(1 + n) + 1) AS w FROM ut LEFT JOIN idf USING (term), n),
     norm AS (SELECT r, no, sqrt(sum(w * w)) AS norm FROM uw GROUP BY ALL),
     s AS (SELECT r, no, name, round(sum(w * weight) / any_value(norm), 6) AS score FROM uw JOIN tw USING (term) JOIN norm USING (r, no)
           WHERE kind = 'header' OR no = 0 GROUP BY r, no, i, name),
     own AS (SELECT r, name, score, no = 0 AS whole FROM s WHERE score >= {licenses.THRESHOLD}
             QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, name, least(no, 1)) = 1),
     p AS (SELECT r, doc_id, path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, regexp_extract(path, '([^/]*)$', 1) AS base FROM f),
     m AS (SELECT * FROM p LEFT JOIN own USING (r)),
     held AS (SELECT dir AS from_dir, name AS held, score AS held_score FROM m WHERE name IS NOT NULL AND regexp_matches(base, '(?i)^(licen[cs]e|copying|unlicense)([._-].*)?$')
              QUALIFY row_number() OVER (PARTITION BY dir ORDER BY score DESC, name) = 1),
     up AS (SELECT dir, k, array_to_string(string_split(dir, '/')[1 : len(string_split(dir, '/')) - k], '/') AS from_dir
            FROM (SELECT dir, unnest(range(0, len(string_split(dir, '/')))) AS k FROM (SELECT DISTINCT dir FROM p))),
     near AS (SELECT * FROM up JOIN held USING (from_dir) QUALIFY row_number() OVER (PARTITION BY dir ORDER BY k) = 1)
SELECT m.doc_id, m.path, coalesce(m.name, near.held) AS license,
       CASE WHEN m.name IS NOT NULL THEN CASE WHEN whole THEN 'file' ELSE 'header' END WHEN near.held IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
       CASE WHEN m.name IS NOT NULL THEN m.score ELSE near.held_score END AS score, CASE WHEN m.name IS NULL THEN near.from_dir END AS from_dir
FROM m LEFT JOIN near ON m.dir = near.dir""",
    "op4_exact_top_k": """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT q.r AS q, q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
           FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.r <> c.r AND len(q.e) = len(c.e)),
     r AS (SELECT *, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op9_benchmark_decontamination": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
                  coalesce(regexp_extract_all({_LOWER}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+'), []) AS w FROM documents),
     i AS (SELECT CAST(item_id AS VARCHAR) AS item, coalesce(regexp_extract_all({_LOWER}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+'), []) AS w FROM benchmark),
     iw AS (SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[p : p + least(13, len(w)) - 1], ' ') AS t
            FROM i, unnest(range(1, greatest(1, len(w) - 11))) AS u(p) WHERE len(w) > 0),
     sizes AS (SELECT DISTINCT n FROM iw),
     dw AS (SELECT r, n, p, array_to_string(w[p : p + n - 1], ' ') AS t
            FROM (SELECT r, n, w, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes WHERE len(w) >= n)),
     hits AS (SELECT dw.r, dw.n, dw.p, iw.item FROM dw JOIN iw ON dw.n = iw.n AND dw.t = iw.t),
     words AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT r, p, n FROM hits)) GROUP BY r),
     items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)""",
    "op10_substring_dedup": """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
     win AS (SELECT r, p, md5(array_to_string(w[p : p + 34], ' ')) AS t FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS p FROM d WHERE len(w) >= 35)),
     rep AS (SELECT t FROM win GROUP BY t HAVING count(*) > 1),
     gone AS (SELECT DISTINCT r, unnest(range(p, p + 35)) AS q FROM win WHERE t IN (SELECT t FROM rep)),
     words AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS q FROM d),
     kept AS (SELECT r, string_agg(word, ' ' ORDER BY q) AS t FROM words ANTI JOIN gone USING (r, q) GROUP BY r),
     n AS (SELECT r, count(*) AS n_removed FROM gone GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN n USING (r) LEFT JOIN kept USING (r)""",
}
