"""Scrubbed texts, guards, names, and texts around matches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions import names, scrub
from tessella.functions import text as tx
from tessella.plans.registry import query
from tessella.runtime import ship, table

_W = "list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda w: w <> '')"


@query("SELECT doc_id, sha256(trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))) AS sha FROM documents")
def squeezed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(tx.squeeze(F.col("text")), 256).alias("sha"))


@query("""
WITH t AS (SELECT conv_id, turn, trim(coalesce(text, '')) AS t FROM conversations), p AS (SELECT *, regexp_extract_all(t, '(?s).+?[.!?]+["'')\\]”’]*(?:\\s|$)|.+$') AS p, list_filter(regexp_split_to_array(t, '\\s+'), lambda w: w <> '') AS w FROM t),
     s AS (SELECT *, list_transform(range(1, len(p) + 1), lambda i: len(list_filter(regexp_split_to_array(array_to_string(p[1:i], ''), '\\s+'), lambda w: w <> ''))) AS sums FROM p),
     g AS (SELECT *, list_transform(range(1, len(p) + 1), lambda i: CASE WHEN regexp_matches(p[i], '[.!?]+["'')\\]”’]*\\s*$') THEN abs(sums[i] - 8) END) AS gaps FROM s), a AS (SELECT *, list_position(gaps, list_min(gaps)) AS best FROM g)
SELECT conv_id, turn, len(w) > 12 AS truncated, CASE WHEN len(w) <= 12 THEN t WHEN sums[best] < len(w) AND sums[best] <= 12 THEN trim(array_to_string(p[1:best], ''), ' ' || chr(10)) ELSE array_to_string(w[1:8], ' ') END AS text FROM a""")
def truncated_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers cut at the sentence end nearest 8 words."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.truncate_answer(F.col("text"), 12, 8).alias("a")).select("conv_id", "turn", "a.truncated", "a.text")


@query(f"""
WITH t AS (SELECT conv_id, turn, lower(array_to_string({_W}, ' ')) AS w FROM conversations), p AS (SELECT *, lag(w) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM t)
SELECT conv_id, turn, contains(' ' || before || ' ', ' ' || array_to_string(string_split(w, ' ')[1:2], ' ') || ' ') AS echoes FROM p WHERE before IS NOT NULL""")
def echoed_openings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a turn's first two words occur together in the turn before."""
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.words(F.lower("text")).alias("w"))
    p = t.withColumn("before", F.lag("w").over(Window.partitionBy("conv_id").orderBy("turn"))).filter("before IS NOT NULL")
    return p.select("conv_id", "turn", tx.contains_run(F.slice("w", 1, 2), F.col("before")).alias("echoes"))


_NAMES = ("France", "Germany", "New Jordan", "Jordan", "China")


@query("""
WITH s AS (SELECT n_nationkey AS id, 'Dr. ' || upper(n_name[1:1]) || lower(n_name[2:]) || ' met Mr. Jordan and New Jordan, not Jordanians, near Senator  China.' AS said FROM nation),
     r AS (SELECT id, said, regexp_replace(said, '\\b(?:(?:Mr|Mrs|Ms|Dr|Senator|President)\\.?\\s+)?(?:New Jordan|Germany|France|Jordan|China)\\b', '[NAME]', 'g') AS redacted FROM s)
SELECT id, redacted, CAST(len(list_filter(['France', 'Germany', 'New Jordan', 'Jordan', 'China', 'Egypt'], lambda n: regexp_matches(lower(redacted), '\\b' || lower(n) || '\\b'))) AS INT) AS left_over FROM r""")
def redacted_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names redacted, longest first, with their titles; and how many names survive, one of which was never asked for."""
    n = F.col("n_name")
    said = F.concat(F.lit("Dr. "), F.upper(F.substring(n, 1, 1)), F.lower(F.substring(n, 2, 100)), F.lit(" met Mr. Jordan and New Jordan, not Jordanians, near Senator  China."))
    r = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), tx.redact(said, list(_NAMES)).alias("redacted"))
    return r.withColumn("left_over", F.size(scrub.survivors(F.col("redacted"), [*_NAMES, "Egypt"])))


_LEAD, _TRAIL = "[\"''“”‘’(\\[{\\-–—*]*", "[,.;:!?)\\]}\"''“”‘’\\-–—*]*"
_TITLES = ", ".join(f"'{h}'" for h in sorted(scrub.HONORIFICS))


@query(f"""
WITH t AS (SELECT conv_id, turn, {_W} AS w FROM conversations), k AS (SELECT conv_id, turn, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS tok FROM t),
     a AS (SELECT *, regexp_extract(tok, '^{_LEAD}') AS lead FROM k), b AS (SELECT *, tok[length(lead) + 1 :] AS rest FROM a), c AS (SELECT *, regexp_extract(rest, '{_TRAIL}$') AS trail FROM b), d AS (SELECT *, rest[1 : length(rest) - length(trail)] AS core FROM c),
     e AS (SELECT *, core IN ('NAME', 'NUMBER') AND suffix(lead, '[') AND prefix(trail, ']') AS own, replace(core, '.', '') AS stem, right(core, 1) || trail AS tail FROM d),
     f AS (SELECT *, regexp_matches(core, '^[A-Z]') AND NOT own AND NOT regexp_matches(core, '^I([''’](m|ve|d|ll))?$') AS cap,
                  contains(tail, '!') OR contains(tail, '?') OR (contains(tail, '.') AND NOT (stem <> '' AND (length(stem) = 1 OR contains(core, '.') OR upper(stem) IN ({_TITLES})))) AS ends FROM e),
     g AS (SELECT *, coalesce(lag(ends) OVER o, true) AS starts, coalesce(lag(cap) OVER o, false) AS before FROM f WINDOW o AS (PARTITION BY conv_id, turn ORDER BY i)),
     h AS (SELECT *, sum(CASE WHEN cap AND before AND NOT starts THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id, turn ORDER BY i) AS run FROM g),
     r AS (SELECT conv_id, turn, run, min(i) AS i, count(*) AS n, arg_min(cap, i) AND (count(*) > 1 OR NOT arg_min(starts, i)) AS name, arg_min(lead, i) AS lead, arg_max(trail, i) AS trail, any_value(core) AS core, any_value(own) AS own, any_value(tok) AS tok FROM h GROUP BY ALL),
     s AS (SELECT *, NOT name AND NOT own AND (length(regexp_replace(core, '[^0-9]', '', 'g')) > 1 OR (length(regexp_replace(core, '[^0-9]', '', 'g')) = 1 AND (contains(core, '$') OR contains(core, '%')))) AS number FROM r)
SELECT conv_id, turn, string_agg(CASE WHEN name THEN lead || '[NAME]' || trail WHEN number THEN lead || '[NUMBER]' || trail ELSE tok END, ' ' ORDER BY i) AS stripped,
       round(sum(CASE WHEN name OR number THEN n ELSE 0 END) / sum(n), 6) AS density, CASE WHEN sum(CASE WHEN name OR number THEN n ELSE 0 END) / sum(n) <= 0.02 THEN 'Z' WHEN sum(CASE WHEN name OR number THEN n ELSE 0 END) / sum(n) <= 0.08 THEN 'L' ELSE 'H' END AS bucket FROM s GROUP BY conv_id, turn""")
def entity_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with names and numbers replaced, their density and its bucket."""
    ship(spark)
    t = table(spark, sf_dir, "conversations").filter(F.size(tx.words(F.col("text"))) > 0)
    d = t.select("conv_id", "turn", scrub.entity_free(F.col("text")).alias("stripped"), scrub.entity_density(F.col("text")).alias("d"))
    return d.select("conv_id", "turn", "stripped", F.round("d", 6).alias("density"), tx.density_bucket(F.col("d")).alias("bucket"))


#: By remainder: what the host says of the guest, and what is left of it.
_INTRODUCED = (
    ("GUEST, professor of law at {n}, joins us.", "GUEST, [DESCRIPTION REMOVED], joins us."),
    ("We go to GUEST, who served as U.S. ambassador to {n}, now at the {n} Institute, and thank you.", "We go to GUEST, [DESCRIPTION REMOVED], and thank you."),
    ("GUEST is the author of a book on {n}. Hello.", "GUEST is [DESCRIPTION REMOVED]. Hello."),
    ("GUEST, my old friend, is in {n}.", "GUEST, my old friend, is in {n}."),
    ("GUEST, who lives in {n}, what did you see?", "GUEST, who lives in {n}, what did you see?"),
)


def _fill(pattern: str, name: str) -> str:
    """A pattern as an SQL concatenation."""
    return "'" + pattern.replace("{n}", f"' || {name} || '") + "'"


@query(f"""
WITH n AS (SELECT n_nationkey AS id, upper(n_name[1:1]) || lower(n_name[2:]) AS n FROM nation)
SELECT id, 'About GUEST, professor.' || chr(10) || 'HOST: ' || CASE id % 5 {" ".join(f"WHEN {i} THEN {_fill(after, 'n')}" for i, (_, after) in enumerate(_INTRODUCED))} END || chr(10) || 'GUEST: Thanks.' AS text, CASE WHEN id % 5 <= 2 THEN 1 ELSE 0 END AS removed FROM n""")
def affiliation_scrub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts whose spoken lines lose the guest's descriptions; the SQL holds what must be left of each kind."""
    ship(spark)
    n = F.concat(F.upper(F.substring("n_name", 1, 1)), F.lower(F.substring("n_name", 2, 100)))
    said = F.lit(None).cast("string")
    for i, (before, _) in enumerate(_INTRODUCED):
        said = F.when(F.col("n_nationkey") % 5 == i, F.regexp_replace(F.lit(before), F.lit(r"\{n\}"), n)).otherwise(said)
    prompt = F.concat(F.lit("About GUEST, professor.\nHOST: "), said, F.lit("\nGUEST: Thanks."))
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), scrub.unaffiliated(prompt).alias("s")).select("id", "s.text", "s.removed")


@query("""
WITH s AS (SELECT s_suppkey AS id, s_suppkey % 3 AS k FROM supplier)
SELECT id, CASE k WHEN 0 THEN 'It is number ' || id || ' in the list of all that we have here.|The case, is worrying to all of us here.' WHEN 1 THEN 'Sure, Robert.|Nothing of that kind happened.' ELSE 'Number ' || id || ' it is, I think.|No, I can tell that it holds here.' END AS options, k <> 1 AS stripped FROM s""")
def deixis_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Option sets without address to the host, all options or none; the SQL holds what must be left of each kind."""
    ship(spark)
    i, k = F.col("s_suppkey").cast("string"), F.col("s_suppkey") % 3
    options = (
        F.when(k == 0, F.array(F.concat(F.lit("Well, you know, it is number "), i, F.lit(" in the list of all that we have here, Robert.")), F.lit("The case, as you said, is worrying to all of us here.")))
        .when(k == 1, F.array(F.lit("Sure, Robert."), F.lit("Nothing of that kind happened.")))
        .otherwise(F.array(F.concat(F.lit("number "), i, F.lit(" it is, Robert Siegel, I think.")), F.lit("No, I can tell that it holds here.")))
    )
    done = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), scrub.undirected(options, F.array(F.lit("ROBERT SIEGEL, HOST"))).alias("s"))
    return done.select("id", F.array_join("s.options", "|").alias("options"), "s.stripped")


_CUES = {"cause": ["why", "how come", "what made"], "future": ["will", "going to"], "factual": ["what", "when", "who"]}


@query("""
WITH q AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'Why will it? ' WHEN 1 THEN 'What made you? ' WHEN 2 THEN 'Going to say when, what? ' ELSE '' END || text AS t FROM conversations),
     c AS (SELECT *, (contains(lower(t), 'why')::INT + contains(lower(t), 'how come')::INT + contains(lower(t), 'what made')::INT) AS cause, (contains(lower(t), 'will')::INT + contains(lower(t), 'going to')::INT) AS future,
                  ((contains(lower(t), 'what') AND NOT contains(lower(t), 'what made'))::INT + contains(lower(t), 'when')::INT + contains(lower(t), 'who')::INT) AS factual FROM q)
SELECT conv_id, turn, CASE WHEN greatest(cause, future, factual) = 0 THEN 'unclear' WHEN cause = greatest(cause, future, factual) THEN 'cause' WHEN future = greatest(cause, future, factual) THEN 'future' ELSE 'factual' END AS kind FROM c""")
def question_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions by the kind with most cues; a cue inside a longer one doesn't count."""
    k = F.col("turn") % 4
    t = F.concat(F.when(k == 0, "Why will it? ").when(k == 1, "What made you? ").when(k == 2, "Going to say when, what? ").otherwise(""), F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.question_type(t, _CUES).alias("kind"))


@query("SELECT n_nationkey AS id, n_regionkey AS code, 'Land of ' || n_name || ', sort of' AS label FROM nation UNION ALL SELECT n_nationkey, n_regionkey + 10, 'Other' FROM nation")
def decoded_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes and labels parsed from 'k=Label, k2=Label'; labels may hold commas."""
    r = F.col("n_regionkey")
    cell = F.concat(r.cast("string"), F.lit("=Land of "), F.col("n_name"), F.lit(", sort of, "), (r + 10).cast("string"), F.lit(" = Other"))
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.explode(tx.decode_pairs(cell)).alias("code", "label")).select("id", F.col("code").cast("long").alias("code"), "label")


_FIRST, _LAST = ("JOHN", "MARY"), ("SMITH", "JONES")


def _people(key: str) -> str:
    return f"CASE {key} % 6 WHEN 0 THEN 'J. Smith' WHEN 1 THEN 'Mary Q. Jones' WHEN 2 THEN 'Van Halen' WHEN 3 THEN 'Dr. Robert Stone' WHEN 4 THEN 'Juror B-' || {key} ELSE 'Matthew van Dyk' END"


@query(f"""
WITH p AS (SELECT c_custkey AS id, {_people("c_custkey")} AS name FROM customer)
SELECT id, regexp_matches(string_split(name, ' ')[1], '^[^A-Za-z]*[A-Za-z][^A-Za-z]*$') AS initial, name = 'Van Halen' AS particle, name = 'Mary Q. Jones' AS generic, upper(regexp_replace(name, '[^A-Za-z0-9]', '', 'g')) AS digit_key,
       upper(regexp_replace(name, '[^A-Za-z]', '', 'g')) AS punct_key, CASE id % 6 WHEN 3 THEN 'Dr. Bob Stone;Dr. Bobby Stone;Dr. Rob Stone;Dr. Robbie Stone' WHEN 5 THEN 'Matt van Dyk;Matty van Dyk' ELSE '' END AS nicknames FROM p""")
def name_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicates, keys and short forms of names."""
    n = F.expr(_people("c_custkey").replace("'Juror B-' || c_custkey", "concat('Juror B-', c_custkey)"))
    p = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), n.alias("name"))
    c = F.col("name")
    return p.select(
        "id",
        names.initial_form(c).alias("initial"),
        names.particle_only(c).alias("particle"),
        names.generic(c, _FIRST, _LAST).alias("generic"),
        names.digit_key(c).alias("digit_key"),
        names.punct_key(c).alias("punct_key"),
        F.array_join(names.nickname_forms(c, sorted(scrub.HONORIFICS)), ";").alias("nicknames"),
    )


@query("""
WITH s AS (SELECT doc_id, regexp_extract_all(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), '[^' || chr(1) || ']+') AS s FROM documents),
     h AS (SELECT doc_id, list_filter(s, lambda x: regexp_matches(x, '(^|[^A-Za-z0-9_])(the|der|la)([^A-Za-z0-9_]|$)'))[1] AS x FROM s)
SELECT doc_id, sha256(trim(regexp_replace(x, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))) AS sha FROM h""")
def sentences_around(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first sentence of a document with a certain word."""
    s = names.sentence_around(F.col("text"), r"(^|[^A-Za-z0-9_])(the|der|la)([^A-Za-z0-9_]|$)")
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(s, 256).alias("sha"))


@query("""
SELECT item_id, CASE item_id % 3 WHEN 0 THEN 'choice_line,option_line' WHEN 1 THEN 'distribution_instruction' ELSE '' END AS residue, CASE item_id % 3 WHEN 0 THEN 'A. yes' WHEN 1 THEN 'Give a probability for each option' ELSE 'Answer freely.' END AS tail FROM benchmark""")
def choice_residue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a forced choice left in prompts that should be open, and each prompt's last block."""
    k = F.col("item_id") % 3
    body = F.regexp_replace(F.coalesce("text", F.lit("")), r"(?m)^([A-Z])\.", "$1")
    end = F.when(k == 0, "Which of these replies did they give?\n\nA. yes").when(k == 1, "Give a probability for each option").otherwise("Answer freely.")
    p = table(spark, sf_dir, "benchmark").select("item_id", F.concat(body, F.lit("\n\n"), end).alias("p"))
    return p.select("item_id", F.array_join(scrub.choice_residue(F.col("p")), ",").alias("residue"), scrub.tail(F.col("p")).alias("tail"))
