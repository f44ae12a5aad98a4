"""Readers and sinks: tables written in each of the engine's formats to the shared folder, and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import ranges
from tessella.plans.registry import query
from tessella.runtime import ensure_checkpoint_dir, table
from tessella.sources import readers, sinks


def _folder(spark: SparkSession) -> str:
    """A new folder in the shared place."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"


def _text(df: DataFrame, line, folder: str) -> str:
    """One line of text for each row, in one file."""
    df.select(line.alias("value")).coalesce(1).write.mode("append").text(folder)
    return folder


@query("SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS person_id, CASE WHEN n_nationkey % 4 <> 0 THEN CAST(n_regionkey AS INT) END AS R1, n_name AS country FROM nation")
def survey_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tab-separated survey with an artifact column and answers that don't parse."""
    folder = _folder(spark)
    n = table(spark, sf_dir, "nation").orderBy("n_nationkey").coalesce(1)
    answer = F.when(F.col("n_nationkey") % 4 == 0, "x").otherwise(F.col("n_regionkey").cast("string"))
    n.select(F.col("n_nationkey").alias("Unnamed: 0"), answer.alias("R1"), F.col("n_name").alias("country")).write.csv(folder, sep="\t", header=True)
    return readers.survey(spark, folder, {"R1": "int", "country": "string"})


@query("SELECT 'R' || n_nationkey AS key, 0 AS code, 'Item about ' || n_name AS text FROM nation UNION ALL SELECT 'v' || n_nationkey, n_regionkey, 'Land ' || n_name FROM nation UNION ALL SELECT 'v' || n_nationkey, n_regionkey + 10, 'Other' FROM nation")
def codebook_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text codebook's items and codes."""
    k = F.col("n_nationkey").cast("string")
    n = table(spark, sf_dir, "nation").withColumn("line", F.explode(F.array(F.concat(F.lit("R"), k, F.lit("\tItem about "), F.col("n_name")), F.concat(F.lit("v"), k, F.lit('\t"'), F.col("n_regionkey").cast("string"), F.lit("=Land "), F.col("n_name"), F.lit(", "), (F.col("n_regionkey") + 10).cast("string"), F.lit('=Other"')))))
    book = readers.codebook(spark, _text(n, F.col("line"), _folder(spark)))
    items = book["items"].select(F.col("item").alias("key"), F.lit(0).cast("long").alias("code"), "text")
    return items.unionByName(book["decode"].select(F.col("var").alias("key"), F.col("code").cast("long").alias("code"), F.col("label").alias("text")))


def _json_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = table(spark, sf_dir, "customer").groupBy().agg(F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list(F.to_json(F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))))), ", "), F.lit("]")).alias("doc"))
    return readers.json_array(spark, _text(every, F.col("doc"), _folder(spark)), "id long, name string")


@query("SELECT c_custkey AS id, c_name AS name FROM customer")
def json_array_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of one JSON array."""
    return _json_array(spark, sf_dir)


@query("SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_custkey IN (SELECT n_nationkey * 7 FROM nation)")
def wanted_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the records of the wanted ids."""
    return readers.wanted(_json_array(spark, sf_dir), table(spark, sf_dir, "nation").select((F.col("n_nationkey") * 7).alias("id")), "id")


@query("SELECT n_nationkey * 7 AS id, c_name AS name, CASE WHEN c_custkey IS NULL THEN 'not found' END AS reason FROM nation LEFT JOIN customer ON c_custkey = n_nationkey * 7")
def wanted_or_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every wanted id, with a reason where there is no record."""
    return readers.found_or_reason(_json_array(spark, sf_dir), table(spark, sf_dir, "nation").select((F.col("n_nationkey") * 7).alias("id")), "id")


@query("""
SELECT 'C' || s_suppkey AS canonical_id, s_acctbal > 0 AS clean, CAST(2 AS INT) AS variants, s_suppkey AS first_id, CAST(DATE '2001-02-03' + CAST(s_suppkey % 300 AS INT) AS VARCHAR) AS date, 'A; B' AS program, s_suppkey % 2 = 0 AS substantive FROM supplier""")
def pool_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pool in CSV: booleans by word, variants split, cells whose programs hold the separator."""
    k = F.col("s_suppkey")
    cell = F.concat(F.lit("T-"), k.cast("string"), F.lit("|"), F.date_format(F.date_add(F.lit("2001-02-03").cast("date"), (k % 300).cast("int")), "yyyy-MM-dd"), F.lit("|A; B|cl1|"), F.when(k % 2 == 0, "S").otherwise("-"))
    folder = _folder(spark)
    pool = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("C"), k.cast("string")).alias("canonical_id"),
        F.col("s_name").alias("canonical_name"),
        F.when(F.col("s_acctbal") > 0, "Yes").otherwise("no").alias("clean"),
        F.lit("1").alias("qualifies"),
        F.lit("").alias("ambiguous_identity"),
        F.lit("Jane Doe; J. Doe;").alias("variants"),
        F.concat_ws(";", cell, cell).alias("transcripts"),
    )
    pool.write.csv(folder, header=True, quote='"', escape='"')
    p = readers.typed_pool(spark, folder)
    first = F.get("transcripts", F.lit(1))
    return p.select("canonical_id", "clean", F.size("variants").alias("variants"), F.regexp_extract(first["transcript_id"], r"(\d+)", 1).cast("long").alias("first_id"), first["date"].cast("string").alias("date"), first["program"].alias("program"), first["substantive"].alias("substantive"))


@query("SELECT event_id AS id, event_type AS kind, value FROM events")
def jsonl_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines written and read."""
    folder = _folder(spark)
    sinks.jsonl(table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("kind"), "value"), folder)
    return readers.jsonl(spark, folder, "id long, kind string, value double")


@query("SELECT n_nationkey AS id, n_name AS name FROM nation WHERE n_nationkey % 5 <> 4")
def tolerant_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines of which every fifth was cut short."""
    line = F.to_json(F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")))
    cut = F.when(F.col("n_nationkey") % 5 == 4, F.substring(line, 1, 9)).otherwise(line)
    return readers.jsonl(spark, _text(table(spark, sf_dir, "nation"), cut, _folder(spark)), "id long, name string", tolerant=True)


@query("SELECT n_nationkey AS id, 'run' || n_regionkey AS run FROM nation")
def folder_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines of many folders, with the folder each comes from."""
    folder = _folder(spark)
    for region in range(5):
        n = table(spark, sf_dir, "nation").filter(F.col("n_regionkey") == region).select(F.col("n_nationkey").alias("id"))
        n.coalesce(1).write.json(f"{folder}/run{region}")
    return readers.by_folder(spark, folder, "id long", "*.json")


@query("SELECT c_custkey AS id, 'c' || c_custkey % 7 AS chunk FROM customer WHERE c_custkey % 7 IN (1, 4)")
def chunk_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table exported in chunks, of which some are allowed."""
    folder = _folder(spark)
    sinks.chunked(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("c"), (F.col("c_custkey") % 7).cast("string")).alias("chunk")), folder)
    return readers.chunks(spark, folder, "id long", ["c1", "c4"])


@query("SELECT n_nationkey AS id, CASE n_regionkey % 3 WHEN 0 THEN 'SAME' WHEN 1 THEN 'DIFFERENT' END AS label FROM nation")
def label_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One labelling in three shapes of file: a map, a map under a name, rows; all must say the same."""
    label = F.when(F.col("n_regionkey") % 3 == 0, " same").when(F.col("n_regionkey") % 3 == 1, "Different")
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("id"), label.alias("label"))
    entries = F.array_join(F.collect_list(F.concat(F.lit('"'), F.col("id"), F.lit('": '), F.coalesce(F.concat(F.lit('"'), F.col("label"), F.lit('"')), F.lit("null")))), ", ")
    as_map = n.agg(F.concat(F.lit("{"), entries, F.lit("}")).alias("m")).first()["m"]
    as_rows = n.agg(F.array_join(F.collect_list(F.to_json(F.struct("id", "label"), {"ignoreNullFields": "false"})), ", ").alias("r")).first()["r"]
    found = None
    for doc in (as_map, f'{{"labels": {as_map}}}', f'{{"rows": [{as_rows}]}}'):
        one = readers.labels(spark, _text(spark.range(1), F.lit(doc), _folder(spark)))
        found = one if found is None else found.intersect(one)
    return found


@query("SELECT n_nationkey AS id, sha256(n_name || chr(10)) AS sha256, length(n_name) + 1 AS bytes FROM nation")
def input_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name, size and digest of every input file; a file for each nation here."""
    folder = _folder(spark)
    table(spark, sf_dir, "nation").select(F.col("n_name").alias("value"), F.col("n_nationkey").alias("id")).repartition("id").write.partitionBy("id").text(folder)
    return readers.digests(spark, folder).filter("folder LIKE 'id=%'").select(F.regexp_extract("folder", r"(\d+)", 1).cast("long").alias("id"), "sha256", F.col("bytes").cast("long").alias("bytes"))


@query("SELECT event_id AS id, value FROM events")
def resumed_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fact table after a run that broke off halfway, the whole run and a third one: each row is there once."""
    folder = _folder(spark)
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "value")
    for part in (e.filter("id % 2 = 0"), e, e):
        sinks.append_missing(part, folder, ["id"])
    return spark.read.parquet(folder)


@query("SELECT s_suppkey AS id, s_acctbal AS balance, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS place FROM supplier")
def sorted_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV sorted over all its part files, with each row's place as read."""
    folder = _folder(spark)
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"))
    sinks.sorted_csv(s, folder, F.desc("balance"), F.col("id"))
    back = spark.read.csv(folder, header=True, schema=s.schema).withColumns({"file": F.col("_metadata.file_name"), "at": F.monotonically_increasing_id()})
    # Part files by name, rows as they stand in them.
    return ranges.before(back, [F.col("file"), F.col("at")], "before").select("id", "balance", (F.col("before") + 1).alias("place"))


@query("SELECT n_nationkey AS id, n_name AS name FROM nation")
def fallback_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table in the first folder that holds it."""
    return spark.read.parquet(readers.resolved(spark, [_folder(spark), sf_dir], "nation.parquet")).select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))


@query("""
SELECT o_orderkey AS id, c_name AS title, CASE WHEN o_custkey % 3 = 0 THEN c_custkey * 10 END AS words FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_custkey % 2 = 0""")
def side_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles and word counts from side tables that were written once; ids without an entry have none."""
    titles, words = _folder(spark), _folder(spark)
    c = table(spark, sf_dir, "customer")
    c.filter("c_custkey % 2 = 0").select("c_custkey", "c_name").write.parquet(titles)
    c.filter("c_custkey % 6 = 0").select("c_custkey", (F.col("c_custkey") * 10).alias("words")).write.parquet(words)
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("c_custkey"))
    return o.join(spark.read.parquet(titles), "c_custkey", "left").join(spark.read.parquet(words), "c_custkey", "left").select("id", F.col("c_name").alias("title"), "words")


@query("SELECT n_nationkey AS person_id, n_regionkey AS R1, n_nationkey % 7 AS T1 FROM nation")
def nested_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide rows as nested records and back."""
    wide = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("person_id"), F.col("n_regionkey").alias("R1"), (F.col("n_nationkey") % 7).alias("T1"))
    r = readers.nested(wide, "person_id", {"interests": ["R1"], "traits": ["T1"]})
    return r.select("person_id", F.col("interests")["R1"].alias("R1"), F.col("traits")["T1"].alias("T1"))
