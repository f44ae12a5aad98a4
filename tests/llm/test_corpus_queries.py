"""Every registered corpus query with SQL against that SQL, over the smallest tables; and the others' shape."""

import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from tessella.llm import queries

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def plain(v):
    return ("nan" if math.isnan(v) else round(v, 9) + 0.0) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_agrees_with_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    cursor = duck.execute(queries.SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted(repr(tuple(plain(r[i]) for i in at)) for r in cursor.fetchall())


#: The columns that a query must return, in any order; more may follow.
CONTRACT = {
    "op1_toxicity": "doc_id held_out score predicted",
    "op3_language_id": "doc_id held_out lang_pred score",
    "op4_exact_top_k": "query_id rank vec_id score",
    "op5_html_extraction": "page_id url text n_chars",
    "op6_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op7_simhash_near_dedup": "doc_id fingerprint component_id",
    "op8_sharding": "doc_id size text_crc32 law shard slot grown_shard",
    "op9_benchmark_decontamination": "doc_id n_words n_hit n_items items_sha256 contaminated",
    "op10_substring_dedup": "doc_id n_words n_removed kept_sha256",
}


@pytest.mark.parametrize("name", sorted(CONTRACT))
def test_query_returns_its_columns(spark, name):
    df = queries.QUERIES[name](spark, SF)
    assert set(CONTRACT[name].split()) <= set(df.columns)
    if "doc_id" in df.columns:
        ids = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id")
        assert df.select("doc_id").distinct().count() == ids.distinct().count()
    if "held_out" in df.columns:
        assert df.filter(F.col("held_out") != (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2)).count() == 0


LARGE = "/root/testdata/sf0.1"


@pytest.mark.skipif(not os.path.isdir(LARGE), reason="no test tables")
def test_held_out_accuracy(spark):
    """What no model learnt from: toxic documents are found and clean ones left alone, languages are told apart."""
    toxic = queries.QUERIES["op1_toxicity"](spark, LARGE).filter("held_out").join(spark.read.parquet(f"{LARGE}/labels.parquet"), "doc_id")
    by = {r["toxic"]: r for r in toxic.groupBy("toxic").agg(F.count("*").alias("n"), F.sum("predicted").alias("flagged")).collect()}
    assert by[1]["flagged"] >= 0.9 * by[1]["n"] and by[0]["flagged"] <= 0.02 * by[0]["n"]
    langs = queries.QUERIES["op3_language_id"](spark, LARGE).filter("held_out").join(spark.read.parquet(f"{LARGE}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("lang IS NOT NULL")
    right = langs.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.99
