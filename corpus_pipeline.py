"""The corpus pipeline: language ID, near-dedup, substring dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's docs. All stages but the last
return the columns of ``documents``.

Edge cases, alike in all stages: null ids and languages are kept as they are or
filled (below), null and empty texts go in the first stage, texts of any length
are read whole, rows that repeat are near duplicates of each other, further
input columns are ignored, no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import langid
from tessella.llm.common import held_out
from tessella.llm.decontam import decontaminate
from tessella.llm.packing import pack
from tessella.llm.queries import tokenizer_path
from tessella.llm.simhash import near_duplicates
from tessella.llm.substrings import dedup_substrings
from tessella.runtime import materialise, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their predicted language as ``lang``; those without one (null texts and texts without a letter) go.

    Where no document has a language to learn from, none has a prediction: then
    ``lang`` stays as it is and only documents without a letter go.
    """
    prototypes = langid.learn(docs, ~held_out(docs["doc_id"]))
    if not prototypes:
        return docs.filter(langid.lettered(docs["text"])).select(*COLUMNS)
    kept = langid.identify(docs, prototypes, carry=("text", "source", "n_chars")).filter(F.col("lang_pred") != langid.UNKNOWN)
    return kept.withColumnRenamed("lang_pred", "lang").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: one of the smallest id."""
    return near_duplicates(docs, carry=COLUMNS[1:]).filter("keeper").select(*COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without words in repeated windows; a document that loses all its words goes."""
    left = dedup_substrings(docs, carry=("lang", "source", "n_chars"), rejoin=False)
    left = left.filter((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    length = F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.length("kept_text").cast("long"))
    return left.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", length.alias("n_chars"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by a benchmark item, as they are."""
    found = decontaminate(docs, table(spark, sf_dir, "benchmark"), carry=("lang", "source", "n_chars"))
    return found.filter(~F.col("contaminated")).select("doc_id", F.col("clean_text").alias("text"), "lang", "source", "n_chars")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Power-of-two pieces with their token ids; each is a sequence of its own, numbered and batched by its length's bucket."""
    pieces = pack(docs, tokenizer_path(), carry=("lang", "source"))
    return pieces.select("doc_id", "lang", "source", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", F.col("sequence_offset").alias("offset"), "bucket", "batch_id", "batch_row")


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: SQL has neither the tokenizer nor XXH64; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialise(docs)
    return docs
