"""Readers of the engine's file formats. All of them are lazy Spark scans; schemas are given, not inferred."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions import text as tx


def resolved(spark: SparkSession, folders: Sequence[str], name: str) -> str:
    """The file's path in the first of the folders that holds it; an error names them all."""
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            return f"{folder}/{name}"
    raise FileNotFoundError(f"{name} is in none of {', '.join(folders)}")


def survey(spark: SparkSession, path: str, columns: Mapping[str, str]) -> DataFrame:
    """A tab-separated survey with a header: the named columns with their types, and ``person_id``, the row's place.

    The place counts from 0 in file order. It comes from a count per partition,
    so no task sees all rows. Artifact columns of an export ('Unnamed: 0') go.
    """
    raw = spark.read.csv(path, sep="\t", header=True)
    raw = raw.select(*[c for c in raw.columns if c in columns]).withColumn("_at", F.monotonically_increasing_id())
    part = F.shiftright("_at", 33)
    sizes = raw.groupBy(part.alias("_part")).agg(F.count("*").alias("n")).orderBy("_part").collect()
    starts, at = {}, 0
    for r in sizes:
        starts[r["_part"]] = at
        at += r["n"]
    offset = F.create_map(*[F.lit(x).cast("long") for kv in starts.items() for x in kv]) if starts else None
    place = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + (F.element_at(offset, part) if starts else F.lit(0))
    return raw.select(place.cast("long").alias("person_id"), *[F.col(c).try_cast(t).alias(c) for c, t in columns.items() if c in raw.columns])


def codebook(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """A text codebook's dimensions: items ('R1<tab>text') and decodes ('gender<tab>"1=Male, 2=Female"')."""
    lines = spark.read.text(path).select(F.trim("value").alias("line"))
    item = r"^([A-Z]{1,5}\d+)\s+(.+)$"
    items = lines.filter(F.col("line").rlike(item) & ~F.col("line").rlike(r"\d+\s*=")).select(F.regexp_extract("line", item, 1).alias("item"), F.regexp_extract("line", item, 2).alias("text"))
    decode = r'^(\w+)\s+.*?"?((?:\d+\s*=).*?)"?$'
    found = lines.filter(F.col("line").rlike(r"\d+\s*=")).select(F.regexp_extract("line", decode, 1).alias("var"), F.explode(tx.decode_pairs(F.regexp_extract("line", decode, 2))).alias("code", "label"))
    return {"items": items, "decode": found}


def json_array(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Records of one JSON array per file. A file is one task: convert large ones to Parquet once."""
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def wanted(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The records of the wanted ids; on Parquet, bounds of the ids also skip row groups."""
    lo, hi = ids.agg(F.min(key), F.max(key)).first()
    near = df if lo is None else df.filter(F.col(key).between(lo, hi))
    return near.join(ids.select(key).distinct(), key, "left_semi")


def found_or_reason(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Every wanted id once for each of its records, with a reason where there is none."""
    return ids.select(key).distinct().join(df.withColumn("_hit", F.lit(True)), key, "left").withColumn("reason", F.when(F.col("_hit").isNull(), "not found")).drop("_hit")


def jsonl(spark: SparkSession, path: str | Sequence[str], schema: T.StructType | str, tolerant: bool = False) -> DataFrame:
    """JSON lines. Tolerant: broken lines, such as a last one cut short, go; else they fail the read."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED" if tolerant else "FAILFAST").json(path)


def by_folder(spark: SparkSession, path: str, schema: T.StructType | str, pattern: str = "*.jsonl") -> DataFrame:
    """JSON lines of all folders below a path, with the folder's name as ``run``."""
    df = spark.read.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).json(path)
    return df.withColumn("run", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1))


def chunks(spark: SparkSession, path: str, schema: T.StructType | str, allowed: Sequence[str]) -> DataFrame:
    """A table partitioned by chunk, only the allowed chunks: others are not even listed."""
    given = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    full = T.StructType([*given.fields, T.StructField("chunk", T.StringType())])
    return spark.read.schema(full).json(path).filter(F.col("chunk").isin(list(allowed)))


def typed_pool(spark: SparkSession, path: str) -> DataFrame:
    """The candidate pool's CSV: booleans by word, variants split, transcript cells parsed."""
    raw = spark.read.csv(path, header=True, quote='"', escape='"')
    flag = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit("")))).isin("true", "1", "yes", "t")
    return raw.select(
        "canonical_id",
        "canonical_name",
        *[flag(c).alias(c) for c in ("clean", "qualifies", "ambiguous_identity")],
        F.filter(F.transform(F.split("variants", ";"), lambda v: F.trim(v)), lambda v: v != "").alias("variants"),
        tx.transcript_cells(F.col("transcripts")).alias("transcripts"),
    )


def labels(spark: SparkSession, path: str) -> DataFrame:
    """(id, label) from a JSON document that is a map, or holds it under 'labels', or lists rows under 'rows'; repeated ids fail."""
    doc = spark.read.text(path, wholetext=True).select("value")
    as_map = F.coalesce(F.from_json(F.get_json_object("value", "$.labels"), "map<string,string>"), F.when(F.get_json_object("value", "$.rows").isNull(), F.from_json("value", "map<string,string>")))
    as_rows = F.from_json(F.get_json_object("value", "$.rows"), "array<struct<id:string,label:string>>")
    entries = F.coalesce(F.transform(F.map_entries(as_map), lambda e: F.struct(e["key"].alias("id"), e["value"].alias("label"))), as_rows)
    out = doc.select(F.inline(entries)).select(F.col("id").try_cast("long").alias("id"), F.upper(F.trim("label")).alias("label"))
    per = out.groupBy("id").agg(F.count("*").alias("n"), F.first("label").alias("label"))
    return per.select("id", F.when(F.col("n") == 1, F.col("label")).otherwise(F.raise_error(F.concat(F.lit("label given twice for id "), F.col("id").cast("string"))).cast("string")).alias("label"))


def digests(spark: SparkSession, path: str) -> DataFrame:
    """Name, folder, size and SHA-256 of every file below a path; one file is hashed in one row."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("folder"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def long_form(df: DataFrame, key: str, items: Sequence[str], value: str = "answer") -> DataFrame:
    """Wide answers to (key, item, answer) rows; missing ones go."""
    return df.unpivot(key, list(items), "item", value).filter(F.col(value).isNotNull())


def nested(df: DataFrame, key: str, groups: Mapping[str, Sequence[str]]) -> DataFrame:
    """A wide row as one record: a map from item to answer for each group."""
    maps: list[Column] = [F.map_from_arrays(F.array(*map(F.lit, cols)), F.array(*[F.col(c) for c in cols])).alias(g) for g, cols in groups.items()]
    return df.select(key, *maps)
