"""SimHash near-deduplication with multi-index hashing.

Fingerprints: whole texts, A-Z lower-cased, words are runs of anything but
ASCII white space, 3-word shingles with repeats, XXH64 with seed 42; a bit is 1
if over half of the hashes have it (no words: zero).

Links: multi-index hashing. Two fingerprints within 2 bits differ in at most one
bit of one of their two 32-bit segments. A table holds every distinct
fingerprint by the value of each segment; each fingerprint looks up the small
Hamming ball around its own segments (the value itself and its one-bit
neighbours; of two neighbours the one with the zero asks) and verifies the
complete distance to what it finds. A segment value that more than ``HOT``
fingerprints share is no bucket: its entries and the look-ups that meet it are
split by the halves of the other segment, with what is left of the distance,
and hot ones of these once more. Then 56 bits are fixed, so a bucket holds at
most 256 fingerprints whatever the data, and nothing is left out.

Scale: exact copies collapse to one fingerprint before any look-up (a grouped
minimum, summed before the shuffle). A distinct fingerprint makes about 36
narrow look-ups; all joins are hash-partitioned on (segment, value). Nothing is
collected or crossed, and no table with a row for each fingerprint or document
is broadcast: Spark would size it by its Parquet file, a fraction of the hash
table that the driver builds.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tessella.llm.common import TEXT, in_slices, rows, schema_of
from tessella.operators.components import components
from tessella.runtime import materialise, ship

SHINGLE, SEED, DISTANCE = 3, 42, 2
#: A bucket of more fingerprints is split further, up to LEVELS times in all.
HOT, LEVELS = 32, 3

#: Bits of each byte value, least significant first.
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    words = text.lower().split() if text else []
    if not words:
        return 0
    if len(words) < shingle:
        parts = [b" ".join(words)]
    else:
        parts = list(map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)))
    hashes = np.array(list(map(xxhash.xxh64_intdigest, parts, repeat(seed))), np.uint64)
    lanes = hashes.view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(lanes[:, j], minlength=256) @ _BITS for j in range(8)])
    return int((ones * 2 > len(parts)).astype(np.uint64) @ (np.uint64(1) << np.arange(64, dtype=np.uint64)))


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = (), shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """One row per document row with its 64-bit fingerprint as a signed long ``fp``. Null, empty and blank texts: zero."""
    ship(docs.sparkSession)
    out = schema_of(docs, id_col, carry, [T.StructField("fp", T.LongType())])
    arrow = to_arrow_schema(out)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in in_slices(whole, 8 << 20, 4096):
                found = np.array([fingerprint(x.as_py(), shingle, seed) for x in batch.column(TEXT)], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(found)], schema=arrow)

    return rows(docs, id_col, text_col, carry).mapInArrow(mark, out)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def moves(level: int) -> list[tuple[int, int, int, int]]:
    """(fixed, fixed then, flip, cost): how a look-up goes on from each set of fixed bits of a level.

    The bits that aren't fixed yet are one aligned segment. Either half of it
    may be the one that is close: as it is, or with one bit flipped.
    """
    size, every = 64 >> level, (1 << 64) - 1
    found = []
    for lo in range(0, 64, size):
        free = ((1 << size) - 1) << lo
        for half in (lo, lo + size // 2):
            then = every ^ free | ((1 << size // 2) - 1) << half
            found += [(_signed(every ^ free), _signed(then), 0, 0), *[(_signed(every ^ free), _signed(then), _signed(1 << b), 1) for b in range(half, half + size // 2)]]
    return found


def _moves(level: int, condition) -> Column:
    """The moves of a level that meet a condition, a row each."""
    every = F.array(*[F.struct(*[F.lit(v).cast("long").alias(n) for n, v in zip(("of", "then", "flip", "cost"), m, strict=True)]) for m in moves(level)])
    return F.inline(F.filter(every, lambda m: (m["of"] == F.col("fixed")) & condition(m)))


def links(distinct: DataFrame, distance: int = DISTANCE, hot: int = HOT) -> DataFrame:
    """(a, b): every pair of distinct fingerprints ``fp`` within the distance of each other, a smaller than b; a pair may come twice.

    A look-up has a budget of bits that may still differ. It flips a bit only
    if half the budget pays for it, and only a zero bit: of two fingerprints
    that differ there exactly one asks. With nothing flipped both ask, and one
    is kept.
    """
    if distance not in (0, 1, 2):
        raise ValueError("distance must be 0, 1 or 2: one flipped bit a segment is enumerated")
    asks = distinct.select("fp", F.lit(0).cast("long").alias("fixed"), F.lit(0).cast("long").alias("flips"), F.lit(distance).cast("long").alias("budget"))
    tables = distinct.select("fp", F.lit(0).cast("long").alias("fixed"))
    found, key = [], ["fixed", "value"]
    for level in range(LEVELS):
        fp = F.col("fp")
        pays = lambda m: (m["cost"] * 2 <= F.col("budget")) & ((m["flip"] == 0) | (F.col("fp").bitwiseAND(m["flip"]) == 0))
        near = asks.select("fp", "flips", "budget", _moves(level, pays))
        near = near.select("fp", F.col("then").alias("fixed"), F.col("flips").bitwiseOR(F.col("flip")).alias("flips"), (F.col("budget") - F.col("cost")).alias("budget"))
        near = near.withColumn("value", fp.bitwiseXOR(F.col("flips")).bitwiseAND(F.col("fixed")))
        held = tables.select("fp", _moves(level, lambda m: m["flip"] == 0)).select("fp", F.col("then").alias("fixed"), fp.bitwiseAND(F.col("then")).alias("value"))
        held, last = materialise(held), level == LEVELS - 1
        buckets = held.select(*key, F.col("fp").alias("b"))
        if not last:
            # A hot bucket answers with one row, without a fingerprint: ask further.
            crowded = materialise(held.groupBy(*key).count().filter(F.col("count") > hot).select(*key))
            buckets = buckets.join(crowded, key, "left_anti").unionByName(crowded.withColumn("b", F.lit(None).cast("long")))
            tables = held.join(crowded, key, "left_semi").select("fp", "fixed")
        once = F.when(F.col("flips") == 0, fp < F.col("b")).otherwise(fp != F.col("b"))
        close = F.bit_count(fp.bitwiseXOR(F.col("b"))) <= distance
        # Never a broadcast: Spark takes the look-ups for as small as the file that they come from.
        met = materialise(near.join(buckets.hint("merge"), key).filter(F.col("b").isNull() | close & once).select("fp", "fixed", "flips", "budget", "b"))
        found.append(met.filter("b IS NOT NULL").select(F.least("fp", "b").alias("a"), F.greatest("fp", "b").alias("b")))
        asks = met.filter("b IS NULL").drop("b")
        if last or not crowded.take(1):
            break
    return reduce(DataFrame.unionByName, found)


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = (), distance: int = DISTANCE) -> DataFrame:
    """One row per document row: ``fp`` (signed long), ``component_id`` (the smallest id that links reach) and ``keeper``.

    ``keeper`` is true for exactly one row of each component: one of its smallest id.

    Edge cases: documents without words have fingerprint zero and link like any
    other; rows that repeat have equal fingerprints and meet in one component; a
    null id takes part but can name a component only if no member has an id;
    fewer words than a shingle: the whole sequence is the shingle; a bit that
    exactly half of the hashes have is 0. Texts are read whole, whatever their
    length, one at a time beyond 8 MB. Further input columns are ignored unless
    carried; no rows give no rows.
    """
    marked = materialise(fingerprints(docs, id_col=id_col, text_col=text_col, carry=carry).withColumn("_row", F.monotonically_increasing_id()))
    first = F.struct(marked[id_col].isNull().alias("none"), marked[id_col].alias("id"), "_row")
    least = materialise(marked.groupBy("fp").agg(F.min(first).alias("_least")))
    found = components(links(least, distance))
    # Sort-merge joins: neither the fingerprints nor their names go through the driver.
    joined = least.join(found.hint("merge"), least.fp == found.node, "left").select("fp", "_least", "root")
    named = joined.filter("root IS NOT NULL").groupBy("root").agg(F.min("_least").alias("_first"))
    linked = joined.filter("root IS NOT NULL").join(named, "root").select("fp", "_first")
    alone = joined.filter("root IS NULL").select("fp", F.col("_least").alias("_first"))
    names = linked.unionByName(alone).withColumnRenamed("fp", "_fp")
    out = marked.join(names.hint("merge"), marked.fp == names["_fp"], "left")
    keeper = F.col("_row") == F.col("_first._row")
    return out.select(*[marked[c] for c in (id_col, *carry)], "fp", F.col("_first.id").alias("component_id"), keeper.alias("keeper"))


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
