"""Byte-balanced sharding of indivisible groups by Karmarkar-Karp differencing.

Documents with equal texts are one group and stay together. Heavy groups are
items of their own; the light rest is bundled by a hash of the text, and each
bundle is an indivisible item whose size is the sum of its documents' bytes. Differencing starts with one partial partition for
each item (the item in one part, the others empty) and repeatedly combines the
two whose parts differ most, the largest part of one with the smallest of the
other, until one partition is left.

Scale: texts are read once, for their size and hash, and never shuffled unless
they are asked for; the narrow rows are written to the shared folder. The
number of bundles is a parameter, not a function of the input, so the driver
differences a bounded list whatever the number of documents; a group is heavy
from a share of all bytes on that only a bounded number can have. Rows are
dealt evenly into blocks, whatever their ids and texts; slots come from counts
by shard and block and a row number within a block of some ``BLOCK_ROWS``, so
no task sees a whole shard.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import schema_of
from tessella.runtime import materialise

SHARDS, BUNDLES = 8, 4096
#: Documents of one block are numbered in one window; blocks of a shard follow each other.
LEAST_BLOCKS, BLOCK_ROWS = 512, 1 << 18
#: Heavy groups times shards are at most so many numbers on the driver, or as many groups as bundles.
MOST_SUMS = 1 << 18


def difference(sizes: Sequence[int], parts: int) -> list[int]:
    """The part of each item, by Karmarkar-Karp differencing. Ties combine in the order of the items.

    A partial partition is a list of (sum, items), largest sum first; an item
    list is a tree of pairs, so combining two takes the same time at any size.
    """
    if parts < 1:
        raise ValueError("parts must be 1 or more")
    order = count()
    heap = []
    for i, size in enumerate(sizes):
        sums = [(size, i)] + [(0, None)] * (parts - 1)
        heap.append((-size, next(order), sums))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, _, one = heapq.heappop(heap)
        _, _, other = heapq.heappop(heap)
        sums = [(a + b, (x, y) if x is not None and y is not None else x if y is None else y) for (a, x), (b, y) in zip(one, reversed(other), strict=True)]
        sums.sort(key=lambda p: -p[0])
        heapq.heappush(heap, (sums[-1][0] - sums[0][0], next(order), sums))
    found = [0] * len(sizes)
    for part, (_, tree) in enumerate(heap[0][2] if heap else []):
        todo = [tree]
        while todo:
            x = todo.pop()
            if isinstance(x, tuple):
                todo += x
            elif x is not None:
                found[x] = part
    return found


def text_size(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus 1."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def shard(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: Sequence[str] = (),
    shards: int = SHARDS,
    bundles: int = BUNDLES,
    with_text: bool = True,
) -> DataFrame:
    """One row per document row: ``size``, ``text_crc32``, ``shard``, and ``slot``, its place in the shard from 0.

    Slots follow blocks of rows and the rows in them; equal inputs in equal
    files give equal slots.

    Edge cases: a null text counts as empty (size 1, CRC 0) and groups with
    empty texts; null ids and rows that repeat are numbered like others; one
    giant group fills its shard and the rest is balanced over the others; fewer
    groups than shards leave shards empty; equal sizes combine in the order of
    bundles, then of hashes; texts are read whole, whatever their length; no
    rows give no rows. Further input columns are ignored unless carried; a
    carried column with a result's name is an error.
    """
    if shards < 1 or bundles < 1:
        raise ValueError("shards and bundles must be 1 or more")
    schema_of(docs, id_col, [*[text_col] * with_text, *carry], [T.StructField(c, T.LongType()) for c in ("size", "text_crc32", "shard", "slot")])
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    own = [docs[id_col].alias("_id"), F.xxhash64(text).alias("_hash"), text_size(docs[text_col].cast("string")).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")]
    base = docs.select(*own, *[docs[text_col].alias("_text")] * with_text, *[docs[c].alias(f"_c{i}") for i, c in enumerate(carry)])
    base = materialise(base.withColumns({"_bundle": F.pmod("_hash", F.lit(bundles)).cast("int"), "_row": F.monotonically_increasing_id()}))
    weights = base.groupBy("_bundle").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
    total, most = sum(r["size"] for r in weights), min(shards * bundles, max(bundles, MOST_SUMS // max(shards, 1)))
    heavy = base.groupBy("_hash", "_bundle").agg(F.sum("size").alias("size")).filter(F.col("size") * most >= total).collect() if weights else []
    heavy.sort(key=lambda r: r["_hash"])
    light = {r["_bundle"]: r["size"] for r in sorted(weights, key=lambda r: r["_bundle"])}
    for r in heavy:
        light[r["_bundle"]] -= r["size"]
    light = {b: size for b, size in light.items() if size}
    parts = difference([*light.values(), *[r["size"] for r in heavy]], shards)
    spark = docs.sparkSession
    of_bundle = spark.createDataFrame(list(zip(light, parts)), "_bundle int, _light int")
    of_group = spark.createDataFrame([(r["_hash"], p) for r, p in zip(heavy, parts[len(light) :], strict=True)], "_hash long, _heavy int")
    # Even a shard that holds nearly all rows has blocks of bounded size.
    blocks = max(LEAST_BLOCKS, -(-sum(r["n"] for r in weights) // BLOCK_ROWS))
    placed = base.join(F.broadcast(of_group), "_hash", "left").join(F.broadcast(of_bundle), "_bundle", "left").withColumn("shard", F.coalesce("_heavy", "_light"))
    placed = placed.withColumn("_block", F.pmod(F.xxhash64("_row"), F.lit(blocks)).cast("int"))
    counts = placed.groupBy("shard", "_block").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("shard").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("shard", "_block", before.alias("_offset"))
    row = F.row_number().over(Window.partitionBy("shard", "_block").orderBy("_row")) - 1
    slotted = placed.withColumn("_place", row).join(offsets, ["shard", "_block"])
    return slotted.select(
        F.col("_id").alias(id_col),
        *[F.col("_text").alias(text_col)] * with_text,
        *[F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)],
        "size",
        "text_crc32",
        "shard",
        (F.col("_offset") + F.col("_place")).cast("long").alias("slot"),
    )
