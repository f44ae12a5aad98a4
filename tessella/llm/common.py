"""What the training-data operators share: input shaping, Arrow output, block sizing."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Column names that operators use inside; input columns never keep their own names there.
ID, TEXT = "_id", "_text"


def text_bytes(df: DataFrame, text_col: str) -> Column:
    """The whole text as UTF-8 bytes; Python workers then need no decoding."""
    return df[text_col].cast("string").cast("binary")


def rows(df: DataFrame, id_col: str, text_col: str, carry: Sequence[str] = ()) -> DataFrame:
    """Only id, text and the carried columns, so further or clashing input columns do no harm."""
    return df.select(df[id_col].alias(ID), text_bytes(df, text_col).alias(TEXT), *[df[c].alias(f"_c{i}") for i, c in enumerate(carry)])


def schema_of(df: DataFrame, id_col: str, carry: Sequence[str], fields: Sequence[T.StructField]) -> T.StructType:
    clash = {f.name for f in fields} & {id_col, *carry}
    if clash:
        raise ValueError(f"carried columns clash with results: {sorted(clash)}")
    kept = [T.StructField(c, df.schema[c].dataType, True) for c in (id_col, *carry)]
    return T.StructType([*kept, *fields])


def in_slices(batch: pa.RecordBatch, most_bytes: int, most_rows: int):
    """Slices of a batch of about so many text bytes, so that a task's memory stays bounded by a slice (or by its longest text)."""
    texts = batch.column(batch.schema.get_field_index(TEXT))
    start, held = 0, 0
    for i in range(len(texts)):
        held += len(texts[i].as_buffer() or b"") if texts[i].is_valid else 0
        if held >= most_bytes or i + 1 - start >= most_rows:
            yield batch.slice(start, i + 1 - start)
            start, held = i + 1, 0
    if start < len(texts):
        yield batch.slice(start)


def held_out(id_col: Column) -> Column:
    """True for rows that no model may learn from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def blocks_for(total_bytes: int, block_bytes: int, least: int) -> int:
    """How many blocks hold so many bytes; it grows with the input, so a block doesn't."""
    return max(least, -(-int(total_bytes or 0) // block_bytes))
