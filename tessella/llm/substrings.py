"""Exact substring deduplication by Rabin-Karp hashes of every fixed-length word window.

Words are runs of anything but ASCII white space. Each word gets a polynomial
hash of its bytes and each window of ``window`` consecutive words a polynomial
hash of its words, both by prefix sums modulo 2^64 with an odd base, so a whole
block of documents is hashed in a few vectorised passes. A window that starts
at two places or more is repeated; the words it covers go.

Scale: input splits are cut into chunks of some rows, packed and compressed, and
chunks are dealt evenly into blocks of a few MB, whatever their ids and texts.
A block sends each of its distinct window hashes once, sorted
and packed, to the bucket of the hash's leading bits; the bucket finds hashes
that two blocks sent (or one block saw twice) and answers each block with those
of its hashes. A passage in a third of all documents therefore costs a bucket
one hash for each block, never one row for each copy. Blocks and buckets grow
in number with the input, not in size. A block sends to at most ``MOST_PARTS``
ranges of hashes; where there are more buckets, groups of blocks of a bucket's
size are sorted once more and sent on from each range to its buckets, so that
messages stay long at any size. The compressed text is shuffled once (both uses
share that exchange), the hashes once or twice in about six bytes each.

Two different windows share a hash with probability 2^-64 for each pair.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tessella.llm.common import TEXT, blocks_for, in_slices, rows, schema_of
from tessella.llm.hashing import WORD_BASE, mixed, rolling, word_hashes
from tessella.runtime import ship

WINDOW = 35
#: Text bytes of one block, and of the text whose windows meet in one bucket.
BLOCK_BYTES, BUCKET_BYTES = 4 << 20, 32 << 20
#: Text bytes of a chunk of rows, which is packed and dealt as one, and its rows at most.
CHUNK_BYTES, CHUNK_ROWS = 256 << 10, 4096
LEAST_BLOCKS = 64
#: Ranges of hashes that a block sends to at most.
MOST_PARTS = 2048

RESULT = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_removed", T.LongType()),
    T.StructField("removed", T.ArrayType(T.ArrayType(T.LongType()))),
    T.StructField("kept_text", T.StringType()),
]


class Windows:
    """The distinct window hashes of a block's texts, sorted, and where each occurs."""

    def __init__(self, texts: Sequence[bytes], window: int):
        hashes, places, _ = word_hashes(np.frombuffer(b"\n".join(texts), np.uint8))
        bounds = np.cumsum([len(t) + 1 for t in texts])
        self.window = window
        self.first = np.concatenate(([0], np.searchsorted(places, bounds)))
        of = np.repeat(np.arange(len(texts)), np.diff(self.first))
        last = max(len(hashes) - window + 1, 0)
        self.starts = np.flatnonzero(of[:last] == of[window - 1 :][:last])
        rolled = mixed(rolling(hashes, self.starts, self.starts + window, WORD_BASE))
        self.distinct, self.inverse, times = np.unique(rolled, return_inverse=True, return_counts=True)
        self.twice = times > 1

    def covered(self, repeated: np.ndarray) -> np.ndarray:
        """For each word, whether a repeated window covers it; repeated: by distinct hash."""
        hit = self.starts[repeated[self.inverse]]
        edge = np.zeros(int(self.first[-1]) + 1, np.int32)
        edge[hit] += 1
        edge[hit + self.window] -= 1
        return np.cumsum(edge[:-1]) > 0


def _pack(sorted_hashes: np.ndarray) -> bytes:
    """Sorted hashes as zstd-compressed byte planes of their differences: about six bytes a hash."""
    gaps = np.diff(sorted_hashes, prepend=np.uint64(0))
    return pa.compress(np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 8).T).tobytes(), codec="zstd", asbytes=True)


def _unpack(blob: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(blob, 8 * n, codec="zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).reshape(-1), dtype=np.uint64)


#: Sorted hashes of one block, or of several with the block of each; which of them their block saw twice.
_SENT = T.StructType([
    T.StructField("_bucket", T.IntegerType()),
    T.StructField("_block", T.IntegerType()),
    T.StructField("_n", T.IntegerType()),
    T.StructField("_hashes", T.BinaryType()),
    T.StructField("_twice", T.BinaryType()),
    T.StructField("_blocks", T.BinaryType()),
])
_ANSWER = T.StructType([T.StructField("_block", T.IntegerType()), T.StructField("_n", T.IntegerType()), T.StructField("_hashes", T.BinaryType())])


def _table(columns: Sequence[list], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(columns, schema, strict=True)], schema=schema)


def _cuts(sorted_hashes: np.ndarray, first: int, n: int, width: int) -> np.ndarray:
    """Where each of n ranges of hashes begins, and the end; range i holds the hashes from (first + i) x width on."""
    edges = [min((first + i) * width, (1 << 64) - 1) for i in range(1, n)]
    return np.concatenate(([0], np.searchsorted(sorted_hashes, np.array(edges, np.uint64)), [len(sorted_hashes)])).astype(np.int64)


_PACKED = T.StructType([T.StructField("_block", T.IntegerType()), T.StructField("_rows", T.BinaryType())])


def _packed(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _rows(group: pa.Table) -> pa.Table:
    """The rows of a block's chunks."""
    return pa.concat_tables([pa.ipc.open_stream(x.as_py()).read_all() for x in group.column("_rows")])


def _entries(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All hashes of the messages, sorted, with the block of each and whether that saw it twice."""
    hashes, blocks, twice = [], [], []
    for n, block, packed, bits, many in zip(*[group.column(c).to_pylist() for c in ("_n", "_block", "_hashes", "_twice", "_blocks")], strict=True):
        hashes.append(_unpack(packed, n))
        blocks.append(np.full(n, block, np.int32) if many is None else np.frombuffer(pa.decompress(many, 4 * n, codec="zstd", asbytes=True), np.int32))
        twice.append(np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool))
    every = np.concatenate(hashes)
    order = np.argsort(every, kind="stable")
    return every[order], np.concatenate(blocks)[order], np.concatenate(twice)[order]


def _spans(flags: np.ndarray) -> np.ndarray:
    edges = np.zeros(len(flags) + 2, np.int8)
    edges[1:-1] = flags
    return np.flatnonzero(np.diff(edges)).reshape(-1, 2)


def dedup_substrings(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: Sequence[str] = (),
    window: int = WINDOW,
    rejoin: bool = True,
) -> DataFrame:
    """One row per document row: its word count, the removed word intervals, and the kept words joined by single spaces.

    Without ``rejoin`` a text that loses nothing is kept as it is.

    A window that starts anywhere else too, in the same document or another, is
    repeated; every word that a repeated window covers is removed, at all its
    places. Windows are judged on the input alone. The input must give the same
    rows in the same order when it is read again, as files do.

    Edge cases: a null or empty text has no words and keeps an empty text; a
    text of fewer than ``window`` words has no window; rows that repeat (equal
    id and text, null ids too) count as separate documents, so their windows
    repeat; texts are read whole, a block being at least its longest text; an
    empty table gives no rows. Further input columns are ignored unless carried.
    """
    spark = docs.sparkSession
    ship(spark)
    base = rows(docs, id_col, text_col, carry)
    total = base.agg(F.sum(F.octet_length(TEXT))).first()[0]
    blocks, buckets = blocks_for(total, BLOCK_BYTES, LEAST_BLOCKS), blocks_for(total, BUCKET_BYTES, LEAST_BLOCKS)
    # A bucket is a range of hashes; a block sends to ranges of ``inner`` buckets each.
    inner = -(-buckets // MOST_PARTS)
    outer = -(-buckets // inner)
    width = -(-(1 << 64) // (outer * inner))
    packed = to_arrow_schema(_PACKED)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Chunks of the split's rows, each with a block by the hash of its place."""
        place = TaskContext.get().partitionId() << 40
        for whole in batches:
            for batch in in_slices(whole, CHUNK_BYTES, CHUNK_ROWS):
                block = int(mixed(np.array([place], np.uint64))[0]) % blocks
                place += 1
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([_packed(batch)], pa.binary())], schema=packed)

    dealt = base.mapInArrow(deal, _PACKED)
    sent, answer = to_arrow_schema(_SENT), to_arrow_schema(_ANSWER)

    def texts_of(group: pa.Table) -> list[bytes]:
        return [x.as_py() or b"" for x in group.column(TEXT)]

    def send(group: pa.Table) -> pa.Table:
        w = Windows(texts_of(_rows(group)), window)
        at, block = _cuts(w.distinct, 0, outer, width * inner), group.column("_block")[0].as_py()
        out: list[list] = [[] for _ in sent]
        for b in np.flatnonzero(np.diff(at)).tolist():
            part = slice(at[b], at[b + 1])
            for column, value in zip(out, (b, block, at[b + 1] - at[b], _pack(w.distinct[part]), np.packbits(w.twice[part]).tobytes(), None), strict=True):
                column.append(value)
        return _table(out, sent)

    def send_on(group: pa.Table) -> pa.Table:
        """From a range to its buckets, the hashes of many blocks in one message each."""
        hashes, of, twice = _entries(group)
        first = group.column("_bucket")[0].as_py() * inner
        at = _cuts(hashes, first, inner, width)
        out: list[list] = [[] for _ in sent]
        for b in np.flatnonzero(np.diff(at)).tolist():
            part = slice(at[b], at[b + 1])
            owners = pa.compress(of[part].tobytes(), codec="zstd", asbytes=True)
            for column, value in zip(out, (first + b, None, at[b + 1] - at[b], _pack(hashes[part]), np.packbits(twice[part]).tobytes(), owners), strict=True):
                column.append(value)
        return _table(out, sent)

    def count(group: pa.Table) -> pa.Table:
        hashes, of, repeated = _entries(group)
        same = hashes[1:] == hashes[:-1]
        repeated[1:] |= same
        repeated[:-1] |= same
        hashes, of = hashes[repeated], of[repeated]
        order = np.argsort(of, kind="stable")
        hashes, of = hashes[order], of[order]
        edges = np.concatenate(([0], np.flatnonzero(np.diff(of)) + 1, [len(of)])) if len(of) else np.zeros(1, int)
        parts = list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))
        return _table([[int(of[lo]) for lo, _ in parts], [hi - lo for lo, hi in parts], [_pack(hashes[lo:hi]) for lo, hi in parts]], answer)

    result = schema_of(docs, id_col, carry, RESULT)
    arrow = to_arrow_schema(result)

    def remove(chunks: pa.Table, answers: pa.Table) -> pa.Table:
        got: list[list] = [[], [], [], []]
        if not len(chunks):
            return arrow.empty_table()
        group = _rows(chunks)
        texts = texts_of(group)
        if texts:
            w = Windows(texts, window)
            told = [_unpack(packed, n) for packed, n in zip(answers.column("_hashes").to_pylist(), answers.column("_n").to_pylist(), strict=True)]
            told = np.sort(np.concatenate([np.zeros(0, np.uint64), *told]))
            repeated = told[np.minimum(np.searchsorted(told, w.distinct), len(told) - 1)] == w.distinct if len(told) else np.zeros(len(w.distinct), bool)
            gone = w.covered(repeated)
            for text, lo, hi in zip(texts, w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
                mine, words = gone[lo:hi], text.split()
                spans = _spans(mine)
                kept = b" ".join(compress(words, (~mine).tolist()) if len(spans) else words) if rejoin or len(spans) else text
                for column, value in zip(got, (hi - lo, int(mine.sum()), spans.tolist(), kept), strict=True):
                    column.append(value)
        new = [pa.array(x, f.type) for x, f in zip(got[:-1], list(arrow)[-len(RESULT) : -1], strict=True)]
        kept = [group.column(0), *group.columns[2 : 2 + len(carry)]]
        return pa.Table.from_arrays([*kept, *new, pa.array(got[-1], pa.binary()).cast(pa.string())], schema=arrow)

    messages = dealt.groupBy("_block").applyInArrow(send, _SENT)
    if inner > 1:
        messages = messages.withColumn("_salt", F.pmod(F.xxhash64("_block"), F.lit(inner))).groupBy("_bucket", "_salt").applyInArrow(send_on, _SENT)
    answers = messages.groupBy("_bucket").applyInArrow(count, _ANSWER)
    return dealt.groupBy("_block").cogroup(answers.groupBy("_block")).applyInArrow(remove, result)
