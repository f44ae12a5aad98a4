"""Sequence packing by power-of-two decomposition.

A document's token ids and an end id are cut into pieces whose lengths are
powers of two, at most ``most`` tokens: whole pieces of ``most``, then the
binary digits of the rest from large to small. Each piece is a sequence of its
own, so no sequence crosses documents, and its length's bucket numbers it:
sequences of one bucket fill batches of ``most`` tokens (``most`` / length rows
of equal length), which need no padding.

Tokens are those of a public tokenizer file (a parameter; a lower-casing
byte-pair vocabulary with word ends). Texts over the plain part of Unicode are
cut here: words are looked up by 64-bit hash in a worker's table, and words not
seen before get vectorised byte-pair merges, all of a batch at once. Any other
text goes through the tokenizer library whole, so ids agree with it everywhere.

Scale: one narrow pass, no shuffle. Sequences and batches are numbered by
bucket, partition and their place in both, so numbers are unique without
counting rows across tasks; they stay the same when a lost task is run again
over the same files. A partition leaves at most one batch of a bucket unfilled.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tessella.llm.common import TEXT, in_slices, rows, schema_of
from tessella.llm.hashing import word_hashes
from tessella.runtime import ship

MOST, END = 4096, 2

PIECE = [
    T.StructField("start", T.LongType()),
    T.StructField("length", T.LongType()),
    T.StructField("doc_tokens", T.LongType()),
    T.StructField("ids", T.ArrayType(T.IntegerType())),
    T.StructField("ids_crc32", T.LongType()),
    T.StructField("bucket", T.IntegerType()),
    T.StructField("sequence_id", T.LongType()),
    T.StructField("batch_id", T.LongType()),
    T.StructField("batch_row", T.IntegerType()),
]

#: Where a bucket and a partition stand in a sequence's or a batch's number.
_BUCKET_AT, _PARTITION_AT = 56, 32

#: Tokens that a worker's table holds before it starts anew, and bytes of a word that is merged here.
_TABLE_BITS, _LONGEST = 21, 48
_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|[0-9]|(?:[^\w\s]|_)+")

_models: dict = {}


def _byte_letters() -> list[str]:
    """The letter that stands for each byte: itself where printable, else the next free one from 256 on."""
    free = count(256)
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    return [chr(b) if b in plain else chr(next(free)) for b in range(256)]


class Merger:
    """Byte-pair merges of many words at once, and a table of words already merged."""

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocabulary, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        letters = _byte_letters()
        self.inner = np.array([vocabulary.get(x, -1) for x in letters], np.int32)
        self.last = np.array([vocabulary.get(x + suffix, -1) for x in letters], np.int32)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        left = np.array([vocabulary[a] for a, _ in pairs], np.uint64)
        right = np.array([vocabulary[b] for _, b in pairs], np.uint64)
        joined = np.array([vocabulary[a + b] for a, b in pairs], np.int64)
        # An open-addressed table of the pairs, an eighth full at most.
        self.bits = max(10, (8 * len(pairs)).bit_length())
        self.keys = np.full(1 << self.bits, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.ranks = np.full(1 << self.bits, len(pairs), np.int32)
        self.joined = np.zeros(1 << self.bits, np.int32)
        self.none, self.probes = len(pairs), 1
        keys = (left << np.uint64(32)) | right
        for rank, (key, at, to) in enumerate(zip(keys.tolist(), self._slots(keys).tolist(), joined.tolist(), strict=True)):
            probe = 1
            while int(self.keys[at]) not in (key, 0xFFFFFFFFFFFFFFFF):
                at, probe = (at + 1) & ((1 << self.bits) - 1), probe + 1
            if int(self.keys[at]) != key:
                self.keys[at], self.ranks[at], self.joined[at] = key, rank, to
                self.probes = max(self.probes, probe)
        self.small = max(vocabulary.values()) < 1 << 16
        self.reset()

    def reset(self) -> None:
        """Forget all tokens. By slot of an open-addressed table: a token's hash and its number."""
        self.hashes = np.zeros(1 << _TABLE_BITS, np.uint64)
        self.numbers = np.full(1 << _TABLE_BITS, -1, np.int32)
        self.begin, self.size, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint16 if self.small else np.uint32)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (none: no such merge) and result of each pair."""
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        at = self._slots(keys)
        for _ in range(self.probes - 1):
            wrong = (self.keys[at] != keys) & (self.ranks[at] != self.none)
            if not wrong.any():
                break
            at = np.where(wrong, (at + 1) & ((1 << self.bits) - 1), at)
        same = self.keys[at] == keys
        return np.where(same, self.ranks[at], np.int32(self.none)), self.joined[at]

    def _merge(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (a padded matrix) and their number for words of one length, a row of bytes each.

        Again and again the pair of least rank is joined, the leftmost of equals.
        """
        n = raw.shape[1]
        result = np.column_stack((self.inner[raw[:, :-1]], self.last[raw[:, -1]]))
        sizes = np.full(len(raw), n)
        ids, who = result, np.arange(len(raw))
        ranks, joined = self._find(ids[:, :-1].ravel(), ids[:, 1:].ravel())
        ranks, joined = ranks.reshape(-1, n - 1), joined.reshape(-1, n - 1)
        for width in range(n, 1, -1):
            at = ranks.argmin(axis=1)
            more = ranks[np.arange(len(who)), at] != self.none
            if not more.all():
                result[who[~more], :width], sizes[who[~more]] = ids[~more], width
                who, ids, ranks, joined, at = who[more], ids[more], ranks[more], joined[more], at[more]
            if not len(who):
                return result, sizes
            line, cols = np.arange(len(who)), np.arange(width - 1)
            new = joined[line, at]
            ids = np.where(cols > at[:, None], ids[:, 1:], ids[:, :-1])
            ids[line, at] = new
            later = cols[:-1] >= at[:, None]
            ranks, joined = np.where(later, ranks[:, 1:], ranks[:, :-1]), np.where(later, joined[:, 1:], joined[:, :-1])
            for side in (at - 1, at):
                fits = np.flatnonzero((side >= 0) & (side < width - 2))
                x = side[fits]
                ranks[fits, x], joined[fits, x] = self._find(ids[fits, x], ids[fits, x + 1])
        result[who, :1], sizes[who] = ids, 1
        return result, sizes

    def _words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Flat ids of the words, with each word's begin and size."""
        begin, size, flat, at = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), [], 0
        by_length: dict[int, list[int]] = defaultdict(list)
        for i, w in enumerate(words):
            by_length[len(w)].append(i)
        for n, members in by_length.items():
            if n <= _LONGEST:
                raw = np.frombuffer(b"".join([words[i] for i in members]), np.uint8).reshape(-1, n)
                ids, sizes = self._merge(raw) if n > 1 else (self.last[raw], np.ones(len(members), np.int64))
            else:
                each = [self.library.encode(words[i].decode("utf-8"), add_special_tokens=False).ids for i in members]
                sizes = np.array([len(x) for x in each])
                ids = np.zeros((len(each), sizes.max()), np.int64)
                for row, x in zip(ids, each, strict=True):
                    row[: len(x)] = x
            part = ids[np.arange(ids.shape[1]) < sizes[:, None]]
            begin[members], size[members] = at + np.cumsum(sizes) - sizes, sizes
            flat.append(part)
            at += len(part)
        return np.concatenate(flat) if flat else np.zeros(0, np.int64), begin, size

    def _learn(self, tokens: list[bytes]) -> None:
        """Append the ids of new tokens: each is cut into words, and each distinct word merged once."""
        number: defaultdict[bytes, int] = defaultdict(count().__next__)
        parts: list[int] = []
        cuts = np.zeros(len(tokens) + 1, np.int64)
        for i, token in enumerate(tokens):
            if token.isalpha():
                parts.append(number[token])
            else:
                parts += [number[w.encode("utf-8")] for w in _WORD.findall(token.decode("utf-8"))]
            cuts[i + 1] = len(parts)
        flat, begin, size = self._words(list(number))
        of = np.array(parts, np.int64)
        new, ends = _gather(flat, begin[of], size[of])
        bounds = np.concatenate(([0], ends))[cuts]
        self.begin = np.concatenate((self.begin, len(self.flat) + bounds[:-1]))
        self.size = np.concatenate((self.size, np.diff(bounds)))
        self.flat = np.concatenate((self.flat, new.astype(self.flat.dtype)))

    def _number(self, hashes: np.ndarray, text: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Each token's number; tokens not seen before are learnt."""
        mask = (1 << _TABLE_BITS) - 1
        out = np.full(len(hashes), -1, np.int64)
        left, at = np.arange(len(hashes)), (hashes & np.uint64(mask)).astype(np.int64)
        missing = []
        while len(left):
            there, free = self.hashes[at], self.numbers[at] < 0
            hit = ~free & (there == hashes[left])
            out[left[hit]] = self.numbers[at[hit]]
            missing.append(left[free])
            on = ~hit & ~free
            left, at = left[on], (at[on] + 1) & mask
        new = np.concatenate(missing) if missing else left
        if len(new):
            each, first, inverse = np.unique(hashes[new], return_index=True, return_inverse=True)
            which, known = new[first], len(self.begin)
            self._learn([text[a:b] for a, b in zip(starts[which].tolist(), ends[which].tolist(), strict=True)])
            out[new] = known + inverse
            todo, at = np.arange(len(each)), (each & np.uint64(mask)).astype(np.int64)
            while len(todo):
                free = np.flatnonzero(self.numbers[at] < 0)
                slots, pick = np.unique(at[free], return_index=True)
                put = todo[free[pick]]
                self.numbers[slots], self.hashes[slots] = known + put, each[put]
                rest = np.setdiff1d(np.arange(len(todo)), free[pick], assume_unique=True)
                todo, at = todo[rest], (at[rest] + 1) & mask
        return out

    def encode(self, texts: Sequence[bytes]) -> list[np.ndarray]:
        """The ids of each text, as the library gives them without special tokens."""
        out: list = [None] * len(texts)
        plain = []
        for i, ordinary in enumerate(_plain(texts)):
            if ordinary:
                plain.append(i)
            else:
                out[i] = np.array(self.library.encode(texts[i].decode("utf-8", "replace"), add_special_tokens=False).ids, np.uint32)
        lowered = [texts[i].decode("utf-8").lower().encode("utf-8") for i in plain]
        joined = b"\n".join(lowered)
        hashes, starts, ends = word_hashes(np.frombuffer(joined, np.uint8))
        if len(self.begin) + len(hashes) > 1 << (_TABLE_BITS - 1):
            self.reset()
        numbers = self._number(hashes, joined, starts, ends)
        bounds = np.searchsorted(starts, np.cumsum([0] + [len(x) + 1 for x in lowered]))
        begin, size = self.begin[numbers], self.size[numbers]
        for i, lo, hi in zip(plain, bounds[:-1], bounds[1:], strict=True):
            out[i] = _gather(self.flat, begin[lo:hi], size[lo:hi])[0].astype(np.uint32)
        return out


def _gather(flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The concatenated stretches of flat, and where each ends in the result."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.arange(total) + np.repeat(begin - ends + size, size)], ends


#: Bytes of texts that are not cut here: code points from U+0240 on, and control characters that are no white space to the library.
_RARE = np.array([b >= 0xC9 or 0x1C <= b <= 0x1F or b == 0xC2 for b in range(256)])
#: What follows a byte 0xC2 in U+0085 and in numerals that are no digits.
_NUMERAL = np.isin(np.arange(256), [0x85, 0xB2, 0xB3, 0xB9, 0xBC, 0xBD, 0xBE])


def _plain(texts: Sequence[bytes]) -> list[bool]:
    """Whether each text is one that is cut here. Such a text is in NFC, as it has no combining mark."""
    found = []
    for t in texts:
        a = np.frombuffer(t, np.uint8)
        at = np.flatnonzero(_RARE[a])
        if len(at):
            second, third = a[np.minimum(at + 1, len(a) - 1)], a[np.minimum(at + 2, len(a) - 1)]
            # Dashes, quotation marks and the ellipsis: U+2010 to U+2014, U+2018 to U+201F, U+2026.
            mark = (a[at] == 0xE2) & (second == 0x80) & ((third >= 0x90) & (third <= 0x94) | (third >= 0x98) & (third <= 0x9F) | (third == 0xA6))
            at = at[~mark & ~((a[at] == 0xC2) & ~_NUMERAL[second])]
        found.append(not len(at) and b"<|" not in t)
    return found


def tokenizer(path: str) -> Merger:
    """The tokenizer of a file, one for each worker process."""
    if path not in _models:
        _models[path] = Merger(path)
    return _models[path]


@lru_cache(maxsize=1 << 14)
def pieces_of(n: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: powers of two, large ones first."""
    found, at = [], 0
    while at < n:
        size = min(most, 1 << ((n - at).bit_length() - 1))
        found.append((at, size))
        at += size
    return found


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: Sequence[str] = (),
    most: int = MOST,
    end: int = END,
    with_ids: bool = True,
) -> DataFrame:
    """One row per piece: its place in the document, its ids, their CRC-32, its bucket, sequence and batch.

    ``ids_crc32`` is over little-endian unsigned 32-bit ids; ``doc_tokens``
    counts the document's ids with the end id. ``bucket`` is the binary
    logarithm of the length; ``sequence_id`` is unique, ``sequence_offset``
    always 0: a piece fills its sequence. A batch holds sequences of one bucket,
    ``most`` tokens of them, by ``batch_row``. ``with_ids=False`` leaves ``ids``
    null where only the layout is wanted.

    Edge cases: a null or empty text is its end id alone, one piece of length
    1; a document of any length is read whole and gives as many pieces as it
    needs; rows that repeat, or share an id, are packed separately, and which
    of their pieces gets which number depends on the partitions; no rows give
    no pieces. Further input columns are ignored unless carried.
    """
    if most & (most - 1) or most < 1:
        raise ValueError("most must be a power of two")
    ship(docs.sparkSession)
    out = schema_of(docs, id_col, carry, PIECE)
    arrow = to_arrow_schema(out)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = tokenizer(tokenizer_path)
        partition, seen = TaskContext.get().partitionId() << _PARTITION_AT, [0] * most.bit_length()
        for whole in batches:
            for batch in in_slices(whole, 2 << 20, 1024):
                texts = [x.as_py() or b"" for x in batch.column(TEXT)]
                every = [np.append(ids, np.uint32(end)).astype("<u4") for ids in model.encode(texts)]
                found = []
                for i, ids in enumerate(every):
                    raw, n = memoryview(ids.tobytes()), len(ids)
                    for start, size in pieces_of(n, most):
                        bucket = size.bit_length() - 1
                        found.append((i, start, size, n, zlib.crc32(raw[4 * start : 4 * (start + size)]), bucket, seen[bucket]))
                        seen[bucket] += 1
                of, starts, sizes, totals, crcs, buckets, numbers = np.array(found, np.int64).T
                first, batched = (buckets << _BUCKET_AT) + partition, most // sizes
                columns = {"start": starts, "length": sizes, "doc_tokens": totals, "ids_crc32": crcs, "bucket": buckets, "sequence_id": first + numbers, "batch_id": first + numbers // batched, "batch_row": numbers % batched}
                kept = [batch.column(k).take(pa.array(of)) for k in (0, *range(2, 2 + len(carry)))]
                fields = list(arrow)[len(kept) :]
                new = [pa.array(columns[f.name]).cast(f.type) if f.name in columns else pa.nulls(len(of), f.type) for f in fields]
                if with_ids:
                    # Pieces follow each other as their documents' ids do.
                    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
                    at = next(i for i, f in enumerate(fields) if f.name == "ids")
                    new[at] = pa.ListArray.from_arrays(offsets, np.concatenate(every).view(np.int32)).cast(fields[at].type)
                yield pa.RecordBatch.from_arrays([*kept, *new], schema=arrow)

    return rows(docs, id_col, text_col, carry).mapInArrow(cut, out).withColumn("sequence_offset", F.lit(0).cast("long"))


def sequence_columns() -> list[Column]:
    """The layout of a piece without its ids."""
    return [F.col(c) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id")] + [F.col("sequence_offset").alias("offset")] + [F.col(c) for c in ("bucket", "batch_id", "batch_row")]
