"""Language identification with hyperdimensional n-gram profiles.

Every letter has a random vector of +1 and -1 (a hash of its code point, so no
table has to be shipped); other characters count as one gap symbol. An n-gram's
vector binds (multiplies) its letters' vectors, each rotated by its place; a
text's vector bundles (adds) its n-grams' vectors, and a language's prototype
bundles the vectors of the texts that it learns from. A text takes the language
whose prototype has the highest cosine with it.

Scale: both passes read each text once. Learning adds n-gram counts by language
within a task and sends one vector for each language and task; prototypes are
languages x dimensions numbers, checked against ``MOST_LANGUAGES`` before they
are sent out. Predicting needs no shuffle.
"""

from __future__ import annotations

import codecs
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tessella.llm.common import ID, TEXT, in_slices, rows, schema_of
from tessella.runtime import ship

NGRAM, DIMENSIONS = 3, 1024
UNKNOWN = "und"
#: More language values than this (there are fewer registered languages) are taken for a mistake: an error, nothing is dropped.
MOST_LANGUAGES = 8192
#: Texts whose n-gram counts meet in one matrix, their UTF-8 bytes, and n-gram vectors that a worker keeps.
_TEXTS, _BYTES, _KEPT = 64, 1 << 18, 1 << 15
#: Longer texts are counted piece by piece, so many bytes at a time.
_PIECE = 1 << 20
_GAP = 32

_tables: dict = {}


def _symbols() -> np.ndarray:
    """By code point: its lower-case letter's code point, or the gap."""
    if "symbols" not in _tables:
        _tables["symbols"] = np.array([ord(chr(i).lower()[0]) if chr(i).isalpha() else _GAP for i in range(0x110000)], np.uint32)
    return _tables["symbols"]


def _letters(codes: np.ndarray, dims: int) -> np.ndarray:
    """A row of +1 and -1 for each code point."""
    x = codes.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(1, dims // 64 + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    bits = np.unpackbits((x ^ (x >> np.uint64(31))).view(np.uint8), axis=1)
    return bits.astype(np.int8) * 2 - 1


class Grams:
    """Vectors of n-grams; the latest are kept, at most _KEPT of them."""

    def __init__(self, n: int, dims: int):
        self.n, self.dims = n, dims
        self.keys, self.vectors = np.zeros(0, np.uint64), np.zeros((0, dims), np.int8)

    def _bind(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones((len(keys), self.dims), np.int8)
        for place in range(self.n):
            codes = (keys >> np.uint64(21 * place)) & np.uint64((1 << 21) - 1)
            each, at = np.unique(codes, return_inverse=True)
            out *= np.roll(_letters(each, self.dims), place, axis=1)[at]
        return out

    def of(self, keys: np.ndarray) -> np.ndarray:
        """Rows for sorted distinct keys."""
        at = np.searchsorted(self.keys, keys)
        new = keys[(at == len(self.keys)) | (self.keys[np.minimum(at, max(len(self.keys) - 1, 0))] != keys)] if len(self.keys) else keys
        if len(new):
            if len(self.keys) + len(new) > _KEPT:
                if len(keys) > _KEPT:
                    return self._bind(keys)
                self.keys, self.vectors, new = self.keys[:0], self.vectors[:0], keys
            every = np.concatenate((self.keys, new))
            order = np.argsort(every)
            self.keys, self.vectors = every[order], np.concatenate((self.vectors, self._bind(new)))[order]
        return self.vectors[np.searchsorted(self.keys, keys)]


    def bundled(self, table: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """A row of summed vectors for each row of counts; some thousand n-grams at a time."""
        out = np.zeros((len(table), self.dims), np.float32)
        for at in range(0, len(keys), 8192):
            out += table[:, at : at + 8192] @ self.of(keys[at : at + 8192]).astype(np.float32)
        return out


def counts(texts: Sequence[bytes | None], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted n-gram keys that occur, their counts by text (a matrix), and whether each text has a letter.

    A run of other characters is one gap; every text begins and ends with one,
    and n-grams don't cross texts.
    """
    decoded = [(t or b"").decode("utf-8", "replace") for t in texts]
    raw = np.frombuffer("\x00".join(["", *decoded, ""]).encode("utf-32-le", "replace"), np.uint32)
    symbols = _symbols()[raw]
    # Every text has the gap before it; the one after it is that of the next text.
    bound = np.cumsum([0] + [len(t) + 1 for t in decoded])
    parting = np.zeros(len(raw), bool)
    parting[bound] = True
    of = np.cumsum(parting) - 1
    letter = symbols != _GAP
    has = np.bincount(of[letter], minlength=len(texts)) > 0
    # Of a run of other characters the first is kept, if it stands between letters.
    following = np.minimum.accumulate(np.where(letter, of, len(texts) + 1)[::-1])[::-1]
    inner = np.zeros(len(raw), bool)
    inner[1:] = letter[:-1]
    keep = letter | parting | (inner & (following == of))
    symbols, of, parting = symbols[keep], of[keep], parting[keep]
    each, small = np.unique(symbols, return_inverse=True)
    base, m = len(each), len(small) - n + 1
    if m <= 0 or not has.any():
        return np.zeros(0, np.uint64), np.zeros((len(texts), 0), np.float32), has
    code = np.zeros(m, np.int64)
    for place in range(n):
        code += small[place : place + m] * base**place
    owner, last = of[:m], np.arange(n - 1, n - 1 + m)
    within = (of[last] == owner) | (parting[last] & (of[last - 1] == owner))
    code, owner = code[within], owner[within]
    if base**n <= 1 << 22:
        seen = np.zeros(base**n, bool)
        seen[code] = True
        grams = np.flatnonzero(seen)
        slot = np.zeros(base**n, np.int32)
        slot[grams] = np.arange(len(grams))
        col = slot[code]
    else:
        grams, col = np.unique(code, return_inverse=True)
    table = np.bincount(owner.astype(np.int64) * len(grams) + col, minlength=len(texts) * len(grams)).reshape(len(texts), len(grams)).astype(np.float32)
    keys, left = np.zeros(len(grams), np.uint64), grams.copy()
    for place in range(n):
        keys |= each[left % base].astype(np.uint64) << np.uint64(21 * place)
        left //= base
    order = np.argsort(keys)
    return keys[order], table[:, order], has


def _pieces(text: bytes, size: int) -> Iterator[str]:
    """The text in pieces of about so many bytes, cut between characters."""
    decoder = codecs.getincrementaldecoder("utf-8")("replace")
    for at in range(0, len(text), size):
        yield decoder.decode(text[at : at + size], at + size >= len(text))


def long_counts(text: bytes, n: int, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """What counts() gives for one text, piece by piece: sorted keys that occur and their counts, and last the rest.

    A piece goes on from the last n - 1 symbols before it; a gap is held back
    until a letter follows or the text ends.
    """
    tail = np.array([_GAP], np.uint32)
    held = False
    for part in chain(_pieces(text, size), [None]):
        if part is None:
            new = np.array([_GAP], np.uint32)
        else:
            symbols = _symbols()[np.frombuffer(part.encode("utf-32-le", "replace"), np.uint32)]
            letter = symbols != _GAP
            # Of a run of other characters one gap stays, before the letter that follows; none at the text's beginning.
            before = np.concatenate(([held], ~letter[:-1])) if len(letter) else np.zeros(0, bool)
            at = np.flatnonzero(letter)
            gaps = before[at] & ((np.arange(len(at)) > 0) | (tail[-1] != _GAP))
            new = np.insert(symbols[at], np.flatnonzero(gaps), _GAP)
            held = held if not len(letter) else bool(not letter[-1]) if letter.any() else True
        run = np.concatenate((tail, new)).astype(np.uint64)
        m = len(run) - n + 1
        if m > 0:
            keys = np.zeros(m, np.uint64)
            for place in range(n):
                keys |= run[place : place + m] << np.uint64(21 * place)
            each, times = np.unique(keys, return_counts=True)
            yield each, times.astype(np.float32)[None, :]
        tail = run[max(len(run) - n + 1, 0) :].astype(np.uint32)


def vector_of(grams: Grams, text: bytes, size: int) -> tuple[np.ndarray, float]:
    """The bundled vector of a long text, and how many n-grams it holds."""
    vector, total = np.zeros((1, grams.dims)), 0.0
    for keys, table in long_counts(text, grams.n, size):
        vector += grams.bundled(table, keys)
        total += float(table.sum())
    return vector, total


def _has_letter(text: bytes, size: int) -> bool:
    return any((_symbols()[np.frombuffer(p.encode("utf-32-le", "replace"), np.uint32)] != _GAP).any() for p in _pieces(text, size))


def _short(batch: pa.RecordBatch, longest: int) -> tuple[np.ndarray, list[tuple[int, bytes]]]:
    """The places of the texts of a batch that are counted together, and the longer ones."""
    sizes = np.array([len(x.as_buffer()) if x.is_valid else 0 for x in batch.column(TEXT)], np.int64)
    return np.flatnonzero(sizes <= longest), [(int(i), batch.column(TEXT)[int(i)].as_py()) for i in np.flatnonzero(sizes > longest)]


def learn(docs: DataFrame, learnable: Column, *, text_col: str = "text", lang_col: str = "lang", n: int = NGRAM, dims: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """A prototype for each language, from the rows that are learnable, with a language and a letter.

    Every such row counts, also those that repeat; no such rows give no
    prototypes. Texts are read whole, long ones in pieces. Further columns are
    ignored.
    """
    ship(docs.sparkSession)
    base = rows(docs.filter(learnable & docs[lang_col].isNotNull() & docs[text_col].isNotNull()), lang_col, text_col)
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("vector", T.ArrayType(T.DoubleType()))])
    arrow = to_arrow_schema(schema)

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, sums = Grams(n, dims), {}
        for whole in batches:
            for batch in in_slices(whole, _BYTES, _TEXTS):
                short, long = _short(batch, _PIECE)
                langs = np.array(batch.column(ID).cast(pa.string()).to_pylist(), object)
                for i, text in long:
                    if _has_letter(text, _PIECE):
                        vector, total = vector_of(grams, text, _PIECE)
                        sums[langs[i]] = sums.get(langs[i], 0) + vector[0] / np.sqrt(max(total, 1))
                part = batch.take(pa.array(short))
                keys, table, has = counts([x.as_py() for x in part.column(TEXT)], n)
                if not len(keys):
                    continue
                total = np.maximum(table.sum(axis=1, keepdims=True), 1)
                names, at = np.unique(langs[short][has], return_inverse=True)
                shares = np.zeros((len(names), len(keys)), np.float32)
                np.add.at(shares, at, (table / np.sqrt(total))[has])
                for name, vector in zip(names, grams.bundled(shares, keys), strict=True):
                    sums[name] = sums.get(name, 0) + vector.astype(np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], arrow.field("vector").type)], schema=arrow)

    parts = base.mapInArrow(bundle, schema)
    dimension = parts.select("lang", F.posexplode("vector").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    packed = dimension.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v"))
    found = packed.select("lang", F.col("v.x").alias("v")).limit(MOST_LANGUAGES + 1).collect()
    if len(found) > MOST_LANGUAGES:
        raise ValueError(f"over {MOST_LANGUAGES} values of {lang_col}")
    return {r.lang: np.array(r.v) for r in found}


def lettered(text: Column) -> Column:
    """Whether a text holds a letter; false for null."""
    return F.coalesce(text.cast("string").rlike(r"\p{L}"), F.lit(False))


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], *, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = (), n: int = NGRAM, dims: int = DIMENSIONS) -> DataFrame:
    """One row per document row: ``lang_pred`` and ``score``, the cosine with that language's prototype (0 where negative).

    Edge cases: null texts and texts without a letter get ``und`` and score 0,
    as do all texts if there is no prototype; a text of one or two letters has
    n-grams with gaps; equal cosines go to the smaller name. Texts of any length
    are read whole; those over 1 MB in pieces, so that a worker's memory stays
    some 100 MB beside the text itself. Rows that repeat get equal results; no
    rows give no rows; further input columns are ignored unless carried.
    """
    ship(docs.sparkSession)
    out = schema_of(docs, id_col, carry, [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    arrow = to_arrow_schema(out)
    names = sorted(prototypes)
    matrix = np.stack([prototypes[x] / max(np.linalg.norm(prototypes[x]), 1e-12) for x in names]).astype(np.float32) if names else None

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams(n, dims)
        for whole in batches:
            for batch in in_slices(whole, _BYTES, _TEXTS):
                short, long = _short(batch, _PIECE)
                keys, table, has_short = counts([batch.column(TEXT)[int(i)].as_py() for i in short], n)
                has, best, score = np.zeros(len(batch), bool), np.zeros(len(batch), int), np.zeros(len(batch))
                has[short] = has_short
                found = [(short, grams.bundled(table, keys))] if len(keys) and names else []
                for i, text in long:
                    has[i] = _has_letter(text, _PIECE)
                    found += [([i], vector_of(grams, text, _PIECE)[0])] if names else []
                for at, vectors in found:
                    near = vectors @ matrix.T / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
                    best[at], score[at] = near.argmax(axis=1), np.clip(near.max(axis=1), 0, 1).astype(float)
                known = has & bool(names)
                picked = [names[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(picked, pa.string()), pa.array(np.where(known, score, 0.0))], schema=arrow)

    return rows(docs, id_col, text_col, carry).mapInArrow(predict, out)
