"""Benchmark decontamination with a generalised suffix automaton.

Test items are normalised to word sequences (A-Z lower-cased; words are runs of
ASCII digits, ASCII letters and any non-ASCII characters). One automaton over
all items of a block streams each document's words and tracks the longest
suffix that occurs in some item. A window is 13 consecutive item words; an item
of fewer words is one window. Every document word inside an occurrence of a
window is hit.

Scale: one narrow pass over the documents, no shuffle. Items travel as a
broadcast block of at most ``block_words`` words (or one longer item); a larger
item table becomes more blocks and one pass each. Passes are written to the
shared folder one after the other and the block before is dropped, so driver
and workers hold one block at a time; a worker process builds its automaton
once, not once a task. Spans and item ids pass from block to block in the row.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tessella.llm.common import ID, TEXT, in_slices, rows, schema_of
from tessella.runtime import materialise, ship

WINDOW = 13
COVERAGE = 0.05
#: Words of one broadcast block of items: about 100 MB of automaton in a worker.
BLOCK_WORDS = 200_000

#: The automaton that a worker process built last, by its broadcast's number.
_latest: dict[int, Automaton] = {}

#: Each byte's normal form: lower-case word bytes stay, all else parts words.
_NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

RESULT = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("n_items", T.LongType()),
    T.StructField("item_ids", T.ArrayType(T.StringType())),
    T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))),
    T.StructField("contaminated", T.BooleanType()),
    T.StructField("clean_text", T.StringType()),
]


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_NORMAL).split() if text else []


class Automaton:
    """Generalised suffix automaton of word-id sequences, with the items of each window."""

    def __init__(self, items: Sequence[tuple[str | None, Sequence[bytes]]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.window = window
        ids = self.vocabulary
        sequences = [(name, [ids.setdefault(w, len(ids)) for w in words]) for name, words in items if words]
        for _, seq in sequences:
            last = 0
            for w in seq:
                last = self._extend(last, w)
        self.shortest = min([window, *(len(s) for _, s in sequences)])
        #: By state: (length, items) of the windows that end there, longest suffix first.
        self.windows: dict[int, dict[int, set[str | None]]] = {}
        for name, seq in sequences:
            size = min(window, len(seq))
            state, matched = 0, 0
            for w in seq:
                state, matched = self.step(state, matched, w)
                if matched >= size:
                    at = state
                    while self.length[self.link[at]] >= size:
                        at = self.link[at]
                    self.windows.setdefault(at, {}).setdefault(size, set()).add(name)
        self._ending: dict[int, list[tuple[int, frozenset]]] = {}

    def _new(self, length: int, link: int, nxt: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(nxt)
        return len(self.length) - 1

    def _split(self, p: int, q: int, w: int) -> int:
        """The state of the longest word sequence of p followed by w, cloned from q if q holds longer ones."""
        if self.length[p] + 1 == self.length[q]:
            return q
        clone = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p != -1 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, w: int) -> int:
        if w in self.next[last]:
            return self._split(last, self.next[last][w], w)
        cur = self._new(self.length[last] + 1, 0, {})
        p = last
        while p != -1 and w not in self.next[p]:
            self.next[p][w] = cur
            p = self.link[p]
        if p != -1:
            self.link[cur] = self._split(p, self.next[p][w], w)
        return cur

    def step(self, state: int, matched: int, w: int) -> tuple[int, int]:
        """State and length of the longest suffix that occurs in an item, one word on."""
        nxt = self.next
        while state and w not in nxt[state]:
            state = self.link[state]
            matched = self.length[state]
        if w in nxt[state]:
            return nxt[state][w], matched + 1
        return 0, 0

    def ending(self, state: int) -> list[tuple[int, frozenset]]:
        """Every window that is a suffix of the state's sequences."""
        if state not in self._ending:
            found, at = [], state
            while at > 0:
                found += [(size, frozenset(names)) for size, names in self.windows.get(at, {}).items()]
                at = self.link[at]
            self._ending[state] = sorted(found, key=lambda x: -x[0])
        return self._ending[state]

    def scan(self, words: Sequence[bytes]) -> tuple[list[tuple[int, int]], set[str | None]]:
        """Maximal hit spans [start, end) and the items with an occurring window."""
        known = np.fromiter(map(self.vocabulary.get, words, [-1] * len(words)), np.int64, len(words))
        edges = np.flatnonzero(np.diff(np.concatenate(([0], (known >= 0).view(np.int8), [0]))))
        spans: list[tuple[int, int]] = []
        names: set[str | None] = set()
        for start, end in edges.reshape(-1, 2):
            if end - start < self.shortest:
                continue
            state = matched = 0
            for i, w in enumerate(known[start:end].tolist(), int(start) + 1):
                state, matched = self.step(state, matched, w)
                if matched >= self.shortest:
                    longest = 0
                    for size, who in self.ending(state):
                        if size <= matched:
                            names |= who
                            longest = longest or size
                    if longest:
                        lo = i - longest
                        while spans and spans[-1][1] >= lo:
                            lo = min(lo, spans.pop()[0])
                        spans.append((lo, i))
        return spans, names


def automaton_of(number: int, block: Callable[[], list], window: int) -> Automaton:
    """The automaton of a broadcast block, built once a worker process; the one before it goes."""
    if number not in _latest:
        _latest.clear()
        _latest[number] = Automaton(block(), window)
    return _latest[number]


def merged(spans: Sequence[Sequence[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for lo, hi in sorted(map(list, spans)):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return out


def without(text: bytes, spans: Sequence[Sequence[int]]) -> bytes:
    """The text without the bytes of the words in the spans and of what lies between them."""
    plain = text.translate(_NORMAL)
    shape = np.frombuffer(plain, np.uint8) != 32
    edges = np.flatnonzero(np.diff(np.concatenate(([0], shape.view(np.int8), [0])))).reshape(-1, 2)
    out, at = [], 0
    for lo, hi in spans:
        out.append(text[at : edges[lo][0]])
        at = int(edges[hi - 1][1])
    return b"".join([*out, text[at:]])


def _blocks(items: DataFrame, item_id: str, item_text: str, block_words: int) -> Iterator[list]:
    """Items as (id, words), in blocks; the driver holds one block at a time."""
    block, held = [], 0
    for r in rows(items, item_id, item_text).select(F.col(ID).cast("string"), TEXT).toLocalIterator():
        words = words_of(bytes(r[1]) if r[1] is not None else None)
        if words:
            block.append((r[0], words))
            held += len(words)
        if held >= block_words:
            yield block
            block, held = [], 0
    if block:
        yield block


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    carry: Sequence[str] = (),
    window: int = WINDOW,
    coverage: float = COVERAGE,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """One row per document row: counts, item ids, hit spans (word offsets) and the text without them.

    ``contaminated``: some word is hit and hit words make up at least ``coverage``
    of all. ``clean_text``: the text without its hit spans where contaminated,
    otherwise the text as it is.

    Edge cases: a null or empty text has no words and is never contaminated
    (clean_text keeps the null); a null or wordless item is no item; a null
    item id hits words but is neither listed nor counted; item ids that repeat
    count once; equal items under several ids count once each; no items or no
    documents: no hits, no rows. Further input columns are ignored unless named
    in ``carry``. Texts are read whole, whatever their length.
    """
    spark = docs.sparkSession
    ship(spark)
    base = rows(docs, id_col, text_col, carry)
    hits = [T.StructField("_spans", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("_items", T.ArrayType(T.StringType()))]
    between = T.StructType([*base.schema.fields, *hits])
    result = schema_of(docs, id_col, carry, RESULT)
    width = len(base.columns)
    current = base.withColumns({f.name: F.lit(None).cast(f.dataType) for f in hits})

    def over(df: DataFrame, block: list, last: bool) -> DataFrame:
        shared = spark.sparkContext.broadcast(block)
        number = uuid.uuid4().int
        schema = result if last else between
        arrow = to_arrow_schema(schema)

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = automaton_of(number, lambda: shared.value, window)
            for whole in batches:
                for batch in in_slices(whole, 8 << 20, 4096):
                    got: list[list] = [[] for _ in (RESULT if last else hits)]
                    old = (batch.column("_spans").to_pylist(), batch.column("_items").to_pylist())
                    for cell, had, listed in zip(batch.column(TEXT), *old, strict=True):
                        text = cell.as_py()
                        words = words_of(text)
                        spans, names = automaton.scan(words)
                        spans = merged([*(had or []), *spans])
                        names = sorted({*(listed or []), *(x for x in names if x is not None)})
                        row = (spans, names)
                        if last:
                            n, hit = len(words), sum(hi - lo for lo, hi in spans)
                            bad = hit > 0 and hit + 1e-9 >= coverage * n
                            row = (n, hit, len(names), names, spans, bad, without(text, spans) if bad else text)
                        for column, value in zip(got, row, strict=True):
                            column.append(value)
                    if last:
                        kept = [batch.column(0), *batch.columns[2 : 2 + len(carry)]]
                        got[-1] = pa.array(got[-1], pa.binary()).cast(pa.string())
                    else:
                        kept = batch.columns[:width]
                    new = [x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(got, list(arrow)[len(kept) :], strict=True)]
                    yield pa.RecordBatch.from_arrays([*kept, *new], schema=arrow)

        found = df.mapInArrow(scan, schema)
        if not last:
            # A table between two passes: a stage never holds two automata, and the block can go.
            found = materialise(found)
            shared.destroy()
        return found

    waiting: list = []
    for block in _blocks(items, item_id, item_text, block_words):
        if waiting:
            current = over(current, waiting, last=False)
        waiting = block
    return over(current, waiting, last=True)

