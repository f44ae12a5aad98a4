"""Toxicity by weak supervision.

Voters: lexicon voters (a word or word beginning that labelled toxic documents
use far more than clean ones) and pattern voters (shouting, runs of
exclamation marks, several or many different lexicon words, none at all).
A generative label model fits each voter's hit rates for both classes by
expectation-maximisation, and the voters' correlations given the class;
correlated voters share their weight. A linear classifier then learns the
posterior labels and scores every text.

Scale: fitting reads at most ``most_rows`` labelled ids (those that hash
lowest), found from the labels alone and broadcast, so no text is shuffled; the
driver gets one row of votes for each of these ids, however many documents
share it. Scoring is one narrow pass over all whole texts with a model of a few
hundred numbers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tessella.llm.common import ID, TEXT, in_slices, rows, schema_of
from tessella.runtime import ship

#: Labelled documents that a model learns from at most, and lexicon voters at most.
MOST_ROWS, MOST_VOTERS = 20_000, 256
THRESHOLD = 0.3
#: A lexicon voter's least number of toxic documents, share of them among all it hits, and log odds.
LEAST_TOXIC, PRECISION, LOG_ODDS = 3, 0.9, 3.5
#: A voter's share of toxic documents must be this unlikely for a feature that both classes share alike.
CHANCE = 1e-3
#: Beginnings of words that vote beside whole words.
PREFIXES = (4, 5, 6)
PATTERNS = ("shouting", "exclaiming", "many", "several", "none")

_LETTERS = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_UPPER = bytes(range(65, 91))


def words_of(text: bytes | None) -> set[bytes]:
    """Distinct lower-case words."""
    return set(text.decode("utf-8", "replace").lower().encode("utf-8").translate(_LETTERS).split()) if text else set()


def features(words: set[bytes]) -> set[bytes]:
    """The words, and their beginnings marked by a star."""
    found = set(words)
    for p in PREFIXES:
        found |= {w[:p] + b"*" for w in words if len(w) > p}
    return found


def telling(toxic: int, clean: int, prior: float) -> bool:
    """Whether so large a share of toxic documents is no chance, by the Chernoff bound of the binomial tail."""
    n = toxic + clean
    share = toxic / n
    bound = toxic * np.log(share / prior) + (clean * np.log((1 - share) / (1 - prior)) if clean else 0.0)
    return share > prior and bound >= -np.log(CHANCE)


def separate(ranked: Sequence[tuple[bytes, int]], most: int) -> list[bytes]:
    """The first features (word or beginning, toxic documents) that find something new, at most so many.

    A feature is left out if a beginning that is taken covers it, or if it is a
    beginning that finds no more than what is taken of it, so one root has one
    voter and the rarer roots get theirs.
    """
    taken: list[bytes] = []
    most_of: dict[bytes, int] = {}
    for feature, toxic in ranked:
        stem = feature.rstrip(b"*")
        if any(stem[:p] + b"*" in most_of for p in PREFIXES if p <= len(stem)) or most_of.get(stem, -1) >= toxic:
            continue
        taken.append(feature)
        for p in PREFIXES:
            if p <= len(stem):
                most_of[stem[:p]] = max(most_of.get(stem[:p], 0), toxic)
        if feature.endswith(b"*"):
            most_of[feature] = toxic
        if len(taken) == most:
            break
    return taken


class Lexicon:
    """The voters' words and beginnings by place, with a quick test of which words of a text can hit any."""

    def __init__(self, entries: Sequence[bytes]):
        self.place = {w: i for i, w in enumerate(entries)}
        self.roots = {w[: min(PREFIXES)] for w in entries}

    def votes(self, text: bytes | None) -> np.ndarray:
        """1 for each lexicon voter that finds its word and each pattern voter that fires."""
        n, least = len(self.place), min(PREFIXES)
        out = np.zeros(n + len(PATTERNS))
        hitting = 0
        for w in words_of(text):
            if w[:least] in self.roots:
                hits = features({w}) & self.place.keys()
                hitting += bool(hits)
                out[[self.place[h] for h in hits]] = 1
        size = len(text) if text else 0
        out[n] = size > 0 and size - len(text.translate(None, _UPPER)) > 0.3 * size
        out[n + 1] = size > 0 and text.count(b"!!") * 200 > size
        out[n + 2] = hitting >= 4
        out[n + 3] = hitting >= 2
        out[n + 4] = hitting == 0
        return out


@dataclass
class Model:
    """The lexicon voters, the classifier's weights (lexicon, patterns, share of hits) and its bias."""

    lexicon: list[bytes]
    weights: np.ndarray
    bias: float
    #: For each voter its hit rate in toxic and clean texts, and its share of weight among correlated voters.
    toxic_rate: np.ndarray
    clean_rate: np.ndarray
    share: np.ndarray

    def __post_init__(self) -> None:
        self.voters = Lexicon(self.lexicon)

    def score(self, text: bytes | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.voters.votes(text) @ self.weights + self.bias, -30, 30))))


def label_model(hits: np.ndarray, prior: float, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of the toxic class by row, both hit rates by voter, and each voter's share of weight.

    The class is latent. Rates come from expectation-maximisation; a voter's
    share is 1 over the sum of its squared correlations given the class (1 if it
    is independent of all others), estimated anew in each round.
    """
    rows_in, inverse, times = np.unique(hits, axis=0, return_inverse=True, return_counts=True)
    hits, n, m = rows_in, times.sum(), hits.shape[1]
    positive = hits[:, : m - 1].sum(axis=1)
    post = np.where(positive >= 2, 0.95, np.where(positive == 1, 0.3, 0.02))
    share = np.ones(m)
    for _ in range(rounds):
        weight = (times * post, times * (1 - post))
        rates = [np.clip((w @ hits + 0.5) / (w.sum() + 1), 1e-4, 1 - 1e-4) for w in weight]
        squared = np.zeros((m, m))
        for w, rate in zip(weight, rates, strict=True):
            centred = (hits - rate) * np.sqrt(w)[:, None]
            cov = centred.T @ centred / max(w.sum(), 1)
            sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
            squared += w.sum() / n * np.clip(cov / np.outer(sd, sd), 0, 1) ** 2
        np.fill_diagonal(squared, 1)
        share = 1 / squared.sum(axis=1)
        odds = np.log(prior / (1 - prior))
        odds = odds + (hits * (np.log(rates[0]) - np.log(rates[1])) * share).sum(axis=1) + ((1 - hits) * (np.log1p(-rates[0]) - np.log1p(-rates[1])) * share).sum(axis=1)
        new = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        moved, post = np.abs(new - post).max(), new
        if moved < 1e-4:
            break
    return post[inverse.ravel()], rates[0], rates[1], share


def linear(x: np.ndarray, target: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by Newton steps with a ridge."""
    a = np.column_stack((x, np.ones(len(x))))
    beta = np.zeros(a.shape[1])
    penalty = np.full(a.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        step = np.linalg.solve((a * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ a + np.diag(penalty), a.T @ (target - p) - penalty * beta)
        beta += step
        if np.abs(step).max() < 1e-6:
            break
    return beta[:-1], float(beta[-1])


def learn(
    docs: DataFrame,
    labels: DataFrame,
    learnable: Column,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    most_rows: int = MOST_ROWS,
    most_voters: int = MOST_VOTERS,
) -> Model | None:
    """A model from labelled documents. learnable: over the labels' id column. None without both classes.

    Null labels and labels without a document teach nothing; of an id that is
    labelled more than once the larger label holds; documents that share an id
    all count for the lexicon, and the one of most votes (as bits) for the label
    model. Features of equal rank go by name. Empty tables give no model. Texts
    are read whole, whatever their length. Further columns are ignored.
    """
    ship(docs.sparkSession)
    known = labels.filter(learnable & labels[label_col].isNotNull() & labels[id_col].isNotNull()).groupBy(labels[id_col].alias("_key")).agg(F.max(labels[label_col]).cast("int").alias("_label"))
    # A threshold on the hash leaves little more than is wanted, so the last step sorts a bounded number of rows.
    share = min(1.0, 1.25 * most_rows / max(known.count(), 1))
    chosen = known.filter(F.pmod(F.xxhash64("_key"), F.lit(1 << 30)) < int(share * (1 << 30))).orderBy(F.pmod(F.xxhash64("_key"), F.lit(1 << 30)), "_key").limit(most_rows)
    base = rows(docs, id_col, text_col).join(F.broadcast(chosen), F.col(ID) == F.col("_key")).select("_label", "_key", TEXT)
    counted = T.StructType([T.StructField("feature", T.BinaryType()), T.StructField("toxic", T.LongType()), T.StructField("clean", T.LongType())])
    arrow = to_arrow_schema(counted)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = (Counter(), Counter())
        totals = [0, 0]
        for whole in batches:
            for batch in in_slices(whole, 8 << 20, 4096):
                for label, text in zip(batch.column(0).to_pylist(), batch.column(TEXT), strict=True):
                    seen[label > 0].update(features(words_of(text.as_py())))
                    totals[label > 0] += 1
        # The empty feature counts the documents.
        seen[0][b""], seen[1][b""] = totals
        names = list(seen[0].keys() | seen[1].keys())
        for lo in range(0, len(names), 100_000):
            part = names[lo : lo + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), pa.array([seen[1][x] for x in part], pa.int64()), pa.array([seen[0][x] for x in part], pa.int64())], schema=arrow)

    sums = base.mapInArrow(count, counted).groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    precise = (F.col("toxic") >= LEAST_TOXIC) & (F.col("toxic") >= PRECISION * (F.col("toxic") + F.col("clean")))
    kept = sums.filter(precise | (F.octet_length("feature") == 0))
    ranked = kept.withColumn("_all", F.octet_length("feature") == 0).orderBy(F.desc("_all"), F.desc((F.col("toxic") + 0.5) * (F.col("toxic") + 1) / (F.col("clean") + 0.5)), "feature").limit(most_voters * 8).collect()
    total = next((r for r in ranked if r["_all"]), None)
    if total is None or not total["toxic"] or not total["clean"]:
        return None
    odds = lambda r: np.log((r["toxic"] + 0.5) / (total["toxic"] + 1)) - np.log((r["clean"] + 0.5) / (total["clean"] + 1))
    prior = float(np.clip(total["toxic"] / (total["toxic"] + total["clean"]), 0.01, 0.99))
    lexicon = separate([(bytes(r["feature"]), r["toxic"]) for r in ranked if not r["_all"] and odds(r) >= LOG_ODDS and telling(r["toxic"], r["clean"], prior)], most_voters)
    voters = Lexicon(lexicon)
    voted = T.StructType([base.schema["_key"], T.StructField("votes", T.BinaryType())])

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in in_slices(whole, 8 << 20, 4096):
                bits = [np.packbits(voters.votes(x.as_py()).astype(bool)).tobytes() for x in batch.column(TEXT)]
                yield pa.RecordBatch.from_arrays([batch.column("_key"), pa.array(bits, pa.binary())], schema=to_arrow_schema(voted))

    ballots = [r["votes"] for r in base.mapInArrow(vote, voted).groupBy("_key").agg(F.max("votes").alias("votes")).collect()]
    m = len(lexicon) + len(PATTERNS)
    hits = np.unpackbits(np.frombuffer(b"".join(bytes(b) for b in ballots), np.uint8).reshape(len(ballots), -1), axis=1, count=m).astype(np.float64)
    post, toxic_rate, clean_rate, share = label_model(hits, prior)
    weights, bias = linear(hits, post)
    return Model(lexicon, weights, bias, toxic_rate, clean_rate, share)


def classify(docs: DataFrame, model: Model | None, *, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = (), threshold: float = THRESHOLD) -> DataFrame:
    """One row per document row: ``score`` (0 to 1) and ``predicted`` (1 from the threshold on).

    Edge cases: null and empty texts are scored as texts without a lexicon
    word; without a model every score is 0; long texts are read whole; rows
    that repeat get equal scores; a score that equals the threshold is
    predicted 1; no rows give no rows; further input columns are ignored unless
    carried.
    """
    ship(docs.sparkSession)
    out = schema_of(docs, id_col, carry, [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    arrow = to_arrow_schema(out)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in in_slices(whole, 8 << 20, 4096):
                scores = np.array([model.score(x.as_py()) if model else 0.0 for x in batch.column(TEXT)])
                yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(scores, pa.float64()), pa.array((scores >= threshold).astype(np.int32))], schema=arrow)

    return rows(docs, id_col, text_col, carry).mapInArrow(apply, out)
