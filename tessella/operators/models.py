"""Fitted models: Platt, isotonic, ridge with folds, greedy forward selection.

Spark makes the statistics that a fit needs (sums by distinct confidence and
fold, cross products by fold), whose size doesn't grow with the rows; the
driver solves a few small equations. No table is collected or sent to one group.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.runtime import materialise, ship


def platt(x: np.ndarray, y: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """Slope and intercept of a logistic curve, by Newton steps on smoothed targets."""
    up, down = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    beta = np.array([0.0, np.log((up + 1) / (down + 1))])
    a = np.column_stack((x, np.ones(len(x))))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 1e-9 * np.eye(2), a.T @ (target - p))
        beta = beta + step
        if np.abs(step).max() < 1e-10:
            break
    return float(beta[0]), float(beta[1])


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Upper ends and levels of the best rising step function (pool adjacent violators); equal x pool first."""
    ends, at = np.unique(x, return_inverse=True)
    weight = np.bincount(at).astype(float)
    level = np.bincount(at, weights=y) / weight
    stack: list[list[float]] = []
    for e, v, w in zip(ends, level, weight, strict=True):
        stack.append([e, v, w])
        while len(stack) > 1 and stack[-2][1] >= stack[-1][1]:
            e2, v2, w2 = stack.pop()
            _, v1, w1 = stack.pop()
            stack.append([e2, (v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2])
    return np.array([s[0] for s in stack]), np.array([s[1] for s in stack])


def step_at(ends: np.ndarray, levels: np.ndarray, x: np.ndarray) -> np.ndarray:
    return levels[np.minimum(np.searchsorted(ends, x), len(ends) - 1)]


def _logistic(counts: DataFrame, folds: int, rounds: int = 100) -> list[tuple[float, float] | None]:
    """platt() of the other folds' rows, for each fold; a round is one aggregate over distinct confidences. None without both classes' rows."""
    own, x, n, up = (F.col(c) for c in ("own", "x", "n", "up"))
    sums = counts.groupBy("own").agg(F.sum("n").alias("n"), F.sum("up").alias("up")).collect()
    ups, rows = ([sum(r[c] for r in sums if r["own"] != f) for f in range(folds)] for c in ("up", "n"))
    if not sums:
        return [None] * folds
    beta = [np.array([0.0, np.log((ups[f] + 1) / (rows[f] - ups[f] + 1))]) for f in range(folds)]
    moving = {f for f in range(folds) if rows[f]}
    for _ in range(rounds):
        sums = []
        for f in sorted(moving):
            high, low = (ups[f] + 1) / (ups[f] + 2), 1 / (rows[f] - ups[f] + 2)
            z = F.least(F.greatest(x * float(beta[f][0]) + float(beta[f][1]), F.lit(-30.0)), F.lit(30.0))
            p = 1 / (1 + F.exp(-z))
            gap, spread = up * high + (n - up) * low - n * p, n * p * (1 - p)
            mine = lambda v, f=f: F.sum(F.when(own != f, v).otherwise(0.0))
            sums += [mine(gap * x), mine(gap), mine(spread * x * x), mine(spread * x), mine(spread)]
        if not sums:
            break
        found = iter(counts.agg(*[e.alias(f"s{i}") for i, e in enumerate(sums)]).first())
        for f in sorted(moving):
            g1, g2, h11, h12, h22 = (next(found) or 0.0 for _ in range(5))
            step = np.linalg.solve(np.array([[h11, h12], [h12, h22]]) + 1e-9 * np.eye(2), np.array([g1, g2]))
            beta[f] = beta[f] + step
            if np.abs(step).max() < 1e-10:
                moving.discard(f)
    return [(float(b[0]), float(b[1])) if rows[f] else None for f, b in enumerate(beta)]


_BLOCK = "fold int, end double, up double, n double"


def _pooled(fold: int, ends: np.ndarray, up: np.ndarray, n: np.ndarray) -> pd.DataFrame:
    """Neighbouring blocks pooled until levels rise; pooling blocks of pooled stretches gives the same as pooling all rows."""
    stack: list[list[float]] = []
    for e, u, w in zip(ends.tolist(), up.tolist(), n.tolist(), strict=True):
        stack.append([e, u, w])
        while len(stack) > 1 and stack[-2][1] * stack[-1][2] >= stack[-1][1] * stack[-2][2]:
            e2, u2, w2 = stack.pop()
            _, u1, w1 = stack.pop()
            stack.append([e2, u1 + u2, w1 + w2])
    return pd.DataFrame([(fold, *s) for s in stack], columns=["fold", "end", "up", "n"])


def _steps(counts: DataFrame, folds: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """isotonic() of the other folds' rows, for each fold: pooled within ranges of confidence, then over what is left of them.

    A row a level comes to the driver; levels of noisy outcomes are few.
    """

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([*batches, pd.DataFrame({"own": [], "x": [], "n": [], "up": []})])
        for fold in range(folds):
            mine = rows[rows["own"] != fold].groupby("x", sort=True)[["up", "n"]].sum()
            if len(mine):
                yield _pooled(fold, mine.index.to_numpy(float), mine["up"].to_numpy(float), mine["n"].to_numpy(float))

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("end")
        return _pooled(int(pdf["fold"].iloc[0]), pdf["end"].to_numpy(), pdf["up"].to_numpy(), pdf["n"].to_numpy())

    found = counts.repartitionByRange("x").mapInPandas(local, _BLOCK).groupBy("fold").applyInPandas(whole, _BLOCK).collect()
    levels = {f: sorted((r["end"], r["up"] / r["n"]) for r in found if r["fold"] == f) for f in range(folds)}
    return [(np.array([e for e, _ in levels[f]]), np.array([v for _, v in levels[f]])) for f in range(folds)]


def calibrated(df: DataFrame, key: str, subject: str, conf: str, hit: str, kind: str, folds: int = 5, fold: Column | None = None) -> DataFrame:
    """(key, calibrated): cross-fitted confidences; each subject's fold (by its hash, or as given) is scored by a map fitted on the others.

    Where the others are empty a confidence stays as it is. Rows are narrow
    passes; fits see counts by distinct confidence and fold.
    """
    ship(df.sparkSession)
    rows = df.select(F.col(key).alias("key"), F.col(conf).cast("double").alias("x"), F.col(hit).cast("double").alias("y"), (F.pmod(F.xxhash64(subject), F.lit(folds)) if fold is None else fold).cast("int").alias("own"))
    counts = materialise(rows.groupBy("own", "x").agg(F.count("*").cast("double").alias("n"), F.sum("y").alias("up")))
    x, out = F.col("x"), F.col("x")
    if kind == "platt":
        for f, fitted in enumerate(_logistic(counts, folds)):
            if fitted:
                out = F.when(F.col("own") == f, 1 / (1 + F.exp(-(x * fitted[0] + fitted[1])))).otherwise(out)
        return rows.select("key", out.alias("calibrated"))
    fitted = _steps(counts, folds)

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            values, own = pdf["x"].to_numpy(float).copy(), pdf["own"].to_numpy()
            for f, (ends, levels) in enumerate(fitted):
                if len(ends):
                    values[own == f] = step_at(ends, levels, pdf["x"].to_numpy(float)[own == f])
            yield pd.DataFrame({"key": pdf["key"], "calibrated": values})

    return rows.mapInPandas(apply, f"key {df.schema[key].dataType.simpleString()}, calibrated double")


def cross_products(df: DataFrame, columns: Sequence[str], fold: Column, folds: int) -> np.ndarray:
    """By fold the matrix of sums of products of the columns and 1 (first): partial matrices in the tasks, summed by cell."""
    width = len(columns) + 1

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((folds, width, width))
        for batch in batches:
            z = np.column_stack([np.ones(len(batch)), *[batch.column(i + 1).to_numpy(zero_copy_only=False) for i in range(width - 1)]])
            own = batch.column(0).to_numpy(zero_copy_only=False)
            for f in range(folds):
                sums[f] += z[own == f].T @ z[own == f]
        cells = np.arange(sums.size, dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(sums.ravel())], names=["cell", "v"])

    narrow = df.select(fold.cast("int").alias("_fold"), *[F.col(c).cast("double") for c in columns])
    out = np.zeros(folds * width * width)
    for r in narrow.mapInArrow(partial, "cell int, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect():
        out[r["cell"]] = r["v"]
    return out.reshape(folds, width, width)


def ridge_of(sums: np.ndarray, chosen: Sequence[int], targets: Sequence[int], penalty: float) -> np.ndarray:
    """Intercepts (first row, not penalised) and slopes of a ridge, from the sums of products."""
    n, at = max(sums[0, 0], 1.0), list(chosen)
    mean_x, mean_y = sums[0, at] / n, sums[0, targets] / n
    xx = sums[np.ix_(at, at)] - n * np.outer(mean_x, mean_x)
    xy = sums[np.ix_(at, targets)] - n * np.outer(mean_x, mean_y)
    slopes = np.linalg.solve(xx + penalty * np.eye(len(at)), xy)
    return np.vstack([mean_y - mean_x @ slopes, slopes])


def fold_errors(df: DataFrame, features: Sequence[str], targets: Sequence[str], sets: Sequence[Sequence[int]], sums: np.ndarray, fold: Column, penalty: float) -> list[float]:
    """The mean absolute out-of-fold error of a ridge on each set of features (by place); one pass over the rows scores all sets."""
    folds, p = len(sums), len(features)
    aims = list(range(p + 1, p + 1 + len(targets)))
    fits = [[ridge_of(sums.sum(axis=0) - sums[f], [i + 1 for i in chosen], aims, penalty) for f in range(folds)] for chosen in sets]

    def miss(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(len(sets)), 0
        for batch in batches:
            z = np.column_stack([batch.column(i + 1).to_numpy(zero_copy_only=False) for i in range(p + len(targets))])
            own = batch.column(0).to_numpy(zero_copy_only=False)
            n += len(z) * len(targets)
            for f in range(folds):
                mine = z[own == f]
                for s, chosen in enumerate(sets):
                    total[s] += np.abs(mine[:, list(chosen)] @ fits[s][f][1:] + fits[s][f][0] - mine[:, p:]).sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sets), dtype=np.int32)), pa.array(total), pa.array(np.full(len(sets), n, np.int64))], names=["s", "total", "n"])

    narrow = df.select(fold.cast("int").alias("_fold"), *[F.col(c).cast("double") for c in (*features, *targets)])
    found = {r["s"]: r["total"] / max(r["n"], 1) for r in narrow.mapInArrow(miss, "s int, total double, n long").groupBy("s").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect()}
    return [found[s] for s in range(len(sets))]


def greedy_order(df: DataFrame, key: str, features: Sequence[str], targets: Sequence[str], most: int, penalty: float = 1.0, folds: int = 5) -> DataFrame:
    """Forward selection: in each round the feature whose ridge has the least out-of-fold error joins the list (ties: the first).

    Cross products by fold are summed once; a round is one narrow pass over the
    rows that scores all its candidates. Folds come from the key's hash. Rows
    with a null in any column teach nothing.
    """
    spark = df.sparkSession
    ship(spark)
    table = materialise(df.select(key, *features, *targets).na.drop())
    fold = F.pmod(F.xxhash64(key), F.lit(folds))
    sums = cross_products(table, [*features, *targets], fold, folds)
    chosen, rows = [], []
    for place in range(1, min(most, len(features)) + 1):
        left = [i for i in range(len(features)) if i not in chosen]
        errors = fold_errors(table, features, targets, [[*chosen, i] for i in left], sums, fold, penalty)
        best = min(range(len(left)), key=lambda j: (errors[j], j))
        chosen.append(left[best])
        rows.append((place, features[left[best]], errors[best]))
    return spark.createDataFrame(rows, "place int, feature string, mae double")
