"""Exact top-k inner-product search: clustered shards, a ball tree in each, branch and bound.

Vectors are quantised to integers, so scores and ties are exact. A router (the
upper levels of a ball tree, split on a bounded sample) deals every row to the
shard of its neighbours; shards that grow beyond their size are cut by a salt.
Each shard has a ball (centre, radius), and a query's inner product with any of
its rows is at most <q, centre> + |q| * radius. Within a shard a ball tree is
searched in the order of that bound; a node is left out once its bound lies
below the current kth score (or equals it while all its ids are larger).

The current kth score is shared in three rounds: a query first searches the
shard that it lies in; the kth score found goes with it to the ``NEXT`` shards
of highest bound; and the better kth score of both goes with it to whichever
other shards may still hold a row as good. A shard whose ball cannot reach the
kth score never hears of the query.

Scale: a vector is shuffled once for each round, whatever the number of
queries, and only to shards that some query asks; a shard that more than
``block_queries`` queries ask gets one copy for each such block, so both sides
of a group stay bounded. The table of balls goes out in blocks of ``MOST_CELLS``
numbers, each a narrow pass over the queries. Results are k rows for each query
and asked shard, merged by a window that keeps k while it reads.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tessella.runtime import materialise, ship

K, SCALE = 5, 256
SHARD_ROWS, BLOCK_QUERIES = 4096, 4096
LEAF = 128
#: Shards that a query asks in the second round.
NEXT = 4
#: Rows that the router is split on, and numbers in a sample or a block of balls (32 MB as doubles).
SAMPLE, MOST_CELLS = 16_384, 1 << 22
#: Inner products below this are exact in doubles; beyond, whole numbers of any size are used.
_EXACT = 2.0**52
_LONG = (-(1 << 63), (1 << 63) - 1)

_FOUND = T.StructType([T.StructField(c, T.LongType()) for c in ("_q", "_qid", "_id", "_score")])
_BALL = T.StructType([T.StructField("_shard", T.StringType()), T.StructField("_dim", T.IntegerType()), T.StructField("_centre", T.ArrayType(T.DoubleType())), T.StructField("_radius", T.DoubleType())])


def halves(points: np.ndarray) -> tuple[np.ndarray, float, np.ndarray] | None:
    """A direction between two far points, the median along it, and which points lie up to it; None for points that are all alike."""
    with np.errstate(all="ignore"):
        far = ((points - points.mean(axis=0)) ** 2).sum(axis=1)
        a = points[far.argmax()]
        b = points[((points - a) ** 2).sum(axis=1).argmax()]
        along = points @ (b - a)
        for near in (along <= np.median(along), along < np.median(along)):
            if near.any() and not near.all():
                return b - a, float(along[near].max()), near
    return None


class Router:
    """Planes that lead a vector to the leaf of its neighbours; split on a sample."""

    def __init__(self, sample: np.ndarray, leaf: int):
        #: direction, cut, and the next plane on either side, or ~leaf.
        self.planes: list[list] = []
        self.leaves = 0
        todo = [(np.arange(len(sample)), -1, 0)]
        while todo:
            at, parent, side = todo.pop()
            split = halves(sample[at]) if len(at) > leaf else None
            me = len(self.planes) if split else ~self.leaves
            if parent >= 0:
                self.planes[parent][2 + side] = me
            if split:
                direction, cut, near = split
                self.planes.append([direction, cut, 0, 0])
                todo += [(at[near], me, 0), (at[~near], me, 1)]
            else:
                self.leaves += 1

    def of(self, points: np.ndarray) -> np.ndarray:
        out = np.zeros(len(points), np.int32)
        todo = [(0, np.arange(len(points)))] if self.planes else []
        while todo:
            node, at = todo.pop()
            if node < 0:
                out[at] = ~node
            elif len(at):
                direction, cut, low, high = self.planes[node]
                with np.errstate(all="ignore"):
                    near = points[at] @ direction <= cut
                todo += [(low, at[near]), (high, at[~near])]
        return out


def ball(points: np.ndarray) -> tuple[np.ndarray, float]:
    """Centre and radius; a margin keeps the radius an upper bound in spite of rounding."""
    with np.errstate(all="ignore"):
        centre = points.mean(axis=0)
        radius = np.sqrt(((points - centre) ** 2).sum(axis=1).max()) * (1 + 1e-12) + 1e-12 * np.sqrt((centre**2).sum())
    return centre, float(radius)


def upper_bounds(queries: np.ndarray, centres: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """For each query and ball the most that an inner product can be; infinite where numbers overflow."""
    with np.errstate(all="ignore"):
        length = np.sqrt((queries**2).sum(axis=1))[:, None]
        reach = np.sqrt((centres**2).sum(axis=1)) + radii
        found = queries @ centres.T + length * radii + 1e-12 * length * reach + 1e-9
    return np.nan_to_num(found, nan=np.inf, posinf=np.inf, neginf=np.inf)


class BallTree:
    """Nodes are stretches of the ordered rows; a parent comes before its children."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, points: np.ndarray, leaf: int = LEAF):
        order = np.argsort(ids, kind="stable")
        spans, parents, balls, leaves = [], [], [], []
        todo = [(0, len(ids), -1)]
        while todo:
            lo, hi, parent = todo.pop()
            me, here = len(spans), points[order[lo:hi]]
            spans.append((lo, hi))
            parents.append(parent)
            balls.append(ball(here))
            split = halves(here) if hi - lo > leaf else None
            if split:
                near = split[2]
                order[lo:hi] = np.concatenate((order[lo:hi][near], order[lo:hi][~near]))
                mid = lo + int(near.sum())
                todo += [(mid, hi, me), (lo, mid, me)]
            else:
                # Rows that are all alike are one ball; they are read some at a time, smallest ids first.
                leaves += [(me, at, min(at + leaf, hi)) for at in range(lo, hi, leaf)]
        self.parents, self.leaves = parents, leaves
        self.centres, self.radii = np.stack([c for c, _ in balls]), np.array([r for _, r in balls])
        self.rows, self.ids, self.points = rows[order], ids[order], points[order]
        self.least = np.array([self.ids[lo:hi].min() for _, lo, hi in leaves])
        self.most = float(np.abs(points).max(initial=0))

    def _leaf_bounds(self, queries: np.ndarray) -> np.ndarray:
        bounds = upper_bounds(queries, self.centres, self.radii)
        for node, parent in enumerate(self.parents):
            if parent >= 0:
                np.minimum(bounds[:, node], bounds[:, parent], out=bounds[:, node])
        return bounds[:, [node for node, _, _ in self.leaves]]

    def search(self, own: np.ndarray, queries: np.ndarray, floors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(scores, ids), k of each query and -inf where there are fewer, best first, of all rows but its own that may matter above the floor; and (query, row) pairs scored."""
        with np.errstate(all="ignore"):
            whole = float(np.abs(queries).max(initial=0)) * self.most * max(queries.shape[1], 1) >= _EXACT
        scores, ids = np.full((len(queries), k), -np.inf, object if whole else float), np.full((len(queries), k), _LONG[1], np.int64)
        bounds = self._leaf_bounds(queries)
        order = np.argsort(-bounds, axis=1, kind="stable")
        bounds = np.take_along_axis(bounds, order, axis=1)
        scored = 0
        for step in range(len(self.leaves)):
            # Bounds fall from step to step, so a query that stops here has stopped for good.
            live = np.flatnonzero((bounds[:, step] >= scores[:, -1]) & (bounds[:, step] >= floors))
            if not len(live):
                break
            leaf = order[live, step]
            useful = (np.floor(bounds[live, step]) > scores[live, -1]) | (self.least[leaf] <= ids[live, -1])
            live, leaf = live[useful], leaf[useful]
            by = np.argsort(leaf, kind="stable")
            for at in np.split(by, np.flatnonzero(np.diff(leaf[by])) + 1):
                if len(at):
                    q, (_, lo, hi) = live[at], self.leaves[leaf[at[0]]]
                    scored += len(q) * (hi - lo)
                    scores[q], ids[q] = self._merged(scores[q], ids[q], own[q], queries[q], lo, hi, whole)
        return scores, ids, scored

    def _merged(self, scores: np.ndarray, ids: np.ndarray, own: np.ndarray, queries: np.ndarray, lo: int, hi: int, whole: bool) -> tuple[np.ndarray, np.ndarray]:
        """The best of what there was and the rows from lo to hi."""
        k, there = scores.shape[1], self.points[lo:hi]
        new = np.array([[sum(int(a) * int(b) for a, b in zip(x, y, strict=True)) for y in there] for x in queries], object) if whole else queries @ there.T
        new[self.rows[lo:hi] == own[:, None]] = -np.inf
        scores = np.concatenate((scores, new), axis=1)
        ids = np.concatenate((ids, np.broadcast_to(self.ids[lo:hi], new.shape)), axis=1)
        if whole:
            top = np.array([sorted(range(len(s)), key=lambda j, s=s, i=i: (-s[j], i[j]))[:k] for s, i in zip(scores, ids, strict=True)])
        else:
            top = np.lexsort((ids, -scores), axis=-1)[:, :k]
        return np.take_along_axis(scores, top, axis=1), np.take_along_axis(ids, top, axis=1)


def scaled(vector: Column, scale: int = SCALE) -> Column:
    """scale * x of each component as double; null for vectors that are null or hold a null or a component that isn't finite (so scaled)."""
    double = F.transform(vector, lambda x: x.cast("double") * scale)
    bad = F.exists(double, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(vector.isNotNull() & ~F.coalesce(bad, F.lit(True)), double)


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), dim)


def _placed(base: DataFrame, shard_rows: int) -> DataFrame:
    """The rows with their whole-number vectors ``_v`` and the shard of each."""
    n, widest = base.agg(F.count("*"), F.max("_dim")).first()
    numbered = base.withColumn("_row", F.monotonically_increasing_id())
    wanted = min(SAMPLE, max(MOST_CELLS // max(widest or 1, 1), 2))
    chosen = numbered.filter(F.pmod(F.xxhash64("_row"), F.lit(1 << 30)) <= (1 << 30) * min(1.0, wanted / max(n, 1))) if n > wanted else numbered
    leaf = max(2, wanted * shard_rows // n) if n > wanted else shard_rows
    sample: dict[int, list] = {}
    for r in chosen.filter("_dim > 0").select("_dim", "_v").collect() if n > shard_rows else []:
        sample.setdefault(r["_dim"], []).append(r["_v"])
    routers = {dim: Router(np.floor(np.array(v)), leaf) for dim, v in sample.items()}
    schema = T.StructType([*numbered.schema.fields, T.StructField("_leaf", T.IntegerType())])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("_v")
            sizes = pc.list_value_length(v).to_numpy()
            ends = np.cumsum(sizes, dtype=np.int64)
            flat, leaves = np.floor(v.flatten().to_numpy(zero_copy_only=False)), np.zeros(len(sizes), np.int32)
            for dim in np.unique(sizes).tolist():
                if dim in routers:
                    at = np.flatnonzero(sizes == dim)
                    leaves[at] = routers[dim].of(flat[(ends[at] - dim)[:, None] + np.arange(dim)])
            whole = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(flat))
            columns = [whole.cast(f.type) if f.name == "_v" else pa.array(leaves) if f.name == "_leaf" else batch.column(f.name) for f in to_arrow_schema(schema)]
            yield pa.RecordBatch.from_arrays(columns, schema=to_arrow_schema(schema))

    routed = materialise(numbered.mapInArrow(route, schema))
    salts = routed.groupBy("_dim", "_leaf").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("_salts"))
    salt = F.pmod(F.xxhash64("_row", F.lit(3)), F.col("_salts"))
    return routed.join(salts, ["_dim", "_leaf"]).withColumn("_shard", F.concat_ws("/", "_dim", "_leaf", salt)).drop("_leaf", "_salts")


def top_k(
    vectors: DataFrame,
    is_query: Column,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = K,
    scale: int = SCALE,
    shard_rows: int = SHARD_ROWS,
    block_queries: int = BLOCK_QUERIES,
    next_shards: int = NEXT,
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k rows of highest inner product, ties to the smaller id.

    Edge cases: ids are whole numbers. Null vectors, null ids and vectors with a
    component that is null, not finite or not finite times ``scale`` take no
    part, neither as query nor as candidate. Only vectors of the query's length
    are its candidates; fewer candidates than k give all of them. Every row is
    a candidate and, if it is a query, asks for itself, also where rows share
    an id: only a query's own row is left out, so ids that repeat may return,
    and rows that repeat as queries repeat their results. Inner products are
    exact at any size; a score beyond a long is given (and ranked) as the
    largest or smallest long. Empty vectors score 0; an empty table gives no
    rows. Vectors of any length are read whole. Further input columns are
    ignored.
    """
    spark = vectors.sparkSession
    ship(spark)
    base = vectors.select(vectors[id_col].cast("long").alias("_id"), scaled(vectors[vector_col], scale).alias("_v"), F.coalesce(is_query, F.lit(False)).alias("_is"))
    rows = materialise(_placed(base.filter("_id IS NOT NULL AND _v IS NOT NULL").withColumn("_dim", F.size("_v")), shard_rows))
    queries = rows.filter("_is").select(F.col("_row").alias("_q"), F.col("_id").alias("_qid"), F.col("_v").alias("_qv"), F.col("_dim").alias("_qdim"), F.col("_shard").alias("_home"))
    found_schema, ball_schema = to_arrow_schema(_FOUND), to_arrow_schema(_BALL)

    def bounding(group: pa.Table) -> pa.Table:
        dim = group.column("_dim")[0].as_py()
        centre, radius = ball(_matrix(group.column("_v"), dim))
        cells = ([group.column("_shard")[0].as_py()], [dim], [centre.tolist()], [radius])
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(cells, ball_schema, strict=True)], schema=ball_schema)

    balls = materialise(rows.groupBy("_shard").applyInArrow(bounding, _BALL))
    shards, cells = balls.agg(F.count("*"), F.sum(F.col("_dim") + 1)).first()
    parts = max(1, -(-int(cells or 0) // MOST_CELLS))
    blocks = [balls.filter(F.pmod(F.xxhash64("_shard"), F.lit(parts)) == i) for i in range(parts)]

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        """left: rows of a shard; right: queries with their floors."""
        got: list[list] = [[], [], [], []]
        if len(left) and len(right):
            dim = left.column("_dim")[0].as_py()
            tree = BallTree(left.column("_row").to_numpy(), left.column("_id").to_numpy(), _matrix(left.column("_v"), dim))
            asking, names = right.column("_q").to_numpy(), right.column("_qid").to_pylist()
            floors = np.array([-np.inf if f is None else f for f in right.column("_floor").to_pylist()], float)
            scores, ids, _ = tree.search(asking, _matrix(right.column("_qv"), dim), floors, k)
            for i, j in zip(*np.nonzero(scores > -np.inf), strict=True):
                for column, value in zip(got, (int(asking[i]), names[i], int(ids[i, j]), min(max(int(scores[i, j]), _LONG[0]), _LONG[1])), strict=True):
                    column.append(value)
        return pa.Table.from_arrays([pa.array(x, pa.int64()) for x in got], schema=found_schema)

    def searched(asks: DataFrame) -> DataFrame:
        copies = asks.groupBy("_asked").agg(F.ceil(F.count("*") / block_queries).cast("int").alias("_copies"))
        left = rows.join(copies, rows["_shard"] == copies["_asked"]).withColumn("_copy", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)))
        right = asks.join(copies, "_asked").withColumn("_copy", F.pmod(F.xxhash64("_q"), F.col("_copies")).cast("int"))
        return materialise(left.select("_shard", "_copy", "_dim", "_row", "_id", "_v").groupBy("_shard", "_copy").cogroup(right.groupBy("_asked", "_copy")).applyInArrow(answer, _FOUND))

    asks_schema = T.StructType([*[f for f in queries.schema.fields if f.name in ("_q", "_qid", "_qv")], T.StructField("_floor", T.LongType()), T.StructField("_asked", T.StringType())])

    def asking(found: Sequence[DataFrame], block: DataFrame, near: bool) -> DataFrame:
        """Queries with the shards of a block that may hold a row as good as the floor: the next of highest bound, or the others."""
        kth = reduce(DataFrame.unionByName, found).withColumn("_place", F.row_number().over(Window.partitionBy("_q").orderBy(F.desc("_score"))))
        floors = kth.filter(F.col("_place") == k).select(F.col("_q").alias("_of"), F.col("_score").alias("_floor"))
        table = block.collect()
        by_dim = {}
        for dim in {r["_dim"] for r in table}:
            here = [r for r in table if r["_dim"] == dim]
            by_dim[dim] = (np.array([r["_shard"] for r in here], object), np.array([r["_centre"] for r in here]).reshape(len(here), dim), np.array([r["_radius"] for r in here]))
        shared = spark.sparkContext.broadcast(by_dim)
        arrow = to_arrow_schema(asks_schema)

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for lo in range(0, len(whole), 512):
                    batch = whole.slice(lo, 512)
                    dims = np.array(batch.column("_qdim").to_pylist())
                    for dim in set(dims.tolist()) & shared.value.keys():
                        part = batch.take(pa.array(np.flatnonzero(dims == dim)))
                        names, centres, radii = shared.value[dim]
                        bounds = upper_bounds(_matrix(part.column("_qv"), dim), centres, radii)
                        bounds[np.array(part.column("_home").to_pylist(), object)[:, None] == names] = -np.inf
                        place = np.argsort(np.argsort(-bounds, axis=1, kind="stable"), axis=1)
                        floor = np.array([-np.inf if f is None else f for f in part.column("_floor").to_pylist()], float)[:, None]
                        i, j = np.nonzero((bounds >= floor) & (bounds > -np.inf) & ((place < next_shards) == near))
                        for at in range(0, len(i), 4096):
                            kept = part.take(pa.array(i[at : at + 4096]))
                            columns = [pa.array(names[j[at : at + 4096]], pa.string()) if f.name == "_asked" else kept.column(f.name).cast(f.type) for f in arrow]
                            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

        return queries.join(floors, queries["_q"] == floors["_of"], "left").mapInArrow(ask, asks_schema)

    found = [searched(queries.select("_q", "_qid", "_qv", F.lit(None).cast("long").alias("_floor"), F.col("_home").alias("_asked")))]
    for near in (True, False) if shards > 1 else ():
        found.append(searched(materialise(reduce(DataFrame.unionByName, [asking(found, b, near) for b in blocks]))))
    best = Window.partitionBy("_q").orderBy(F.desc("_score"), "_id")
    ranked = reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select(F.col("_qid").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("_id").alias(id_col), F.col("_score").alias("score"))
