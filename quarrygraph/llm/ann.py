"""Approximate nearest neighbours by inner product, with low-dimensional stable projections and kd-trees.

Vectors get one more coordinate that gives all of them the same length, so that the largest inner product is the least
Euclidean distance. A few Gaussian (2-stable) projections of them are indexed by kd-trees: a top tree, fitted on a bounded
sample, deals every vector to a cell, and each block of a cell's vectors has a tree of its own. A query takes blocks of
projected neighbours in the order of their projected distance and verifies them on the original vectors. The squared
projected distance of a vector at distance r is r^2 times a chi-square variable, so once the next projected distance is beyond
a chi-square quantile of the k-th best distance found, an unseen vector among the nearest k is unlikely, and the search stops.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrygraph.llm.common import arrow_map, discard, materialize

#: Projections; the chance that a nearest neighbour passes the stopping test; vectors of a leaf.
PROJECTIONS, SURE, LEAF = 8, 0.98, 128
#: Vectors the top tree is fitted on; vectors of a cell, aimed at, and of a block; most cells; queries of a block; tasks that a cell's queries are dealt to.
SAMPLE, CELL, MOST_CELLS, QUERY_BLOCK, SALTS = 16_384, 4096, 4096, 1024, 4


def chi_square_quantile(p: float, m: int) -> float:
    """Of an even number of degrees of freedom, by bisection."""
    low, high = 0.0, 400.0
    for _ in range(80):
        x = (low + high) / 2
        below = 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(m // 2))
        low, high = (x, high) if below < p else (low, x)
    return high


def split_tree(points: np.ndarray, leaves: int) -> list[np.ndarray]:
    """The rows of each leaf of a kd-tree with median splits along the widest side."""
    parts = [np.arange(len(points))]
    while len(parts) < leaves:
        k = max(range(len(parts)), key=lambda i: len(parts[i]))
        rows = parts[k]
        if len(rows) < 2:
            break
        side = np.ptp(points[rows], axis=0).argmax()
        order = rows[np.argsort(points[rows, side], kind="stable")]
        parts[k : k + 1] = [order[: len(order) // 2], order[len(order) // 2 :]]
    return parts


class TopTree:
    """Splits (side, value, left, right) that deal projected points to numbered cells."""

    def __init__(self, points: np.ndarray, cells: int):
        self.nodes: list[list] = []
        self.cells = 0
        self._grow(points, cells)

    def _grow(self, points: np.ndarray, cells: int) -> int:
        """The number of the node: from 0 for a split, below 0 for a cell."""
        if cells <= 1 or len(points) < 2 or not np.ptp(points, axis=0).any():
            self.cells += 1
            return -self.cells
        side = int(np.ptp(points, axis=0).argmax())
        value = float(np.median(points[:, side]))
        left = points[:, side] < value
        if not left.any():
            value = float(points[points[:, side] > value, side].min())
            left = points[:, side] < value
        at = len(self.nodes)
        self.nodes.append([side, value, 0, 0])
        self.nodes[at][2] = self._grow(points[left], cells // 2)
        self.nodes[at][3] = self._grow(points[~left], cells - cells // 2)
        return at

    def cell_of(self, points: np.ndarray) -> np.ndarray:
        at = np.zeros(len(points), np.int64) if self.nodes else np.full(len(points), -1)
        while (open_ := np.flatnonzero(at >= 0)).size:
            node = np.array([self.nodes[i] for i in at[open_]])
            left = points[open_, node[:, 0].astype(int)] < node[:, 1]
            at[open_] = np.where(left, node[:, 2], node[:, 3]).astype(np.int64)
        return -at - 1


class Projection:
    """Vectors with the levelling coordinate, projected. ``top``: the largest squared length."""

    def __init__(self, dim: int, top: float, seed: int):
        self.matrix = np.random.default_rng(seed).standard_normal((dim + 1, PROJECTIONS))
        self.top = top

    def points(self, x: np.ndarray) -> np.ndarray:
        level = np.sqrt(np.maximum(self.top - (x * x).sum(axis=1), 0))
        return x @ self.matrix[:-1] + level[:, None] * self.matrix[-1]

    def queries(self, x: np.ndarray) -> np.ndarray:
        return x @ self.matrix[:-1]


def exact_scores(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of the rows, added up from the first component to the last."""
    return np.cumsum(x * y, axis=1)[:, -1]


class Found:
    """The k best (score, id) of each query so far."""

    def __init__(self, n: int, k: int):
        self.score, self.id = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)

    def add(self, q: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Candidates (score, id) for the queries ``q``, in any order."""
        k = self.score.shape[1]
        q, score, ids = np.concatenate([np.repeat(np.unique(q), k), q]), np.concatenate([self.score[np.unique(q)].ravel(), score]), np.concatenate([self.id[np.unique(q)].ravel(), ids])
        order = np.lexsort((ids, -score, q))
        q, score, ids = q[order], score[order], ids[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        keep = place < k
        self.score[q[keep], place[keep]], self.id[q[keep], place[keep]] = score[keep], ids[keep]


def search_block(x: np.ndarray, ids: np.ndarray, points: np.ndarray, q: np.ndarray, q_ids: np.ndarray, q_points: np.ndarray, bound: np.ndarray, top: float, k: int) -> Found:
    """The best of one block of vectors for each query. ``bound``: a score that k vectors elsewhere are known to reach."""
    leaves = split_tree(points, max(1, -(-len(points) // LEAF)))
    low, high = np.stack([points[r].min(axis=0) for r in leaves]), np.stack([points[r].max(axis=0) for r in leaves])
    gap = np.zeros((len(q), len(leaves)))
    for side in range(points.shape[1]):
        at = q_points[:, side, None]
        gap += np.maximum(np.maximum(low[:, side] - at, at - high[:, side]), 0) ** 2
    order = np.argsort(gap, axis=1, kind="stable")
    found, far, length = Found(len(q), k), chi_square_quantile(SURE, points.shape[1]), (q * q).sum(axis=1)
    slack = 1e-9 * (top + length)
    alive = np.arange(len(q))
    for turn in range(len(leaves)):
        least = np.maximum(found.score[alive, -1], bound[alive])
        reach = far * np.maximum(length[alive] + top - 2 * least, 0) + slack[alive]
        alive = alive[gap[alive, order[alive, turn]] <= reach]
        if not len(alive):
            break
        leaf = order[alive, turn]
        by = np.argsort(leaf, kind="stable")
        for part in np.split(by, np.flatnonzero(np.diff(leaf[by])) + 1):
            rows, who = leaves[leaf[part[0]]], alive[part]
            near = q[who] @ x[rows].T
            hit, col = np.nonzero(near >= (np.maximum(found.score[who, -1], bound[who]) - slack[who])[:, None])
            other = ids[rows[col]] != q_ids[who[hit]]
            hit, col = hit[other], col[other]
            if len(hit):
                found.add(who[hit], exact_scores(q[who[hit]], x[rows[col]]), ids[rows[col]])
    return found


def _prepared(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            keep, data, dims, lengths = [], [], [], []
            for i, v in enumerate(batch.column(1)):
                v = v.values if v.is_valid else None
                if v is None or len(v) == 0 or v.null_count:
                    continue
                x = v.to_numpy(zero_copy_only=False).astype(np.float64)
                size = float((x * x).sum())
                if np.isfinite(x).all() and x.any():
                    keep.append(i)
                    data.append(x.tobytes())
                    dims.append(len(x))
                    lengths.append(size)
            columns = [batch.column(0).take(pa.array(keep, pa.int64())), pa.array(data, pa.binary()), pa.array(dims, pa.int32()), pa.array(lengths, pa.float64())]
            return pa.RecordBatch.from_arrays(columns, names=["id", "x", "dim", "length"])

        return step

    return arrow_map(vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long"), vector_col), make, "id bigint, x binary, dim int, length double", 4096)


def _block_rows(rows: DataFrame, size: int, salts: int) -> DataFrame:
    """(cell, ids, xs, bounds): ``rows`` (cell, id, x, bound) put together, at most ``size`` of a cell in a row; a written table. The rows
    of a cell are dealt to ``salts`` tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, ids, xs, bounds = None, [], [], []

        def row() -> pa.RecordBatch:
            columns = [pa.array([cell], pa.int32()), *(pa.array([v], pa.binary()) for v in (np.array(ids, np.int64).tobytes(), b"".join(xs), np.array(bounds, np.float64).tobytes()))]
            return pa.RecordBatch.from_arrays(columns, names=["cell", "ids", "xs", "bounds"])

        for batch in batches:
            for c, i, x, b in zip(*(col.to_pylist() for col in batch.columns), strict=True):
                if ids and (c != cell or len(ids) >= size):
                    yield row()
                    ids, xs, bounds = [], [], []
                cell = c
                ids.append(i)
                xs.append(x)
                bounds.append(b)
        if ids:
            yield row()

    dealt = rows.select("cell", "id", "x", "bound").repartition("cell", F.pmod(F.xxhash64("id"), F.lit(salts))).sortWithinPartitions("cell")
    return materialize(dealt.mapInArrow(run, "cell int, ids binary, xs binary, bounds binary"), "blocks")


def _searched(index: DataFrame, asked: DataFrame, projection: Projection, top: float, k: int) -> DataFrame:
    """(query_id, id, score): the best of each block of vectors for each query that is dealt to its cell."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, near, scores = [], [], []
            for own, xs, who, qs, bounds in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own, who = np.frombuffer(own, np.int64), np.frombuffer(who, np.int64)
                x, q = np.frombuffer(xs).reshape(len(own), -1), np.frombuffer(qs).reshape(len(who), -1)
                found = search_block(x, own, projection.points(x), q, who, projection.queries(q), np.frombuffer(bounds), top, k)
                good = np.isfinite(found.score)
                ids.append(np.broadcast_to(who[:, None], good.shape)[good])
                near.append(found.id[good])
                scores.append(found.score[good])
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in (ids, near, scores)], names=["query_id", "id", "score"])

        return step

    queries = asked.select("cell", F.col("ids").alias("who"), F.col("xs").alias("qs"), F.col("bounds").alias("least"))
    return arrow_map(index.join(queries, "cell").select("ids", "xs", "who", "qs", "least"), make, "query_id bigint, id bigint, score double", 1)


def _boxes(index: DataFrame, projection: Projection) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cells, least and largest projections in each), of at most ``MOST_CELLS`` cells."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            points = [projection.points(np.frombuffer(xs).reshape(len(ids) // 8, -1)) for ids, xs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            sides = np.array([[*p.min(axis=0), *p.max(axis=0)] for p in points])
            return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in sides.T)], names=["cell", *names])

        return step

    names = [f"{side}{i}" for side in ("low", "high") for i in range(PROJECTIONS)]
    each = arrow_map(index.select("cell", "ids", "xs"), make, ", ".join(["cell int", *(f"{c} double" for c in names)]), 1)
    rows = each.groupBy("cell").agg(*(F.min(c).alias(c) for c in names[:PROJECTIONS]), *(F.max(c).alias(c) for c in names[PROJECTIONS:])).collect()
    sides = np.array([r[1:] for r in rows]).reshape(len(rows), 2 * PROJECTIONS)
    return np.array([r[0] for r in rows], np.int64), sides[:, :PROJECTIONS], sides[:, PROJECTIONS:]


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = 17, cell: int = CELL) -> DataFrame:
    """(query_id, rank, id, score): for each vector whose id is divisible by ``every``, the k others with the largest inner
    product found, all of them where there are fewer; best first, ties to the smaller id.

    Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do those of another dimension
    than the most frequent one, or with a null id. Repeated rows count once. Of equal vectors only the k + 1 smallest ids can
    be among the k nearest of any query, so only these are indexed. An empty table gives no rows; other columns aren't
    read.

    Queries are dealt to cells (of about ``cell`` vectors) like the vectors, and both meet there in blocks: first in each query's own cell, which
    gives the score that its k-th neighbour reaches at least, and then in the other cells that the chi-square test on a cell's bounds
    doesn't rule out for that score. So the index is read twice, however many queries there are, and nothing passes the driver but the top tree
    and the bounds of its cells.
    """
    spark = vectors.sparkSession
    every_row = materialize(_prepared(vectors, id_col, vector_col).distinct(), "vectors")
    dims = sorted(((r["count"], r["dim"]) for r in every_row.groupBy("dim").count().orderBy(F.desc("count"), F.desc("dim")).limit(1).collect()), reverse=True)
    schema = f"query_id bigint, rank int, `{id_col}` bigint, score double"
    if not dims:
        return spark.createDataFrame([], schema)
    dim = dims[0][1]
    rows = every_row.where(F.col("dim") == dim).select("id", "x", "length")
    top, n = rows.agg(F.max("length"), F.count(F.lit(1))).first()
    projection = Projection(dim, top, seed)
    held = rows.withColumn("nth", F.row_number().over(Window.partitionBy("x").orderBy("id"))).where(F.col("nth") <= k + 1).select("id", "x")
    sample = rows.select("x").where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < min(1.0, SAMPLE / n) * (1 << 20)).toArrow()["x"].to_pylist()
    tree = TopTree(projection.points(np.stack([np.frombuffer(x) for x in sample])) if sample else np.zeros((0, PROJECTIONS)), min(MOST_CELLS, max(1, n // cell)))
    salts = 1 + n // (cell * MOST_CELLS)

    def dealt(df: DataFrame, project) -> DataFrame:
        def make():
            def step(batch: pa.RecordBatch) -> pa.RecordBatch:
                x = np.stack([np.frombuffer(v) for v in batch.column(1).to_pylist()])
                return pa.RecordBatch.from_arrays([pa.array(tree.cell_of(project(x)).astype(np.int32)), batch.column(0), batch.column(1), pa.array(np.full(len(x), -np.inf))], names=["cell", "id", "x", "bound"])

            return step

        return arrow_map(df.select("id", "x"), make, "cell int, id bigint, x binary, bound double", 4096)

    index = _block_rows(dealt(held, projection.points), cell, salts)
    home = materialize(dealt(rows.where(F.col("id") % every == 0), projection.queries), "home")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id")))).where(F.col("rank") <= k)
    asked = _block_rows(home, QUERY_BLOCK, SALTS)
    first = materialize(ranked(_searched(index, asked, projection, top, k)), "first")
    if tree.cells == 1:
        discard(every_row, index, home, asked)
        return first.select("query_id", "rank", F.col("id").alias(id_col), "score")
    reached = first.groupBy(F.col("query_id").alias("id")).agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("found")).where(F.col("found") == k).select("id", "least")
    cells, low, high = _boxes(index, projection)
    far = chi_square_quantile(SURE, PROJECTIONS)

    def others():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            q, bound = np.stack([np.frombuffer(v) for v in batch.column(2).to_pylist()]), batch.column(3).to_numpy()
            points, length, gap = projection.queries(q), (q * q).sum(axis=1), np.zeros((len(q), len(cells)))
            for side in range(PROJECTIONS):
                at = points[:, side, None]
                gap += np.maximum(np.maximum(low[:, side] - at, at - high[:, side]), 0) ** 2
            reach = far * np.maximum(length + top - 2 * bound, 0) + 1e-9 * (top + length)
            who, other = np.nonzero((gap <= reach[:, None]) & (cells != batch.column(0).to_numpy()[:, None]))
            take = pa.array(who)
            return pa.RecordBatch.from_arrays([pa.array(cells[other].astype(np.int32)), *(batch.column(i).take(take) for i in (1, 2, 3))], names=["cell", "id", "x", "bound"])

        return step

    bounded = home.drop("bound").join(reached, "id", "left").select("cell", "id", "x", F.coalesce("least", F.lit(float("-inf"))).alias("bound"))
    more = _block_rows(arrow_map(bounded, others, "cell int, id bigint, x binary, bound double", 256), QUERY_BLOCK, SALTS)
    every_one = materialize(first.drop("rank").unionByName(_searched(index, more, projection, top, k)), "found")
    discard(every_row, index, home, asked, first, more)
    return ranked(every_one).select("query_id", "rank", F.col("id").alias(id_col), "score")
