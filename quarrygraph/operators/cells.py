"""Search by cosine over an inverted file of cells: a table of vectors dealt to the nearest of some centres, probed by bounds.

The angle is a metric, so a vector of a cell is no nearer to a query than the angle between query and centre less the cell's radius.
Searches above a threshold, and exact ones for the nearest, therefore only read the cells that this bound doesn't rule out;
approximate ones read a number of the nearest cells that hold a wanted type. Queries and vectors meet by a join on the cell."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrygraph.operators import dense
from quarrygraph.operators.vector import dot
from quarrygraph.sources.shared import discard, materialize

#: Vectors that the centres are fitted on, at most about; rounds of fitting; cells at most; rounding of angles; tasks that a cell is dealt to.
SAMPLE, ROUNDS, MOST_CELLS, SLACK, PARTS = 16_384, 12, 4096, 1e-7, 16


@dataclass
class CellIndex:
    """``rows``: (id, unit, cell, angle, type) of every usable vector; ``centres``: unit vectors; ``cells``: numbers of those that hold
    vectors, with ``radius`` (the largest angle) and ``types`` of each."""

    rows: DataFrame
    centres: np.ndarray
    cells: np.ndarray
    radius: np.ndarray
    types: list[set]


def _units(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of the usable rows, their vectors at length one)."""
    return dense.units(column, dim)[0]


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel(), pa.float64()))


def fit_centres(vectors: DataFrame, cells: int, vector_col: str = "embedding", seed: int = 5) -> np.ndarray:
    """At most ``cells`` centres by spherical k-means on a sample of about ``SAMPLE`` vectors, chosen by their hash. The most frequent
    dimension counts. No usable vectors: no centres."""
    usable = vectors.where(F.col(vector_col).isNotNull() & (F.size(vector_col) > 0))
    sizes = usable.groupBy(F.size(vector_col).alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()
    if not sizes:
        return np.zeros((0, 0))
    dim, n = sizes[0]["dim"], sizes[0]["n"]
    part = usable.where((F.size(vector_col) == dim) & (F.pmod(F.xxhash64(vector_col), F.lit(1 << 20)) < min(1.0, SAMPLE / n) * (1 << 20)))
    _, x = _units(part.select(vector_col).toArrow()[vector_col].combine_chunks(), dim)
    rng = np.random.default_rng(seed)
    x = x[np.lexsort(x.T)] if len(x) else x  # whatever order the rows came in
    centres = x[rng.permutation(len(x))[: min(cells, MOST_CELLS)]]
    for _ in range(ROUNDS):
        of = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, of, x)
        size = np.sqrt((sums * sums).sum(axis=1))
        centres = np.where(size[:, None] > 1e-9, sums / np.maximum(size, 1e-9)[:, None], centres)
    return centres


def build_index(vectors: DataFrame, centres: np.ndarray, id_col: str = "vec_id", vector_col: str = "embedding", type_col: str = "label") -> CellIndex:
    """Every vector of the centres' dimension in its cell; null ones, and those that are zero or hold null or non-finite values, are left out."""
    key, kind = vectors.schema[id_col].dataType.simpleString(), vectors.schema[type_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, x = _units(batch.column(1), centres.shape[1])
            near = x @ centres.T
            of = near.argmax(axis=1)
            angle = np.arccos(np.clip(near[np.arange(len(keep)), of], -1, 1))
            take = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), _lists(x), pa.array(of, pa.int32()), pa.array(angle), batch.column(2).take(take)], names=["id", "unit", "cell", "angle", "type"])

    schema = f"id {key}, unit array<double>, cell int, angle double, type {kind}"
    if not len(centres):
        return CellIndex(vectors.sparkSession.createDataFrame([], schema), centres, np.zeros(0, int), np.zeros(0), [])
    rows = materialize(vectors.select(id_col, vector_col, type_col).mapInArrow(run, schema).repartition("cell", F.pmod(F.xxhash64("id"), F.lit(PARTS))).sortWithinPartitions("cell"), "cells")
    about = rows.groupBy("cell").agg(F.max("angle").alias("radius"), F.collect_set("type").alias("types")).orderBy("cell").collect()  # a row for each cell
    return CellIndex(rows, centres, np.array([r["cell"] for r in about], int), np.array([r["radius"] for r in about]), [set(r["types"]) for r in about])


def _probes(index: CellIndex, queries: DataFrame, probes: int | None, types: Sequence | None) -> DataFrame:
    """(query_id, query, cell) of the cells to read: those within ``reach`` of a query, or the ``probes`` nearest. ``queries``: (query_id, query, reach)."""
    chosen = np.array([i for i, held in enumerate(index.types) if types is None or held & set(types)], int)
    numbers, radius, centres, dim = index.cells[chosen], index.radius[chosen], index.centres[index.cells[chosen]], index.centres.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, x = _units(batch.column(1), dim)
            away = np.arccos(np.clip(x @ centres.T, -1, 1))
            if probes is None:
                who, cell = np.nonzero(away - radius <= batch.column(2).to_numpy()[keep][:, None] + SLACK)
            else:
                cell = np.argsort(away, axis=1, kind="stable")[:, :probes]
                who, cell = np.repeat(np.arange(len(cell)), cell.shape[1]), cell.ravel()
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep[who], pa.int64())), _lists(x[who]), pa.array(numbers[cell].astype(np.int32))], names=["query_id", "query", "cell"])

    key = queries.schema["query_id"].dataType.simpleString()
    return queries.select("query_id", "query", "reach").mapInArrow(run, f"query_id {key}, query array<double>, cell int")


def _scored(index: CellIndex, asked: DataFrame, types: Sequence | None, itself: bool) -> DataFrame:
    rows = index.rows if types is None else index.rows.where(F.col("type").isin(*types))
    pairs = asked.join(rows.select("cell", "id", "unit"), "cell")
    return (pairs if itself else pairs.where(F.col("id") != F.col("query_id"))).select("query_id", "id", dot(F.col("unit"), F.col("query")).alias("score"))


def _ranked(scored: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def _asked(queries: DataFrame, reach: Column) -> DataFrame:
    return queries.select("query_id", F.col("query").cast("array<double>").alias("query"), reach.cast("double").alias("reach"))


def _blocks(index: CellIndex, types: Sequence | None) -> DataFrame:
    rows = index.rows if types is None else index.rows.where(F.col("type").isin(*types))
    return dense.packed(rows.select("id", "unit", "cell"), "cell-blocks")


def _exact(index: CellIndex, asked: DataFrame, blocks: DataFrame, types: Sequence | None, k: int, least: float, itself: bool) -> DataFrame:
    """:func:`_ranked` rows of ``asked`` (query_id, query, reach), by products of blocks: each query meets the vectors of the cells within its reach,
    or of the nearest one that holds any where that is null."""
    centres, radius, dim = index.centres, np.full(len(index.centres), -np.inf), index.centres.shape[1]
    held = np.array([types is None or bool(kinds & set(types)) for kinds in index.types])
    radius[index.cells[held]] = index.radius[held]
    usable = asked.where(F.size("query") == dim).select("query_id", "query", F.lit(0).alias("cell"), "reach")
    queries = dense.packed(usable, "asked", lambda batch: batch.column(3).to_numpy(zero_copy_only=False).astype(np.float64)[:, None])

    def within(x: np.ndarray, reach: np.ndarray) -> np.ndarray:
        away = np.arccos(np.clip(x @ centres.T, -1, 1))
        nearest_of = np.where(np.isfinite(radius), away, np.inf).argmin(axis=1)
        return np.where(np.isnan(reach), np.arange(len(radius)) == nearest_of[:, None], away - radius <= reach + SLACK)

    found = dense.best_rows(queries, blocks, k, least, itself, within)
    discard(queries)
    return found


def above_threshold(index: CellIndex, queries: DataFrame, threshold: float = 0.85, limit: int = 5, itself: bool = False) -> DataFrame:
    """(query_id, rank, id, score): of each of the ``queries`` (query_id, query) the ``limit`` best rows with a cosine from ``threshold``; exact, ties to
    the smaller id. Only the cells are read that can hold such rows. Unusable queries have no rows; ``itself``: a row may have its query's id."""
    if not len(index.cells):
        return nearest(index, queries, limit, 1, None, itself)
    blocks = _blocks(index, None)
    found = _exact(index, _asked(queries, F.lit(float(np.arccos(np.clip(threshold, -1, 1))))), blocks, None, limit, threshold, itself)
    discard(blocks)
    return found


def nearest(index: CellIndex, queries: DataFrame, k: int, probes: int | None = None, types: Sequence | None = None, itself: bool = False) -> DataFrame:
    """(query_id, rank, id, score): the k best rows of each query, of the given types only.

    With ``probes``, those in as many nearest cells that hold a wanted type: approximate. Without, exact: the nearest of these cells
    gives the score that the k-th row reaches at least, and then all cells that can hold a better one are read."""
    if probes is not None or not len(index.cells):
        return _ranked(_scored(index, _probes(index, _asked(queries, F.lit(0.0)), probes or 1, types), types, itself), k)
    blocks = _blocks(index, types)
    first = _exact(index, _asked(queries, F.lit(None)), blocks, types, k, dense.NONE, itself)
    least = first.groupBy("query_id").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n")).where(F.col("n") == k)
    # least and greatest leave nulls out
    reach = F.when(F.col("least").isNull(), F.lit(float(np.pi))).otherwise(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("least")))))
    bounded = materialize(_asked(queries.join(least, "query_id", "left"), reach), "reach")
    found = _exact(index, bounded, blocks, types, k, dense.NONE, itself)
    discard(blocks, bounded)
    return found
