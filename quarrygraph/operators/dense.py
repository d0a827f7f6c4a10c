"""Exact searches of many queries over many vectors as products of blocks.

Both sides are packed into blocks of some hundred KB, and the blocks dealt to groups; each group of queries meets each group of vectors in one
task, which holds its queries and their best rows so far and lets the vectors' blocks pass. A product in single precision leaves out what
can't be among the best (its error has a bound); what is left is scored in double precision, each pair in the same way, so equal vectors tie."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrygraph.sources.shared import materialize

#: Bytes of a block's vectors, of a group's at most, of vectors that wait to be packed; queries and pairs that are scored at once; pairs that wait to be ranked.
BLOCK_BYTES, GROUP_BYTES, WAITING_BYTES, QUERY_ROWS, PAIR_ROWS, WAITING_PAIRS = 1 << 19, 1 << 25, 1 << 25, 2048, 1 << 15, 1 << 18
#: Below every cosine.
NONE = -1.5


def units(column: pa.Array, dim: int | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """(numbers of the usable rows, their vectors at length one), for each dimension there is or just for ``dim``. Null vectors, and
    those that are empty, zero or hold null or non-finite values, are left out."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    begins, out = np.cumsum(sizes) - sizes, []
    for d in [dim] if dim is not None else np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == d)
        x = values.reshape(-1, d) if d and len(rows) * d == len(values) else values[begins[rows][:, None] + np.arange(d)]
        with np.errstate(over="ignore", invalid="ignore"):
            length = np.sqrt((x * x).sum(axis=1))
        good = np.isfinite(length) & (length > 0)
        out.append((rows[good], x[good] / length[good][:, None]))
    return out


def packed(df: DataFrame, label: str, extra: Callable[[pa.RecordBatch], np.ndarray] | None = None) -> DataFrame:
    """(no, dim, cell, ids, x, extra) of blocks of ``df`` (id, vector, cell, ...), written: usable vectors at length one, of one dimension and
    cell in each block. ``extra`` gives an array of a batch, whose rows are kept beside the vectors."""
    key = df.schema[0].dataType.simpleString()
    kind = df.schema[0].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        ids_type = to_arrow_type(kind)
        waiting: dict[tuple[int, int], list] = {}
        size = 0

        def block(at: tuple[int, int]) -> pa.RecordBatch:
            parts = waiting.pop(at)
            ids = pa.concat_arrays([p[0] for p in parts]).cast(ids_type)
            x, more = (np.concatenate([p[i] for p in parts]) for i in (1, 2))
            step = max(1, BLOCK_BYTES // (8 * at[0]))
            cuts = range(0, len(ids), step)
            lists = pa.ListArray.from_arrays(pa.array([*cuts, len(ids)], pa.int32()), ids)
            return pa.RecordBatch.from_arrays(
                [pa.array([at[0]] * len(cuts), pa.int32()), pa.array([at[1]] * len(cuts), pa.int32()), lists, pa.array([x[a : a + step].tobytes() for a in cuts], pa.binary()), pa.array([more[a : a + step].tobytes() for a in cuts], pa.binary())],
                names=["dim", "cell", "ids", "x", "extra"])

        for batch in batches:
            cells = batch.column(2).to_numpy(zero_copy_only=False)
            beside = extra(batch) if extra else np.zeros((batch.num_rows, 0))
            for rows, x in units(batch.column(1)):
                for cell in np.unique(cells[rows]).tolist():
                    of = np.flatnonzero(cells[rows] == cell)
                    at = (x.shape[1], int(cell))
                    waiting.setdefault(at, []).append((batch.column(0).take(pa.array(rows[of])), x[of], beside[rows[of]]))
                    size += x[of].nbytes
                    if sum(p[1].nbytes for p in waiting[at]) >= BLOCK_BYTES:
                        size -= sum(p[1].nbytes for p in waiting[at])
                        yield block(at)
            if size > WAITING_BYTES:
                for at in list(waiting):
                    yield block(at)
                size = 0
        for at in list(waiting):
            yield block(at)

    found = df.where(F.col(df.columns[0]).isNotNull() & F.col(df.columns[1]).isNotNull()).mapInArrow(run, f"dim int, cell int, ids array<{key}>, x binary, extra binary")
    # numbers that follow each other within a partition, and over partitions of one block
    no = F.monotonically_increasing_id()
    return materialize(found.withColumn("no", F.shiftright(no, 33) + no.bitwiseAND(F.lit((1 << 33) - 1))), label)


def _ranks(ids: np.ndarray) -> np.ndarray:
    return ids if ids.dtype != object else np.unique(ids, return_inverse=True)[1]


class _Best:
    """The best ``k`` rows so far of some queries of one dimension. ``bound``: what the k-th of each reaches at least."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, extra: np.ndarray, k: int, least: float):
        self.ids, self.x, self.extra, self.k = ids, x, extra, k
        self.single = x.astype(np.float32)
        self.bound = np.full(len(ids), least)
        self.eps = (x.shape[1] + 8) * 2.0**-23
        self.waiting: list[tuple] = []
        self.found: tuple | None = None
        self.size = 0

    def meet(self, rows: np.ndarray, ids: np.ndarray, x: np.ndarray, itself: bool, allowed: Callable[[np.ndarray], np.ndarray] | None) -> None:
        single = np.ascontiguousarray(x.astype(np.float32).T)
        order = None if itself else np.argsort(ids, kind="stable")
        for a in range(0, len(rows), QUERY_ROWS):
            at = rows[a : a + QUERY_ROWS]
            near = self.single[at] @ single
            if allowed is not None:
                near[~allowed(at)] = -np.inf
            if order is not None:  # the rows of a query's own id
                low, high = (np.searchsorted(ids, self.ids[at], side, sorter=order) for side in ("left", "right"))
                for i in np.flatnonzero(high > low).tolist():
                    near[i, order[low[i] : high[i]]] = -np.inf
            hit = near >= (self.bound[at] - self.eps)[:, None].astype(np.float32)
            if near.shape[1] > self.k and np.count_nonzero(hit) > 4 * self.k * len(at):
                reached = np.partition(near, near.shape[1] - self.k, axis=1)[:, near.shape[1] - self.k].astype(np.float64)
                self.bound[at] = np.maximum(self.bound[at], reached - self.eps)
                hit = near >= (self.bound[at] - self.eps)[:, None].astype(np.float32)
            places = np.flatnonzero(hit)
            for b in range(0, len(places), PAIR_ROWS):
                i, j = np.divmod(places[b : b + PAIR_ROWS], near.shape[1])
                i = at[i]
                score = (self.x[i] * x[j]).sum(axis=1)
                keep = score >= self.bound[i]
                self.waiting.append((i[keep], score[keep], ids[j[keep]]))
                self.size += int(keep.sum())
                if self.size > WAITING_PAIRS + (len(self.found[0]) // 2 if self.found else 0):
                    self.settle()

    def settle(self) -> None:
        parts = ([self.found] if self.found else []) + self.waiting
        self.waiting, self.size = [], 0
        if not parts:
            return
        q, score, ids = (np.concatenate([p[i] for p in parts]) for i in range(3))
        order = np.lexsort((_ranks(ids), -score, q))
        q, score, ids = q[order], score[order], ids[order]
        nth = np.arange(len(q)) - np.searchsorted(q, q)
        last = nth == self.k - 1
        self.bound[q[last]] = np.maximum(self.bound[q[last]], score[last])
        keep = nth < self.k
        self.found = q[keep], score[keep], ids[keep]


def best_rows(
    queries: DataFrame, vectors: DataFrame, k: int, least: float = NONE, itself: bool = False,
    may_meet: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None, allowed: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None,
) -> DataFrame:
    """(query_id, rank, id, score): the ``k`` best rows of each query with a score from ``least``, ties to the smaller id; all rows but those of its own
    id, or those too (``itself``). Both sides are :func:`packed`, and are read no more when this returns.

    ``may_meet`` gives, of the queries' vectors and extras, a (queries, cells) table of the cells that each has to look into. ``allowed`` gives, of
    some queries' extras and a block's, a (queries, rows) table of the pairs that count."""
    spark = queries.sparkSession
    query_key, key = (df.schema["ids"].dataType.elementType for df in (queries, vectors))
    count = lambda df: df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("x")), F.lit(0))).first()
    (asked, asked_bytes), (held, held_bytes) = count(queries), count(vectors)
    across = max(1, -(-asked_bytes // GROUP_BYTES))
    # enough groups for all cores, and none much over the bytes of one
    down = max(1, -(-held_bytes // GROUP_BYTES), min(held, -(-2 * spark.sparkContext.defaultParallelism // across)))

    def groups(df: DataFrame, own: int, other: int, side: int) -> DataFrame:
        dealt = df.withColumn("own", F.pmod("no", F.lit(own))).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(other - 1))))
        task = F.col("own") * down + F.col("other") if side == 0 else F.col("other") * down + F.col("own")
        ids = [F.col("ids") if side == n else F.lit(None).cast(f"array<{kind.simpleString()}>") for n, kind in enumerate((query_key, key))]
        return dealt.select(task.cast("int").alias("task"), F.lit(side).alias("side"), "dim", "cell", ids[0].alias("asked"), ids[1].alias("held"), "x", "extra")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, waiting, ready = None, {}, {}

        def numbers(ids: pa.Array) -> np.ndarray:
            return ids.to_numpy(zero_copy_only=False) if pa.types.is_integer(ids.type) else np.array(ids.to_pylist(), object)

        def rows_of(best: _Best) -> pa.RecordBatch:
            best.settle()
            q, score, ids = best.found or (np.zeros(0, np.int64), np.zeros(0), best.ids[:0])
            return pa.RecordBatch.from_arrays([pa.array(best.ids[q].tolist(), out[0]), pa.array(ids.tolist(), out[1]), pa.array(score, pa.float64())], names=["query_id", "id", "score"])

        def prepared(dim: int) -> tuple | None:
            if dim not in ready:
                blocks = waiting.pop(dim, None)
                if blocks is None:
                    return None
                ids, x, extra = (np.concatenate([b[i] for b in blocks]) for i in range(3))
                best = _Best(ids, x, extra, k, least)
                looks = None
                if may_meet is not None:  # as bits: a row of them for each query
                    looks = np.concatenate([np.packbits(may_meet(x[a : a + QUERY_ROWS], extra[a : a + QUERY_ROWS]), axis=1, bitorder="little") for a in range(0, len(ids), QUERY_ROWS)])
                ready[dim] = best, looks
            return ready[dim]

        for batch in batches:
            for r in range(batch.num_rows):
                now, side, dim, cell = (batch.column(i)[r].as_py() for i in range(4))
                if now != task:
                    for best, _ in ready.values():
                        yield rows_of(best)
                    task, waiting, ready = now, {}, {}
                ids = numbers(batch.column(4 + side)[r].values)
                x = np.frombuffer(batch.column(6)[r].as_buffer()).reshape(-1, dim)
                extra = np.frombuffer(batch.column(7)[r].as_py()).reshape(len(ids), -1)
                if side == 0:
                    waiting.setdefault(dim, []).append((ids, x, extra))
                    continue
                found = prepared(dim)
                if found is None:
                    continue
                best, looks = found
                rows = np.arange(len(best.ids)) if looks is None else np.flatnonzero(looks[:, cell >> 3] >> (cell & 7) & 1)
                best.meet(rows, ids, x, itself, None if allowed is None else lambda at, best=best, extra=extra: allowed(best.extra[at], extra))
        for best, _ in ready.values():
            yield rows_of(best)

    from pyspark.sql.pandas.types import to_arrow_type

    out = to_arrow_type(query_key), to_arrow_type(key)
    both = groups(queries, across, down, 0).unionByName(groups(vectors, down, across, 1))
    met = both.repartitionById(across * down, "task").sortWithinPartitions("task", "side").mapInArrow(run, f"query_id {query_key.simpleString()}, id {key.simpleString()}, score double")
    some = materialize(met, "met")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return some.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
