"""Helpers shared by the training-data operators: written tables, bounded batches, bounded sampling."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrygraph.sources.shared import discard, free_names, materialize, shared_dir  # noqa: F401

#: Rows, and bytes of their columns, that a step works on at a time: what comes in larger batches is cut up.
BATCH_ROWS, BATCH_BYTES = 256, 4 << 20


def cut_batches(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most ``rows`` rows and about ``size`` bytes; a longer row makes a piece of its own.

    Spark itself fills a batch with no more than spark.sql.execution.arrow.maxBytesPerBatch (64 MB unless set), so both sides
    hold a bounded number of bytes without any setting of ours in the session."""
    for batch in batches:
        at, weight = 0, _row_bytes(batch)
        ends = np.cumsum(weight)
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            n = int(np.searchsorted(ends, done + size, "right")) - at
            n = max(1, min(n, rows, batch.num_rows - at))
            yield batch.slice(at, n)
            at += n


def _row_bytes(batch: pa.RecordBatch) -> np.ndarray:
    """Bytes of the strings and binaries of each row."""
    total = np.full(batch.num_rows, 8, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
            total += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    return total


def arrow_map(
    df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema, rows: int = BATCH_ROWS
) -> DataFrame:
    """``mapInArrow`` with a function made once per task by ``make``; it turns a batch of bounded size into a batch or None."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = None
        for batch in cut_batches(batches, rows):
            if step is None:
                step = make()
            out = step(batch)
            if out is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``: the fold of a row."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def labelled_pieces(
    rows: DataFrame, label: str, per_class: int, cut: Callable[[str, int], list[str]], text_col: str = "text", docs: DataFrame | None = None, id_col: str = "doc_id"
) -> list[tuple[int, object, list[str]]]:
    """(hash of the text, label, pieces of the text) of a bounded sample of labelled rows, in order of the hash.

    About ``per_class`` rows of each label are taken (all of them where there are fewer), by the hash of the text, or of the
    id where ``rows`` has ids and labels only and the texts are those of ``docs``;
    ``cut(text, hash)`` gives their pieces, a bounded number of bounded length. Copies of a text count once, with the largest
    of their labels, and are put together before anything reaches the driver. At most 1,000 labels are accepted.
    """
    own = [] if docs is not None else [F.col(text_col).alias("text")]
    rows = rows.where(F.col(label).isNotNull()).select(F.col(label).alias("label"), *own, *([F.col(id_col).alias("_id")] if docs is not None else []))
    if docs is not None:  # a row for each id, with the largest of its labels, so that what is broadcast is bounded
        rows = rows.groupBy("_id").agg(F.max("label").alias("label"))
    counts = rows.groupBy("label").count().limit(1001).collect()
    if len(counts) > 1000:
        raise ValueError(f"{label} has over 1,000 values")
    if not counts:
        return []
    share = F.coalesce(*(F.when(F.col("label") == r["label"], F.lit(min(1.0, per_class / r["count"]))) for r in counts))
    chosen = lambda of: F.pmod(F.xxhash64(of), F.lit(1 << 20)) / float(1 << 20) < share
    if docs is None:
        sample = rows.where(chosen("text"))
    else:  # about per_class short rows of each label: small enough for a broadcast, so no text is shuffled
        sample = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(rows.where(chosen("_id"))), "_id")
    sample = sample.where("text is not null").select(F.xxhash64("text").alias("hash"), "label", "text")

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            pieces = [cut(text, h) for h, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pieces, pa.list_(pa.string()))], names=["hash", "label", "pieces"])

        return step

    kind = sample.schema["label"].dataType.simpleString()
    cut_rows = arrow_map(sample, make, f"hash bigint, label {kind}, pieces array<string>")
    one = cut_rows.groupBy("hash").agg(F.max(F.struct("label", "pieces")).alias("x")).select("hash", "x.*")
    return sorted((r["hash"], r["label"], r["pieces"]) for r in one.collect())


def word_windows(text: str, size: int, most: int, seed: int) -> list[str]:
    """At most ``most`` of the text's successive windows of ``size`` words, evenly spread from a seeded beginning."""
    words = text.split()
    starts = range(0, max(len(words), 1), size)
    if len(starts) > most:
        step = len(starts) / most
        shift = (seed % 997) / 997 * step
        starts = [starts[int(shift + k * step) % len(starts)] for k in range(most)]
    return [" ".join(words[i : i + size]) for i in starts]


def streamed_sha256(df: DataFrame, key: list[str], order: list[Column | str], text: str, out: str, joint: str = "") -> DataFrame:
    """(key, out): the hex SHA-256 of the texts of each key in ``order``, ``joint`` between them. A key's rows pass through one task, as
    the digest needs them one after the other, but none is held. Null texts are left out."""
    from hashlib import sha256

    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = to_arrow_schema(df.select(*key).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, any_ = None, None, False
        for batch in cut_batches(batches, 4096):
            rows = []
            for *own, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != at:
                    if at is not None:
                        rows.append((*at, state.hexdigest()))
                    at, state, any_ = own, sha256(), False
                if value is not None:
                    if any_:
                        state.update(joint.encode())
                    state.update(value.encode("utf-8", "surrogatepass"))
                    any_ = True
            yield _keyed(rows)
        yield _keyed([(*at, state.hexdigest())] if at is not None else [])

    def _keyed(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [[]] * (len(kinds) + 1)
        return pa.RecordBatch.from_arrays([*(pa.array(c, f.type) for c, f in zip(columns, kinds)), pa.array(columns[-1], pa.string())], names=[*key, out])  # noqa: B905

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*key).schema), f"{out} string"])
    return df.repartition(*key).sortWithinPartitions(*key, *order).select(*key, text).mapInArrow(run, schema)
