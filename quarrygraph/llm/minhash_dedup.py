"""Near duplicates by HyperMinHash: compressed registers, banded, with an estimate before exact verification.

Documents with equal shingle sets form a class. A class's shingles, hashed to 64 bits, fall into ``REGISTERS`` buckets by their first
bits; of each bucket's least hash, the register keeps how many zeros lead and the ``MANTISSA`` bits behind the first one. A bucket
without a shingle takes the register of the first filled one in an order of its own, so that small sets have all registers too,
each of which two sets share with a probability of their Jaccard similarity.

Classes that share a band of ``ROWS`` registers meet in a list. At 0.8, the ``BANDS`` bands miss a pair with a probability of
(1 - 0.8**4)**32, 5e-8; at 0.9, 2e-15. Lists of a few classes are turned into pairs. Before a pair's sets are read, its similarity is
estimated from the registers, corrected for those that are equal by their compression only; a pair goes if the estimate is six
standard deviations below the threshold. What is left is verified on the full sets.

Longer lists are those of groups of copies. They aren't turned into pairs: their classes are compared with the list's pivot, a class
with much company, in a group of near copies its centre. Two classes that are linked with each other, but not both with the
pivot, share elements of their differences from it; such pairs are found by these elements, as in :mod:`jaccard_join`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrygraph.llm.common import arrow_map, cut_batches, discard, materialize
from quarrygraph.llm.components import connected_components
from quarrygraph.llm.jaccard_join import CHUNK, HANDED_ON, Order, compare, components_of, difference_lists, frequent_shingles, links_of, sets_of, verified
from quarrygraph.llm.shingles import digest, mix, shingle_sets

#: Registers of a sketch, bits of their mantissas, and the bands they form.
REGISTERS, MANTISSA, BANDS, ROWS = 128, 10, 32, 4
#: Fixed value of the HyperMinHash paper: accidental collisions of registers are this times 2**-MANTISSA, for sets of one size.
COLLISIONS = 0.169919487159739
#: Standard deviations below the threshold at which an estimate rules a pair out.
DEVIATIONS = 6
#: Lists of up to so many classes are turned into pairs; the others get a pivot.
LONGEST = 4
_BITS = REGISTERS.bit_length() - 1
_BOUNDS = np.arange(REGISTERS, dtype=np.uint64) << np.uint64(64 - _BITS)
#: For each register, all registers in an order of its own.
_ORDER = np.argsort(mix(np.arange(REGISTERS * REGISTERS, dtype=np.uint64), 23).reshape(REGISTERS, REGISTERS), axis=1)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """The registers of a set of sorted hashes that isn't empty."""
    first = np.searchsorted(shingles, _BOUNDS)
    least = shingles[np.minimum(first, len(shingles) - 1)]
    filled = (first < len(shingles)) & (least >> np.uint64(64 - _BITS) == np.arange(REGISTERS, dtype=np.uint64))
    # at most 52 bits, so that a double holds them exactly
    part, exponent = np.frexp(((least << np.uint64(_BITS)) >> np.uint64(12)).astype(np.float64))
    zeros = np.where(part > 0, 52 - exponent, 53)
    register = (zeros << MANTISSA | np.maximum((part * 2 - 1) * (1 << MANTISSA), 0).astype(np.int64)).astype("<u2")
    empty = np.flatnonzero(~filled)
    if len(empty):
        order = _ORDER[empty]
        register[empty] = register[order[np.arange(len(empty)), filled[order].argmax(axis=1)]]
    return register


def band_keys(registers: np.ndarray) -> np.ndarray:
    """A hash of each band of each sketch (sketch, register)."""
    bands = registers.reshape(len(registers), BANDS, ROWS).astype(np.uint64)
    h = np.broadcast_to(mix(np.arange(BANDS, dtype=np.uint64), 29), bands.shape[:2])
    for i in range(ROWS):
        h = mix(h * np.uint64(0xD6E8FEB86659FD93) + bands[:, :, i], i)
    return h


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Jaccard similarities from registers (pair, register) and set sizes, without the share of accidental collisions."""
    chance = COLLISIONS * 2.0**-MANTISSA * 4 * na * nb / (na + nb) ** 2
    return ((a == b).mean(axis=1) - chance) / (1 - chance)


def ruled_out(similarity: np.ndarray, n: np.ndarray, percent: int) -> np.ndarray:
    """Whether an estimate is too low for a pair whose smaller set has ``n`` shingles: few shingles fill few registers, and the
    others only repeat them."""
    filled = REGISTERS * (1 - (1 - 1 / REGISTERS) ** n)
    p = percent / 100
    return similarity < p - DEVIATIONS * np.sqrt(p * (1 - p) * (1 / filled + 1 / REGISTERS))


def _sketched(docs: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """(id, text_hash, cls, n, sketch) per document row; the sketch once per task and class."""
    id_type = docs.schema[id_col].dataType

    def make():
        known: set[bytes] = set()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            cls, n, sketches = [], [], []
            for s in shingle_sets([t or "" for t in batch.column(1).to_pylist()], k):
                key = digest(s) if len(s) else None
                new = key is not None and key not in known
                if new and len(known) < 1_000_000:
                    known.add(key)
                cls.append(key)
                n.append(len(s))
                sketches.append(sketch(s).tobytes() if new else None)
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(cls, pa.binary()), pa.array(n, pa.int64()), pa.array(sketches, pa.binary())], names=["_id", "text_hash", "cls", "n", "sketch"])

        return step

    named = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))
    return arrow_map(named, make, f"_id {id_type.simpleString()}, text_hash bigint, cls binary, n bigint, sketch binary")


def _registers(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(len(column), REGISTERS)


def _banded(sketches: DataFrame) -> DataFrame:
    """(key, cls, n) of every band."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            keys = band_keys(_registers(batch.column(2)))
            of = pa.array(np.repeat(np.arange(len(keys)), BANDS))
            return pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), batch.column(0).take(of), batch.column(1).take(of)], names=["key", "cls", "n"])

        return step

    return arrow_map(sketches.select("cls", F.col("n").cast("int").alias("n"), "sketch"), make, "key bigint, cls binary, n int", 1024)


def _lists(sketches: DataFrame) -> DataFrame:
    """(key, cls, n, size, company) of the classes that share a band with others: of how many, and how many they meet in all; a written table."""
    banded = materialize(_banded(sketches), "banded")
    # written before the join: a side that is an aggregate keeps Spark from splitting the other side's long lists
    several = materialize(banded.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "several")
    members = materialize(banded.join(several, "key"), "members")
    # a class has a row for each of its bands at most
    out = materialize(members.select("key", "cls", "n", "size", F.sum("size").over(Window.partitionBy("cls")).alias("company")), "lists")
    discard(banded, several, members)
    return out


def _counted(sets: DataFrame) -> DataFrame:
    """(shingle, n): shingles that several classes of a chunk hold, with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def frequent() -> pa.RecordBatch:
            hashes, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            return pa.RecordBatch.from_arrays([pa.array(hashes[n >= HANDED_ON].view(np.int64)), pa.array(n[n >= HANDED_ON])], names=["shingle", "n"])

        for batch in cut_batches(batches):
            for x in batch.column(0):
                held.append(np.frombuffer(x.as_buffer(), np.uint64))
                size += len(held[-1])
            if size > CHUNK:
                yield frequent()
                held, size = [], 0
        yield frequent()

    return sets.select("hashes").mapInArrow(run, "shingle bigint, n bigint")


def _linked(pairs: DataFrame, sketches: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are links: those whose estimate isn't too low, verified on full sets; a written table."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            na, nb = (batch.column(i).to_numpy().astype(np.float64) for i in (3, 5))
            near = estimate(_registers(batch.column(2)), _registers(batch.column(4)), na, nb)
            return batch.filter(pa.array(~ruled_out(near, np.minimum(na, nb), percent))).select([0, 1])

        return step

    of = lambda side: sketches.select(F.col("cls").alias(side), F.col("sketch").alias(f"s{side}"), F.col("n").alias(f"n{side}"))
    held = pairs.join(of("b"), "b").join(of("a"), "a").where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
    near = materialize(arrow_map(held.select("a", "b", "sa", "na", "sb", "nb"), make, "a binary, b binary", 1024), "near")
    out = materialize(verified(near, sets, percent), "links")
    discard(near)
    return out


def _labels(docs: DataFrame, rows: DataFrame, sketches: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(node, label) of the classes that have links; a written table."""
    every = _lists(sketches)
    sets = sets_of(every.select("cls").distinct(), rows, docs, k, id_col, text_col)
    order = Order(*frequent_shingles(_counted(sets)))
    # the pairs of short lists; classes of the others are compared with the list's pivot
    side = lambda x: every.where(F.col("size") <= LONGEST).select("key", F.col("cls").alias(x))
    pairs = materialize(side("a").join(side("b"), "key").where("a < b").select("a", "b").distinct(), "pairs")
    links = _linked(pairs, sketches, sets, percent)
    long = every.where(F.col("size") > LONGEST)
    # of each class the best of its lists' members, and of each list the best one of its classes: a pivot needn't be in the list,
    # and so a group's lists have one pivot, wherever its centre is
    pivots = materialize(long.groupBy("key").agg(F.max(F.struct("company", "cls", "n")).alias("p")), "pivots")
    best = materialize(long.join(pivots, "key").groupBy("cls").agg(F.max("p").alias("p")), "best")
    shared = materialize(long.select("key", "cls").join(best, "cls").groupBy("key").agg(F.max("p").alias("p")), "shared")
    met = long.join(shared, "key").where(F.col("cls") != F.col("p.cls")).groupBy("cls").agg(F.max("n").alias("n"), F.max("company").cast("float").alias("score"), F.collect_set("p").alias("p"))
    each = F.transform("p", lambda p: F.struct(p["cls"].alias("pivot"), p["n"].alias("size"), p["company"].cast("float").alias("new_weight")))
    asked = materialize(met.select("cls", "n", "score", F.xxhash64("cls").alias("known"), F.col("score").alias("weight"), each.alias("pivots")), "asked")
    compared = compare(asked, sets, percent, order)
    links = links.union(compared.where("linked").select(F.col("cls").alias("a"), F.col("pivot").alias("b")))
    links, _ = links_of(difference_lists(compared), pairs.limit(0), links, lambda more: sets, percent, order)
    labels = connected_components(links)
    discard(every, sets, pairs, pivots, best, shared, asked, compared)
    return labels


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_shingles and component_id, the least id that links reach.

    Two documents are linked when the sets of their distinct ``k``-word shingles have an intersection of at least ``percent``
    hundredths of their union; every link is confirmed on the full sets, and one of 0.8 is missed with a probability of 5e-8
    (at lower thresholds of more: ``percent`` is 80 or more). With fewer words, the whole sequence is the only shingle. A null or
    empty text, or one of white space, has no shingles and is linked with nothing; its component is its own id. Repeated rows
    give repeated rows. A row with a null id is linked like any other, and has the least id of its component (null if there is
    none). Very long texts are read whole. An empty table gives no rows. Only the two named columns are read.
    """
    if percent < 80:
        raise ValueError("the bands are made for 80 hundredths or more")
    every = materialize(_sketched(docs, k, id_col, text_col), "sketched")
    rows = every.select("_id", "text_hash", "cls", "n")
    sketches = materialize(every.where("sketch is not null").select("cls", "n", "sketch").dropDuplicates(["cls"]), "sketches")
    labels = _labels(docs, rows, sketches, k, percent, id_col, text_col)
    of = components_of(rows, labels, F.col("_id"))
    discard(sketches)
    component = F.when(F.col("cls").isNull(), F.col("_id")).otherwise(F.col("value"))
    return rows.join(of, "cls", "left").select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"))
