"""N-gram Jaccard join by T-occurrence search with DivideSkip.

Documents with equal shingle sets form a class, found by a digest; all that follows is about classes. A class with n
shingles can only be linked to one that shares T of them. Shingles are put into one order for the whole corpus: rare ones
first, then frequent ones by how many documents hold them (their inverted lists are the long ones). By DivideSkip, the T - c
longest lists of a class aren't merged: a linked class must occur in c of its short lists. The short lists are merged by
their shingle in Spark's sort-merge join, occurrences are counted, and those in the long lists are found by binary probes of
the sorted shingles of both classes.

A list can be as long as a group of near copies, so lists that would make many pairs are split by a pivot first:

* The pivot p of a list is the class with the most frequent shingles, in a group of near copies its centre. Every class x of
  the list is compared with p, and from then on stands for its difference D(x) from p: the shingles that only one of both has.
* Linked sets x and y differ by K(x, y) = |x| + |y| - 2 T(x, y) shingles at most. So if they aren't both linked with p, their
  differences share (|D(x)| + |D(y)| - K(x, y)) / 2 elements at least, and one at least. (If |D(x)| + |D(y)| <= K(x, y), both are
  linked with p: |K(x, y) - K(x, p)| <= ||y| - |p|| <= |D(y)|.)
* That is the T-occurrence search again, over the lists of (p, element of the difference): what a group has in common is gone
  from the lists, and what only few have comes first in their order. Classes that are linked with one pivot count as one
  from then on. With p = {} the first lists are the same thing. Lists that are still long get a pivot again.

Where texts have few different words, lists are long without a centre, and pivots don't split them. Such lists are split into chains:
by the next element that their classes share, and the one behind that, which are among the first ones in each class's order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrygraph.llm.common import arrow_map, cut_batches, discard, free_names, materialize
from quarrygraph.llm.components import connected_components
from quarrygraph.llm.shingles import digest, mix, shingle_sets

#: Shingles that get an exact place among the frequent ones: 8 bytes each reach every task. More of them only make
#: the order less sharp; results don't depend on it.
FREQUENT = 500_000
#: Shingles whose counts a task adds up at a time, and the least count that it hands on.
CHUNK, HANDED_ON = 3_000_000, 2
#: c: occurrences in merged lists that make a candidate (fewer, where a link needs fewer). A pair that also meets in a list with a
#: pivot is found behind it.
MERGED = 3
#: A list is merged if that tries at most so many pairs for each of its rows; the others get a pivot, until a round of pivots (of so
#: many at most) has left more than a quarter of the pairs. What is left then is split into chains.
PAIRS_PER_ROW, ROUNDS = 64, 4
#: Elements of a chain at most; pairs up to which a list isn't split, for each row that would come of it; and shingles of a list's
#: classes, on average, up to which it is split at all: those of longer texts can go on in too many ways.
LEVELS, CHAIN_PAIRS, CHAIN_SHINGLES = 8, 2, 48
#: Hash buckets of wanted ids, broadcast to drop other documents before their texts are shuffled: at most so many numbers.
BUCKETS = 1 << 19


def least_overlap(n: int, percent: int) -> int:
    """The least number of shared shingles with any linked set, of whatever size: ceil(n * percent / 100)."""
    return -(-n * percent // 100)


def _classes(docs: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """kind 0: a row per document (id, hash of the text, cls, n); kind 1: shingles that several documents of a chunk hold, with
    their counts."""
    id_type = docs.schema[id_col].dataType
    named = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        names, types = ("kind", "_id", "text_hash", "cls", "n", "shingle"), (pa.int8(), to_arrow_type(id_type), pa.int64(), pa.binary(), pa.int64(), pa.int64())
        held, known, size = [], set(), 0

        def frequent() -> pa.RecordBatch:
            hashes, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            hashes, n = hashes[n >= HANDED_ON], n[n >= HANDED_ON]
            columns = [pa.array([1] * len(n), types[0]), *(pa.nulls(len(n), t) for t in types[1:4]), pa.array(n), pa.array(hashes.view(np.int64))]
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in cut_batches(batches):
            cls, n = [], []
            for s in shingle_sets([t or "" for t in batch.column(1).to_pylist()], k):
                key = digest(s) if len(s) else None
                cls.append(key)
                n.append(len(s))
                if key is not None and key not in known:
                    known.add(key)
                    held.append(s)
                    size += len(s)
            columns = [pa.array([0] * len(n), types[0]), batch.column(0), batch.column(2), pa.array(cls, types[3]), pa.array(n, types[4]), pa.nulls(len(n), types[5])]
            yield pa.RecordBatch.from_arrays(columns, names=names)
            if size > CHUNK:
                yield frequent()
                held, size = [], 0
                known.clear()
        yield frequent()

    return named.mapInArrow(run, f"kind tinyint, _id {id_type.simpleString()}, text_hash bigint, cls binary, n bigint, shingle bigint")


def frequent_shingles(counted: DataFrame, most: int = FREQUENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted hashes, rank by count of each, counts) of at most ``most`` shingles with the highest counts."""
    totals = counted.groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") > 2 * HANDED_ON)
    levels = sorted(totals.groupBy(F.least("n", F.lit(1 << 16)).alias("n")).count().collect(), reverse=True)
    least, held = None, 0
    for level, count in levels:
        if held + count > most:
            break
        held, least = held + count, level
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    table = totals.where(F.col("n") >= least).select("shingle", "n").toArrow()
    hashes, n = table["shingle"].to_numpy().view(np.uint64), table["n"].to_numpy()
    order = np.argsort(hashes)
    hashes, n = hashes[order], n[order]
    rank = np.empty(len(n), np.int64)
    rank[np.lexsort((hashes, n))] = np.arange(len(n))
    return hashes, rank, n


def overlap(a, b, percent: int):
    """The least number of shared shingles of linked sets with ``a`` and ``b`` shingles."""
    return -(-(a + b) * percent // (100 + percent))


class Order:
    """The order of all shingles: those that aren't frequent, by hash, then the frequent ones by count."""

    def __init__(self, hashes: np.ndarray, rank: np.ndarray, counts: np.ndarray):
        self.hashes, self.rank, self.weight = hashes, rank.astype(np.int32), np.log2(counts + 1).astype(np.float32)

    def places(self, s: np.ndarray) -> tuple[np.ndarray, float]:
        """(indices that put the sorted ``s`` into the order, mean weight of its shingles)."""
        if not len(self.hashes) or not len(s):
            return np.arange(len(s)), 0.0
        at = np.minimum(np.searchsorted(self.hashes, s), len(self.hashes) - 1)
        known = self.hashes[at] == s
        return np.argsort(np.where(known, self.rank[at], -1), kind="stable"), float(np.where(known, self.weight[at], 0).mean())


def _postings(docs: DataFrame, k: int, percent: int, order: Order, text_col: str) -> DataFrame:
    """(shingle, cls, n, place, score) of the short lists of every class, once per task. ``place``: of the shingle in the order;
    ``score``: how frequent the shingles of the class are."""

    def make():
        known: set[bytes] = set()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            shingle, cls, size, place, scores = [], [], [], [], []
            for s in shingle_sets([t or "" for t in batch.column(0).to_pylist()], k):
                n = len(s)
                lists = min(n, n - least_overlap(n, percent) + MERGED)
                # another set differs by one shingle at least: too much for a link of small ones
                if not n or n * 100 < percent * (n + 1) and (n - 1) * 100 < percent * n:
                    continue
                key = digest(s)
                if key in known:
                    continue
                if len(known) < 1_000_000:
                    known.add(key)
                places, score = order.places(s)
                shingle.append(s[places[:lists]])
                cls += [key] * lists
                size += [n] * lists
                scores += [score] * lists
                place.append(np.arange(lists))
            many = np.concatenate(shingle) if shingle else np.zeros(0, np.uint64)
            columns = [pa.array(many.view(np.int64)), pa.array(cls, pa.binary()), pa.array(size, pa.int32()), pa.array(np.concatenate(place) if place else [], pa.int32()), pa.array(scores, pa.float32())]
            return pa.RecordBatch.from_arrays(columns, names=["shingle", "cls", "n", "place", "score"])

        return step

    return arrow_map(docs.select(text_col), make, "shingle bigint, cls binary, n int, place int, score float")


#: Columns of a list's row. ``of``: the pivot, by its hash; ``rest``: size of the difference from the pivot; ``place``: of the list's element in it; ``known``: a
#: class that this one is known to be linked with, by its hash, of ``weight``.
_ROW = ("key", "of", "cls", "n", "rest", "place", "score", "known", "weight")


def most_apart(n: int, percent: int) -> int:
    """The most elements by which a set of n differs from a linked one, of whatever size."""
    return n * (100 - percent) // percent


def _leads(percent: int) -> Column:
    """Whether an element comes in the first half of those that can be shared: of each pair, one has its first MERGED ones there."""
    return 2 * (F.col("place").cast("long") - (MERGED - 1)) * percent <= F.col("n").cast("long") * (100 - percent)


def _open(each: DataFrame, percent: int) -> DataFrame:
    """(key, members, pairs) of the lists that make pairs of classes not known to be linked; a written table."""
    of_known = each.groupBy("key", "known").agg(F.count(F.lit(1)).alias("n"), F.sum(_leads(percent).cast("long")).alias("leaders"))
    pairs = F.sum("leaders") * F.sum("n") - F.sum(F.col("leaders") * F.col("n"))
    return materialize(of_known.groupBy("key").agg(F.sum("n").alias("members"), pairs.alias("pairs")).where("pairs > 0"), "open")


def _with_pivots(lists: DataFrame, percent: int) -> DataFrame:
    """(cls, n, score, known, weight, pivots) of the classes that are to be compared with the pivots of their lists; a written table."""
    best = F.max_by(F.struct(F.col("cls").alias("pivot"), F.col("n").alias("size"), F.col("score").alias("new_weight")), F.struct("score", -F.col("n"), "cls")).alias("p")
    cells = materialize(lists.where(_leads(percent)).groupBy("key").agg(best), "cells")
    same = [F.max(c).alias(c) for c in ("n", "score", "known", "weight")]  # of a class, not of a list
    found = lists.join(cells, "key").where(F.col("cls") != F.col("p.pivot")).groupBy("cls").agg(*same, F.collect_set("p").alias("pivots"))
    out = materialize(found, "pairs")
    discard(cells)
    return out


def _difference(x: np.ndarray, p: np.ndarray, percent: int, order: Order) -> tuple[np.ndarray, int, bool]:
    """(the elements by which x differs from the pivot p, in order; how many of them any class has to share that is linked with x,
    but not with p if x is; whether x and p are linked). With an empty p: the shingles of x, and what any link has to share."""
    if not len(p):
        return x[order.places(x)[0]], least_overlap(len(x), percent), False
    at = np.minimum(np.searchsorted(p, x), len(p) - 1)
    both = p[at] == x
    gone = np.ones(len(p), bool)
    gone[at[both]] = False
    own, lost = x[~both], p[gone]
    # what the class adds, rare ones first, then what it lacks, frequent ones first
    difference = np.concatenate([own[order.places(own)[0]], lost[order.places(lost)[0][::-1]]])
    d = len(difference)
    linked = d <= len(x) + len(p) - 2 * overlap(len(x), len(p), percent)
    return difference, max(1, (d - abs(len(x) - len(p)) + 2) // 2 if linked else d - most_apart(len(x), percent)), linked


def compare(pairs: DataFrame, sets: DataFrame, percent: int, order: Order) -> DataFrame:
    """A row for each class and pivot: whether they are linked, the size of their difference and the keys of the lists of the
    pivot and an element of it, in order, as many as a link needs; a written table."""
    same = ["cls", "pivot", "size", "new_weight", "n", "score", "known", "weight"]
    each = pairs.select("cls", "n", "score", "known", "weight", F.explode("pivots").alias("p")).select("*", "p.*")
    held = each.join(sets.select("cls", "hashes"), "cls").join(sets.select(F.col("cls").alias("pivot"), F.col("hashes").alias("base")), "pivot")

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            linked, apart, keys = [], [], []
            for pivot, x, p in zip(batch.column(1).to_pylist(), batch.column(8), batch.column(9), strict=True):
                difference, share, near = _difference(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(p.as_buffer(), np.uint64), percent, order)
                d = len(difference)
                linked.append(near)
                apart.append(d)
                keys.append(mix(difference[: max(0, d - share + MERGED) if share <= d else 0] ^ np.uint64(int.from_bytes(pivot[:8], "little")), 7).view(np.int64))
            ends = np.zeros(len(keys) + 1, np.int32)
            np.cumsum([len(x) for x in keys], out=ends[1:])
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)))
            return pa.RecordBatch.from_arrays([*batch.columns[:8], pa.array(linked), pa.array(apart, pa.int32()), lists], names=[*same, "linked", "rest", "keys"])

        return step

    schema = "cls binary, pivot binary, size int, new_weight float, n int, score float, known bigint, weight float, linked boolean, rest int, keys array<bigint>"
    return materialize(arrow_map(held.select(*same, "hashes", "base"), make, schema), "compared")


def _knows(compared: DataFrame) -> DataFrame:
    """(cls, known, weight): of itself and the pivots that it is linked with, the one with the most frequent shingles; a written table."""
    found = F.max(F.when(F.col("linked"), F.struct(F.col("new_weight").alias("weight"), F.xxhash64("pivot").alias("known")))).alias("found")
    own = F.max(F.struct("weight", "known")).alias("own")
    better = F.coalesce(F.col("found.weight") >= F.col("own.weight"), F.lit(False))
    pick = lambda c: F.when(better, F.col(f"found.{c}")).otherwise(F.col(f"own.{c}")).alias(c)
    return materialize(compared.groupBy("cls").agg(found, own).select("cls", pick("known"), pick("weight")), "knows")


def _apart(na: Column, nb: Column, percent: int) -> Column:
    """By how many elements linked classes with na and nb shingles differ at most."""
    return na + nb - 2 * F.ceil((na + nb) * percent / F.lit(100 + percent) - 1e-9)


def _merged(lists: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the classes that occur together in MERGED of the lists of one pivot, or in as many as a link of theirs needs."""
    side = lambda x: lists.select("key", _leads(percent).alias("leads" + x), *(F.col(c).alias(c + x) for c in ("of", "cls", "n", "rest", "place", "known")))
    na, nb = F.col("na").cast("long"), F.col("nb").cast("long")
    twice = F.col("resta") + F.col("restb") - _apart(na, nb, percent)  # what they need to share
    shared = F.least(F.col("resta") - F.col("placea"), F.col("restb") - F.col("placeb")) + (MERGED - 1)  # this one, those behind it, and earlier ones
    possible = (F.least(na, nb) * 100 >= F.greatest(na, nb) * percent) & (2 * shared >= twice)
    pairs = side("a").join(side("b"), "key").where("clsa < clsb and knowna != knownb and (leadsa or leadsb) and ofa = ofb").where(possible)
    counted = pairs.groupBy("ofa", F.col("clsa").alias("a"), F.col("clsb").alias("b")).agg(F.count(F.lit(1)).alias("m"), F.max(twice).alias("twice"))
    return materialize(counted.where((F.col("m") >= MERGED) | (2 * F.col("m") >= F.col("twice"))).select("a", "b").distinct(), "candidates")


def _prefixes(rows: DataFrame, sets: DataFrame, percent: int, order: Order) -> DataFrame:
    """(cls, of, share, elements): the first elements of a class's difference from the pivot ``of`` in order, as many as chains of
    ``LEVELS`` can reach, and how many a link shares; a written table."""
    wanted = rows.select("cls", "of").distinct()
    bases = sets.select(F.xxhash64("cls").alias("of"), F.col("hashes").alias("base")).join(wanted.select("of").distinct(), "of", "left_semi")
    held = wanted.join(sets.select("cls", "hashes"), "cls").join(bases, "of", "left").select("cls", "of", "hashes", F.coalesce("base", F.lit(b"")).alias("base"))

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            shares, elements = [], []
            for x, p in zip(batch.column(2), batch.column(3), strict=True):
                difference, share, _ = _difference(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(p.as_buffer(), np.uint64), percent, order)
                shares.append(share)
                elements.append(difference[: max(0, len(difference) - share) + MERGED + LEVELS].view(np.int64))
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shares, pa.int32()), pa.array(elements, pa.list_(pa.int64()))], names=["cls", "of", "share", "elements"])

        return step

    return materialize(arrow_map(held, make, "cls binary, of bigint, share int, elements array<bigint>"), "prefixes")


def _chain_lists(rows: DataFrame, level: int) -> tuple[DataFrame, int]:
    """((key, of, long) of the lists with classes not known to be linked; how many pairs the long ones have). A list is long if it has
    over CHAIN_PAIRS times as many pairs as rows come of it, when it is split, and short texts."""
    window = F.greatest(F.least(_window(level), F.col("rest") - 1 - F.col("place")), F.lit(0))
    by_known = rows.groupBy("key", "of", "known").agg(F.count(F.lit(1)).alias("n"), F.sum(window).alias("more"), F.sum(F.col("n").cast("long")).alias("size"))
    pairs = ((F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))) / 2).cast("long").alias("pairs")
    sums = by_known.groupBy("key", "of").agg(pairs, F.sum("more").alias("more"), F.sum("n").alias("members"), F.sum("size").alias("size")).where("pairs > 0")
    splits = (F.col("pairs") > CHAIN_PAIRS * F.col("more")) & (F.lit(level > 1) | (F.col("size") <= CHAIN_SHINGLES * F.col("members")))
    out = materialize(sums.select("key", "of", "pairs", splits.alias("long")), "chain-lists")
    return out, out.where("long").agg(F.sum("pairs")).first()[0] or 0


def _window(level: int) -> Column:
    """Among how many elements behind its place the next shared one is, if this one is shared as the level-th to (level + MERGED - 1)-th."""
    return F.col("rest") - F.col("share") - F.col("place") + (level + MERGED - 1)


def _chained(lists: DataFrame, sets: DataFrame, percent: int, order: Order) -> tuple[DataFrame, DataFrame]:
    """((a, b) of the classes that may be linked, of lists that no pivot splits; the lists that aren't split here either).

    A list's classes share its element. Those of a link share the next one too, as many as they need, and it is among the
    first ones behind: so a list can be split by what comes next in each class's order, which gives chains of two elements, then
    of three and so on. That is done where a list has more pairs than rows come of it, which is so where texts are short and
    have few different words, and as long as it halves the pairs; where the first step doesn't, no list is split. A pair that meets in a chain's list may
    share up to MERGED - 1 elements before it; those with more of them are found by the counts of the other lists. Classes
    that may share no more than the chain holds are paired there."""
    prefixes = _prefixes(lists, sets, percent, order)
    rows = materialize(lists.select(*_ROW).join(prefixes.select("cls", "of", "share"), ["cls", "of"]), "chains")
    columns = ("key", "of", "cls", "n", "rest", "place", "known", "share")
    still, before = _chain_lists(rows, 1)
    rest = rows.join(still.where("not long"), ["key", "of"], "left_semi").select(*_ROW)
    found = [rows.limit(0).select(F.col("cls").alias("a"), F.col("cls").alias("b"))]
    marked = rows.join(still.where("long").select("key", "of"), ["key", "of"], "left_semi").select(*columns)

    def paired(chosen: DataFrame, level: int) -> None:
        side = lambda x: chosen.select("key", *(F.col(c).alias(c + x) for c in columns[1:]))
        na, nb = F.col("na").cast("long"), F.col("nb").cast("long")
        shared = F.least(F.col("resta") - F.col("placea"), F.col("restb") - F.col("placeb")) + (MERGED + level - 2)
        possible = (F.least(na, nb) * 100 >= F.greatest(na, nb) * percent) & (2 * shared >= F.col("resta") + F.col("restb") - _apart(na, nb, percent))
        pairs = side("a").join(side("b"), "key").where("clsa < clsb and knowna != knownb and ofa = ofb").where(possible)
        found.append(materialize(pairs.select(F.col("clsa").alias("a"), F.col("clsb").alias("b")).distinct(), "candidates"))

    for level in range(1, LEVELS + 1):
        if not before:
            break
        following = marked.join(prefixes.select("cls", "of", "elements"), ["cls", "of"]).select(*columns, F.posexplode(F.slice("elements", F.col("place") + 2, F.greatest(_window(level), F.lit(0)))).alias("step", "element"))
        longer = materialize(following.withColumns({"key": F.xxhash64("key", "element"), "place": F.col("place") + F.col("step") + 1}).select(*columns), "chains")
        lists_of, after = _chain_lists(longer, level + 1)
        every = lists_of.agg(F.sum("pairs")).first()[0] or 0
        # a pair stands in the lists of several short chains, so the first steps may hold more
        if every > (before * 4 if level < MERGED else before / 2) or level == LEVELS:  # no gain: paired where they are, or merged by counts
            if level == 1:
                rest = lists
            else:
                paired(marked, level)
            discard(longer, lists_of)
            break
        paired(marked.where(F.col("share") < level + MERGED), level)
        if level + 1 < MERGED:  # pairs have MERGED elements in common, as those that are merged by counts
            marked, before = longer.join(lists_of, ["key", "of"], "left_semi").select(*columns), every
            continue
        paired(longer.join(lists_of.where("not long"), ["key", "of"], "left_semi"), level + 1)
        marked, before = longer.join(lists_of.where("long"), ["key", "of"], "left_semi").select(*columns), after
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out, rest


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the overlap, found by binary probes of the smaller set in the larger."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            good = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                small, large = sorted((np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)), key=len)
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                good[i] = int((large[at] == small).sum()) >= overlap(len(small), len(large), percent)
            return batch.filter(pa.array(good)).select([0, 1])

        return step

    of = lambda side: sets.select(F.col("cls").alias(side), F.col("hashes").alias(f"h{side}"))
    return arrow_map(pairs.join(of("b"), "b").join(of("a"), "a").select("a", "b", "ha", "hb"), make, "a binary, b binary")


def sets_of(classes: DataFrame, rows: DataFrame, docs: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """(cls, hashes) of the ``classes``, from the texts of documents in the hash buckets of one id of each; a written table."""
    bucket = lambda of: F.pmod(F.xxhash64(of), F.lit(BUCKETS)).alias("bucket")
    wanted = rows.join(classes, "cls", "left_semi").groupBy("cls").agg(F.min("_id").alias("_id")).select(bucket("_id")).distinct()
    near = docs.select(bucket(id_col), F.col(text_col).alias("text")).join(F.broadcast(wanted), "bucket", "left_semi")

    def make():
        known: set[bytes] = set()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            cls, sets = [], []
            for s in shingle_sets([t or "" for t in batch.column(0).to_pylist()], k):
                key = digest(s)
                if key not in known:
                    if len(known) < 1_000_000:
                        known.add(key)
                    cls.append(key)
                    sets.append(s.tobytes())
            return pa.RecordBatch.from_arrays([pa.array(cls, pa.binary()), pa.array(sets, pa.binary())], names=["cls", "hashes"])

        return step

    # the buckets hold other documents too, and equal sets more than once
    found = arrow_map(near.select("text"), make, "cls binary, hashes binary").join(classes, "cls", "left_semi")
    return materialize(found.groupBy("cls").agg(F.first("hashes").alias("hashes")), "sets")


def links_of(lists: DataFrame, candidates: DataFrame, links: DataFrame, sets_with: Callable[[DataFrame], DataFrame], percent: int, order: Order) -> tuple[DataFrame, DataFrame | None]:
    """(links (a, b) of the classes in the lists, as many as their components need, with the given ``links`` and those of the
    ``candidates``; the sets (cls, hashes) of classes, by ``sets_with`` of those that need any)."""
    sets, before = None, None
    for turn in range(ROUNDS + 1):
        still = _open(lists, percent)
        many = F.col("pairs") > F.lit(PAIRS_PER_ROW) * F.col("members")
        of_all, of_long = still.agg(F.sum("pairs"), F.sum(F.when(many, F.col("pairs")))).first()
        if not of_all:
            discard(still)
            break
        split = bool(of_long) and turn < ROUNDS and (before is None or of_long <= before / 4)
        before = of_long
        lists = materialize(lists.join(still.select("key", many.alias("long")), "key").select(*_ROW, "long"), "lists")
        discard(still)
        long, short = lists.where("long"), lists.where("not long").select(*_ROW)
        if of_long and not split:  # what isn't chained is merged with the short ones: its occurrences add up
            if sets is None:
                sets = sets_with(lists.select("cls"))
            chains, rest = _chained(long.select(*_ROW), sets, percent, order)
            candidates = candidates.union(chains).union(_merged(short.unionByName(rest), percent))
            discard(lists)
            break
        candidates = candidates.union(_merged(short, percent))
        if sets is None:
            sets = sets_with(candidates.select("a").union(candidates.select("b")).union(long.select("cls")).toDF("cls"))
        if not split:
            discard(lists)
            break
        pairs = _with_pivots(long, percent)
        discard(lists)
        compared = compare(pairs, sets, percent, order)
        discard(pairs)
        links = links.union(compared.where("linked").select(F.col("cls").alias("a"), F.col("pivot").alias("b")))
        lists = difference_lists(compared)
    if sets is not None:
        links = links.union(verified(candidates.distinct(), sets, percent))
    return links, sets


def difference_lists(compared: DataFrame) -> DataFrame:
    """The lists of (pivot, element of the difference)."""
    return compared.select(F.xxhash64("pivot").alias("of"), "cls", "n", "score", "rest", F.posexplode("keys").alias("place", "key")).join(_knows(compared), "cls").select(*_ROW)


def link_classes(docs: DataFrame, k: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(a row per document row: id, text_hash, cls, n; the component of each class that has links: node, label). Both are
    written tables."""
    every = materialize(_classes(docs, k, id_col, text_col), "classes")
    rows = every.where("kind = 0").select("_id", "text_hash", "cls", "n")
    order = Order(*frequent_shingles(every.where("kind = 1")))
    postings = materialize(_postings(docs, k, percent, order, text_col), "postings")
    # lists of several classes, of which one has the shared shingle early in its order
    key = F.xxhash64("cls")
    # written before the join: a side that is an aggregate keeps Spark from splitting the other side's long lists
    several = postings.groupBy("shingle").agg(F.min(key).alias("x"), F.max(key).alias("y"), F.max(_leads(percent)).alias("leads")).where("x != y and leads").select("shingle")
    several = materialize(several, "several")
    posts = F.collect_set(F.struct(F.col("shingle").alias("key"), "place")).alias("posts")
    shared = materialize(postings.join(several, "shingle").groupBy("cls", "n", "score").agg(posts), "shared")
    discard(postings, several)
    lists = shared.select(F.lit(0).cast("long").alias("of"), "cls", "n", "score", key.alias("known"), F.col("score").alias("weight"), F.col("n").alias("rest"), F.explode("posts").alias("p")).select("*", "p.*").select(*_ROW)
    nothing = shared.limit(0).select(F.col("cls").alias("a"), F.col("cls").alias("b"))

    def sets_with(more: DataFrame) -> DataFrame:  # what comes in later rounds has been in a long list before
        return sets_of(more.distinct(), rows, docs, k, id_col, text_col)

    links, sets = links_of(lists, nothing, nothing, sets_with, percent, order)
    labels = connected_components(links)
    discard(shared, sets)
    return rows, labels


def components_of(rows: DataFrame, labels: DataFrame, least: Column) -> DataFrame:
    """(cls, value) of every class: the least value of ``least`` over the rows of its component; a written table."""
    own = rows.where("cls is not null").groupBy("cls").agg(F.min(least).alias("least"))
    named = materialize(own.join(labels.withColumnRenamed("node", "cls"), "cls", "left").withColumn("label", F.coalesce("label", "cls")), "named")
    of_label = materialize(named.groupBy("label").agg(F.min("least").alias("value")), "own")
    out = materialize(named.join(of_label, "label").select("cls", "value"), "components")
    discard(named, of_label, labels)
    return out


def jaccard_components(docs: DataFrame, k: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_shingles and component_id, the least id that links reach.

    Two documents are linked when their sets' intersection has at least ``percent`` hundredths of their union. A null or
    empty text, or one of white space, has no shingles and is linked with nothing; its component is its own id. Repeated
    rows give repeated rows. A row with a null id is linked like any other, and has the least id of its component (null if
    there is none). Very long texts are read whole. An empty table gives no rows. Only the two named columns are read.
    """
    rows, labels = link_classes(docs, k, percent, id_col, text_col)
    of = components_of(rows, labels, F.col("_id"))
    component = F.when(F.col("cls").isNull(), F.col("_id")).otherwise(F.col("value"))
    return rows.join(of, "cls", "left").select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"))


def keep_one_of_each(docs: DataFrame, k: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, with all columns: that with the least id (of equal ids, the least hash of the text). Rows
    with a null id and rows without words stay, all of them; so do texts of other components under the same id, while
    repeated rows are one. Very long texts are read whole; an empty table stays empty. Columns may have any names.
    """
    rows, labels = link_classes(docs, k, percent, id_col, text_col)
    one = components_of(rows, labels, F.when(F.col("_id").isNotNull(), F.struct("_id", "text_hash"))).where("value is not null").select("value._id", "value.text_hash")
    kept = materialize(one.distinct(), "kept")
    stays = F.col(id_col).isNull() | F.regexp_like(F.coalesce(F.col(text_col), F.lit("")), F.lit("^[ \\x09-\\x0D]*$"))
    keys = free_names(docs, "kept_id", "kept_text")
    named = docs.where(~stays).withColumns(dict(zip(keys, (F.col(id_col), F.xxhash64(text_col)), strict=True)))
    found = named.join(kept.toDF(*keys), keys, "left_semi").dropDuplicates(keys)
    return found.drop(*keys).union(docs.where(stays))
