"""Repeated passages across documents, by a sparse suffix array over minimiser positions.

Documents with equal word sequences form a class. Of each class, the suffixes at minimiser positions are kept: of every
``least`` successive words, the run of ``K`` words with the least hash begins one, so that equal passages of ``least`` words
keep the same suffix in every document. Suffixes that begin alike in several classes are sorted by the words that follow
(and once more by the words before, read backwards); neighbours of different classes are compared and the match is
extended to the left and right, at most to ``least`` words on a side: longer matches are the union of those of their suffixes.

A neighbour shares the most words on one side only. Where a suffix could share more windows of ``least`` words than those of its
matches, by the words that its neighbours of both orders share with it, the windows in question are looked up by their hashes
among all suffixes that begin alike. So every passage of ``least`` words that two classes share is found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrygraph.llm.common import arrow_map, cut_batches, discard, materialize
from quarrygraph.llm.shingles import mix, word_hashes

#: Words that a kept suffix must begin with in all documents that share it.
K = 20
#: Sorted records that a task compares at a time; results don't depend on it.
SORTED_ROWS = 4096
#: Runs on either side that a suffix is compared with while the next ones leave windows in question. It only saves lookups.
NEAR_RUNS = 10
#: Hash buckets of suffixes, broadcast to drop other records before they are shuffled: at most so many numbers.
BUCKETS = 1 << 19
_ODD = np.uint64(0xD6E8FEB86659FD93)
_RECORD = "suffix bigint, cls binary, at int, last int, after binary, before binary"


def _slide(x: np.ndarray, n: int, f) -> np.ndarray:
    """f over every window of n values, by doubling."""
    out, have = x, 1
    while have < n:
        step = min(have, n - have)
        out, have = f(out[: len(out) - step], out[step:]), have + step
    return out


def minimisers(runs: np.ndarray, width: int) -> np.ndarray:
    """Positions that hold the least value of some ``width`` successive ones."""
    least = _slide(runs, width, np.minimum)
    edge = np.zeros(width - 1, np.uint64)
    return np.flatnonzero(_slide(np.concatenate([edge, least, edge]), width, np.maximum) == runs)


def _documents(texts: list[str], least: int) -> Iterator[tuple[np.ndarray, bytes | None, np.ndarray, np.ndarray]]:
    """(word hashes, class, kept positions, hash of the ``K`` words there) of each text; no class without words."""
    h, first, *_ = word_hashes(texts)
    runs = h.copy()
    for j in range(1, K):
        m = max(0, len(h) - j)
        runs[:m] = mix(runs[:m] * _ODD + h[j:], j)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        own, none = h[a:b], np.zeros(0, np.int64)
        if a == b:
            yield own, None, none, own
            continue
        place = np.arange(1, b - a + 1, dtype=np.uint64)
        cls = np.array([mix(own * _ODD + place, 3).sum(dtype=np.uint64), mix(own + place * _ODD, 5).sum(dtype=np.uint64)], "<u8").tobytes()
        at = minimisers(runs[a : b - K + 1], least - K + 1) if b - a >= least else none
        yield own, cls, at, runs[a : b - K + 1][at]


def _anchors(docs: DataFrame, least: int, id_col: str, text_col: str) -> DataFrame:
    """kind 0: (id, hash of id and text, cls, n words) per document; kind 1: (cls, suffix hash, position), once per task and class."""
    kind = docs.schema[id_col].dataType.simpleString()

    def make():
        known: set[bytes] = set()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows, cls, n, hashes, at = [], [], [], [], []
            for i, (words, key, places, runs) in enumerate(_documents([t or "" for t in batch.column(1).to_pylist()], least)):
                new = key is not None and key not in known
                if new and len(known) < 1_000_000:
                    known.add(key)
                m = len(places) if new else 0
                rows.append(i)
                cls += [key] * (1 + m)
                n += [len(words)] + [None] * m
                rows += [None] * m
                hashes.append(np.concatenate([np.zeros(1, np.int64), runs.view(np.int64)[:m]]))
                at.append(np.concatenate([np.full(1, -1), places[:m]]))
            place = np.concatenate(at)
            rows = pa.array(rows, pa.int64())
            columns = [pa.array(place >= 0).cast(pa.int8()), batch.column(0).take(rows), batch.column(2).take(rows), pa.array(cls, pa.binary()), pa.array(n, pa.int64()),
                       pa.array(np.concatenate(hashes)), pa.array(place.astype(np.int32))]
            return pa.RecordBatch.from_arrays(columns, names=["kind", "_id", "doc_key", "cls", "n", "suffix", "at"])

        return step

    return arrow_map(docs.select(id_col, text_col, F.xxhash64(id_col, text_col)), make, f"kind tinyint, _id {kind}, doc_key bigint, cls binary, n bigint, suffix bigint, at int")


def _contexts(texts: DataFrame, least: int) -> DataFrame:
    """(suffix, cls, at, last, after, before) of the wanted positions: 32-bit hashes of the words that follow and go before.

    Positions of a text that have all this in common, as those in a repeated word or phrase have, and follow each other by ``least`` words
    at most, are one record, from ``at`` to ``last``: what the first one shares with another text, they all share, each moved
    along, and these stretches join. So a text that repeats itself has as many records as it has different contexts."""
    side = least - K

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            suffix, cls, at, last, after, before = [], [], [], [], [], []
            for (words, key, places, runs), wanted in zip(_documents([t or "" for t in batch.column(0).to_pylist()], least), batch.column(1).to_pylist(), strict=True):
                keep = np.isin(places, np.array(wanted, np.int64))
                small = (words >> np.uint64(32)).astype("<u4")
                padded = np.concatenate([np.zeros(side, "<u4"), small, np.zeros(side, "<u4")])
                known: dict[tuple, int] = {}
                for p, s in zip(places[keep].tolist(), runs.view(np.int64)[keep].tolist(), strict=True):
                    context = s, padded[p + K + side : p + K + 2 * side].tobytes(), padded[p : p + side][::-1].tobytes()
                    i = known.get(context)
                    if i is not None and p - last[i] <= least:
                        last[i] = p
                        continue
                    known[context] = len(at)
                    suffix.append(s)
                    cls.append(key)
                    at.append(p)
                    last.append(p)
                    after.append(context[1])
                    before.append(context[2])
            columns = [pa.array(suffix, pa.int64()), pa.array(cls, pa.binary()), pa.array(at, pa.int32()), pa.array(last, pa.int32()), pa.array(after, pa.binary()), pa.array(before, pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["suffix", "cls", "at", "last", "after", "before"])

        return step

    return arrow_map(texts, make, _RECORD, 128)


def _alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many leading columns agree; zeros (the end of a text) agree with nothing."""
    return np.logical_and.accumulate((a == b) & (a != 0), axis=1).sum(axis=1)




def _neighbours(records: DataFrame, least: int, order: list[str]) -> DataFrame:
    """For sorted records: kind 0, a match (cls, at, start, end in words, other class) of each with its nearest neighbours of
    another class; kind 1, the first and last run of each partition, to be compared with those of other partitions; kind 2,
    the record after the first run and the one before the last, which those runs are compared with where they go on in
    another partition; kind 3, records that may share more windows than their matches hold: start is how many words on the
    side of the order the neighbours share, end the windows that matches hold (bit j: the one with j words behind the suffix);
    kind 4, matches with neighbours further off that hold more of these. ``silent`` records get none of their own."""
    side = least - K
    fields = ["suffix", "cls", "at", "last", "after", "before"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the last run so far, whose next one isn't known yet, and the record before it
        held: pa.Table | None = None
        context: pa.Table | None = None

        def compared(t: pa.Table, old: int, known: int) -> tuple[pa.RecordBatch, np.ndarray]:
            """Matches and the first record of each run. The first ``known`` records had been compared with the run before
            them, the first ``old`` with the run behind them too."""
            n = t.num_rows
            suffix, cls = t["suffix"].to_numpy(), np.array(t["cls"].to_pylist(), object)
            wide = [np.frombuffer(b"".join(t[c].to_pylist()), "<u4").reshape(n, side) for c in ("after", "before")]
            at, last = t["at"].to_numpy().astype(np.int64), t["last"].to_numpy().astype(np.int64)
            new = np.ones(n, bool)
            new[1:] = (suffix[1:] != suffix[:-1]) | (cls[1:] != cls[:-1])
            begin = np.flatnonzero(new)
            of = np.cumsum(new) - 1
            i, own = np.arange(n), ~t["silent"].to_numpy()
            follow = np.append(begin[1:], n)[of]  # the first record of the next run
            prior = begin[of] - 1  # the last one of the run before
            out, bits = [], np.uint64(1) << np.arange(side + 1, dtype=np.uint64)
            reach, windows = np.full(n, -1, np.int64), np.zeros(n, np.uint64)
            for other, ok in ((follow, (follow < n) & (i >= old) & own), (prior, (prior >= 0) & (i >= known) & own)):
                a, b = i[ok], other[ok]
                same = suffix[a] == suffix[b]
                a, b = a[same], b[same]
                r, before = _alike(wide[0][a], wide[0][b]), _alike(wide[1][a], wide[1][b])
                good = r + before + K >= least
                out.append((a[good], b[good], at[a[good]] - before[good], last[a[good]] + K + r[good]))
                reach[a] = np.maximum(reach[a], r if order[0] == "after" else before)
                windows[a[good]] |= (bits[r] * np.uint64(2) - np.uint64(1) - (bits[side - before] - np.uint64(1)))[good]
            # all windows that the neighbours on this side allow
            allowed = bits[reach] * np.uint64(2) - np.uint64(1) if order[0] == "after" else bits[side] * np.uint64(2) - bits[side - np.maximum(reach, 0)]
            left = np.flatnonzero((reach >= 0) & (allowed & ~windows != 0))
            more = []
            for step in (x for d in range(2, NEAR_RUNS + 1) for x in (d, -d)):
                run_at = of[left] + step
                ok = (run_at >= 0) & (run_at < len(begin))
                a = left[ok]
                b = begin[run_at[ok]] if step > 0 else begin[run_at[ok] + 1] - 1
                ok = (suffix[a] == suffix[b]) & (cls[a] != cls[b])
                a, b = a[ok], b[ok]
                r, before = _alike(wide[0][a], wide[0][b]), _alike(wide[1][a], wide[1][b])
                held = bits[r] * np.uint64(2) - np.uint64(1) - (bits[side - before] - np.uint64(1))
                good = (r + before + K >= least) & (held & ~windows[a] & allowed[a] != 0)
                a, b = a[good], b[good]
                windows[a] |= held[good]
                more.append((a, b, at[a] - before[good], last[a] + K + r[good]))
                left = left[allowed[left] & ~windows[left] != 0]
            a, b, start, end = (np.concatenate(x) for x in zip(*out, strict=True))
            more = [np.concatenate(x) for x in zip(*more, strict=True)]
            kinds = np.repeat([0, 4, 3], [len(a), len(more[0]), len(left)]).astype(np.int8)
            a, b, start, end = (np.concatenate(x) for x in zip((a, b, start, end), more, strict=True))
            own = np.concatenate([a, left])
            columns = [pa.array(kinds), pa.array(suffix[own]), pa.array(list(cls[own]), pa.binary()), pa.array(at[own].astype(np.int32)), pa.array(last[own].astype(np.int32)), *[pa.nulls(len(own), pa.binary())] * 2,
                       pa.array(np.concatenate([start, reach[left]]).astype(np.int64)), pa.array(np.concatenate([end, windows[left].view(np.int64)]).astype(np.int64)), pa.array(list(cls[b]) + [None] * len(left), pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["kind", *fields, "start", "end", "other"]), begin

        def edge(t: pa.Table, kind: int) -> pa.RecordBatch:
            t = t.combine_chunks()
            n = t.num_rows
            columns = [pa.array(np.full(n, kind, np.int8)), *(t[c].combine_chunks() for c in fields), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["kind", *fields, "start", "end", "other"])

        opening = True  # in the partition's first run
        for batch in cut_batches(batches, SORTED_ROWS, 16 << 20):
            parts = [x for x in (context, held) if x is not None]
            old, known = context.num_rows if context is not None else 0, sum(x.num_rows for x in parts)
            t = pa.concat_tables([*parts, pa.Table.from_batches([batch])])
            matches, begin = compared(t, old, known)
            yield matches
            if opening:
                first = int(begin[1]) if len(begin) > 1 else t.num_rows
                if first > known:
                    yield edge(t.slice(known, first - known), 1)
                if len(begin) > 1:
                    yield edge(t.slice(first, 1), 2)
                    opening = False
            last = int(begin[-1])
            context = t.slice(last - 1, 1).combine_chunks() if last else None
            held = t.slice(last).combine_chunks()
        if not opening:
            yield edge(context, 2)
            yield edge(held, 1)

    return records.mapInArrow(run, f"kind tinyint, {_RECORD}, start bigint, end bigint, other binary")


def _compared(records: DataFrame, least: int, order: list[str]) -> DataFrame:
    """The matches of neighbours in this order (kinds 0 and 4), and the records that may share more (kind 3)."""
    keys = ["suffix", *order, "cls", "at"]
    ordered = records.repartitionByRange(*keys).sortWithinPartitions(*keys)
    found = materialize(_neighbours(ordered.withColumn("silent", F.lit(False)), least, order), "neighbours")
    # two runs of each partition at most and two records beside: some rows for each partition, and a document's repeats
    edges = found.where("kind in (1, 2)").groupBy("suffix", "cls", "at", "last", "after", "before").agg((F.min("kind") == 2).alias("silent"))
    between = _neighbours(edges.repartition(1).sortWithinPartitions(*keys), least, order)
    return found.where("kind in (0, 3, 4)").unionByName(between.where("kind in (0, 3, 4)")).drop("after", "before")


def _matches(records: DataFrame, least: int, order: list[str]) -> DataFrame:
    """(cls, start, end, other) of the matches of neighbours in this order."""
    return _compared(records, least, order).where("kind = 0").select("cls", "start", "end", "other")


def _open_windows(after: DataFrame, before: DataFrame, side: int) -> DataFrame:
    """(suffix, cls, at, windows) in question: within the words that neighbours on either side share, and not in a match; a written table."""
    of = lambda df, a, b: df.where("kind = 3").select("suffix", "cls", "at", a.alias("after"), b.alias("before"), F.col("end").alias("held"))
    none, reach = F.lit(None).cast("long"), F.col("start")
    each = of(after, reach, none).unionByName(of(before, none, reach)).groupBy("suffix", "cls", "at").agg(F.max("after").alias("after"), F.max("before").alias("before"), F.bit_or("held").alias("held"))
    power = lambda n: F.expr(f"shiftleft(1L, cast({n} as int))")
    allowed = (power("after + 1") - 1).bitwiseAND(F.bitwise_not(power(f"{side} - before") - 1))
    left = allowed.bitwiseAND(F.bitwise_not("held"))
    # a side without a row allows all, and what it allows is in its matches
    return materialize(each.where(f"after is not null and before is not null and after + before >= {side}").select("suffix", "cls", "at", left.alias("windows")).where("windows != 0"), "windows")


def _windows_of(batch: pa.RecordBatch, side: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, words from the window's first one to the suffix) of the ``windows`` of (suffix, after, before, windows) that lie within their texts."""
    n = batch.num_rows
    wide = [np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u4").reshape(n, side).astype(np.uint64) for c in ("after", "before")]
    suffix, wanted = batch.column("suffix").to_numpy(), batch.column("windows").to_numpy()
    rows, hashes, ahead = [], [], []
    for j in range(side + 1):
        words = np.concatenate([wide[1][:, : side - j], wide[0][:, :j]], axis=1)
        i = np.flatnonzero((wanted >> j & 1 == 1) & (words != 0).all(axis=1))
        h = mix(suffix[i].view(np.uint64), j)
        for c in range(side):
            h = mix(h * _ODD + words[i, c], 1)
        rows.append(i)
        hashes.append(h.view(np.int64))
        ahead.append(np.full(len(i), side - j))
    return np.concatenate(rows), np.concatenate(hashes), np.concatenate(ahead)


def _window_hashes(records: DataFrame, side: int) -> DataFrame:
    """(window, cls, start, more) of the records' ``windows``; more: how far the record's last position is."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows, hashes, ahead = _windows_of(batch, side)
            at = batch.column("at").to_numpy().astype(np.int64)
            more = batch.column("last").to_numpy().astype(np.int64) - at
            return pa.RecordBatch.from_arrays([pa.array(hashes), batch.column("cls").take(pa.array(rows)), pa.array(at[rows] - ahead), pa.array(more[rows])], names=["window", "cls", "start", "more"])

        return step

    return arrow_map(records.select("suffix", "cls", "at", "after", "before", "windows", "last"), make, "window bigint, cls binary, start bigint, more bigint", SORTED_ROWS)


def _window_classes(records: DataFrame, side: int) -> DataFrame:
    """(window, cls): the least and the largest class of those that hold a window, among records that are read together."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows, hashes, _ = _windows_of(batch, side)
            _, rank = np.unique(np.array(batch.column("cls").to_pylist(), object), return_inverse=True)
            order = np.lexsort((rank[rows], hashes))
            rows, hashes, rank = rows[order], hashes[order], rank[rows[order]]
            new = np.ones(len(rows) + 1, bool)
            new[1:-1] = hashes[1:] != hashes[:-1]
            keep = new[:-1] | new[1:] & (rank != rank[np.flatnonzero(new[:-1])][np.cumsum(new[:-1]) - 1])
            return pa.RecordBatch.from_arrays([pa.array(hashes[keep]), batch.column("cls").take(pa.array(rows[keep]))], names=["window", "cls"])

        return step

    return arrow_map(records.select("suffix", "cls", "after", "before", "windows"), make, "window bigint, cls binary", SORTED_ROWS)


def _held_windows(near: DataFrame, asked: DataFrame, side: int) -> DataFrame:
    """(window, cls) of the records' windows that are asked for. They meet by the whole hash: what passes is held by an asked window's
    classes, however many windows there are."""
    return _window_classes(near, side).join(asked.select("window").distinct(), "window", "left_semi")


def _window_matches(records: DataFrame, windows: DataFrame, least: int) -> DataFrame:
    """(cls, start, end, other) of the windows in question that several classes hold."""
    of_suffix = materialize(windows.groupBy("suffix").agg(F.bit_or("windows").alias("windows")), "of-suffix")
    bucket = F.pmod(F.col("suffix"), F.lit(BUCKETS)).alias("bucket")
    near = records.withColumn("bucket", bucket).join(F.broadcast(of_suffix.select(bucket).distinct()), "bucket", "left_semi").drop("bucket").join(of_suffix, "suffix")
    near = materialize(near.join(windows.select("suffix", "cls", "at", F.col("windows").alias("asked")), ["suffix", "cls", "at"], "left"), "near")
    asked = materialize(_window_hashes(near.where("asked is not null").withColumn("windows", F.col("asked")), least - K), "asked")
    found = _held_windows(near, asked, least - K)
    several = materialize(found.groupBy("window").agg(F.min("cls").alias("x"), F.max("cls").alias("y")).where("x != y"), "several")
    discard(of_suffix, near)
    # only for those that ask: the others' matches hold all the windows that they share
    return asked.join(several, "window").select("cls", "start", (F.col("start") + least + F.col("more")).alias("end"), F.when(F.col("cls") == F.col("x"), F.col("y")).otherwise(F.col("x")).alias("other"))


def repeated_passages(docs: DataFrame, least: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row and maximal stretch of its words that other documents hold in passages of ``least`` words or
    more: id, n_words, start_word, end_word (exclusive) and other_id, the least id of some document that shares it.

    Words are separated by white space and lower-cased (A-Z). Of equal word sequences of ``least`` words or more, every copy
    is one whole stretch; its other_id is the least id of the copies (for that one itself: its own). A passage that only
    one document repeats within itself isn't reported. Null and empty texts, and those with fewer words, have no
    rows; nor has an empty table. Rows with a null id can match others and are reported with it; repeated rows are copies. Very long
    texts are read whole. ``least`` is 21 to 82 words. Other columns aren't read.
    """
    if not K < least <= K + 62:
        raise ValueError(f"least must be over {K} and at most {K + 62}")
    every = materialize(_anchors(docs, least, id_col, text_col), "suffixes")
    rows, kept = every.where("kind = 0").select("_id", "doc_key", "cls", "n"), every.where("kind = 1").select("cls", "suffix", "at")
    shared = kept.groupBy("suffix").agg(F.min("cls").alias("x"), F.max("cls").alias("y")).where("x != y").select("suffix")
    # written before the join: a side that is an aggregate keeps Spark from splitting a frequent suffix of the other side
    shared = materialize(shared, "shared")
    wanted = materialize(kept.join(shared, "suffix").groupBy("cls").agg(F.collect_set("at").alias("wanted")), "wanted")
    of_class = rows.where(F.col("n") >= least).groupBy("cls").agg(F.min("_id").alias("first"), F.count(F.lit(1)).alias("copies"), F.min("doc_key").alias("doc_key"))
    of_class = materialize(of_class.join(wanted.select("cls", F.lit(True).alias("partly")), "cls", "left"), "of-class")
    chosen = of_class.where("partly").join(wanted, "cls").select("doc_key", "wanted")
    texts = docs.select(F.xxhash64(id_col, text_col).alias("doc_key"), F.col(text_col).alias("text")).join(chosen, "doc_key").select("text", "wanted")
    records = materialize(_contexts(texts, least), "contexts")
    discard(shared, wanted)
    after, before = _compared(records, least, ["after", "before"]), _compared(records, least, ["before", "after"])
    windows = _open_windows(after, before, least - K)
    columns = ["cls", "start", "end", "other"]
    matches = after.where("kind != 3").select(*columns).unionByName(before.where("kind != 3").select(*columns)).unionByName(_window_matches(records, windows, least))
    spans = materialize(matches.groupBy("cls", "start", "end").agg(F.min("other").alias("other")), "spans")
    discard(records, windows)

    grouped = spans.groupBy("cls").agg(F.array_sort(F.collect_list(F.struct("start", "end", "other"))).alias("spans"))

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            cls, starts, ends, others = [], [], [], []
            for key, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for s in found:
                    if cls and cls[-1] == key and s["start"] <= ends[-1]:
                        ends[-1] = max(ends[-1], s["end"])
                    else:
                        cls.append(key)
                        starts.append(s["start"])
                        ends.append(s["end"])
                        others.append(s["other"])
            columns = [pa.array(cls, pa.binary()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array(others, pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["cls", "start_word", "end_word", "other"])

        return step

    merged = arrow_map(grouped, make, "cls binary, start_word bigint, end_word bigint, other binary")
    firsts = of_class.select(F.col("cls").alias("other"), F.col("first").alias("other_id"))
    partly = merged.join(firsts, "other").select("cls", "start_word", "end_word", "other_id")
    single = of_class.where("copies = 1").select("cls").join(partly, "cls")
    out = rows.join(single, "cls").select("_id", "n", "start_word", "end_word", "other_id")
    whole = rows.join(of_class.where("copies > 1").select("cls", "first"), "cls").select("_id", "n", F.lit(0).cast("long").alias("start_word"), F.col("n").alias("end_word"), F.col("first").alias("other_id"))
    out = out.unionByName(whole)
    return out.select(F.col("_id").alias(id_col), F.col("n").alias("n_words"), "start_word", "end_word", "other_id")
