"""Benchmark decontamination by pigeonhole edit matching.

Each benchmark item, lower-cased and with every run of other characters than letters and digits as one space, is cut into
segments of at most 64 characters. A segment with an error budget of e is split into e + 1 pieces: wherever it occurs with at
most e edits, one of its pieces occurs unchanged. Documents are searched for the pieces by rolling hashes, and around
each hit Myers' bit-parallel distance, run over many hits at once, decides whether the segment is there. From a piece of a
segment that is there, the match is followed left and right over the item for as long as the characters agree.

Many texts are searched at once, laid end to end; pieces, matches and what follows them stay within one text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quarrygraph.llm.common import arrow_map

WORD = 64
#: Entries (segments times distinct characters) of one block's match table: 8 bytes each.
BLOCK_ENTRIES = 1 << 22


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point, its lower-case code point (where that is one) and whether it is a letter or digit."""
    found = getattr(_tables, "found", None)
    if found is None:
        n = 0x110000
        lower, alnum = np.arange(n, dtype=np.uint32), np.zeros(n, bool)
        for c in range(n):
            ch = chr(c)
            if ch.isalnum():
                alnum[c] = True
                if len(low := ch.lower()) == 1:
                    lower[c] = ord(low)
        found = _tables.found = lower, alnum
    return found


#: Code points that are looked at in one go, so that what a very long text needs besides its own characters is bounded.
STRETCH = 1 << 20


class Texts:
    """Texts normalized and laid end to end, each begun by a space. ``codes``: their code points; ``begins``: where each begins,
    and the end."""

    def __init__(self, texts: list[str]):
        lower, alnum = _tables()
        flat = np.frombuffer(("\n" + "\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
        self.raw = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) + 1 for t in texts], out=self.raw[1:])
        self.kept = np.zeros(len(flat), bool)
        codes, ends = [], [0]
        for k in range(0, len(flat), STRETCH):
            part = flat[k : k + STRETCH]
            ok = alnum[part]
            keep = self.kept[k : k + STRETCH]
            keep[:] = ok
            keep[1:] |= ok[:-1]  # one space after each word
            keep[:1] |= k > 0 and alnum[flat[k - 1]]
            keep[self.raw[(self.raw >= k) & (self.raw < k + STRETCH)] - k] = True
            codes.append(np.where(ok, lower[part], 32).astype(np.uint32)[keep])
            ends.append(ends[-1] + len(codes[-1]))
        self.codes, self.ends = np.concatenate(codes), np.array(ends)
        before = np.array([np.count_nonzero(self.kept[x // STRETCH * STRETCH : x]) for x in self.raw.tolist()])
        self.begins = self.ends[self.raw // STRETCH] + before

    def ends_of(self, text: np.ndarray) -> np.ndarray:
        """Where each of these texts ends: behind the space that begins the next one."""
        return self.begins[text + 1] + 1

    def origin(self, at: int, text: int) -> int:
        """The place in its text of a code point kept."""
        k = int(np.searchsorted(self.ends, at, "right")) - 1
        place = k * STRETCH + int(np.flatnonzero(self.kept[k * STRETCH : (k + 1) * STRETCH])[at - self.ends[k]])
        return min(place, int(self.raw[text + 1]) - 1) - int(self.raw[text]) - 1


def normalize(text: str) -> np.ndarray:
    """The code points of one normalized text, without spaces at its ends."""
    codes = Texts([text]).codes[1:-1]
    return codes[:-1] if len(codes) and codes[-1] == 32 else codes


@dataclass
class Block:
    """Segments of some items. ``start``: of each segment in its item; ``pieces``: sorted hashes; ``owner``: (segment, offset) of
    each; ``classes``: the column of each code point in the match table; ``short``: hashes of items shorter than a piece."""

    items: list
    codes: np.ndarray
    bounds: np.ndarray
    item_of: np.ndarray
    start: np.ndarray
    lengths: np.ndarray
    budgets: np.ndarray
    pieces: np.ndarray
    owner: np.ndarray
    classes: np.ndarray
    table: np.ndarray
    short: dict
    q: int

    @classmethod
    def of(cls, items: list[tuple[object, np.ndarray]], q: int, least: int = 24) -> Block:
        segments, item_of, start, short = [], [], [], {}
        for i, (_, codes) in enumerate(items):
            if len(codes) < q:
                short.setdefault(codes.tobytes(), []).append(i)
                continue
            at = 0
            # a short one is searched word for word, with the spaces around it
            for part in np.array_split(codes, -(-len(codes) // WORD)) if len(codes) >= least else [np.concatenate([[32], codes, [32]]).astype(np.uint32)]:
                segments.append(part)
                item_of.append(i)
                start.append(at)
                at += len(part)
        letters = np.unique(np.concatenate([np.array([32], np.uint32), *segments]))
        classes = np.full(0x110000, len(letters), np.uint32)
        classes[letters] = np.arange(len(letters))
        table = np.zeros((len(segments), len(letters) + 1), np.uint64)
        hashes, owner, lengths, budgets = [], [], [], []
        for s, codes in enumerate(segments):
            np.bitwise_or.at(table[s], classes[codes], np.uint64(1) << np.arange(len(codes), dtype=np.uint64))
            n = max(1, len(codes) // q) if len(items[item_of[s]][1]) >= least else 1
            lengths.append(len(codes))
            budgets.append(n - 1)
            rolled = rolling(codes, q)
            for k in range(n):
                at = k * len(codes) // n
                hashes.append(rolled[at])
                owner.append((s, at))
        order = np.argsort(np.array(hashes, np.uint64), kind="stable")
        bounds = np.zeros(len(items) + 1, np.int64)
        np.cumsum([len(codes) for _, codes in items], out=bounds[1:])
        return cls([i for i, _ in items], np.concatenate([codes for _, codes in items]), bounds, np.array(item_of, np.int64), np.array(start, np.int64), np.array(lengths, np.int64),
                   np.array(budgets, np.int64), np.array(hashes, np.uint64)[order], np.array(owner, np.int64).reshape(-1, 2)[order], classes, table, short, q)

    def hits(self, texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(segment, where it would begin, offset of the piece, text) of each piece's exact hits, one for each place of a segment."""
        flags = np.zeros(1 << 20, bool)
        flags[self.pieces >> np.uint64(44)] = True
        found = []
        for k in range(0, len(texts.codes), STRETCH):
            rolled = rolling(texts.codes[k : k + STRETCH + self.q - 1], self.q)
            at = np.flatnonzero(flags[rolled >> np.uint64(44)])
            low, high = np.searchsorted(self.pieces, rolled[at], "left"), np.searchsorted(self.pieces, rolled[at], "right")
            n = high - low
            at, first = np.repeat(at, n) + k, np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
            text = np.searchsorted(texts.begins, at, "right") - 1
            inside = at + self.q <= texts.ends_of(text)
            segment, offset = self.owner[first[inside], 0], self.owner[first[inside], 1]
            found.append(np.stack([segment, at[inside] - offset, text[inside], offset], axis=1))
        rows = np.concatenate(found)
        _, one = np.unique(rows[:, :3], axis=0, return_index=True)
        segment, begin, text, offset = rows[one].T
        return segment, begin, offset, text

    def verify(self, texts: Texts, segment: np.ndarray, begin: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(least distance of each segment around its place within the text, the end of that match) by Myers' algorithm on all at once."""
        one, m, e = np.uint64(1), self.lengths[segment], self.budgets[segment]
        top = one << (m - 1).astype(np.uint64)
        vp, vn = np.full(len(segment), ~np.uint64(0)), np.zeros(len(segment), np.uint64)
        score, best, end = m.copy(), m.copy(), begin.copy()
        start, low, high = begin - e, texts.begins[text], texts.ends_of(text)
        for j in range(int((m + 2 * e).max(initial=0))):
            at = start + j
            inside = (at >= low) & (at < high) & (j < m + 2 * e)
            eq = np.where(inside, self.table[segment, self.classes[texts.codes[np.where(inside, at, 0)]]], np.uint64(0))
            xv = eq | vn
            xh = (((eq & vp) + vp) ^ vp) | eq
            hp, hn = vn | ~(xh | vp), vp & xh
            score = score + ((hp & top) != 0) - ((hn & top) != 0)
            hp, hn = hp << one, hn << one
            vp, vn = hn | ~(xv | hp), hp & xv
            better = inside & (score < best)
            best, end = np.where(better, score, best), np.where(better, at + 1, end)
        return best, end

    def followed(self, texts: Texts, segment: np.ndarray, begin: np.ndarray, offset: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first and last place in its item, place in the texts) of the characters that agree around each hit."""
        item = self.item_of[segment]
        own, at = self.bounds[item] + self.start[segment] + offset, begin + offset
        reach = []
        for step, first, stop, edge in ((-1, -1, self.bounds[item] - 1, texts.begins[text] - 1), (1, self.q, self.bounds[item + 1], texts.ends_of(text))):
            n, i = np.full(len(own), first, np.int64), np.arange(len(own))
            while len(i):
                ok = (own[i] + n[i] != stop[i]) & (at[i] + n[i] != edge[i])
                i = i[ok]
                i = i[self.codes[own[i] + n[i]] == texts.codes[at[i] + n[i]]]
                n[i] += step
            reach.append(n)
        base = own - self.bounds[item]
        return base + reach[0] + 1, base + reach[1], at + reach[0] + 1


def rolling(codes: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of the q code points from each position that has them."""
    n = len(codes) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    wide = codes.astype(np.uint64)
    h = wide[:n].copy()
    for k in range(1, q):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += wide[k : k + n]
    h ^= h >> np.uint64(29)
    return h * np.uint64(0xBF58476D1CE4E5B9)


def item_blocks(benchmark: DataFrame, q: int, least: int, id_col: str, text_col: str) -> Iterator[Block]:
    """The benchmark in blocks of bounded size, read one partition at a time."""
    items: list[tuple[object, np.ndarray]] = []
    letters: set[int] = set()
    segments = 0
    for key, text in benchmark.select(id_col, text_col).toLocalIterator():
        codes = normalize(text or "")
        if not len(codes):
            continue
        more, n = letters | set(codes.tolist()), segments + -(-len(codes) // WORD)
        if items and len(more) * n > BLOCK_ENTRIES:
            yield Block.of(items, q, least)
            items, more, n = [], set(codes.tolist()), -(-len(codes) // WORD)
        items.append((key, codes))
        letters, segments = more, n
    if items:
        yield Block.of(items, q, least)


def search(block: Block, texts: list[str]) -> list[tuple[int, int, int, int, float, int, int, int]]:
    """(text, item, segments found, segments, share of the item's characters found, edits, start, end) of every text and item
    with a segment found, positions in the text's code points. An item shorter than a piece is found where it is all of a text."""
    laid = Texts(texts)
    segment, begin, offset, text = block.hits(laid)
    best, end = np.zeros(len(segment), np.int64), np.zeros(len(segment), np.int64)
    for k in range(0, len(segment), 1 << 16):
        part = slice(k, k + (1 << 16))
        best[part], end[part] = block.verify(laid, segment[part], begin[part], text[part])
    good = best <= block.budgets[segment]
    segment, begin, offset, text, best, end = (x[good] for x in (segment, begin, offset, text, best, end))
    first, last, place = block.followed(laid, segment, begin, offset, text)
    found: dict[tuple[int, int], list[tuple]] = {}
    for row in zip(text.tolist(), block.item_of[segment].tolist(), segment.tolist(), best.tolist(), end.tolist(), first.tolist(), last.tolist(), place.tolist(), strict=True):
        found.setdefault(row[:2], []).append(row[2:])
    out = []
    for (t, i), rows in sorted(found.items()):
        edits: dict[int, int] = {}
        for s, b, *_ in rows:
            edits[s] = min(edits.get(s, b), b)
        size = int(block.bounds[i + 1] - block.bounds[i])
        held = np.zeros(size, bool)
        for s in edits:
            held[block.start[s] : block.start[s] + block.lengths[s]] = True
        for *_, a, z, _ in rows:
            held[max(a, 0) : z] = True
        low = max(int(laid.begins[t]), min(min(e - int(block.lengths[s]), p) for s, _, e, _, _, p in rows))
        high = max(max(e, p + z - a) for _, _, e, a, z, p in rows)
        out.append((t, i, len(edits), int((block.item_of == i).sum()), float(held.mean()), sum(edits.values()), max(laid.origin(low, t), 0), laid.origin(high - 1, t) + 1))
    # a text between the space that begins it and that of the next one; one space at most may end it
    for t in np.flatnonzero(np.diff(laid.begins) <= block.q + 1).tolist() if block.short else ():
        own = laid.codes[laid.begins[t] + 1 : laid.begins[t + 1]]
        for i in block.short.get((own[:-1] if len(own) and own[-1] == 32 else own).tobytes(), ()):
            out.append((t, i, 0, 0, 1.0, 0, 0, len(texts[t])))
    return out


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, least_share: float = 0.4, q: int = 9, least: int = 24,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """One row per document row and benchmark item of which the document holds at least ``least_share`` of the characters: id,
    item, segments found, segments, share, edits, and start and end of the found stretch in the text.

    A segment of n characters may differ by n // q - 1 edits (6 of 64 with q = 9). What is found are segments, and the characters
    around them that agree: a word-for-word quotation of 127 characters or more holds a segment and is covered in full,
    a shorter one if it holds a segment. Items that normalized have fewer than ``least`` characters are searched word for word, those
    with fewer than q as a whole text; null and empty ones match nothing. Null and empty texts hold nothing; very long texts
    are searched whole, a stretch at a time. Repeated rows of either table give rows of their own; without documents or
    items there are none. The benchmark is searched for in blocks of bounded size, however many items it has; other columns
    aren't read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    item_kind = benchmark.schema[item_col].dataType
    schema = f"_id {kind}, _item {item_kind.simpleString()}, segments int, of_segments int, share double, edits int, start bigint, end bigint"
    rows, spark = docs.select(id_col, text_col), docs.sparkSession
    out = None
    for block in item_blocks(benchmark, q, least, item_col, item_text_col):

        def make(block=block):
            from pyspark.sql.pandas.types import to_arrow_type

            types = [to_arrow_type(item_kind), pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.int64(), pa.int64()]

            def step(batch: pa.RecordBatch) -> pa.RecordBatch:
                found = [f for f in search(block, [t or "" for t in batch.column(1).to_pylist()]) if f[4] >= least_share]
                columns = [batch.column(0).take(pa.array([f[0] for f in found], pa.int64())), pa.array([block.items[f[1]] for f in found], types[0])]
                columns += [pa.array([f[k + 1] for f in found], types[k]) for k in range(1, 7)]
                return pa.RecordBatch.from_arrays(columns, names=["_id", "_item", "segments", "of_segments", "share", "edits", "start", "end"])

            return step

        part = arrow_map(rows, make, schema)
        out = part if out is None else out.unionByName(part)
    out = spark.createDataFrame([], schema) if out is None else out
    return out.withColumnRenamed("_id", id_col).withColumnRenamed("_item", item_col)


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, least_share: float = 0.4, q: int = 9, least: int = 24, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """The rows of ``docs`` that :func:`find_contamination` finds nothing in, with all their columns. Rows with a null or empty
    text stay, and so do repeated rows; without items all rows stay, and an empty table stays empty."""
    at = docs.columns.index(text_col)
    for block in item_blocks(benchmark, q, least, item_col, item_text_col):

        def make(block=block):
            def step(batch: pa.RecordBatch) -> pa.RecordBatch:
                clean = np.ones(batch.num_rows, bool)
                for f in search(block, [t or "" for t in batch.column(at).to_pylist()]):
                    clean[f[0]] &= f[4] < least_share
                return batch.filter(pa.array(clean))

            return step

        docs = arrow_map(docs, make, docs.schema)
    return docs
