"""Best-fit-decreasing packing of documents into fixed windows.

1. Every document is tokenized and cut into full windows and one rest shorter than a window (a map over the documents,
   written once). Rests are ranked within their length by a prefix sum over tasks.
2. How many rests have each length (at most window - 1 numbers) is all that best-fit decreasing needs: rests of equal
   length are interchangeable. The plan goes over lengths in descending order; a segment tree indexed by remaining
   capacity finds the tightest open windows; equal windows are kept as one run, so the plan's size depends on the window
   and not on the corpus. It is exactly the packing that best-fit decreasing over single rests gives.
3. A second map looks each rest's rank up in the plan, which gives its window and offset there.

Windows that best fit leaves with a large gap (lengths that don't combine) are then filled: the emptiest windows are laid
out as one stream and cut at the gaps of the others.
"""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass, field
from functools import lru_cache
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrygraph.llm.common import arrow_map, materialize

#: Rank bases (one row for each task and length) are broadcast up to this many rows, 24 bytes each; joined by a shuffle beyond.
BROADCAST_ROWS = 1_000_000
#: Texts that are tokenized at a time, or fewer of the bytes that a batch may have: the more, the fewer distinct units are looked up.
TEXT_ROWS = 4096

_SAFE = re.compile(r"(?<=\S)(?= \S)")
#: Fixed value: the word pattern of byte-level BPE.
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space as Python's ``\s`` has it, for RE2: texts with a space beside it, at their end, or with the mark, aren't split at marks.
_WHITE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_UNSAFE = f" {_WHITE}|{_WHITE} | $|\\x00"
#: More places where a token always begins: after a Latin letter, before a mark of punctuation; after one line feed, before such a letter.
_LATIN = r"[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}]"
_BEGINS = ((f"({_LATIN})([.,;:!?])", "\\1\0\\2"), (f"([^\\pZ\\pC])\\n({_LATIN})", "\\1\n\0\\2"))
#: Units with characters from here on go to the tokenizer: which of them are letters differs between versions of Unicode.
BEYOND = "\u0250"
#: New words that go to the tokenizer's model at a time.
MODEL_WORDS = 20_000


class UnitEncoder:
    """Ids of whole texts, as little-endian integers, by a tokenizer file of the ``tokenizers`` library.

    With a byte-level BPE (as checked here), a space between two characters that aren't white space always begins a
    token: the ids of a text are those of the units split at such spaces, one after the other. Most texts are also split at
    punctuation after letters. The distinct units of a batch are looked up in a bounded cache, and the tokenizer's BPE model
    runs on new words only, many at a time. Texts that hold one of the file's added tokens, such as ``<|endoftext|>``, go to
    the tokenizer whole; so do all texts of any other tokenizer.
    """

    def __init__(self, path: str, limit: int = 800_000, longest: int = 64):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        with open(path, "rb") as f:
            spec = json.load(f)
        before, model = spec.get("pre_tokenizer") or {}, spec["model"]
        # the alphabet of byte-level BPE: printable Latin-1 characters stand for themselves, the others follow from 256
        plain = [c for c in range(256) if 33 <= c <= 126 or 161 <= c <= 172 or c >= 174]
        other = [c for c in range(256) if c not in set(plain)]
        self.alphabet = dict(zip(plain, map(chr, plain), strict=True)) | {c: chr(256 + i) for i, c in enumerate(other)}
        self.byte_level = (
            (before.get("type"), before.get("add_prefix_space"), before.get("use_regex"), model["type"]) == ("ByteLevel", False, True, "BPE")
            and not any(spec.get(k) for k in ("normalizer", "truncation", "padding"))
            and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix"))
            and all(c in model["vocab"] for c in self.alphabet.values())
        )
        self.known: dict[str, bytes] = {}
        self.limit, self.longest = limit, longest
        if self.byte_level:
            import regex

            self.added = [a["content"] for a in spec.get("added_tokens") or () if a["content"]]
            self.model = Tokenizer(self.tokenizer.model)  # no splitting: a word is what it is given
            self.find = regex.compile(_WORDS).findall
            self.sizes = np.zeros(max(model["vocab"].values()) + 1, np.int64)  # bytes of each id
            self.sizes[list(model["vocab"].values())] = [len(token) for token in model["vocab"]]

    def _bpe(self, words: list[str]) -> list[bytes]:
        """Ids of words by the model, which says nothing of where a word ends: as every byte is in some token, their sizes tell."""
        out, space, alphabet, width = [], self.alphabet[32], self.alphabet, self.dtype.itemsize
        for at in range(0, len(words), MODEL_WORDS):
            data = [
                w.replace(" ", space) if w.isascii() and w.isprintable() else w.encode().decode("latin-1").translate(alphabet)
                for w in words[at : at + MODEL_WORDS]
            ]
            ids = np.array(self.model.encode_batch_fast([data], is_pretokenized=True, add_special_tokens=False)[0].ids, self.dtype)
            ends = np.searchsorted(np.cumsum(self.sizes[ids]), np.cumsum([len(d) for d in data])) + 1
            raw, start = ids.tobytes(), 0
            for end in (ends * width).tolist():
                out.append(raw[start:end])
                start = end
        return out

    def _ids_of(self, units: list[str]) -> list[bytes]:
        """Ids of distinct units; those that aren't known yet are encoded, and kept if they are short, as their words are."""
        known = self.known
        out = list(map(known.get, units))
        new = [unit for unit, ids in zip(units, out, strict=True) if ids is None]
        if new:
            beyond = [unit for unit in new if not unit.isascii() and max(unit) >= BEYOND]
            whole = dict(zip(beyond, self._whole(beyond), strict=True))
            more = dict.fromkeys(unit for unit in new if unit.removeprefix(" ").isalpha() and unit not in whole)
            mixed = {unit: self.find(unit) for unit in new if unit not in more and unit not in whole}
            more.update(dict.fromkeys(word for words in mixed.values() for word in words if word not in known))
            more = whole | dict(zip(more, self._bpe(list(more)), strict=True))
            for unit, words in mixed.items():
                if unit not in more:
                    more[unit] = b"".join([more[word] if word in more else known[word] for word in words])
            out = [more[unit] if ids is None else ids for unit, ids in zip(units, out, strict=True)]
            known.update(more if max(map(len, more)) <= self.longest else {k: v for k, v in more.items() if len(k) <= self.longest})
        return out

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        if not self.byte_level:
            return self._whole(texts.to_pylist())
        special = np.zeros(len(texts), bool)
        for token in self.added:
            special |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        odd = pc.match_substring_regex(texts, _UNSAFE).to_numpy(zero_copy_only=False) & ~special
        out = [b""] * len(texts)
        for rows, ids in ((special, lambda of: self._whole(of.to_pylist())), (odd, self._split), (~(special | odd), self._marked)):
            at = np.flatnonzero(rows)
            if len(at):
                for i, data in zip(at.tolist(), ids(texts.take(pa.array(at))), strict=True):
                    out[i] = data
        return out

    def _split(self, texts: pa.Array) -> list[bytes]:
        return self._joined(pa.array(map(_SAFE.split, texts.to_pylist()), pa.list_(pa.string())))

    def _marked(self, texts: pa.Array) -> list[bytes]:
        texts = pc.replace_substring(texts, " ", "\0 ")
        for pattern, to in _BEGINS:
            texts = pc.replace_substring_regex(texts, pattern, to)
        return self._joined(pc.split_pattern(texts, "\0"))

    def _joined(self, units: pa.ListArray) -> list[bytes]:
        """Ids of texts that are given in units."""
        if len(self.known) > self.limit:
            self.known.clear()
        coded = units.flatten().dictionary_encode()
        ids = pa.array(self._ids_of(coded.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary()).take(coded.indices)
        ends = np.frombuffer(ids.buffers()[1], np.int64, len(ids) + 1)[units.offsets.to_numpy()].tolist()
        data = memoryview(ids.buffers()[2] or b"")
        return [bytes(data[start:end]) for start, end in zip(ends, ends[1:])]  # noqa: B905


@lru_cache(maxsize=1)
def shared_encoder(path: str, job: str) -> UnitEncoder:
    """The encoder of this Python worker for one packing: its tasks there go on with the units known so far, other packings don't."""
    return UnitEncoder(path)


class CapacityTree:
    """A segment tree over remaining capacities 0 .. n that counts runs of open windows."""

    def __init__(self, n: int):
        self.size = 1 << n.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, capacity: int, by: int) -> None:
        at = capacity + self.size
        while at:
            self.count[at] += by
            at >>= 1

    def tightest(self, length: int) -> int | None:
        """The least capacity of at least ``length`` with an open window."""
        at = length + self.size
        if self.count[at]:
            return length
        while at > 1:
            if not at & 1 and self.count[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.count[2 * at] else 2 * at + 1
                return at - self.size
            at >>= 1
        return None


@dataclass
class Plan:
    """Where rests go. ``segments[length]``: arrays (first rank, rests in a window, first window, offset)."""

    window: int
    segments: dict[int, np.ndarray]
    windows: int
    dropped: np.ndarray = field(default_factory=lambda: np.zeros((0, 4), np.int64))  # first window, count, fill, first place in the stream
    gaps: np.ndarray = field(default_factory=lambda: np.zeros((0, 5), np.int64))  # first window, count, fill, gap, first place

    def place(self, length: int, rank: int) -> list[tuple[int, int, int]]:
        """[(window, offset, length of the piece), ...] for the rest of this length and rank."""
        rows = self.segments[length]
        first, each, window, offset = rows[np.searchsorted(rows[:, 0], rank, "right") - 1]
        at = rank - first
        window, offset = window + at // each, offset + at % each * length
        k = np.searchsorted(self.dropped[:, 0], window, "right") - 1
        if k < 0 or window >= self.dropped[k, 0] + self.dropped[k, 1]:
            return [(self._number(window), int(offset), length)]
        place, out = self.dropped[k, 3] + (window - self.dropped[k, 0]) * self.dropped[k, 2] + offset, []
        while length:
            g = self.gaps[np.searchsorted(self.gaps[:, 4], place, "right") - 1]
            i, inside = divmod(place - g[4], g[3])
            piece = int(min(length, g[3] - inside))
            out.append((self._number(g[0] + i), int(g[2] + inside), piece))
            place, length = place + piece, length - piece
        return out

    def _number(self, window: int) -> int:
        """The window's number once dropped ones are gone."""
        k = np.searchsorted(self.dropped[:, 0], window, "right")
        return int(window - self.dropped[:k, 1].sum())


def plan_best_fit(counts: dict[int, int], window: int = 1024, least_gap: int = 16) -> Plan:
    """Best-fit decreasing over ``counts`` rests of each length; gaps of ``least_gap`` or more are then filled by cutting."""
    tree, runs = CapacityTree(window), {}  # runs[capacity]: [(first window, count)]
    segments: dict[int, list[tuple[int, int, int, int]]] = {}
    opened = 0

    def put(capacity: int, first: int, count: int) -> None:
        if count:
            runs.setdefault(capacity, []).append((first, count))
            tree.add(capacity, 1)

    for length in sorted((x for x, n in counts.items() if n and x < window), reverse=True):
        left, rank, rows = counts[length], 0, []
        while left:
            capacity = tree.tightest(length)
            if capacity is None:
                capacity = window
                first, count = opened, -(-left // (window // length))
                opened += count
            else:
                first, count = runs[capacity].pop()
                tree.add(capacity, -1)
            each = capacity // length
            whole, part = min(count, left // each), 0
            if whole < count:
                part = left - whole * each
            rows.append((rank, each, first, window - capacity))
            placed = whole * each + part
            put(capacity - each * length, first, whole)
            if part:
                put(capacity - part * length, first + whole, 1)
            put(capacity, first + whole + bool(part), count - whole - bool(part))
            rank, left = rank + placed, left - placed
        segments[length] = rows
    plan = Plan(window, {k: np.array(v, np.int64) for k, v in segments.items()}, opened)
    _fill_gaps(plan, [(first, count, window - capacity) for capacity, of in runs.items() for first, count in of], least_gap)
    return plan


def _fill_gaps(plan: Plan, runs: list[tuple[int, int, int]], least_gap: int) -> None:
    """Drop as many of the emptiest windows as the gaps of the other windows can take."""
    runs = sorted(((fill, first, count) for first, count, fill in runs if plan.window - fill >= least_gap), key=lambda r: (r[0], r[1]))
    room = sum((plan.window - fill) * count for fill, _, count in runs)
    stream, dropped, kept = 0, [], []
    for fill, first, count in runs:
        # dropping n windows takes n * fill tokens out and n gaps away
        n = min(count, max(0, room - stream) // plan.window) if not kept else 0
        if n:
            dropped.append((first, n, fill, stream))
            stream += n * fill
            room -= n * (plan.window - fill)
        if n < count:
            kept.append((first + n, count - n, fill, plan.window - fill))
    place, gaps = 0, []
    for first, count, fill, gap in reversed(kept):
        gaps.append((first, count, fill, gap, place))
        place += count * gap
    if dropped:
        order = sorted(dropped)
        plan.dropped, plan.gaps = np.array(order, np.int64), np.array(gaps, np.int64)


def _tokenized(docs: DataFrame, tokenizer: str, window: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """Full windows and rests with their ids, and each one's rank among those of its task and length."""
    kind, job = docs.schema[id_col].dataType.simpleString(), uuid4().hex

    def make():
        encoder, ranks, task = shared_encoder(tokenizer, job), {}, TaskContext.get().partitionId()
        end = np.array([end_id], encoder.dtype).tobytes()
        width = encoder.dtype.itemsize

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            keys, totals, starts, lengths, ids, rank = [], [], [], [], [], []
            for i, data in enumerate(encoder.encode(batch.column(1))):
                data += end
                total = len(data) // width
                for start in range(0, total, window):
                    n = min(window, total - start)
                    keys.append(i)
                    totals.append(total)
                    starts.append(start)
                    lengths.append(n)
                    ids.append(data[start * width : (start + n) * width])
                    rank.append(ranks.get(n, 0))
                    ranks[n] = rank[-1] + 1
            n = len(keys)
            columns = [batch.column(0).take(pa.array(keys, pa.int64())), pa.array(totals, pa.int64()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int32()),
                       pa.array(ids, pa.binary()), pa.array([width] * n, pa.int32()), pa.array([task] * n, pa.int32()), pa.array(rank, pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=["_id", "doc_tokens", "start", "length", "ids", "width", "task", "rank"])

        return step

    return arrow_map(docs.select(id_col, text_col), make, f"_id {kind}, doc_tokens bigint, start bigint, length int, ids binary, width int, task int, rank bigint", TEXT_ROWS)


def pack_documents(
    docs: DataFrame, tokenizer: str, window: int = 1024, end_id: int = 0, least_gap: int = 16, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per piece: id, start (the document's ids before it), length, ``ids`` (binary, little-endian unsigned 32-bit),
    doc_tokens (the document's ids with the closing ``end_id``), sequence_id and offset in that sequence.

    ``tokenizer`` is the path of a tokenizer file that all executors can open. A null or empty text has the closing id only.
    Repeated rows are packed as separate documents, a null id stays null; an empty table gives no rows. Full windows
    are sequences of their own; then follow the windows of rests, their offsets gapless from 0.
    """
    pieces = materialize(_tokenized(docs, tokenizer, window, end_id, id_col, text_col), "pieces")
    per_task = pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = materialize(per_task.select("task", "length", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "ranks")
    counts = {r["length"]: r["n"] for r in base.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = plan_best_fit(counts, window, least_gap)
    full = counts.get(window, 0)
    base = base.select("task", "length", "base")
    if base.count() <= BROADCAST_ROWS:
        base = F.broadcast(base)
    ranked = pieces.join(base, ["task", "length"]).select("_id", "doc_tokens", "start", "length", "ids", "width", (F.col("base") + F.col("rank")).alias("rank"))
    kind = ranked.schema["_id"].dataType.simpleString()

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            keys, totals, starts, lengths, ids, sequences, offsets = [], [], [], [], [], [], []
            for i, (total, start, length, data, width, rank) in enumerate(zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True)):
                wide = data if width == 4 else np.frombuffer(data, "<u2").astype("<u4").tobytes()
                done = 0
                for sequence, offset, n in [(rank, 0, length)] if length == window else plan.place(length, rank):
                    keys.append(i)
                    totals.append(total)
                    starts.append(start + done)
                    lengths.append(n)
                    ids.append(wide[4 * done : 4 * (done + n)])
                    sequences.append(sequence if length == window else full + sequence)
                    offsets.append(offset)
                    done += n
            long = lambda x: pa.array(x, pa.int64())
            columns = [batch.column(0).take(long(keys)), long(starts), long(lengths), pa.array(ids, pa.binary()), long(totals), long(sequences), long(offsets)]
            return pa.RecordBatch.from_arrays(columns, names=["_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        return step

    schema = f"_id {kind}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"
    return arrow_map(ranked, make, schema, 2048).withColumnRenamed("_id", id_col)
