"""Fill-in-the-middle transformation of texts, by a scan of chunks with a two-state automaton.

A text's units are runs of letters A-Z and a-z, and every other code point. State 1 of the automaton is "within a run", state 0 is
not; a unit begins at a letter in state 0 and at any other code point. What a chunk does is a function: for each start state
the state behind it and how many units begin in it. Functions compose associatively, so chunks of one text are read by
different tasks; a composed scan gives each chunk its entry state and the units before it, and only the chunk that holds a
wanted unit looks for its place. Texts of one chunk are transformed where they are read, with no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrygraph.llm.common import arrow_map, cut_batches, discard, materialize

#: Bytes of a chunk.
CHUNK = 1 << 16
#: The sentinels of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
_FORMS = ("plain", "psm", "spm")


def _letters(data: np.ndarray) -> np.ndarray:
    return ((data | np.uint8(32)) - np.uint8(97)) < 26


def scan(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(whether a unit begins at each byte if its chunk is entered in state 0; states behind each chunk (chunk, start state); how many
    units begin in it (chunk, start state)). ``begins``: the chunks' first bytes and the end of the last; UTF-8."""
    letter = _letters(data)
    inner = np.zeros(len(data), bool)
    inner[1:] = letter[:-1]
    filled = begins[:-1] < begins[1:]
    inner[begins[:-1][filled]] = False
    unit = np.where(letter, ~inner, data & 0xC0 != 0x80)
    total = np.concatenate([[0], np.cumsum(unit)])
    n = total[begins[1:]] - total[begins[:-1]]
    behind, counts = np.tile(np.arange(2), (len(n), 1)), np.stack([n, n], axis=1)
    behind[filled] = letter[begins[1:][filled] - 1][:, None]
    counts[filled, 1] -= letter[begins[:-1][filled]]  # such a chunk goes on with the run before it
    return unit, behind, counts


def compose(behind: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry state of each chunk, units before it; one more of both for the end), from state 0, by doubling: the function of
    2, 4, 8 ... chunks up to each one is composed of two of half as many."""
    state, units = behind.copy(), counts.copy()
    step, n = 1, len(state)
    while step < n:
        left, left_units = state[:-step].copy(), units[:-step].copy()
        right, right_units = state[step:], units[step:]
        units[step:] = left_units + np.take_along_axis(right_units, left, axis=1)
        state[step:] = np.take_along_axis(right, left, axis=1)
        step *= 2
    return np.concatenate([[0], state[:, 0]]), np.concatenate([[0], units[:, 0]])


def draws(id_col: str, seed: int) -> list[Column]:
    """h1 to h4: the first four groups of 8 hex digits of the SHA-256 of ``seed:id`` (a null id: nothing behind the colon)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]


def _form(text: bytes, h3: int, h4: int, plain: int, spm: int) -> int:
    if not text or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= 100 - plain:
        return 0
    return 2 if h4 % 100 < spm else 1


def joined(form: int, prefix: bytes, middle: bytes, suffix: bytes) -> bytes:
    if form == 1:
        return b"".join([PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle])
    return b"".join([SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle]) if form == 2 else b"".join([prefix, middle, suffix])


_RESULT = ("part", "parts", "span", "n", "form", "prefix_chars", "middle_chars", "output")
_SQL = "part bigint, parts bigint, span int, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"
_TYPES = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64())


def _text(pieces: list[bytes]) -> pa.Array:
    return pa.array(pieces, pa.binary()).cast(pa.string())


def _short(docs: DataFrame, plain: int, spm: int, id_sql: str) -> DataFrame:
    """The transformed texts of one chunk; ``docs``: id, text, row, h1 to h4."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [x.as_py() for x in batch.column(1)]
            begins = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
            data = np.frombuffer(b"".join(texts), np.uint8)
            unit, _, counts = scan(data, begins)
            starts, chars = np.flatnonzero(unit), np.concatenate([[0], np.cumsum(data & 0xC0 != 0x80)])
            first = np.searchsorted(starts, begins)
            rows = []
            h = [batch.column(i).to_pylist() for i in range(3, 7)]
            for i, (text, a, *drawn) in enumerate(zip(texts, begins[:-1].tolist(), *h, strict=True)):
                n = int(counts[i, 0])
                form = _form(text, drawn[2], drawn[3], plain, spm)
                if not form:
                    rows.append((0, 1, 0, n, _FORMS[0], None, None, text))
                    continue
                low, high = (a + len(text) if c >= n else int(starts[first[i] + c]) for c in sorted(d % (n + 1) for d in drawn[:2]))
                out = joined(form, text[: low - a], text[low - a : high - a], text[high - a :])
                rows.append((0, 1, 0, n, _FORMS[form], int(chars[low] - chars[a]), int(chars[high] - chars[low]), out))
            *columns, out = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)), _text(list(out))], names=["id", "row", *_RESULT])

        return step

    return arrow_map(docs, make, f"id {id_sql}, row bigint, {_SQL}")


def _chunks(docs: DataFrame, chunk: int, plain: int, spm: int, id_sql: str) -> DataFrame:
    """(id, row, form, h1, h2, no, chunk) of longer texts, cut between code points; a written table, dealt out by chunk."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cut_batches(batches):
            for i in range(batch.num_rows):
                own = batch.slice(i, 1)
                text = own.column(1)[0].as_buffer()
                h1, h2, h3, h4 = (own.column(k)[0].as_py() for k in range(3, 7))
                form, view, cuts = _form(text.to_pybytes(), h3, h4, plain, spm), memoryview(text), [0]
                while cuts[-1] < len(view):
                    at = min(cuts[-1] + chunk, len(view))
                    while at < len(view) and view[at] & 0xC0 == 0x80:
                        at -= 1
                    cuts.append(at)
                for a in range(0, len(cuts) - 1, 64):
                    pieces = [bytes(view[x:y]) for x, y in zip(cuts[a : a + 64], cuts[a + 1 : a + 65], strict=False)]
                    m = len(pieces)
                    same = [own.column(0).take(pa.array([0] * m)), own.column(2).take(pa.array([0] * m)), pa.array([form] * m, pa.int32()), pa.array([h1] * m), pa.array([h2] * m)]
                    yield pa.RecordBatch.from_arrays([*same, pa.array(range(a, a + m), pa.int64()), pa.array(pieces, pa.binary())], names=["id", "row", "form", "h1", "h2", "no", "chunk"])

    return materialize(docs.mapInArrow(run, f"id {id_sql}, row bigint, form int, h1 bigint, h2 bigint, no bigint, chunk binary").repartition("row", "no"), "chunks")


def _functions(chunks: DataFrame) -> DataFrame:
    """(row, no, behind, counts) of each chunk."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [x.as_py() for x in batch.column(2)]
            _, behind, counts = scan(np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64))
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(behind.tolist(), pa.list_(pa.int64())), pa.array(counts.tolist(), pa.list_(pa.int64()))], names=["row", "no", "behind", "counts"])

        return step

    return arrow_map(chunks.select("row", "no", "chunk"), make, "row bigint, no bigint, behind array<bigint>, counts array<bigint>")


def _entered(functions: DataFrame, h: DataFrame) -> DataFrame:
    """(row, no, state, before, units, low, high) of each chunk: its entry state, the units before it, those of the text, and both
    cuts, in units. A text has at most 2 GB, so a row gathers no more than some ten thousand small functions."""
    each = functions.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("no", "behind", "counts"))).alias("chunks")).join(h, "row")

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = [[], [], [], [], [], [], []]
            for row, chunks, h1, h2 in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                state, before = compose(np.array([c["behind"] for c in chunks]), np.array([c["counts"] for c in chunks]))
                n, m = int(before[-1]), len(chunks)
                low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
                for values, new in zip(out, ([row] * m, [c["no"] for c in chunks], state[:-1].tolist(), before[:-1].tolist(), [n] * m, [low] * m, [high] * m), strict=True):
                    values += new
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["row", "no", "state", "before", "units", "low", "high"])

        return step

    return arrow_map(each.select("row", "chunks", "h1", "h2"), make, "row bigint, no bigint, state bigint, before bigint, units bigint, low bigint, high bigint", 16)


def _long(docs: DataFrame, chunk: int, plain: int, spm: int, id_sql: str) -> DataFrame:
    """The transformed texts of several chunks, in parts."""
    chunks = _chunks(docs, chunk, plain, spm, id_sql)
    entered = materialize(_entered(_functions(chunks), chunks.where("no = 0").select("row", "h1", "h2")), "entered")

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows, of = [], []
            texts = [x.as_py() for x in batch.column(4)]
            for i, (form, no, text, state, before, n, low, high) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), texts, *(batch.column(k).to_pylist() for k in range(5, 10)), strict=True)):
                data = np.frombuffer(text, np.uint8)
                unit, *_ = scan(data, np.array([0, len(data)]))
                unit = unit.copy()
                unit[0] &= not (state and _letters(data[:1])[0])
                starts = np.flatnonzero(unit)
                # a unit's place, if it begins here; what lies before it is none of this chunk's business
                place = lambda c: 0 if c < before else int(starts[c - before]) if c < before + len(starts) else len(text)  # noqa: B023, E731
                cuts = [0, place(low), place(high), len(text)] if form else [0, len(text), len(text), len(text)]
                for span in range(3):
                    piece = text[cuts[span] : cuts[span + 1]]
                    lead = no == 0 and form and (PREFIX, MIDDLE, SUFFIX)[span]
                    if piece or lead:
                        rows.append((no, span, n, form, int((np.frombuffer(piece, np.uint8) & 0xC0 != 0x80).sum()), (lead or b"") + piece))
                        of.append(i)
            no, span, n, form, chars, out = zip(*rows, strict=True)
            take = pa.array(of, pa.int64())
            columns = [batch.column(0).take(take), batch.column(1).take(take), pa.array(no, pa.int64()), pa.array(span, pa.int32()), pa.array(n, pa.int64()), pa.array(form, pa.int32()), pa.array(chars, pa.int64()), _text(list(out))]
            return pa.RecordBatch.from_arrays(columns, names=["id", "row", "no", "span", "n", "form", "chars", "output"])

        return step

    held = chunks.select("id", "row", "form", "no", "chunk").join(entered, ["row", "no"]).select("id", "row", "form", "no", "chunk", "state", "before", "units", "low", "high")
    pieces = materialize(arrow_map(held, make, f"id {id_sql}, row bigint, no bigint, span int, n bigint, form int, chars bigint, output string"), "pieces")
    sizes = pieces.groupBy("row").agg(F.count(F.lit(1)).alias("parts"), *(F.sum(F.when(F.col("span") == s, F.col("chars")).otherwise(0)).alias(f"chars{s}") for s in (0, 1)), F.max("no").alias("last"), *(F.sum((F.col("span") == s).cast("long")).alias(f"of{s}") for s in range(3)))
    discard(chunks, entered)
    both = pieces.join(sizes, "row")
    # spans in the order of the form; a span's parts are those of successive chunks, the sentinel's chunk first
    place = F.when(F.col("form") == 2, F.element_at(F.array(F.lit(1), F.lit(2), F.lit(0)), F.col("span") + 1)).when(F.col("form") == 1, F.element_at(F.array(F.lit(0), F.lit(2), F.lit(1)), F.col("span") + 1)).otherwise(F.lit(0))
    named = F.element_at(F.array(*(F.lit(x) for x in _FORMS)), F.col("form") + 1)
    chars = [F.when(F.col("form") > 0, F.col(f"chars{s}")) for s in (0, 1)]
    part = place.cast("long") * (F.col("last") + 1) + F.col("no")
    return both.select("id", "row", part.alias("part"), "parts", "span", "n", named.alias("form"), chars[0].alias("prefix_chars"), chars[1].alias("middle_chars"), "output")


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, plain: int = 10, spm: int = 20, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """The transformed texts, those of one chunk and the longer ones: id, row, part, parts, span, n, form, prefix_chars, middle_chars and output.

    A text of at most ``chunk`` bytes has one row. A longer one has a row for each of its ``parts``, whose outputs follow each other by
    ``part``; ``row`` tells documents with equal ids apart there, and ``span`` says what a part holds: 0 prefix, 1 middle, 2 suffix
    (a plain text is all prefix). ``n``: units of the text. Two cuts, h1 and h2 modulo n + 1 (:func:`draws`), end the prefix and
    the middle. ``form`` is plain (the text as it is) for empty texts, those that hold a sentinel, and about ``plain`` hundredths
    of the others; of the rest, about ``spm`` hundredths are spm (suffix, prefix, middle), the others psm (prefix, suffix,
    middle), each behind its sentinel. Chars count code points and are null for plain texts.

    A null text is empty. Repeated rows give repeated rows (of one id: the same form); a null id is an id. An empty
    table gives no rows. Other columns aren't read.
    """
    id_sql = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text")
    named = docs.select(F.col(id_col).alias("id"), text, *draws(id_col, seed))
    columns = ("id", "text", "row", "h1", "h2", "h3", "h4")
    is_long = F.octet_length("text") > chunk
    short = _short(named.where(~is_long).withColumn("row", F.lit(0).cast("long")).select(*columns), plain, spm, id_sql)
    long = _long(named.where(is_long).withColumn("row", F.monotonically_increasing_id()).select(*columns), chunk, plain, spm, id_sql)
    return short.withColumnRenamed("id", id_col), long.withColumnRenamed("id", id_col)


def restored(form: Column, output: Column) -> Column:
    """The text that a whole output of this form was made from."""
    of = lambda s, i: F.split_part(output, F.lit(s.decode()), F.lit(i))
    middle, between = of(MIDDLE, 2), F.substring_index(output, MIDDLE.decode(), 1)
    cut = lambda a, i: F.split_part(between, F.lit(a.decode()), F.lit(i))
    psm = F.concat(F.substring(cut(SUFFIX, 1), 4, 1 << 30), middle, cut(SUFFIX, 2))
    spm = F.concat(cut(PREFIX, 2), middle, F.substring(cut(PREFIX, 1), 4, 1 << 30))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
