"""One JSON array of objects in a file, of any size and layout, read by many tasks and written by many.

Spark splits the text at every ``}``, so a split's pieces begin behind one: outside of a string or within one, at some depth. A first
pass gives for each split, for both ways it can begin, how it ends and by how much the depth changes; put one after the
other (a row for each split), they say how each begins. A second pass then finds the objects at depth one. Those that lie
across splits come as fragments and are put together.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrygraph.sources.shared import materialize

_QUOTE, _ESCAPE, _OPEN, _CLOSE = (np.uint8(ord(c)) for c in '"\\{}')
_STEPS = np.zeros(256, np.int8)
_STEPS[[ord("{"), ord("[")]], _STEPS[[ord("}"), ord("]")]] = 1, -1
#: Bytes that are worked on at once.
STRETCH_BYTES = 1 << 20
#: Splits whose beginnings are broadcast, some 60 bytes each; a join beyond.
BROADCAST_SPLITS = 1_000_000


def _structure(data: np.ndarray, inside: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(places of brackets outside of strings, their steps of depth, whether a string is open at the end) if ``inside`` says whether
    one is open before. The data don't begin within an escape."""
    quotes, escapes = np.flatnonzero(data == _QUOTE), np.flatnonzero(data == _ESCAPE)
    if len(escapes):  # quotes behind an odd number of backslashes don't count
        first = np.r_[True, escapes[1:] != escapes[:-1] + 1]
        begin = np.maximum.accumulate(np.where(first, escapes, 0))  # of the run that each is in
        before = np.searchsorted(escapes, quotes) - 1
        run = np.where((before >= 0) & (escapes[before] == quotes - 1), quotes - begin[before], 0)
        quotes = quotes[run % 2 == 0]
    brackets = np.flatnonzero(_STEPS[data])
    brackets = brackets[(np.searchsorted(quotes, brackets) + inside) % 2 == 0]
    return brackets, _STEPS[data[brackets]].astype(np.int64), (len(quotes) + inside) % 2


def _stretches(batch: pa.RecordBatch) -> Iterator[tuple[int, int]]:
    """Rows of one split that follow each other, of ``STRETCH_BYTES`` unless one alone has more."""
    file, block = (batch.column(i) for i in (0, 1))
    other = np.zeros(batch.num_rows, bool)
    for c in (file, block):
        other[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
    ends = np.cumsum(pc.binary_length(batch.column(2)).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    cuts = [*np.flatnonzero(other).tolist(), batch.num_rows]
    a = 0
    for cut in cuts:
        while a < cut:
            begin = ends[a - 1] if a else 0
            b = min(cut, max(a + 1, int(np.searchsorted(ends, begin + STRETCH_BYTES, "right"))))
            yield a, b
            a = b


def _bytes(column: pa.Array, a: int, b: int) -> bytes:
    part = column[a:b]
    whole = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part), "}")
    return whole[0].as_buffer().to_pybytes() + b"}"


def _functions(pieces: DataFrame) -> DataFrame:
    """(file, block, after0, step0, after1, step1) of each split; the last one of a file counts a ``}`` too many, behind which nothing comes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[int]] = {}
        for batch in batches:
            for a, b in _stretches(batch):
                own = held.setdefault((batch.column(0)[a].as_py(), batch.column(1)[a].as_py()), [0, 0, 1, 0])
                data = np.frombuffer(_bytes(batch.column(2), a, b), np.uint8)
                for k in (0, 2):
                    _, steps, after = _structure(data, own[k])
                    own[k], own[k + 1] = after, own[k + 1] + int(steps.sum())
        rows = [{"file": f, "block": b, "after0": x[0], "step0": x[1], "after1": x[2], "step1": x[3]} for (f, b), x in held.items()]
        if rows:
            yield pa.RecordBatch.from_pylist(rows)

    return pieces.mapInArrow(run, "file string, block bigint, after0 bigint, step0 bigint, after1 bigint, step1 bigint")


def _objects(pieces: DataFrame) -> DataFrame:
    """(file, block, n, part, text): the objects that begin in each split, n from 0; part 0: whole, 1: the beginning of one that goes on in
    the next split, 2: what goes on (n = -1). ``pieces`` with ``inside`` and ``depth`` of their splits' beginnings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, held, n, inside, depth, going = None, b"", 0, 0, 0, False

        def whole(data: bytes, begins: np.ndarray, ends: np.ndarray, n: int) -> pa.RecordBatch | None:
            """Objects that lie in ``data``; none if there is more between them than commas and blanks."""
            offsets = np.r_[begins, ends[-1] + 1].astype(np.int32)
            cut = pc.ascii_rtrim(pa.StringArray.from_buffers(len(begins), pa.py_buffer(offsets), pa.py_buffer(data)), ", \t\r\n")
            if not np.array_equal(pc.binary_length(cut).to_numpy(zero_copy_only=False), ends + 1 - begins):
                return None
            m = len(begins)
            return pa.RecordBatch.from_arrays([pa.array([split[0]], pa.string()).take(pa.array(np.zeros(m, np.int64))), pa.array(np.full(m, split[1])), pa.array(np.arange(n, n + m)), pa.array(np.zeros(m, np.int8)), cut.cast(pa.binary())], names=["file", "block", "n", "part", "text"])

        def rows_of(found: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
            n, part, text = zip(*found, strict=True) if found else ((), (), ())
            m = len(found)
            return pa.RecordBatch.from_arrays([pa.array([split[0]] * m, pa.string()), pa.array([split[1]] * m, pa.int64()), pa.array(n, pa.int64()), pa.array(part, pa.int8()), pa.array(text, pa.binary())], names=["file", "block", "n", "part", "text"])

        def rest() -> list:
            if going or depth > 1:
                return [(-1, 2, held)] if going else [(n, 1, held)]
            return []

        for batch in batches:
            for a, b in _stretches(batch):
                key = batch.column(0)[a].as_py(), batch.column(1)[a].as_py()
                if key != split:
                    if split is not None:
                        yield rows_of(rest())
                    split, held, n = key, b"", 0
                    inside, depth = batch.column(3)[a].as_py(), batch.column(4)[a].as_py()
                    going = depth > 1
                data = _bytes(batch.column(2), a, b)
                brackets, steps, after = _structure(np.frombuffer(data, np.uint8), inside)
                deep = depth + np.cumsum(steps)
                begins = brackets[(steps > 0) & (deep == 2)]
                ends = brackets[(steps < 0) & (deep == 1)]
                found, at = [], 0
                open_ = depth > 1
                if not open_ and len(ends) and not going:
                    done = whole(data, begins[: len(ends)], ends, n)
                    if done is not None:
                        yield done
                        held = data[begins[len(ends)] :] if len(begins) > len(ends) else b""
                        n += len(ends)
                        inside, depth = after, int(deep[-1])
                        continue
                starts = [0, *begins.tolist()] if open_ else begins.tolist()
                for k, end in enumerate(ends.tolist()):
                    text = (held if k == 0 and open_ else b"") + data[starts[k] : end + 1]
                    if k == 0 and going:
                        found.append((-1, 2, text))
                        going = False
                    else:
                        found.append((n, 0, text))
                        n += 1
                    at = k + 1
                if len(starts) > at:  # the last one goes on
                    held = (held if at == 0 and open_ else b"") + data[starts[at] :]
                else:
                    held = b""
                inside, depth = after, int(deep[-1]) if len(deep) else depth
                yield rows_of(found)
        if split is not None:
            yield rows_of(rest())

    return pieces.mapInArrow(run, "file string, block bigint, n bigint, part tinyint, text binary")


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The objects of the JSON array in the file (or in each file of the folder) ``path``, with the columns of ``schema`` and ``place``, from 0,
    in its array. Fields that an object lacks are null, and so are all of one that can't be parsed; an empty array gives no rows.
    An object lies in one task (up to 2 GB); the array needn't."""
    text = spark.read.text(path, lineSep="}").select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    begins, now = [], {}
    for r in sorted(_functions(text).collect(), key=lambda r: (r["file"], r["block"])):  # a row for each split; a sort in Spark reads all twice
        inside, depth = now.get(r["file"], (0, 0))
        begins.append((r["file"], r["block"], inside, depth))
        now = {r["file"]: (r[f"after{inside}"], depth + r[f"step{inside}"])}
    if not begins:
        return spark.createDataFrame([], schema).withColumn("place", F.lit(0).cast("long"))

    def of_splits(rows: list, kind: str) -> DataFrame:
        df = spark.createDataFrame(rows, f"file string, block bigint, {kind}")
        return F.broadcast(df) if len(rows) <= BROADCAST_SPLITS else df

    # in the order of the text: a broadcast join keeps it, and a sort brings it back
    given = text.join(of_splits(begins, "inside bigint, depth bigint"), ["file", "block"]).select("file", "block", "value", "inside", "depth")
    found = materialize(_objects(given), "objects", "zstd")  # beside the file, which may be as large as the disk allows
    counts = {(r["file"], r["block"]): r["n"] for r in found.groupBy("file", "block").agg(F.max("n").alias("n")).collect()}
    before, n, file = [], 0, None
    for f, b, *_ in begins:
        n = 0 if f != file else n
        file = f
        before.append((f, b, n))
        n += counts.get((f, b), -1) + 1
    placed = found.join(of_splits(before, "before bigint"), ["file", "block"]).withColumn("place", F.col("before") + F.col("n"))
    whole = placed.where("part = 0").select("place", F.col("text").cast("string").alias("text"))
    # pieces of one object: it began last before the splits that go on with it
    parts = placed.where("part > 0").groupBy("file", "place").agg(F.array_sort(F.collect_list(F.struct("block", "text"))).alias("parts"))
    joined = parts.select("place", F.aggregate("parts", F.lit(b""), lambda s, x: F.concat(s, x["text"])).cast("string").alias("text"))
    return whole.unionByName(joined).select(F.from_json("text", schema).alias("r"), "place").select("r.*", "place")


def write_json_array(df: DataFrame, path: str) -> None:
    """The rows of ``df`` in its order as one JSON array in the file ``path``, a row on each line, nulls written out. The tasks write
    compressed parts; these are then joined to one file under another name, each deleted once it is in there, and the file takes the
    place of ``path`` when it is whole. So the disk holds no second copy of the array."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    of = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    mark = uuid.uuid4().hex
    parts, whole = of(f"{path}.parts-{mark}"), of(f"{path}.whole-{mark}")
    fields = F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns)), {"ignoreNullFields": "false"})
    df.select(F.concat(F.lit(","), fields).alias("value")).write.text(parts.toString(), compression="lz4")
    fs = parts.getFileSystem(conf)
    names = sorted(s.getPath().toString() for s in fs.listStatus(parts) if s.getPath().getName().startswith("part-"))
    codecs = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf)
    out = fs.create(whole, True)
    try:
        out.write(bytearray(b"[\n"))
        begun = False
        for name in names:
            part = codecs.getCodec(of(name)).createInputStream(fs.open(of(name)))
            begun = begun or part.read() >= 0  # no comma before the first
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, 1 << 20, False)
            part.close()
            fs.delete(of(name), False)
        out.write(bytearray(b"]\n"))
    finally:
        out.close()
    fs.delete(of(path), True)
    fs.rename(whole, of(path))
    fs.delete(parts, True)
