"""Boundary-aware chunking of a code graph: array expressions, ranges of items and one window per file."""

from __future__ import annotations

from collections.abc import Iterator
from operator import ne

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StructField, StructType

from quarrygraph.functions.text import first_truthy, truthy
from quarrygraph.schemas import MAX_CHUNK
from quarrygraph.sources.shared import free_names, materialize


def pack_groups(sizes: Column, most: int = MAX_CHUNK) -> Column:
    """The group number of each item of an ordered array of sizes, from 0. An item over ``most`` is a group of its own; another
    one opens a group when it doesn't fit into the present one, and sums may equal ``most``."""
    zero = F.struct(F.lit(-1).alias("group"), F.lit(0).cast("bigint").alias("size"), F.lit(True).alias("closed"), F.array().cast("array<int>").alias("out"))

    def step(s: Column, size: Column) -> Column:
        size = size.cast("bigint")
        alone = size > most
        opens = alone | s["closed"] | (s["size"] + size > most)
        group = F.when(opens, s["group"] + 1).otherwise(s["group"])
        return F.struct(group.alias("group"), F.when(opens, size).otherwise(s["size"] + size).alias("size"), alone.alias("closed"), F.concat(s["out"], F.array(group)).alias("out"))

    return F.aggregate(sizes, zero, step, lambda s: s["out"])


class _Table:
    """What items do to the group that is open before them: for every size it may have (``most`` + 1: none is open), its size
    after them and how many groups they open. Sizes that have become equal are one case from then on."""

    def __init__(self, most: int):
        self.most, self.of, self.ahead = most, np.arange(most + 2), np.zeros(most + 2, np.int64)
        self.now, self.opened = np.arange(most + 2), np.zeros(most + 2, np.int64)

    def add(self, size: int) -> None:
        opens = self.now + size > self.most
        self.opened += opens
        self.now = np.where(opens, min(size, self.most + 1), self.now + size)
        if len(self.now) > 8 and opens.any():
            self.now, first, of = np.unique(self.now, return_index=True, return_inverse=True)
            self.ahead += (self.opened - self.opened[first][of])[self.of]
            self.opened, self.of = self.opened[first], of[self.of]

    def after(self) -> tuple[list[int], list[int]]:
        return self.now[self.of].tolist(), (self.opened[self.of] + self.ahead).tolist()


def _greedy(at: int, group: int, sizes: list[int], new: list[bool], most: int) -> tuple[int, int, list[int]]:
    """(size and number of the group open after the items, their groups); ``new``: items that begin a value."""
    out, none = [], most + 1
    for n, begins in zip(sizes, new, strict=True):
        if begins:
            at, group = none, -1
        if at + n > most:
            group, at = group + 1, n if n <= most else none
        else:
            at += n
        out.append(group)
    return at, group, out


def packed(items: DataFrame, by: str, order: str, size: Column, most: int = MAX_CHUNK) -> DataFrame:
    """The items, each row once and with all its columns, and their ``group`` within ``by``, packed greedily in ``order`` like
    :func:`pack_groups`. A null size counts as 0; a null ``by`` is a value of its own; nulls in ``order`` come first, and rows of equal
    order by size. An empty table stays empty; a column named ``group`` gives way.

    Items are sorted over ranges of (by, order), so that no value of ``by`` is gathered in one task, and pass through it one batch
    at a time. Only a range's first value may go on from the range before: its items wait. What a range of one value does to
    the group open before it is a table over that group's size; these tables, one for each such range at most, give the
    open group before every range, and the items that waited are packed from there."""
    items = items.drop("group")
    held, number, seq, waits, now, opened = free_names(items, "size", "range", "seq", "waits", "now", "opened")
    keys = [F.col(f"`{c}`") for c in (by, order, held)]
    sized = items.withColumn(held, F.coalesce(size.cast("bigint"), F.lit(0)))
    at_by, at_size = sized.columns.index(by), sized.columns.index(held)
    tail = [StructField("group", IntegerType()), StructField(number, IntegerType()), StructField(seq, LongType()), StructField(waits, BooleanType()), StructField(now, ArrayType(LongType())), StructField(opened, ArrayType(LongType()))]
    fields = [StructField(f.name, f.dataType) for f in sized.schema]
    lists = pa.list_(pa.int64())

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, total, table, value, alone, at, group, schema = TaskContext.get().partitionId(), 0, _Table(most), None, True, most + 1, -1, None
        for batch in batches:
            values, sizes = batch.column(at_by).to_pylist(), batch.column(at_size).to_pylist()
            schema = batch.schema
            if not values:
                continue
            new = [total > 0 and values[0] != value, *map(ne, values[1:], values)]
            waiting = (new.index(True) if True in new else len(new)) if alone else 0
            for n in sizes[:waiting]:
                table.add(n)
            alone = alone and waiting == len(new)
            at, group, out = _greedy(at, group, sizes[waiting:], new[waiting:], most)
            value = values[-1]
            m = len(values)
            columns = [pa.array([None] * waiting + out, pa.int32()), pa.array([task] * m, pa.int32()), pa.array(range(total, total + m), pa.int64()), pa.array([True] * waiting + [False] * (m - waiting)), pa.nulls(m, lists), pa.nulls(m, lists)]
            total += m
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*schema.names, *(f.name for f in tail)])
        if total:  # a last row about the range: its last value, and its table, or the open group's size and number
            after, opens = table.after() if alone else ([at], [group])
            own = [pa.array([value], f.type) if i == at_by else pa.nulls(1, f.type) for i, f in enumerate(schema)]
            yield pa.RecordBatch.from_arrays([*own, pa.nulls(1, pa.int32()), pa.array([task], pa.int32()), pa.array([-1], pa.int64()), pa.array([alone]), pa.array([after], lists), pa.array([opens], lists)], names=[*schema.names, *(f.name for f in tail)])

    done = materialize(sized.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(first, StructType([*fields, *tail])), "packed")
    firsts = done.where(F.col(seq) == 0).select(number, F.col(f"`{by}`").alias("first"))
    about = done.where(F.col(seq) == -1).select(number, F.col(f"`{by}`").alias("last"), waits, now, opened).join(firsts, number).orderBy(number)
    before, at, group, value = [], most + 1, -1, None
    for r in about.toLocalIterator():  # a row for each range
        if not before or r["first"] != value:
            at, group = most + 1, -1
        before.append((r[number], at, group))
        at, group = (r[now][at], group + r[opened][at]) if r[waits] else (r[now][0], r[opened][0])
        value = r["last"]
    entered, open_at, open_group = free_names(done, "entered", "open_at", "open_group")
    given = done.where(F.col(waits) & (F.col(seq) >= 0)).join(F.broadcast(items.sparkSession.createDataFrame(before, f"{entered} int, {open_at} bigint, {open_group} bigint")), F.col(number) == F.col(entered))

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, at, group = None, most + 1, -1
        for batch in batches:
            tasks, n = batch.column(len(fields)).to_pylist(), 0
            out = []
            while n < len(tasks):  # stretches of one range
                end = n + 1
                while end < len(tasks) and tasks[end] == tasks[n]:
                    end += 1
                if tasks[n] != task:
                    task, at, group = tasks[n], batch.column(len(fields) + 1)[n].as_py(), batch.column(len(fields) + 2)[n].as_py()
                at, group, more = _greedy(at, group, batch.column(at_size)[n:end].to_pylist(), [False] * (end - n), most)
                out += more
                n = end
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(fields)], pa.array(out, pa.int32())], names=[*batch.schema.names[: len(fields)], "group"])

    quoted = [f"`{f.name}`" for f in fields]
    waited = given.repartition(number).sortWithinPartitions(number, seq).select(*quoted, number, open_at, open_group).mapInArrow(again, StructType([*fields, tail[0]]))
    return done.where(~F.col(waits) & (F.col(seq) >= 0)).select(*quoted, "group").unionByName(waited).drop(held)


def class_content(full_context: Column, summary: Column, most: int = MAX_CHUNK) -> Column:
    """The full context, or the summary of classes of over twice the limit; null without context."""
    return F.when(F.length(full_context) > 2 * most, summary).otherwise(truthy(full_context))


def class_summary(name: Column, docstring: Column, num_methods: Column, num_attributes: Column, methods: Column) -> Column:
    """``methods``: array of (name, signature, docstring), null entries for those that weren't found."""
    lines = F.transform(F.filter(methods, lambda m: m.isNotNull()), lambda m: F.concat(
        F.lit("- "), first_truthy(m["signature"], F.concat(F.lit("def "), m["name"], F.lit("(...)"))), F.lit("\n"),
        F.coalesce(F.concat(F.lit("  "), F.substring(truthy(m["docstring"]), 1, 100), F.lit("...\n")), F.lit(""))))
    return F.concat(
        F.lit("# Class: "), name, F.lit("\n\n"), F.coalesce(F.concat(F.lit('"""'), truthy(docstring), F.lit('"""\n\n')), F.lit("")),
        F.lit("## Overview:\n- Methods: "), num_methods.cast("string"), F.lit("\n- Attributes: "), num_attributes.cast("string"), F.lit("\n\n"),
        F.when(F.size(methods) > 0, F.concat(F.lit("## Methods:\n"), F.array_join(lines, ""))).otherwise(F.lit("")))


def header_content(name: Column, docstring: Column, summary: Column) -> Column:
    return F.concat(F.lit("# File: "), name, F.lit("\n\n"), F.coalesce(F.concat(F.lit('"""'), truthy(docstring), F.lit('"""\n\n')), F.lit("")), F.lit("Summary: "), F.coalesce(summary, F.lit("None")), F.lit("\n"))


def chunks(nodes: DataFrame, most: int = MAX_CHUNK, overlap: int = 100) -> DataFrame:
    """Chunks of every file in order: its classes, its functions in greedy groups, then its header if it has a docstring.
    Methods and attributes have no chunks of their own; ``overlap`` is accepted and has no effect. A running number over
    all files makes the chunk id."""
    methods = nodes.where("type = 'method'").groupBy("parent", "name").agg(F.min_by(F.struct("name", "signature", "docstring"), "ord").alias("method"))
    classes = nodes.where((F.col("type") == "class") & truthy(F.col("full_context")).isNotNull())
    named = classes.select("id", F.col("name").alias("parent"), F.posexplode("metadata.method_names").alias("pos", "name")).join(methods, ["parent", "name"], "left")
    listed = named.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "method"))).alias("m")).select("id", F.col("m.method").alias("methods"))
    none = F.array().cast("array<struct<name:string,signature:string,docstring:string>>")
    count = lambda c: F.coalesce(F.col(f"metadata.{c}"), F.lit(0))
    of_class = classes.join(listed, "id", "left").select(
        "file_path", F.lit(0).alias("kind"), "ord",
        class_content(F.col("full_context"), class_summary(F.col("name"), F.col("docstring"), count("num_methods"), count("num_attributes"), F.coalesce("methods", none)), most).alias("content"),
        F.lit("class").alias("chunk_type"), F.col("line_number").alias("start_line"), (F.col("line_number") + F.size(F.split(F.coalesce("source_code", F.lit("")), "\n", -1))).alias("end_line"),
        F.array("name").alias("element_names"),
        F.create_map(F.lit("class_name"), "name", F.lit("num_methods"), count("num_methods").cast("string"), F.lit("docstring"), F.coalesce("docstring", F.lit(""))).alias("metadata"))
    functions = nodes.where("type = 'function'").select("file_path", "ord", "name", F.coalesce(first_truthy(F.col("full_context"), F.col("source_code")), F.lit("")).alias("text"))
    groups = packed(functions, "file_path", "ord", F.length("text"), most).groupBy("file_path", "group").agg(F.min("ord").alias("ord"), F.array_sort(F.collect_list(F.struct("ord", "name", "text"))).alias("x"))
    of_functions = groups.select(
        "file_path", F.lit(1).alias("kind"), "ord", F.array_join("x.text", "\n\n").alias("content"), F.when(F.size("x") == 1, "function").otherwise("mixed").alias("chunk_type"),
        F.lit(0).alias("start_line"), F.lit(0).alias("end_line"), F.col("x.name").alias("element_names"), F.create_map(F.lit("function_names"), F.to_json("x.name")).alias("metadata"))
    headers = nodes.where((F.col("type") == "file") & truthy(F.col("docstring")).isNotNull()).select(
        "file_path", F.lit(2).alias("kind"), "ord", header_content(F.col("name"), F.col("docstring"), F.col("summary")).alias("content"), F.lit("file_section").alias("chunk_type"),
        F.lit(1).alias("start_line"), F.lit(50).alias("end_line"), F.array(F.lit("module")).alias("element_names"), F.create_map(F.lit("file_name"), "name").alias("metadata"))
    every = of_class.unionByName(of_functions).unionByName(headers)
    # the running number: counts per file first, files in ranges of paths, and the counts of whole ranges before each
    files = every.groupBy("file_path").agg(F.count(F.lit(1)).alias("n")).repartitionByRange("file_path").withColumn("part", F.spark_partition_id())
    files = materialize(files, "files")
    parts = files.groupBy("part").agg(F.sum("n").alias("n"))  # a row for each partition
    ahead = parts.withColumn("ahead", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("part", "ahead")
    within = F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy("file_path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = files.withColumn("within", within).join(F.broadcast(ahead), "part").select("file_path", (F.col("ahead") + F.col("within")).alias("before"))
    nth = F.row_number().over(Window.partitionBy("file_path").orderBy("kind", "ord"))
    return every.withColumn("nth", nth).join(before, "file_path").select(
        F.concat(F.lit("chunk_"), (F.col("before") + F.col("nth") - 1).cast("string")).alias("chunk_id"), "content", "chunk_type", "file_path", "start_line", "end_line", "element_names", "metadata")
