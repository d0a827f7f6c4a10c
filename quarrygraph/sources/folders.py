"""Folders as tables: a distributed walk, reading of whole files in balanced partitions, and writing of files by name.

Spark's own readers leave out files whose names begin with ``_`` or ``.``, so the files of a source tree are listed and read by the
tasks, through the file system that the path names (local, hdfs, s3, gs)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrygraph.sources.shared import discard, materialize, running_total

#: Bytes of files that a task reads, about; a larger file is a task of its own. Bytes of a batch that it hands on.
TASK_BYTES, BATCH_BYTES = 64 << 20, 4 << 20


def _file_system(path: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(path if "://" in path or path.startswith("/") else path.replace("file:", "", 1))


def walk(spark: SparkSession, root: str, excluded: tuple[str, ...] = (), suffix: str = "") -> DataFrame:
    """(path, size) of all files below ``root`` whose names end with ``suffix`` and whose full paths hold none of ``excluded``.

    Folders are listed by the tasks, one level after the other; those whose names hold one of ``excluded`` aren't listed.
    Names that begin with ``_`` or ``.`` are files like others. A missing or empty root gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSelector, FileType

        for batch in batches:
            paths, folders, sizes = [], [], []
            for folder in batch.column(0).to_pylist():
                system, path = _file_system(folder)
                prefix = folder[: len(folder) - len(path)] if folder.endswith(path) else ""
                for info in system.get_file_info(FileSelector(path, allow_not_found=True)):
                    is_folder = info.type == FileType.Directory
                    name = info.base_name if is_folder else prefix + info.path
                    if any(x in name for x in excluded) or not (is_folder or info.base_name.endswith(suffix)):
                        continue
                    paths.append(prefix + info.path)
                    folders.append(is_folder)
                    sizes.append(info.size or 0)
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(folders, pa.bool_()), pa.array(sizes, pa.int64())], names=["path", "folder", "size"])

    level, files = spark.createDataFrame([(root.rstrip("/") or "/",)], "path string"), None
    while True:
        found = materialize(level.mapInArrow(run, "path string, folder boolean, size bigint"), "walk")
        own = found.where("not folder").select("path", "size")
        files = own if files is None else files.unionByName(own)
        level = found.where("folder").select("path").repartition("path")
        if level.limit(1).count() == 0:
            return files


def read_files(files: DataFrame, task_bytes: int = TASK_BYTES) -> DataFrame:
    """(path, content) of ``files`` (path, size): whole texts, in partitions of about ``task_bytes``. What isn't UTF-8 is replaced. A
    file that is gone by then is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths, texts, size = [], [], 0

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(texts, pa.string())], names=["path", "content"])

        for batch in batches:
            for full in batch.column(0).to_pylist():
                system, path = _file_system(full)
                with system.open_input_stream(path) as f:
                    text = f.read().decode("utf-8", "replace")
                paths.append(full)
                texts.append(text)
                size += len(text)
                if size > BATCH_BYTES:
                    yield batch_of()
                    paths, texts, size = [], [], 0
        yield batch_of()

    placed = running_total(files, ["path"], "size", "before")
    return placed.withColumn("task", F.floor(F.col("before") / task_bytes)).repartition("task").select("path").mapInArrow(run, "path string, content string")


def write_files(files: DataFrame, root: str) -> None:
    """Each row of ``files`` (path below ``root``, content) as a file, by the tasks; a file that is there is replaced, so a task can run again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in batches:
            for name, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                system, path = _file_system(f"{root.rstrip('/')}/{name}")
                system.create_dir(path.rpartition("/")[0], recursive=True)
                with system.open_output_stream(path) as f:
                    f.write((content or "").encode())
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    discard(materialize(files.select("path", "content").mapInArrow(run, "n bigint"), "written"))
