"""Written intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Where it is unset, a temporary folder, if the whole session runs on this machine;
    a cluster's executors couldn't see that, so there it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = getattr(shared_dir, "own", None)
        if not found:
            found = shared_dir.own = tempfile.mkdtemp(prefix="quarry-")
    return found.rstrip("/")


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names like the wanted ones that aren't columns of ``df``, in whatever case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def materialize(df: DataFrame, label: str, compression: str | None = None) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: its lineage ends, and its rows survive lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._quarry_path = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of ours, or a file."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def discard(*tables: DataFrame | None) -> None:
    """Delete materialized tables that no later plan reads. Other frames, and None, are left alone."""
    for df in tables:
        path = getattr(df, "_quarry_path", None)
        if path:
            remove(df.sparkSession, path)


def passing_session(spark: SparkSession) -> SparkSession:
    """A session beside ``spark`` with its settings, whose jobs delete their shuffle files as they end: for frames that are written once."""
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(key):
            own.conf.set(key, value)
    own.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    return own


def running_total(df: DataFrame, order: list[str], value: str, out: str) -> DataFrame:
    """``df`` with ``out``, the sum of ``value`` over the rows before each in ``order``: within ranges of rows, and over the ranges before
    (a row for each). Rows of equal order are added up in some order."""
    part, ahead = free_names(df, "part", "ahead")
    held = materialize(df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()), "ranges")
    sums = held.groupBy(part).agg(F.sum(value).alias(ahead))
    before = sums.select(part, F.coalesce(F.sum(ahead).over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(ahead))
    within = F.coalesce(F.sum(value).over(Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return held.withColumn(out, within).join(F.broadcast(before), part).withColumn(out, F.col(out) + F.col(ahead)).drop(part, ahead)
