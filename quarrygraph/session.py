"""Session construction and table reading shared by every query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "quarrygraph", master: str | None = None, **conf: str) -> SparkSession:
    """A session with AQE on; ``master`` and extra settings are left to the cluster when not given."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data folder; any path that Spark can read will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
