"""Reading and writing exports, and graphs, chunks and vectors as Parquet."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrygraph.schemas import EDGE_ENDS, EDGE_TYPES, EDGES, EMBEDDING_DIM, NODE_TYPES, NODES, SIMILARITY
from quarrygraph.sources.json_array import read_json_array, write_json_array


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return read_json_array(spark, path, schema).withColumn("ord", F.coalesce("ord", "place")).drop("place")


def read_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """The nodes of nodes.json, one JSON array; ``ord`` is the place in the array where a row has none."""
    return _read(spark, f"{folder}/nodes.json", NODES)


def read_edges(spark: SparkSession, folder: str) -> DataFrame:
    """The edges of relationships.json in the same way; those without a type are UNKNOWN."""
    return _read(spark, f"{folder}/relationships.json", EDGES).withColumn("type", F.coalesce("type", F.lit("UNKNOWN")))


def read_export(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of an export."""
    return read_nodes(spark, folder), read_edges(spark, folder)


def _ordered(df: DataFrame) -> DataFrame:
    return df.orderBy("ord") if "ord" in df.columns else df


def write_nodes(nodes: DataFrame, folder: str) -> DataFrame:
    """nodes.json as a JSON array, in the order of ``ord`` where there is such a column, with forward slashes in paths and an empty array
    for a missing embedding. Returns the nodes as written."""
    out = nodes.withColumn("file_path", F.replace("file_path", F.lit("\\"), F.lit("/")))
    if "embedding" in nodes.columns:
        out = out.withColumn("embedding", F.coalesce("embedding", F.array().cast("array<float>")))
    write_json_array(_ordered(out), f"{folder}/nodes.json")
    return out


def write_edges(edges: DataFrame, folder: str) -> None:
    """relationships.json as a JSON array, in the order of ``ord`` where there is such a column."""
    write_json_array(_ordered(edges), f"{folder}/relationships.json")


def write_export(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    """nodes.json, relationships.json, schema.json with the types and fields, index_config.json with what is looked up by."""
    out = write_nodes(nodes, folder)
    write_edges(edges, folder)
    spark = nodes.sparkSession
    fields = [(f.name, f.dataType.simpleString()) for f in out.schema]
    ends = [(kind, list(a), list(b)) for kind, (a, b) in EDGE_ENDS.items()]
    described = [("node_types", "types", list(NODE_TYPES)), ("edge_types", "types", list(EDGE_TYPES)), *(("node_field", name, [kind]) for name, kind in fields), *(("edge_ends", kind, [f"{x}->{y}" for x in a for y in b]) for kind, a, b in ends)]
    write_json_array(spark.createDataFrame(described, "kind string, name string, content array<string>").coalesce(1), f"{folder}/schema.json")
    indexes = [("vector", "embedding", {"dimension": str(EMBEDDING_DIM), "similarity": SIMILARITY}), *(("lookup", c, {}) for c in ("id", "name", "type", "file_path")), *(("full_text", c, {}) for c in ("name", "docstring", "summary", "llm_description"))]
    write_json_array(spark.createDataFrame(indexes, "kind string, field string, options map<string,string>").coalesce(1), f"{folder}/index_config.json")


def save_tables(tables: dict[str, DataFrame], folder: str, by_type: tuple[str, ...] = ()) -> None:
    """Parquet tables in a folder, those named in ``by_type`` partitioned by their type; what was there is replaced."""
    for name, df in tables.items():
        writer = df.write.mode("overwrite")
        (writer.partitionBy("type") if name in by_type else writer).parquet(f"{folder}/{name}")


def load_tables(spark: SparkSession, folder: str, names: tuple[str, ...]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{folder}/{n}") for n in names}


def load_or_build(spark: SparkSession, folder: str, names: tuple[str, ...], build: Callable[[], dict[str, DataFrame]] | None = None, rebuild: bool = False) -> dict[str, DataFrame]:
    """The saved tables, or those that ``build`` gives, saved first."""
    if not rebuild:
        try:
            return load_tables(spark, folder, names)
        except AnalysisException:
            pass
    if build is None:
        raise ValueError(f"nothing is saved in {folder} and there is nothing to build from")
    save_tables(build(), folder)
    return load_tables(spark, folder, names)


def insert_new(stored: DataFrame, rows: DataFrame, key: str, order: str) -> DataFrame:
    """``stored`` and the rows whose key it lacks, the first of each key."""
    fresh = rows.join(stored.select(key), key, "left_anti")
    fresh = fresh.withColumn("_nth", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_nth = 1").drop("_nth")
    return stored.unionByName(fresh.select(stored.columns))


def upsert(stored: DataFrame, rows: DataFrame, key: str, order: str) -> DataFrame:
    """``stored`` with the rows in place of those with their keys, the last of each key."""
    last = rows.withColumn("_nth", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("_nth = 1").select(stored.columns)
    return stored.join(last.select(key), key, "left_anti").unionByName(last)


def merged_pairs(stored: DataFrame, rows: DataFrame) -> DataFrame:
    """MERGE of rows without payload: each once."""
    return stored.unionByName(rows.select(stored.columns)).distinct()
