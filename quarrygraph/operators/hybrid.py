"""Fusion of graph hits and chunk hits, and their enrichment."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrygraph.functions.text import first_truthy
from quarrygraph.schemas import RETRIEVAL


def merge(kg: DataFrame, chunk_hits: DataFrame, kg_weight: float = RETRIEVAL["kg_weight"], vector_weight: float = RETRIEVAL["vector_weight"]) -> DataFrame:
    """``kg``: (file_path, name, type, content, summary, ord); ``chunk_hits``: (chunk_id, file_path, chunk_type, content,
    element_names, score, rank). Of graph hits with equal file and name the last one counts, in the first one's place. A chunk
    goes to the graph hit of its first element name that has one, the last of several chunks giving the score; other chunks
    are hits of their own. Ordered by ``combined_score``, then graph hits before chunks."""
    key = ["file_path", "name"]
    graph = kg.groupBy(*key).agg(F.max_by(F.struct("type", "content", "summary"), "ord").alias("x"), F.min("ord").alias("place")).select(*key, "x.*", "place")
    names = chunk_hits.select("chunk_id", "rank", "score", "file_path", F.posexplode("element_names").alias("pos", "name"))
    met = names.join(graph.select(*key), key).groupBy("chunk_id").agg(F.min_by(F.struct("file_path", "name", "score", "rank"), "pos").alias("m")).select("chunk_id", "m.*")
    scores = met.groupBy(*key).agg(F.max_by("score", "rank").alias("vector_score"))
    hits = graph.join(scores, key, "left").select(
        F.when(F.col("vector_score").isNull(), "kg").otherwise("both").alias("source"), "type", "name", "file_path", "content", "summary",
        F.lit(1.0).alias("kg_score"), F.coalesce("vector_score", F.lit(0.0)).alias("vector_score"), F.lit(0).alias("kind"), F.col("place").cast("long").alias("place"))
    label = F.array_join("element_names", ", ")
    own = chunk_hits.join(met.select("chunk_id"), "chunk_id", "left_anti").select(
        F.lit("vector").alias("source"), F.col("chunk_type").alias("type"), label.alias("name"), "file_path", "content", F.concat_ws(": ", "chunk_type", label).alias("summary"),
        F.lit(0.0).alias("kg_score"), F.col("score").cast("double").alias("vector_score"), F.lit(1).alias("kind"), F.col("rank").cast("long").alias("place"))
    combined = F.lit(kg_weight) * F.col("kg_score") + F.lit(vector_weight) * F.col("vector_score")
    return hits.unionByName(own).withColumn("combined_score", combined)


def best(merged: DataFrame, k: int = RETRIEVAL["final_top_k"]) -> DataFrame:
    return merged.orderBy(F.desc("combined_score"), "kind", "place").limit(k)


def enrich(hits: DataFrame, nodes: DataFrame) -> DataFrame:
    """Line number, docstring and signature for graph hits, of the first element of the same file whose name holds the hit's."""
    parts = nodes.select(F.col("file_path").alias("_path"), F.col("name").alias("_name"), "ord", "line_number", "docstring", "signature")
    found = hits.where(F.col("source").isin("kg", "both")).select("file_path", "name").distinct()
    first = found.join(parts, (F.col("file_path") == F.col("_path")) & F.contains("_name", "name")).groupBy("file_path", "name").agg(
        F.min_by(F.struct("line_number", "docstring", "signature"), "ord").alias("e"))
    more = hits.join(first, ["file_path", "name"], "left")
    of_graph = F.col("source").isin("kg", "both")
    return more.select(*hits.columns, *(F.when(of_graph, F.col(f"e.{c}")).alias(c) for c in ("line_number", "docstring", "signature")))


def counters(kg: DataFrame, chunk_hits: DataFrame, merged: DataFrame, final: DataFrame) -> DataFrame:
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return one(kg, "kg_results").join(one(chunk_hits, "vector_results"), how="cross").join(one(merged, "merged_results"), how="cross").join(one(final, "final_results"), how="cross")


def kg_hits(nodes: DataFrame) -> DataFrame:
    """Retrieved nodes as graph hits."""
    return nodes.select("file_path", "name", "type", F.coalesce(first_truthy(F.col("full_context"), F.col("source_code")), F.lit("")).alias("content"), F.coalesce("summary", F.lit("")).alias("summary"), "ord")


def formatted(hits: DataFrame) -> DataFrame:
    """(place, text): the markdown section of each hit of a final (bounded) list, in order of score."""
    nth = F.row_number().over(Window.orderBy(F.desc("combined_score"), "kind", "place"))
    return hits.withColumn("nth", nth).select(F.col("nth").alias("place"), section(F.col("nth")).alias("text"))


def section(nth):
    c = F.col
    return F.concat(
        F.format_string("## Result %d (Score: %.3f)\n", nth, c("combined_score")), F.lit("**Source:** "), c("source"), F.lit(" | **Type:** "), c("type"), F.lit(" | **Name:** "), c("name"),
        F.lit("\n**File:** "), c("file_path"), F.lit("\n\n"), F.coalesce(F.concat(F.lit("**Summary:** "), F.nullif("summary", F.lit("")), F.lit("\n\n")), F.lit("")),
        F.lit("```python\n"), F.substring("content", 1, 1000), F.lit("\n```\n\n" + "-" * 60 + "\n\n"))
