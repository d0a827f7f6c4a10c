"""Exact vector search over array columns, in double precision and inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrygraph.operators import dense
from quarrygraph.sources.shared import discard


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null where a length is zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def literal_vector(values: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def normalized(a: Column) -> Column:
    size = norm(a)
    return F.transform(a, lambda x: F.try_divide(x.cast("double"), size))


def scored(vectors: DataFrame, query: Sequence[float], vector_col: str = "embedding") -> DataFrame:
    """Rows with a usable vector and their cosine with the query."""
    usable = vectors.where(F.col(vector_col).isNotNull() & (F.size(vector_col) == len(query)))
    return usable.withColumn("score", cosine(F.col(vector_col), literal_vector(query))).where(F.col("score").isNotNull())


def top_k(
    vectors: DataFrame, query: Sequence[float], k: int, id_col: str = "vec_id", vector_col: str = "embedding", types: Sequence | None = None, type_col: str = "label"
) -> DataFrame:
    """The k rows with the highest cosine, of the given types only; ties to the smaller id."""
    if types:
        vectors = vectors.where(F.col(type_col).isin(*types))
    return scored(vectors, query, vector_col).orderBy(F.desc("score"), F.asc(id_col)).limit(k)


def top_k_then_filter(
    vectors: DataFrame, query: Sequence[float], k: int, types: Sequence, id_col: str = "vec_id", vector_col: str = "embedding", type_col: str = "label"
) -> DataFrame:
    """2k rows first, of any type, then those of the given types: possibly fewer than k."""
    best = top_k(vectors, query, 2 * k, id_col, vector_col)
    return best.where(F.col(type_col).isin(*types)).orderBy(F.desc("score"), F.asc(id_col)).limit(k)


def above_threshold(vectors: DataFrame, query: Sequence[float], threshold: float | None = None, limit: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """At most ``limit`` rows with a score from ``threshold`` (0 and None: 0.85)."""
    return scored(vectors, query, vector_col).where(F.col("score") >= (threshold or 0.85)).orderBy(F.desc("score"), F.asc(id_col)).limit(limit)


def rerank(candidates: DataFrame, vectors: DataFrame, query: Sequence[float], k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The best k of the candidates that have a vector."""
    return top_k(vectors.join(candidates.select(id_col).distinct(), id_col, "left_semi"), query, k, id_col, vector_col)


def batch_top_k(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", itself: bool = False) -> DataFrame:
    """(query_id, rank, id, score): the best k rows of every query other than itself (``itself``: of all rows), by products of blocks
    (:mod:`dense`). Nothing passes the driver; a null id, or a vector that is null, of length zero or holds null or non-finite
    values, takes no part."""
    side = lambda df: dense.packed(df.select(id_col, vector_col, F.lit(0).alias("cell")), "blocks")
    asked, held = side(queries), side(vectors)
    found = dense.best_rows(asked, held, k, itself=itself)
    discard(asked, held)
    return found.select("query_id", "rank", F.col("id").alias(id_col), "score")
