"""Retrieval and triage as single calls over nodes, edges, chunks, vectors and reports."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrygraph.operators import dense, graph, hybrid, triage, vector
from quarrygraph.schemas import DEBUG_RETRIEVAL, RETRIEVAL
from quarrygraph.sources.shared import discard, materialize, running_total


def named_seeds(nodes: DataFrame, entities: Sequence[str]) -> DataFrame:
    """(id) of the nodes whose name is one of the entities, exactly."""
    return nodes.where(F.col("name").isin(*entities)).select("id") if entities else nodes.select("id").limit(0)


def retrieve_subgraph(
    nodes: DataFrame, edges: DataFrame, vectors: DataFrame, query: Sequence[float], entities: Sequence[str] = (),
    semantic_top_k: int = RETRIEVAL["kg_top_k"], n_hops: int = RETRIEVAL["n_hops"], final_top_k: int = RETRIEVAL["final_top_k"],
) -> tuple[DataFrame, DataFrame]:
    """(the best nodes: id and score; the edges between them). Seeds are the nodes named by an entity and the ``semantic_top_k``
    nearest ones; of all within ``n_hops`` of a seed, the ``final_top_k`` nearest with a vector stay. ``vectors``: (id, embedding)."""
    near = vector.top_k(vectors, query, semantic_top_k, id_col="id").select("id")
    seeds = materialize(named_seeds(nodes, entities).unionByName(near).distinct(), "seeds")
    reached, _ = graph.n_hop(seeds, nodes, edges, n_hops)
    best = materialize(vector.rerank(reached, vectors, query, final_top_k, id_col="id").select("id", "score"), "best")
    return best, graph.induced(graph.distinct_edges(edges), F.broadcast(best)).select("type", "source", "target")


#: Queries whose reach is held in one number.
MASK_BITS = 62


def reached_by(seeds: DataFrame, edges: DataFrame, hops: int, wanted: DataFrame | None = None) -> DataFrame:
    """(id, block, mask) of all nodes (of those among the ids of ``wanted``) within ``hops`` undirected steps of ``seeds`` (id, block, mask); a bit of a
    mask is a query. One search serves all queries: what reaches a node is OR-ed before it is shuffled, and only bits that are new
    go on. A step reads the edges at the nodes that have new bits, the last one those that lead to a wanted node."""
    both = edges.select(F.col("source").alias("u"), F.col("target").alias("id")).union(edges.select("target", "source"))
    seen = materialize(seeds.groupBy("id", "block").agg(F.bit_or("mask").alias("mask")), "reach")
    new = seen
    for hop in range(hops):
        near = both.join(graph.small(new.select(F.col("id").alias("u")).distinct()), "u", "left_semi")
        if wanted is not None and hop == hops - 1:
            near = both.join(graph.small(wanted), "id", "left_semi").select("u", "id")
        # the edges that are left, each once: a join with all blocks of a node follows
        step = new.select(F.col("id").alias("u"), "block", "mask").join(near.distinct(), "u").groupBy("id", "block").agg(F.bit_or("mask").alias("mask"))
        known = seen.groupBy("id", "block").agg(F.bit_or("mask").alias("known"))
        fresh = F.col("mask").bitwiseAND(F.bitwise_not(F.coalesce("known", F.lit(0).cast("long"))))
        new = materialize(step.join(known, ["id", "block"], "left").select("id", "block", fresh.alias("mask")).where("mask != 0"), "reach")
        seen = seen.unionByName(new)
    out = seen if wanted is None else seen.join(graph.small(wanted), "id", "left_semi")
    return out.groupBy("id", "block").agg(F.bit_or("mask").alias("mask"))


def retrieve_subgraphs(
    nodes: DataFrame, edges: DataFrame, vectors: DataFrame, queries: DataFrame,
    semantic_top_k: int = RETRIEVAL["kg_top_k"], n_hops: int = RETRIEVAL["n_hops"], final_top_k: int = RETRIEVAL["final_top_k"],
) -> tuple[DataFrame, DataFrame]:
    """:func:`retrieve_subgraph` for a table of ``queries`` (query_id, query, entities) in one plan: (query_id, rank, id, score) of each
    query's best nodes, (query_id, type, source, target) of the edges between them. A query without a vector has no rows."""
    usable = queries.where("query is not null").withColumn("one", F.lit(1).cast("long"))
    numbered = materialize(running_total(usable, ["query_id"], "one", "no").select("query_id", F.col("query").cast("array<double>").alias("query"), "entities", "no", F.floor(F.col("no") / MASK_BITS).alias("block"), F.expr(f"shiftleft(1L, cast(no % {MASK_BITS} as int))").alias("bit")), "queries")
    near = vector.batch_top_k(vectors, numbered.select(F.col("query_id").alias("id"), F.col("query").alias("embedding")), semantic_top_k, id_col="id", itself=True).select("query_id", "id")
    asked_names = numbered.select("query_id", F.explode(F.array_distinct("entities")).alias("name"))
    of_names = nodes.select("id", "name").join(graph.small(asked_names.select("name").distinct()), "name", "left_semi")
    named = asked_names.join(of_names, "name").select("query_id", "id")
    seeds = near.unionByName(named).join(numbered.select("query_id", "block", F.col("bit").alias("mask")), "query_id").select("id", "block", "mask")
    owners = vectors.where("embedding is not null").select("id").distinct()
    wanted = materialize(nodes.select("id").join(graph.small(owners), "id", "left_semi").distinct(), "wanted")
    masks = reached_by(seeds, edges, n_hops, wanted).groupBy("id").agg(F.collect_list("block").alias("blocks"), F.collect_list("mask").alias("masks"))
    held = vectors.where("embedding is not null").select("id", "embedding").join(masks, "id")
    width = (numbered.agg(F.max("block")).first()[0] or 0) + 1

    def bits(batch: pa.RecordBatch) -> np.ndarray:
        of = np.repeat(np.arange(batch.num_rows), pc.list_value_length(batch.column(3)).to_numpy(zero_copy_only=False))
        out = np.zeros((batch.num_rows, width), np.int64)
        out[of, batch.column(3).flatten().to_numpy(zero_copy_only=False)] = batch.column(4).flatten().to_numpy(zero_copy_only=False)
        return out.view(np.float64)  # as they are, in the type that extras have

    def reaches(asked: np.ndarray, rows: np.ndarray) -> np.ndarray:
        is_set = np.unpackbits(np.ascontiguousarray(rows).view(np.uint8), axis=1, bitorder="little")
        return is_set[:, asked[:, 0].astype(np.int64)].T.astype(bool)

    place = (F.col("block") * 64 + F.col("no") % MASK_BITS).alias("place")
    asked = dense.packed(numbered.select("query_id", "query", F.lit(0).alias("cell"), place), "asked", lambda batch: batch.column(3).to_numpy(zero_copy_only=False).astype(np.float64)[:, None])
    rows = dense.packed(held.select("id", "embedding", F.lit(0).alias("cell"), "blocks", "masks"), "reached", bits)
    best = materialize(dense.best_rows(asked, rows, final_top_k, itself=True, allowed=reaches).select("query_id", "rank", "id", "score"), "best")
    discard(asked, rows)
    # only edges between any of the best nodes are sorted out by query
    between = graph.induced(edges, graph.small(best.select("id").distinct()))
    end = lambda c: best.select("query_id", F.col("id").alias(c))
    return best, graph.distinct_edges(between).join(end("source"), "source").join(end("target"), ["query_id", "target"]).select("query_id", "type", "source", "target")


def retrieve(
    nodes: DataFrame, edges: DataFrame, vectors: DataFrame, chunks: DataFrame, query: Sequence[float], entities: Sequence[str] = (),
    kg_top_k: int = RETRIEVAL["kg_top_k"], vector_top_k: int = RETRIEVAL["vector_top_k"], n_hops: int = RETRIEVAL["n_hops"],
    final_top_k: int = RETRIEVAL["final_top_k"], kg_weight: float = RETRIEVAL["kg_weight"], vector_weight: float = RETRIEVAL["vector_weight"],
) -> tuple[DataFrame, DataFrame]:
    """(the final hits, enriched, with ``nth`` from 1; one row of counters): graph retrieval and chunk search, fused. ``chunks`` have an
    ``embedding``; ``nodes`` the columns that hits and their enrichment show."""
    best, _ = retrieve_subgraph(nodes, edges, vectors, query, entities, kg_top_k, n_hops, kg_top_k)
    # in the order of score, which the merge takes for the order of hits
    ranked = best.withColumn("ord", F.row_number().over(hybrid.Window.orderBy(F.desc("score"), "id")).cast("long"))
    kg = materialize(hybrid.kg_hits(nodes.drop("ord").join(F.broadcast(ranked.select("id", "ord")), "id")), "kg")
    nth = F.row_number().over(hybrid.Window.orderBy(F.desc("score"), "chunk_id"))  # of at most vector_top_k rows
    found = materialize(vector.top_k(chunks, query, vector_top_k, id_col="chunk_id").withColumn("rank", nth), "chunk-hits")
    merged = materialize(hybrid.merge(kg, found, kg_weight, vector_weight), "merged")
    final = hybrid.best(merged, final_top_k)
    place = F.row_number().over(hybrid.Window.orderBy(F.desc("combined_score"), "kind", "place"))
    out = materialize(hybrid.enrich(final.withColumn("nth", place), nodes), "hits")
    return out, hybrid.counters(kg, found, merged, out)


def debug_retrieval(nodes: DataFrame, edges: DataFrame, vectors: DataFrame, chunks: DataFrame, query: Sequence[float]) -> tuple[DataFrame, DataFrame]:
    """:func:`retrieve` with the settings for errors."""
    return retrieve(nodes, edges, vectors, chunks, query, **DEBUG_RETRIEVAL)


def code_context(hits: DataFrame) -> DataFrame:
    """The reply to a request for code: (nth, name, type, file, score, summary, content_preview) of final hits."""
    return hits.select("nth", "name", "type", F.col("file_path").alias("file"), F.col("combined_score").alias("score"), F.coalesce("summary", F.lit("")).alias("summary"), triage.preview(F.col("content")).alias("content_preview"))


def classify_errors(reports: DataFrame, reply: Callable[[Column], Column] | None = None, message: str = "error_message") -> DataFrame:
    """Reports with ``classification``, ``confidence``, ``reasoning`` and ``key_indicators``: of the model's ``reply`` to the prompt
    (a column of the prompt), or of our own keyword rules."""
    c = lambda name: F.col(name) if name in reports.columns else F.lit(None)
    if reply is None:
        label = triage.classified(F.col(message))
        found = F.struct(label.alias("classification"), F.when(label == "other", F.lit(triage.FALLBACK[1])).otherwise(F.lit(0.9)).alias("confidence"), F.lit("keywords").alias("reasoning"), F.array().cast("array<string>").alias("key_indicators"))
    else:
        prompt = triage.classification_prompt(F.col(message), c("stack_trace").cast("string"), c("file_path").cast("string"), c("line_number").cast("int"), c("context").cast("string"))
        found = triage.parsed_reply(reply(prompt))
    return reports.withColumn("_found", found).select(*reports.columns, "_found.*")


def debug_replies(solutions: DataFrame, code: DataFrame, key: str = "event_id") -> DataFrame:
    """The reply to each report: class, confidence, explanation, how many pieces of code were found and in which distinct files
    (null without any), suggested fixes and further steps of the explanation (null without any). ``code``: (key, file_path) of each
    report's final hits."""
    files = code.groupBy(key).agg(F.count(F.lit(1)).alias("relevant_code_count"), F.array_sort(F.collect_set("file_path")).alias("relevant_files"))
    some = lambda c: F.when(F.size(c) > 0, c)
    text = F.col("explanation")
    return solutions.join(files, key, "left").select(
        key, F.lit("success").alias("status"), F.col("classification").alias("error_classification"), "confidence", "explanation", "relevant_code_count", "relevant_files",
        some(triage.fixes(text)).alias("suggested_fixes"), some(triage.steps(text)).alias("additional_steps"))


def related_code(reports: DataFrame, files: DataFrame, contains: DataFrame, functions: DataFrame, calls: DataFrame, key: str = "event_id", most: int = 10) -> DataFrame:
    """(key, file_path, function_code, related): for each report's file, that file's function of the report's name (null without one)
    and the code of the functions within two calls of it in either direction, one for each path; ``most`` rows a report."""
    named = contains.join(functions.select(F.col("id").alias("function"), F.col("name").alias("function_name"), F.col("code").alias("function_code")), "function")
    wanted = reports.select(key, "file_path", "function_name").join(files.select("file_path").distinct(), "file_path", "left_semi")
    held = wanted.join(named, ["file_path", "function_name"], "left")
    ends = graph.paths_up_to_two(held.where("function is not null").select(F.col("function").alias("id")).distinct(), calls)
    code = ends.join(functions.select(F.col("id").alias("end"), "code"), "end").groupBy(F.col("start").alias("function")).agg(F.array_sort(F.collect_list("code")).alias("related"))
    none = F.array().cast("array<string>")
    nth = F.row_number().over(hybrid.Window.partitionBy(key).orderBy("function"))
    return held.join(code, "function", "left").withColumn("nth", nth).where(F.col("nth") <= most).select(key, "file_path", "function_code", F.coalesce("related", none).alias("related"))
