"""Graph loading: validation, keys, deduplication, endpoint resolution and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrygraph.functions.text import first_truthy, truthy
from quarrygraph.schemas import NODE_TYPES

#: Fixed value: node type to collection.
COLLECTIONS = {"file": "File", "class": "Class", "method": "Method", "function": "Function", "attribute": "Attribute", "generated_description": "Generated_Description"}


def is_valid() -> Column:
    return truthy(F.col("type")).isNotNull() & truthy(F.col("name")).isNotNull()


def validated(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with a type and a name, the others)."""
    ok = F.coalesce(is_valid(), F.lit(False))
    return nodes.where(ok), nodes.where(~ok)


def unique_key(nodes: DataFrame) -> Column:
    """The id, or else a key made of the type and its parts; rows that lack a part get the md5 of their fields in order of the names."""
    c = lambda name: F.trim(F.coalesce(F.col(name), F.lit("")))
    path, name, parent = F.replace(c("file_path"), F.lit("\\"), F.lit("/")), c("name"), c("parent")
    line, kind = F.coalesce(F.col("line_number"), F.lit(0)).cast("string"), F.coalesce(F.col("type"), F.lit("unknown"))
    has = lambda *parts: F.forall(F.array(*parts), lambda p: p != "")
    key = (
        F.when((kind == "file") & has(path), F.concat_ws(":", kind, path))
        .when((kind == "class") & has(path, name), F.concat_ws(":", kind, path, name))
        .when(kind.isin("method", "attribute") & has(path, parent, name), F.concat_ws(":", kind, path, parent, name, line))
        .when((kind == "function") & has(path, name), F.concat_ws(":", kind, path, name, line))
        .when((kind == "generated_description") & has(path, name), F.concat_ws(":", F.lit("desc"), path, name, line))
    )
    row = F.concat_ws("\x1f", *(F.coalesce(F.col(x).cast("string"), F.lit("")) for x in sorted(nodes.columns)))
    fallback = F.concat(F.when(kind == "generated_description", F.lit("desc")).otherwise(kind), F.lit(":unknown_"), F.md5(row))
    return F.coalesce(truthy(F.col("id")), key, fallback)


def store_key(key: Column) -> Column:
    """``:``, ``/`` and ``.`` as ``_``: different keys can become equal."""
    return F.translate(key, ":/.", "___")


def collection(kind: Column) -> Column:
    """The collection of a node type; of others, every run of letters capitalised."""
    known = F.create_map(*(F.lit(x) for pair in COLLECTIONS.items() for x in pair))
    return F.coalesce(F.try_element_at(known, kind), title(kind))


def title(text: Column) -> Column:
    return F.array_join(F.transform(F.split(text, "_"), lambda w: F.initcap(w)), "_")


def edge_collection(kind: Column) -> Column:
    return title(F.coalesce(kind, F.lit("UNKNOWN")))


def relation_label(kind: Column) -> Column:
    return F.upper(F.coalesce(kind, F.lit("UNKNOWN")))


def first_of_each(rows: DataFrame, key: str, order: str = "ord") -> DataFrame:
    """Each key's row with the least ``order``; rows are compared before they are shuffled."""
    return rows.groupBy(key).agg(F.min_by(F.struct(*rows.columns), order).alias("x")).select("x.*")


def latest_of_each(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Upsert: each key's row with the greatest ``order``."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), order).alias("x")).select("x.*")


def documents(nodes: DataFrame) -> DataFrame:
    """Valid nodes as stored documents, one for each key and collection; empty optional fields become null."""
    valid, _ = validated(nodes)
    keyed = valid.withColumn("unique_key", unique_key(valid)).withColumn("collection", collection(F.col("type")))
    keyed = keyed.withColumn("_key", store_key(F.col("unique_key"))).withColumn("original_id", truthy(F.col("id")))
    optional = [c for c in ("docstring", "source_code", "parent", "full_context", "summary", "signature", "parent_context") if c in nodes.columns]
    lists = [c for c in ("embedding", "related_elements") if c in nodes.columns]
    keyed = keyed.withColumns({c: truthy(F.col(c)) for c in optional} | {c: F.when(F.size(c) > 0, F.col(c)) for c in lists})
    columns = ["collection", "_key", "unique_key", "name", "file_path", "line_number", "type", "original_id", *optional, *lists, "ord"]
    rank = Window.partitionBy("collection", "_key").orderBy("ord")
    return keyed.select(*columns).withColumn("nth", F.row_number().over(rank)).where("nth = 1").drop("nth")


def resolve(edges: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges as (_from, _to, type, collection), edges with an end that isn't stored). An end may be a document's unique key, its
    original id or its store key; the earlier collection in the declared order counts."""
    order = F.array_position(F.array(*(F.lit(COLLECTIONS[t]) for t in NODE_TYPES)), F.col("collection"))
    names = stored.select(F.explode(F.array_distinct(F.array("unique_key", F.coalesce("original_id", "unique_key"), "_key"))).alias("name"), F.concat_ws("/", "collection", "_key").alias("doc"), order.alias("o"))
    by_name = names.groupBy("name").agg(F.min_by("doc", F.struct("o", "doc")).alias("doc"))
    both = edges.join(by_name.select(F.col("name").alias("source"), F.col("doc").alias("_from")), "source", "left").join(
        by_name.select(F.col("name").alias("target"), F.col("doc").alias("_to")), "target", "left")
    found = F.col("_from").isNotNull() & F.col("_to").isNotNull()
    return both.where(found).select("_from", "_to", "type", edge_collection(F.col("type")).alias("collection")), both.where(~found).select(*edges.columns)


def unresolved_ratio(edges: DataFrame, stored: DataFrame) -> DataFrame:
    """(type, unresolved, total, ratio) of the edge types that have unresolved edges."""
    total = edges.groupBy("type").agg(F.count(F.lit(1)).alias("total"))
    lost = resolve(edges, stored)[1].groupBy("type").agg(F.count(F.lit(1)).alias("unresolved"))
    return lost.join(total, "type").select("type", "unresolved", "total", (F.col("unresolved") / F.col("total")).alias("ratio"))


def matched_edges(edges: DataFrame, nodes: DataFrame, key: str = "unique_key") -> DataFrame:
    """Edges whose ends both are nodes, duplicates kept; others give no row."""
    ids = nodes.select(key).distinct()
    return edges.join(ids.withColumnRenamed(key, "source"), "source", "left_semi").join(ids.withColumnRenamed(key, "target"), "target", "left_semi")


def coverage(rows: DataFrame, by: str, fields: list[str]) -> DataFrame:
    """(by, total, with_<field>...): how many rows of each group have each field."""
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("total"), *(F.count(F.col(f)).alias(f"with_{f}") for f in fields))


def counts(rows: DataFrame, by: str) -> DataFrame:
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"))


def embedding_text() -> Column:
    """What is embedded of a node, by its type; null where there is nothing but white space."""
    full, summary, doc = (F.col(c) for c in ("full_context", "summary", "docstring"))
    kind = F.col("type")
    text = (
        F.when(kind == "generated_description", truthy(doc))
        .when(kind.isin("class", "method", "function"), first_truthy(full, summary, doc))
        .when(kind == "file", first_truthy(summary, doc))
    )
    return F.when(F.regexp_replace(text, r"\s", "") != "", text)
