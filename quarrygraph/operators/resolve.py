"""Structural and usage edges of a code graph: name resolution as joins on aggregated lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def structural_edges(nodes: DataFrame) -> DataFrame:
    """defines_class, defines_function, has_method and has_attribute; of classes with one name in a file, the first."""
    files = nodes.where("type = 'file'").select("file_path", F.col("id").alias("source"))
    classes = nodes.where("type = 'class'").groupBy("file_path", F.col("name").alias("parent")).agg(F.min_by("id", "pos").alias("source"))
    kind = lambda pairs: F.element_at(F.create_map(*(F.lit(x) for p in pairs for x in p)), F.col("type"))
    top = nodes.where("type in ('class', 'function')").join(files, "file_path").select(kind((("class", "defines_class"), ("function", "defines_function"))).alias("type"), "source", F.col("id").alias("target"))
    inner = nodes.where("type in ('method', 'attribute')").join(classes, ["file_path", "parent"]).select(kind((("method", "has_method"), ("attribute", "has_attribute"))).alias("type"), "source", F.col("id").alias("target"))
    return top.unionByName(inner)


def module_files(full_names: DataFrame, paths: DataFrame, root: str) -> DataFrame:
    """(full_name, file_path): the file of the module before the last segment: its path with .py, else its package, else a file
    of the last segment at the root."""
    head = F.array_join(F.slice(F.split("full_name", r"\."), 1, F.size(F.split("full_name", r"\.")) - 1), "/")
    options = F.array(
        F.struct(F.lit(0).alias("rank"), F.concat(F.lit(root + "/"), head, F.lit(".py")).alias("file_path")), F.struct(F.lit(1).alias("rank"), F.concat(F.lit(root + "/"), head, F.lit("/__init__.py")).alias("file_path")),
        F.struct(F.lit(2).alias("rank"), F.concat(F.lit(root + "/"), F.element_at(F.split(head, "/"), -1), F.lit(".py")).alias("file_path")))
    dotted = full_names.where(F.contains("full_name", F.lit("."))).select("full_name", F.explode(options).alias("o")).select("full_name", "o.*")
    return dotted.join(paths.select("file_path").distinct(), "file_path").groupBy("full_name").agg(F.min_by("file_path", "rank").alias("file_path"))


def usage_edges(nodes: DataFrame, imports: DataFrame, uses: DataFrame, by_module: bool = False, root: str = "", dedup: bool = True) -> DataFrame:
    """used_in edges from the user to what it uses, for files with imports only.

    A plain name is first looked for among the classes, functions and methods of its file, then through its import; ``base.name``
    needs an import of the base. An import leads to the first class or function in the corpus with its last segment as name, or
    with ``by_module`` to that in the module's own file, such edges being ``imports``. ``dedup``: each edge once.
    """
    order = F.struct("file_path", "pos")
    local = nodes.where("type in ('class', 'function', 'method')").groupBy("file_path", F.col("name").alias("used")).agg(F.min_by("id", "pos").alias("local_id"))
    anywhere = nodes.where("type in ('class', 'function')").groupBy("name").agg(F.min_by("id", order).alias("far_id"))
    parsed = uses.join(imports.select("file_path").distinct(), "file_path", "left_semi")
    last = F.element_at(F.split("target", r"\."), -1)
    targets = imports.select("file_path", "alias", F.col("full_name").alias("target"))
    plain = parsed.where("base is null").join(local, ["file_path", "used"], "left").join(targets.withColumnRenamed("alias", "used"), ["file_path", "used"], "left")
    dotted = parsed.where("base is not null").join(targets.withColumnRenamed("alias", "base"), ["file_path", "base"]).withColumn("local_id", F.lit(None).cast("string"))
    dotted = dotted.withColumn("target", F.concat_ws(".", "target", "used"))
    every = plain.select("user_id", "local_id", "target").unionByName(dotted.select("user_id", "local_id", "target"))
    if by_module:
        of = module_files(imports.select("full_name").unionByName(dotted.select(F.col("target").alias("full_name"))).distinct(), nodes.where("type = 'file'"), root)
        inside = nodes.where("type in ('class', 'function')").groupBy("file_path", "name").agg(F.min_by("id", "pos").alias("module_id"))
        found = of.withColumn("name", F.element_at(F.split("full_name", r"\."), -1)).join(inside, ["file_path", "name"]).select(F.col("full_name").alias("target"), "module_id")
        every = every.join(found, "target", "left").join(anywhere.withColumnRenamed("name", "last"), (last == F.col("last")) & ~F.contains("target", F.lit(".")), "left").withColumn("far_id", F.coalesce("module_id", "far_id"))
        kind = F.when(F.col("local_id").isNotNull(), "used_in").otherwise("imports")
    else:
        every = every.join(anywhere.withColumnRenamed("name", "last"), last == F.col("last"), "left")
        kind = F.lit("used_in")
    edges = every.select(kind.alias("type"), F.col("user_id").alias("source"), F.coalesce("local_id", "far_id").alias("target")).where("target is not null")
    return edges.distinct() if dedup else edges
