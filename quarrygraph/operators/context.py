"""Contexts, summaries, signatures and descriptions of code elements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrygraph.functions.text import line_count, node_key, truthy, word_count
from quarrygraph.sources.python_repo import file_summary


def quoted(doc: Column, end: str) -> Column:
    return F.coalesce(F.concat(F.lit('"""'), truthy(doc), F.lit('"""' + end)), F.lit(""))


def signature(source: Column) -> Column:
    """The lines up to the first that holds both ``:`` and ``def ``, all lines without one."""
    lines = F.split(source, "\n", -1)
    at = F.array_position(F.transform(lines, lambda x: F.contains(x, F.lit(":")) & F.contains(x, F.lit("def "))), F.lit(True))
    return F.array_join(F.when(at > 0, F.slice(lines, 1, at.cast("int"))).otherwise(lines), "\n")


def element_summary(kind: Column, name: Column, parent: Column, doc: Column) -> Column:
    what = F.when(kind == "method", "Method").otherwise("Function")
    return F.concat(what, F.lit(" '"), name, F.lit("'"), F.coalesce(F.concat(F.lit(" in class '"), truthy(parent), F.lit("'")), F.lit("")), F.coalesce(F.concat(F.lit(". "), F.substring(truthy(doc), 1, 150)), F.lit("")))


def described(kind: Column, name: Column, source: Column, returns: str = "return", own: str = "self", init: str = "def __init__") -> Column:
    """The rule-based description: lines, and what the source holds."""
    return F.concat(
        F.lit("This "), kind, F.lit(" named '"), name, F.lit("' contains "), line_count(source).cast("string"), F.lit(" lines of code. "),
        F.when(F.contains(source, F.lit(returns)), "It returns a value. ").otherwise(""),
        F.when(F.contains(source, F.lit(own)) & (kind == "method"), "It operates on instance data. ").otherwise(""),
        F.when(F.contains(source, F.lit(init)), "This is a constructor method. ").otherwise(""))


def described_by_words(kind: Column, name: Column, source: Column) -> Column:
    """The earlier description: the number of words."""
    return F.concat(F.lit("This "), kind, F.lit(" named '"), name, F.lit("' contains approximately "), word_count(source).cast("string"), F.lit(" words of code."))


def with_contexts(nodes: DataFrame, class_names: DataFrame) -> DataFrame:
    """Nodes with full_context, summary, signature, parent_context, related_elements, attributes and metadata."""
    members = nodes.where("type in ('method', 'attribute')")
    methods = members.where("type = 'method'").groupBy("file_path", F.col("parent").alias("name")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "id", "name", "docstring", "source_code"))).alias("methods"))
    own = members.where("type = 'attribute'").select("file_path", F.col("parent").alias("class"), "name")
    classes = nodes.where("type = 'class'").select("id", "file_path", F.col("name").alias("class"))
    names = own.join(classes, ["file_path", "class"]).select("id", "name").unionByName(class_names.select(F.col("class_id").alias("id"), "name"))
    attributes = names.groupBy("id").agg(F.array_sort(F.collect_set("name")).alias("attributes"))
    none = F.array().cast("array<struct<pos:int,id:string,name:string,docstring:string,source_code:string>>")
    of_class = nodes.where("type = 'class'").join(methods, ["file_path", "name"], "left").join(attributes, "id", "left")
    of_class = of_class.withColumn("methods", F.coalesce("methods", none)).withColumn("attributes", F.coalesce("attributes", F.array().cast("array<string>")))
    number = lambda c: F.size(c).cast("string")
    full = F.concat(
        F.lit("# Class: "), F.col("name"), F.lit("\n"), quoted(F.col("docstring"), "\n\n"), F.lit("## Class Definition:\n"), F.col("source_code"), F.lit("\n\n"),
        F.when(F.size("attributes") > 0, F.concat(F.lit("## Attributes ("), number("attributes"), F.lit("):\n"), F.array_join(F.transform("attributes", lambda a: F.concat(F.lit("- "), a, F.lit("\n"))), ""), F.lit("\n"))).otherwise(""),
        F.when(F.size("methods") > 0, F.concat(F.lit("## Methods ("), number("methods"), F.lit("):\n"), F.array_join(F.transform(
            "methods", lambda m: F.concat(F.lit("\n### "), m["name"], F.lit(":\n"), quoted(m["docstring"], "\n"), m["source_code"], F.lit("\n"))), ""))).otherwise(""))
    summary = F.concat(F.lit("Class '"), F.col("name"), F.lit("' with "), number("methods"), F.lit(" methods and "), number("attributes"), F.lit(" attributes"), F.coalesce(F.concat(F.lit(". "), F.substring(truthy(F.col("docstring")), 1, 150)), F.lit("")))
    text, numbers, strings = (F.lit(None).cast(t) for t in ("string", "int", "array<string>"))
    meta = lambda **x: F.struct(*(x.get(k, d).alias(k) for k, d in (("file_size", numbers), ("num_lines", numbers), ("relative_path", text), ("num_methods", numbers), ("num_attributes", numbers), ("method_names", strings), ("attribute_names", strings), ("element_type", text), ("element_id", text))))
    keep = ["id", "name", "type", "file_path", "line_number", "docstring", "source_code", "parent", "pos"]
    out = of_class.select(*keep, full.alias("full_context"), summary.alias("summary"), text.alias("signature"), text.alias("parent_context"), F.col("methods.id").alias("related_elements"), "attributes",
                          meta(num_methods=F.size("methods"), num_attributes=F.size("attributes"), method_names=F.col("methods.name"), attribute_names=F.col("attributes")).alias("metadata"))
    parents = nodes.where("type = 'class'").groupBy("file_path", F.col("name").alias("parent")).agg(F.min_by(F.struct("name", "docstring"), "pos").alias("p"))
    rest = nodes.where("type != 'class'").join(parents, ["file_path", "parent"], "left")
    kind = F.col("type")
    of_method = F.when((kind == "method") & F.col("p").isNotNull(), F.concat(F.lit("# Parent Class: "), F.col("p.name"), F.lit("\n"), quoted(F.col("p.docstring"), "\n\n")))
    of_attribute = F.when((kind == "attribute") & F.col("p").isNotNull(), F.concat(F.lit("# Class: "), F.col("p.name"), F.lit("\n"), quoted(F.col("p.docstring"), "\n\n"), F.lit("Attribute: "), F.col("name"), F.lit("\n"), F.col("source_code")))
    of_function = F.concat(F.coalesce(of_method, F.lit("")), F.when(kind == "method", "# Method: ").otherwise("# Function: "), F.col("name"), F.lit("\n"), quoted(F.col("docstring"), "\n\n"), F.col("source_code"))
    is_function = kind.isin("method", "function")
    more = rest.select(
        *keep, F.when(kind == "file", F.col("source_code")).when(is_function, of_function).otherwise(of_attribute).alias("full_context"),
        F.when(kind == "file", file_summary(F.col("name"), F.col("docstring"), F.col("source_code"))).when(is_function, element_summary(kind, F.col("name"), F.col("parent"), F.col("docstring"))).alias("summary"),
        F.when(is_function, signature(F.col("source_code"))).alias("signature"), F.coalesce(of_method, of_attribute).alias("parent_context"), F.array().cast("array<string>").alias("related_elements"), F.array().cast("array<string>").alias("attributes"),
        F.when(kind == "file", meta(file_size=F.col("file_size"), num_lines=F.col("num_lines"), relative_path=F.col("relative_path"))).alias("metadata"))
    return out.unionByName(more)


def description_nodes(nodes: DataFrame, suffix_line: bool = False, describe=described) -> tuple[DataFrame, DataFrame]:
    """(description nodes, has_description edges) of the classes, methods and functions with source."""
    have = nodes.where(F.col("type").isin("class", "method", "function") & truthy(F.col("source_code")).isNotNull())
    name = F.concat(F.col("name"), F.lit("_description"), *([F.lit("_"), F.col("line_number").cast("string")] if suffix_line else []))
    made = have.select(F.col("id").alias("element_id"), F.col("type").alias("element_type"), name.alias("name"), "file_path", "line_number", describe(F.col("type"), F.col("name"), F.col("source_code")).alias("docstring"), F.col("name").alias("parent"))
    made = made.withColumn("type", F.lit("generated_description")).withColumn("id", node_key(F.lit("generated_description"), F.col("file_path"), None, F.col("name"), F.col("line_number")))
    return made, made.select(F.lit("has_description").alias("type"), F.col("element_id").alias("source"), F.col("id").alias("target"))
