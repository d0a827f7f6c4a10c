"""Python repositories as rows: files, syntax elements, imports and uses, from one pass of a table function over the files."""

from __future__ import annotations

import ast
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrygraph.functions.text import count_of, file_name, first_truthy, line_count, node_key, truthy
from quarrygraph.schemas import EXCLUDED
from quarrygraph.sources import folders
from quarrygraph.sources.shared import materialize

ROWS = (
    "kind string, pos int, type string, name string, line_number int, end_line int, parent string, docstring string, "
    "owner_pos int, base string, used string, alias string, full_name string, error string"
)
_FIELDS = ("kind", "pos", "type", "name", "line_number", "end_line", "parent", "docstring", "owner_pos", "base", "used", "alias", "full_name", "error")


def python_files(spark: SparkSession, path: str, excluded: tuple[str, ...] = EXCLUDED) -> DataFrame:
    """(path, content) of all .py files below ``path`` whose full path holds none of ``excluded``; ``__init__.py`` is one of them."""
    return folders.read_files(folders.walk(spark, path, excluded, ".py"))


def _row(**values) -> tuple:
    return tuple(values.get(f) for f in _FIELDS)


def _uses(node: ast.AST, loads: bool) -> Iterator[tuple[str | None, str]]:
    """(base, name) of what calls name; with ``loads``, of every name and attribute that is read too."""
    for x in ast.walk(node):
        if isinstance(x, ast.Call):
            if isinstance(x.func, ast.Name):
                yield None, x.func.id
            elif isinstance(x.func, ast.Attribute) and isinstance(x.func.value, ast.Name):
                yield x.func.value.id, x.func.attr
        elif loads and isinstance(x, ast.Name) and isinstance(x.ctx, ast.Load):
            yield None, x.id
        elif loads and isinstance(x, ast.Attribute) and isinstance(x.ctx, ast.Load) and isinstance(x.value, ast.Name):
            yield x.value.id, x.attr


def elements_of(content: str, loads: bool = False) -> Iterator[tuple]:
    """Rows of one file: the module, its classes, functions, methods, attributes, imports, uses and class-body assignments.

    Function bodies aren't entered; a class within a class has no parent. ``pos`` numbers elements in order of the text.
    """
    tree = ast.parse(content)
    pos = 0
    yield _row(kind="element", pos=0, type="file", line_number=1, docstring=ast.get_docstring(tree))
    stack: list[tuple[ast.AST, str | None]] = [(x, None) for x in reversed(list(ast.iter_child_nodes(tree)))]
    while stack:
        node, parent = stack.pop()
        if isinstance(node, ast.ClassDef):
            pos += 1
            yield _row(kind="element", pos=pos, type="class", name=node.name, line_number=node.lineno, end_line=node.end_lineno, docstring=ast.get_docstring(node))
            if node.col_offset == 0:  # indented source isn't parsed again
                for name in sorted(_assigned(node)):
                    yield _row(kind="class_name", owner_pos=pos, name=name)
            stack += [(x, node.name) for x in reversed(list(ast.iter_child_nodes(node)))]
        elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            pos += 1
            kind = "method" if parent else "function"
            yield _row(kind="element", pos=pos, type=kind, name=node.name, line_number=node.lineno, end_line=node.end_lineno, parent=parent, docstring=ast.get_docstring(node))
            for base, name in _uses(node, loads):
                yield _row(kind="use", owner_pos=pos, base=base, used=name)
        elif isinstance(node, (ast.Import, ast.ImportFrom)):
            module = getattr(node, "module", None) or ""
            for a in node.names:
                full = a.name if isinstance(node, ast.Import) or not module else f"{module}.{a.name}"
                yield _row(kind="import", pos=node.lineno, alias=a.asname or a.name, full_name=full)
        elif isinstance(node, ast.Assign) and parent:
            for target in node.targets:
                if name := _target(target):
                    pos += 1
                    yield _row(kind="element", pos=pos, type="attribute", name=name, line_number=node.lineno, parent=parent)
        else:
            stack += [(x, parent) for x in reversed(list(ast.iter_child_nodes(node)))]


def _target(target: ast.AST) -> str | None:
    if isinstance(target, ast.Name):
        return target.id
    if isinstance(target, ast.Attribute) and isinstance(target.value, ast.Name) and target.value.id == "self":
        return target.attr
    return None


def _assigned(node: ast.ClassDef) -> set[str]:
    return {name for x in ast.walk(node) if isinstance(x, ast.Assign) for t in x.targets if (name := _target(t))}


class _Extract:
    def eval(self, content: str, loads: bool) -> Iterator[tuple]:
        try:
            rows = list(elements_of(content or "", bool(loads)))
        except (SyntaxError, ValueError, RecursionError) as problem:
            rows = [_row(kind="error", error=f"{type(problem).__name__}: {problem}")]
        yield from rows


class _Functions:
    def eval(self, content: str) -> Iterator[tuple]:
        try:
            found = dict.fromkeys(x.name for x in ast.walk(ast.parse(content or "")) if isinstance(x, ast.FunctionDef))
        except (SyntaxError, ValueError, RecursionError):
            yield None, False
            return
        yield None, True
        for name in found:
            yield name, True


def function_graph(files: DataFrame, root: str = "") -> tuple[DataFrame, DataFrame]:
    """The minimal intake: (path, content) of every file that parses, with its path below ``root``; (path, name) of the functions it
    contains at any depth, each name once. Files that don't parse are left out of both."""
    table = F.udtf(_Functions, returnType="name string, ok boolean")
    rows = materialize(files.lateralJoin(table(F.col("content").outer())).where("ok").select(F.replace("path", F.lit(root), F.lit("")).alias("path"), "name", F.when(F.col("name").isNull(), F.col("content")).alias("content")), "function-graph")
    return rows.where("name is null").select("path", "content"), rows.where("name is not null").select("path", "name")


def extracted(files: DataFrame, loads: bool = False) -> DataFrame:
    """The rows of all files, a row with ``error`` in place of those of a file that can't be parsed."""
    table = F.udtf(_Extract, returnType=ROWS)
    return files.lateralJoin(table(F.col("content").outer(), F.lit(loads)))


def repository(files: DataFrame, root: str = "", loads: bool = False) -> dict[str, DataFrame]:
    """``nodes`` without contexts, ``imports`` (the last of equal aliases), ``uses`` and ``errors`` of a repository."""
    rows = materialize(extracted(files, loads), "syntax")  # five tables are taken from it
    lines = F.split("content", "\n", -1)
    source = F.when(F.col("type") == "file", F.col("content")).when(F.col("type") == "attribute", F.lit("")).otherwise(
        F.array_join(F.slice(lines, F.col("line_number"), F.greatest(F.col("end_line") - F.col("line_number") + 1, F.lit(0))), "\n"))
    name = F.when(F.col("type") == "file", file_name(F.col("path"))).otherwise(F.col("name"))
    elements = rows.where("kind = 'element'").select(
        F.col("path").alias("file_path"), "pos", "type", name.alias("name"), "line_number", "docstring", source.alias("source_code"), "parent",
        F.length("content").alias("file_size"), line_count(F.col("content")).alias("num_lines"), F.replace("path", F.lit(root), F.lit("")).alias("relative_path"))
    elements = elements.withColumn("id", node_key(F.col("type"), F.col("file_path"), F.col("parent"), F.col("name"), F.col("line_number")))
    # order: path, then text; a later element with the same id takes the place of the earlier one
    first = elements.groupBy("id").agg(F.max_by(F.struct(*[c for c in elements.columns if c != "id"]), "pos").alias("x"), F.min("pos").alias("first")).select("id", "x.*", "first")
    nodes = first.drop("pos").withColumnRenamed("first", "pos")
    imports = rows.where("kind = 'import'").groupBy(F.col("path").alias("file_path"), "alias").agg(F.max_by("full_name", "pos").alias("full_name"))
    key = ["file_path", "owner_pos"]
    owners = elements.where("type in ('function', 'method')").select("file_path", F.col("pos").alias("owner_pos"), F.col("id").alias("user_id"))
    uses = rows.where("kind = 'use'").select(F.col("path").alias("file_path"), "owner_pos", "base", "used").join(owners, key)
    names = rows.where("kind = 'class_name'").select(F.col("path").alias("file_path"), "owner_pos", "name").join(
        elements.where("type = 'class'").select("file_path", F.col("pos").alias("owner_pos"), F.col("id").alias("class_id")), key)
    return {"nodes": nodes, "imports": imports, "uses": uses, "class_names": names, "errors": rows.where("kind = 'error'").select(F.col("path").alias("file_path"), "error")}


def file_summary(name, docstring, source, class_token: str = "class ", def_token: str = "def "):
    """The summary of a file: its lines, the beginning of its docstring, and counts of two substrings."""
    return F.concat(
        F.lit("File: "), name, F.lit(" ("), line_count(source).cast("string"), F.lit(" lines)"), F.coalesce(F.concat(F.lit("\nDescription: "), F.substring(truthy(docstring), 1, 200)), F.lit("")),
        F.lit("\nContains: "), count_of(source, class_token).cast("string"), F.lit(" classes, "), count_of(source, def_token).cast("string"), F.lit(" functions/methods"))


__all__ = ["elements_of", "extracted", "file_summary", "first_truthy", "python_files", "repository"]
