"""A tree of Python files derived from the tables: a package for each nation, a module for each of its suppliers, and some that a
scan has to leave out. Queries over source code read it; the SQL has the same texts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrygraph.session import table
from quarrygraph.sources import folders, python_repo
from quarrygraph.sources.shared import shared_dir

_MODULE = '''"""Supplier %1$s of nation %2$s."""
import os
from n%2$s import base_%2$s as base


class Supplier%1$s:
    """Reached by %3$s."""

    nation = %2$s

    def total(self, n):
        """Sums up."""
        return base(n)


def order_%1$s(x):
    os.getcwd()
    return Supplier%1$s()
'''
_PACKAGE = '''def base_%1$s(n):
    return n + %2$s
'''
#: The lines of a module that elements begin at, by type.
MODULE_LINES = {"file": 1, "class": 6, "attribute": 9, "method": 11, "function": 16}


def _sql(text: str, *values: str) -> str:
    parts = text.replace("'", "''")
    for i, v in enumerate(values, 1):
        parts = parts.replace(f"%{i}$s", f"' || {v} || '")
    return f"'{parts}'"


MODULE_SQL, PACKAGE_SQL = _sql(_MODULE, "s_suppkey", "s_nationkey", "s_name"), _sql(_PACKAGE, "n_nationkey", "n_regionkey")
CLASS_SQL = _sql("\n".join(_MODULE.split("\n")[5:13]), "s_suppkey", "s_nationkey", "s_name")
METHOD_SQL = _sql("\n".join(_MODULE.split("\n")[10:13]), "s_suppkey", "s_nationkey", "s_name")
FUNCTION_SQL = _sql("\n".join(_MODULE.split("\n")[15:18]), "s_suppkey", "s_nationkey", "s_name")
PACKAGE_FUNCTION_SQL = _sql(_PACKAGE.rstrip("\n"), "n_nationkey", "n_regionkey")
PATH_SQL = "'n' || s_nationkey || '/s' || s_suppkey || '.py'"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content) of the tree."""
    text = lambda c: F.col(c).cast("string")
    supplier, nation = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    path = lambda k, *rest: F.concat(F.lit("n"), text(k), *rest).alias("path")
    modules = supplier.select(path("s_nationkey", F.lit("/s"), text("s_suppkey"), F.lit(".py")), F.format_string(_MODULE, text("s_suppkey"), text("s_nationkey"), "s_name").alias("content"))
    package = F.format_string(_PACKAGE, text("n_nationkey"), text("n_regionkey")).alias("content")
    out = modules.unionByName(nation.select(path("n_nationkey", F.lit("/__init__.py")), package))
    for other in ("/__pycache__/cached.py", "/tests/test_it.py", "/notes.txt"):
        out = out.unionByName(nation.select(path("n_nationkey", F.lit(other)), package))
    return out.unionByName(nation.select(path("n_nationkey", F.lit("/broken.py")), F.lit("def (:\n").alias("content")))


def written(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str]:
    """((path, content) of the tree's Python files, as scanned; its root)."""
    root = f"{shared_dir(spark)}/tree-{uuid.uuid4().hex}"
    folders.write_files(files(spark, sf_dir), root)
    # folders named tests are left out by name; the shared folder's own name isn't the tree's
    found = python_repo.python_files(spark, root, ("__pycache__", "test_", "/tests/"))
    return found, f"{root}/"


def repository(spark: SparkSession, sf_dir: str, loads: bool = False) -> tuple[dict[str, DataFrame], str]:
    found, root = written(spark, sf_dir)
    return python_repo.repository(found, root, loads), root
