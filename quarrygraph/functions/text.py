"""String expressions with the semantics of the reference's truthiness and stripping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the characters that bullets and numbers begin with.
BULLET = "0123456789.-*• "


def truthy(c: Column) -> Column:
    """Null for an empty string, so that coalesce acts as ``or``."""
    return F.nullif(c, F.lit(""))


def first_truthy(*columns: Column) -> Column:
    return F.coalesce(*(truthy(c) for c in columns))


def count_of(c: Column, token: str) -> Column:
    """How often ``token`` occurs, without overlaps."""
    return ((F.length(c) - F.length(F.replace(c, F.lit(token), F.lit("")))) / F.lit(len(token))).cast("int")


def line_count(c: Column) -> Column:
    return F.size(F.split(c, "\n", -1))


def word_count(c: Column) -> Column:
    """Words between white space."""
    return F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def unbulleted(c: Column) -> Column:
    return F.ltrim(c, F.lit(BULLET))


def node_key(kind: Column, path: Column, parent: Column | None, name: Column, line: Column) -> Column:
    """md5 of type:path[:parent]:name:line, as the model's identity; a file's leaves out its name, a class's its parent."""
    path = F.replace(path, F.lit("\\"), F.lit("/"))
    line = line.cast("string")
    plain = F.concat_ws(":", kind, path, name, line)
    inner = F.concat_ws(":", kind, path, truthy(parent), name, line) if parent is not None else plain
    return F.md5(F.when(kind == "file", F.concat_ws(":", kind, path, line)).when(kind.isin("method", "attribute"), inner).otherwise(plain))
