"""Error triage: trace parsing, query building, line extraction, JSON replies, routing and prompts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrygraph.functions.text import file_name, stripped, truthy, unbulleted

REPLY = "classification string, confidence double, reasoning string, key_indicators array<string>"
#: The answer where a reply can't be parsed, and our own keyword rules for classes.
FALLBACK = ("other", 0.5, "Failed to parse classification response")
KEYWORDS = {
    "environment": r"modulenotfound|importerror|no module named|dependency|package|not installed|config",
    "authentication": r"permission|denied|unauthori[sz]ed|forbidden|token|credential|login|auth",
    "network": r"timeout|timed out|connection|dns|socket|unreachable|network|http 5",
    "debug": r"error|exception|traceback|assert",
}


def trace_fields(trace: Column) -> dict[str, Column]:
    """primary_file, primary_line, primary_function and error_type; empty or 0 where the trace has none."""
    frame = r'File "([^"]+)", line (\d+)'
    return {
        "primary_file": F.regexp_extract(trace, frame, 1), "primary_line": F.coalesce(F.try_to_number(truthy(F.regexp_extract(trace, frame, 2)), F.lit("999999999")).cast("int"), F.lit(0)),
        "primary_function": F.regexp_extract(trace, r"in (\w+)", 1), "error_type": F.regexp_extract(trace, r"(?m)(\w+Error): (.+)$", 1),
    }


def search_query(message: Column, path: Column, context: Column) -> Column:
    """Words of the message that hold ``exception`` or ``error``, the file's stem and 50 characters of context: the first five."""
    words = F.filter(F.split(F.lower(message), r"\s+"), lambda w: F.contains(w, F.lit("exception")) | F.contains(w, F.lit("error")))
    stem = F.replace(file_name(truthy(path)), F.lit(".py"), F.lit(""))
    more = F.array_compact(F.array(stem, F.substring(truthy(context), 1, 50)))
    return F.array_join(F.slice(F.concat(F.coalesce(words, F.array().cast("array<string>")), more), 1, 5), " ")


def _lines(response: Column) -> Column:
    return F.transform(F.split(response, "\n", -1), lambda x: stripped(x))


def _bulleted(line: Column) -> Column:
    return line.startswith("-") | line.startswith("*") | line.startswith("•")


def fixes(response: Column) -> Column:
    """At most ten lines that are numbered 1 to 5, bulleted or hold fix:, change: or update:, of over 10 characters."""
    def wanted(line: Column) -> Column:
        return (F.regexp_like(line, F.lit(r"^[1-5]\.")) | _bulleted(line) | F.regexp_like(F.lower(line), F.lit("fix:|change:|update:"))) & (F.length(line) > 10)

    return F.slice(F.transform(F.filter(_lines(response), wanted), unbulleted), 1, 10)


def steps(response: Column) -> Column:
    """All lines that are numbered 1 to 9, bulleted or begin with Step or STEP, of over 10 characters."""
    def wanted(line: Column) -> Column:
        return (F.regexp_like(line, F.lit(r"^[1-9]\.")) | _bulleted(line) | line.startswith("Step") | line.startswith("STEP")) & (F.length(line) > 10)

    return F.transform(F.filter(_lines(response), wanted), unbulleted)


def fenced(reply: Column) -> Column:
    """What stands in the first ``json`` fence, else in the first fence, else all of it."""
    def between(mark: str) -> Column:
        return stripped(F.element_at(F.split(F.element_at(F.split(reply, mark, -1), 2), "```", -1), 1))

    return F.when(F.contains(reply, F.lit("```json")), between("```json")).when(F.contains(reply, F.lit("```")), between("```")).otherwise(stripped(reply))


def parsed_reply(reply: Column) -> Column:
    """The reply's JSON as a struct, the fallback where it isn't JSON."""
    label, confidence, reason = FALLBACK
    default = F.struct(F.lit(label).alias("classification"), F.lit(confidence).alias("confidence"), F.lit(reason).alias("reasoning"), F.array().cast("array<string>").alias("key_indicators"))
    text = fenced(reply)
    return F.when(F.try_parse_json(text).isNotNull() & (text != ""), F.from_json(text, REPLY)).otherwise(default)


def classified(message: Column) -> Column:
    """Our own keyword rules in place of a language model: the first class whose words the message holds."""
    out, text = F.lit("other"), F.lower(F.coalesce(message, F.lit("")))
    for label, pattern in reversed(KEYWORDS.items()):
        out = F.when(F.regexp_like(text, F.lit(pattern)), label).otherwise(out)
    return out


def route(classification: Column, has_retriever: bool = True) -> Column:
    return F.when((classification == "debug") & F.lit(has_retriever), "retrieval").otherwise("general")


def preview(content: Column) -> Column:
    return F.concat(F.substring(content, 1, 300), F.lit("..."))


def _optional(label: str, c: Column) -> Column:
    return F.coalesce(F.concat(F.lit(label), truthy(c)), F.lit(""))


def classification_prompt(message: Column, trace: Column, path: Column, line: Column, context: Column) -> Column:
    """Asks a model for one of the classes, as JSON."""
    return F.concat_ws(
        "\n", F.lit("Classify this error as one of: debug, environment, authentication, network, other."), F.concat(F.lit("Error Message: "), message), _optional("Stack Trace: ", trace), _optional("File: ", path),
        _optional("Line: ", F.when(line != 0, line.cast("string"))), _optional("Context: ", context), F.lit('Answer with JSON only: {"classification": ..., "confidence": 0.0-1.0, "reasoning": ..., "key_indicators": [...]}'))


def fix_prompt(message: Column, trace: Column, path: Column, line: Column, code_context: Column) -> Column:
    where = F.when(truthy(path).isNotNull(), F.concat_ws(":", path, F.coalesce(line.cast("string"), F.lit("None"))))
    return F.concat_ws("\n", F.lit("Explain and fix this error with the help of the code below: root cause, concrete fixes, steps, prevention."), message, _optional("Stack Trace: ", trace), _optional("File: ", where), F.lit("Code:"), code_context)


def solution_prompt(kind: Column, message: Column, context: Column) -> Column:
    return F.concat_ws("\n", F.concat(F.lit("Give likely causes, steps, checks and prevention for this "), F.upper(kind), F.lit(" error.")), message, _optional("Context: ", context))


def ticket_text(summary: Column, description: Column) -> tuple[Column, Column]:
    """(the ticket's title of at most 100 characters, what is embedded of it)."""
    return F.substring(summary, 1, 100), F.concat_ws(" ", summary, description)
