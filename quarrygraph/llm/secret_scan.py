"""Secret scans through a trigram index.

Each rule's regular expression is turned into a Boolean query over the character trigrams that any match must
hold (after lower-casing ASCII). Every block of documents gets an inverted index from those trigrams to its documents;
a rule's query intersects and unites postings, and only the candidates are searched with the expression itself.
A rule whose expression has no mandatory trigram (``hex``) searches every document.
"""

from __future__ import annotations

import re
import re._constants as rc
import re._parser as rp
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrygraph.llm.common import arrow_map


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds leftmost, non-overlapping matches; one is kept if ``group`` has ``at_least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    at_least: int = 0


#: The three base kinds, as the contract of the query states them.
BASE = (
    Rule("assign", r"(?ai)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]+", 0, 32),
)
#: Further kinds, with publicly documented shapes.
MORE = (
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY(?: BLOCK)?-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"[rs]k_live_[0-9A-Za-z]{24,}"),
    Rule("basic_auth", r"[a-z][a-z0-9+.-]{1,20}://[^\s/:@]{1,80}:[^\s/:@]{3,80}@"),
)
RULES = BASE + MORE

SCHEMA = "{id} {type}, findings array<struct<kind:string,start:bigint,end:bigint,text:string>>"

_ALL = ("and",)  # no condition
_MAX_STRINGS = 64


def _fold(ch: str) -> str:
    return ch.lower() if ch.isascii() else ch


def _grams(strings: set[str]) -> tuple:
    """The query that one of the strings occurs."""
    options = []
    for text in strings:
        data = text.encode()
        if len(data) < 3:
            return _ALL
        options.append(("and", *sorted({data[i : i + 3] for i in range(len(data) - 2)})))
    return options[0] if len(options) == 1 else ("or", *sorted(options, key=repr))


def _walk(tree) -> tuple[set[str] | None, tuple]:
    """(every string that the piece matches, or None if they are many; a necessary query)."""
    run: set[str] | None = {""}
    exact, needs = True, []

    def close() -> None:
        nonlocal run
        query = _grams(run)
        if query != _ALL:
            needs.append(query)
        run = {""}

    for op, arg in tree:
        strings: set[str] | None = None
        query = _ALL
        if op is rc.LITERAL:
            strings = {_fold(chr(arg))}
        elif op is rc.IN:
            members: set[str] | None = set()
            for kind, value in arg:
                if kind is rc.LITERAL:
                    members.add(_fold(chr(value)))
                elif kind is rc.RANGE and value[1] - value[0] < 16:
                    members |= {_fold(chr(c)) for c in range(value[0], value[1] + 1)}
                else:
                    members = None
                    break
            strings = members if members and len(members) <= 16 else None
        elif op is rc.SUBPATTERN:
            strings, query = _walk(arg[3])
        elif op is rc.BRANCH:
            parts = [_walk(x) for x in arg[1]]
            if all(p[0] is not None for p in parts):
                strings = set().union(*(p[0] for p in parts))
            else:
                queries = [p[1] if p[0] is None else _grams(p[0]) for p in parts]
                query = _ALL if _ALL in queries else ("or", *queries)
        elif op in (rc.MAX_REPEAT, rc.MIN_REPEAT):
            low, high, body = arg
            inner, query = _walk(body)
            if low == 0:
                query = _ALL
                strings = inner | {""} if inner is not None and high == 1 else None
            elif inner is not None and low == high and len(inner) == 1:
                strings = {next(iter(inner)) * low}
            elif inner is not None:
                query = _grams({"".join(p) for p in product(inner, repeat=low)}) if len(inner) ** low <= _MAX_STRINGS else _ALL
        elif op is rc.AT:
            continue
        if strings is None:
            close()
            exact = False
            if query != _ALL:
                needs.append(query)
        else:
            if len(run) * len(strings) > _MAX_STRINGS:
                close()
                exact = False
            run = {a + b for a in run for b in strings}
    if exact:
        return run, _ALL
    close()
    return None, ("and", *needs) if needs else _ALL


def trigram_query(pattern: str) -> tuple:
    """Nested ("and"|"or", ...) over byte trigrams that every match of ``pattern`` holds; ("and",) if there are none."""
    strings, query = _walk(rp.parse(pattern))
    return query if strings is None else _grams(strings)


def _leaves(query: tuple) -> set[bytes]:
    return {x for part in query[1:] for x in ({part} if isinstance(part, bytes) else _leaves(part))}


def _holds(query: tuple, postings: dict[bytes, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool) if query[0] == "and" else np.zeros(n, bool)
    for part in query[1:]:
        docs = postings[part] if isinstance(part, bytes) else _holds(part, postings, n)
        out = out & docs if query[0] == "and" else out | docs
    return out


class Scanner:
    """The rules compiled for one task."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = [(r, re.compile(r.pattern), trigram_query(r.pattern)) for r in rules]
        self.grams = sorted(set().union(*(_leaves(q) for *_, q in self.rules)))
        self.codes = np.array([int.from_bytes(g, "big") for g in self.grams], np.uint32)
        self.known = np.zeros(1 << 24, bool)
        self.known[self.codes] = True

    def postings(self, texts: list[str]) -> dict[bytes, np.ndarray]:
        """For each wanted trigram, which texts hold it."""
        found = np.zeros((len(self.grams), len(texts)), bool)
        data = [t.encode().lower() for t in texts]
        ends = np.cumsum([len(d) + 2 for d in data])
        flat = np.frombuffer(b"\0\0".join(data) + b"\0\0", np.uint8)
        step = 1 << 22
        for at in range(0, max(len(flat) - 2, 0), step):
            part = flat[at : at + step + 2].astype(np.uint32)
            codes = part[:-2] << 16 | part[1:-1] << 8 | part[2:]
            hit = np.flatnonzero(self.known[codes])
            found[np.searchsorted(self.codes, codes[hit]), np.searchsorted(ends, hit + at, "right")] = True
        return dict(zip(self.grams, found, strict=True))

    def scan(self, texts: list[str]) -> list[list[tuple[str, int, int, str]]]:
        postings, out = self.postings(texts), [[] for _ in texts]
        for order, (rule, pattern, query) in enumerate(self.rules):
            for i in np.flatnonzero(_holds(query, postings, len(texts))):
                text = texts[i]
                for m in pattern.finditer(text):
                    if m.end(rule.group) - m.start(rule.group) >= rule.at_least:
                        out[i].append((m.start(), order, m.end(), rule.kind, m[0]))
        return [[(kind, start, end, text) for start, _, end, kind, text in sorted(found)] for found in out]


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id and ``findings``, an array of (kind, start, end, text) ordered by start and then
    by the order of ``rules``; positions are code points, the end exclusive.

    A null or empty text has no findings; repeated rows give repeated rows, a null id stays null; an empty table
    gives no rows. Only the two named columns are read, so further columns can have any names.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    found_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("text", pa.string())]))

    def make():
        scanner = Scanner(rules)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = scanner.scan([t or "" for t in batch.column(1).to_pylist()])
            rows = [[dict(zip(("kind", "start", "end", "text"), x, strict=True)) for x in f] for f in found]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, found_type)], names=[id_col, "findings"])

        return step

    return arrow_map(docs.select(id_col, text_col), make, SCHEMA.format(id=f"`{id_col}`", type=kind))


def joined(findings, kinds: tuple[str, ...] | None = None):
    """kind:start:end of the findings (of the given kinds), comma-joined."""
    if kinds is not None:
        findings = F.filter(findings, lambda x: x["kind"].isin(*kinds))
    return F.array_join(F.transform(findings, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact_secrets(
    docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", length_col: str | None = "n_chars"
) -> DataFrame:
    """All rows and columns of ``docs``, with each stretch that findings cover replaced by ``<kind>`` (of its first
    finding); ``length_col``, where there is such a column, becomes the new number of characters of changed texts.

    Null and empty texts stay as they are, as do rows without findings; other columns can have any names.
    """
    names = docs.columns
    at, length_at = names.index(text_col), names.index(length_col) if length_col in names else None

    def make():
        scanner = Scanner(rules)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column(at).to_pylist()
            lengths = batch.column(length_at).to_pylist() if length_at is not None else None
            for i, found in enumerate(scanner.scan([t or "" for t in texts])):
                if not found:
                    continue
                parts, end = [], 0
                for kind, a, b, _ in found:
                    if a >= end:
                        parts += [texts[i][end:a], f"<{kind}>"]
                    end = max(end, b)
                texts[i] = "".join([*parts, texts[i][end:]])
                if lengths is not None:
                    lengths[i] = len(texts[i])
            columns = list(batch.columns)
            columns[at] = pa.array(texts, batch.column(at).type)
            if lengths is not None:
                columns[length_at] = pa.array(lengths, batch.column(length_at).type)
            return pa.RecordBatch.from_arrays(columns, names=names)

        return step

    return arrow_map(docs, make, docs.schema)
