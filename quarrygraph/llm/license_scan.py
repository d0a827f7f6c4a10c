"""License scans through a positional index of rare licence words.

A licence is described by templates, each its text or notice with key phrases at their word positions, some mandatory. Every
phrase is indexed under its rarest word: the one with the highest inverse document frequency over all documents of the
corpus. A file's words are looked up in that index; each posting (phrase, offset) fixes where the phrase must begin, and
the words there are compared. Phrases of one template whose places agree on where the licence begins are then put together.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter, defaultdict
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrygraph.llm.common import arrow_map


@dataclass(frozen=True)
class Template:
    """A licence's notice or text as words, its key phrases in brackets, mandatory ones begun by ``!``.

    The label is given when phrases with at least ``share`` of the IDF weight agree on where the text begins, within ``slack``
    words for each phrase between, and all mandatory ones are there."""

    label: str
    text: str
    share: float = 0.5
    slack: int = 6

    def phrases(self) -> list[tuple[str, int, bool]]:
        """(words, position of the first one, whether it is mandatory) of each key phrase; the first one is, if none is marked."""
        out, at = [], 0
        for i, part in enumerate(self.text.replace("]", "[").split("[")):
            words = part.lstrip("!").split()
            if i % 2:
                out.append((" ".join(words), at, part.startswith("!")))
            at += len(words)
        return out if any(m for *_, m in out) else [(p, at, i == 0) for i, (p, at, _) in enumerate(out)]


#: The base phrases of the query's contract.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Wording of public licence texts and of their usual notices.
_GPL = "this program is free software you can redistribute it and or modify it under the terms of the [!{name}] [as published by the free software foundation] [!either version {version} of the license] or at your option any later version this program is distributed in the hope that it will be useful [but without any warranty without even the implied warranty of merchantability]"
_BSD = "[!redistribution and use in source and binary forms with or without modification are permitted] provided that the following conditions are met 1 [redistributions of source code must retain the above copyright notice] this list of conditions and the following disclaimer 2 [redistributions in binary form must reproduce the above copyright notice]"
TEMPLATES = (
    Template("mit", "[!permission is hereby granted free of charge] to any person obtaining a copy of this software and associated documentation files the software [to deal in the software without restriction] including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions [the above copyright notice and this permission notice shall be included] in all copies or substantial portions of the software [the software is provided as is]", share=0.3, slack=14),
    Template("apache-2", "[!licensed under the apache license version 2 0]"),
    Template("apache-2", "licensed under the [!apache license version 2 0] the license [you may not use this file except in compliance with the license] you may obtain a copy of the license at http www apache org licenses license 2 0 [unless required by applicable law or agreed to in writing] software distributed under the license is [distributed on an as is basis]", slack=10),
    Template("bsd", _BSD, share=0.3, slack=14),
    Template("bsd-3", _BSD + " this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution 3 [!neither the name of]", slack=16),
    Template("isc", "[!permission to use copy modify and or distribute this software for any purpose] with or without fee is hereby granted provided that [the above copyright notice and this permission notice appear in all copies]", share=0.3, slack=10),
    Template("zlib", "[!this software is provided as is without any express or implied warranty] in no event will the authors be held liable for any damages arising from the use of this software [permission is granted to anyone to use this software for any purpose] including commercial applications and to alter it and redistribute it freely", slack=10),
    Template("bsl-1", "[!boost software license version 1 0]"),
    Template("gpl", "[!gnu general public license]"),
    Template("gpl-2", "[!gnu general public license version 2]"),
    Template("gpl-3", "[!gnu general public license version 3]"),
    Template("gpl-2", _GPL.format(name="gnu general public license", version="2"), slack=10),
    Template("gpl-3", _GPL.format(name="gnu general public license", version="3"), slack=10),
    Template("lgpl", "[!gnu lesser general public license]"),
    Template("agpl", "[!gnu affero general public license]"),
    Template("mpl-2", "[!mozilla public license version 2 0]"),
    Template("mpl-2", "[this source code form is subject to the terms of] the [!mozilla public license v 2 0] [if a copy of the mpl was not distributed with this file]"),
    Template("epl-2", "[!eclipse public license v 2 0]"),
    Template("epl-2", "[!eclipse public license version 2 0]"),
    Template("cc-by", "[!creative commons attribution]"),
    Template("cc-by", "[!licensed under cc by]"),
    Template("cc-by-sa", "[!cc by sa]"),
    Template("cc-by-nd", "[!cc by nd]"),
    Template("cc-by-nc", "[!creative commons attribution noncommercial]"),
    Template("cc0", "[!cc0 1 0 universal]"),
    Template("unlicense", "[!this is free and unencumbered software released into the public domain] anyone is free to copy modify publish use compile sell or distribute this software", share=0.3),
    Template("proprietary", "[!all rights reserved]"),
)

SCHEMA = "{id} {type}, n_words bigint, places array<struct<start:bigint,label:string>>, labels array<string>, score double"

#: Lower-cases A-Z and turns every ASCII character that is not a digit or letter into a space; other bytes stay.
_TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """The maximal runs of ASCII digits, lower-cased ASCII letters and non-ASCII characters."""
    return (text or "").encode().translate(_TO_WORDS).split()


def _phrases(base: dict[str, str], templates: tuple[Template, ...]) -> list[str]:
    return list(dict.fromkeys([*base, *(p for t in templates for p, *_ in t.phrases())]))


def licence_idf(docs: DataFrame, phrases: list[str], text_col: str = "text") -> dict[str, float]:
    """1 + ln((1 + N) / (1 + df)) of every word of the phrases, over all rows of ``docs``: one row per licence word (there
    are as many as the phrases have) reaches the driver."""
    wanted = {w.encode() for p in phrases for w in p.split()}

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            n: Counter = Counter()
            for text in batch.column(0).to_pylist():
                n.update(wanted.intersection(words_of(text)))
            n[b""] = batch.num_rows
            return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in n], pa.string()), pa.array(list(n.values()), pa.int64())], names=["word", "n"])

        return step

    counted = arrow_map(docs.select(text_col), make, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    df = {r["word"]: r["n"] for r in counted.collect()}
    total = df.get("", 0)
    return {w.decode(): 1 + math.log((1 + total) / (1 + df.get(w.decode(), 0))) for w in wanted}


class PhraseIndex:
    """Postings of each phrase under its rarest word."""

    def __init__(self, base: dict[str, str], templates: tuple[Template, ...], idf: dict[str, float]):
        self.phrases = [[w.encode() for w in p.split()] for p in _phrases(base, templates)]
        number = {p: i for i, p in enumerate(_phrases(base, templates))}
        self.weight = [sum(idf[w.decode()] for w in p) for p in self.phrases]
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for i, words in enumerate(self.phrases):
            offset = max(range(len(words)), key=lambda k: (idf[words[k].decode()], -k))
            self.postings[words[offset]].append((i, offset))
        self.base = {number[p]: label for p, label in base.items()}
        self.templates = [(t, [(number[p], at, must) for p, at, must in t.phrases()]) for t in templates]
        self.labels: dict[int, set[str]] = defaultdict(set)
        for p, label in (*self.base.items(), *((p, t.label) for t, phrases in self.templates for p, *_ in phrases)):
            self.labels[p].add(label)

    def places(self, words: list[bytes]) -> dict[int, list[int]]:
        """Where each phrase that occurs starts, all its places in order."""
        found: dict[int, list[int]] = defaultdict(list)
        postings, phrases = self.postings, self.phrases
        for at in [i for i, w in enumerate(words) if w in postings]:
            for phrase, offset in postings[words[at]]:
                start, want = at - offset, phrases[phrase]
                if start >= 0 and words[start : start + len(want)] == want:
                    found[phrase].append(start)
        return found

    def own_places(self, found: dict[int, list[int]], label: str) -> dict[int, list[int]]:
        """The places that speak for a label: not those where a phrase of other licences only begins before the end and
        ends behind it (``licensed under cc by`` in ``licensed under cc by nc``)."""
        others = sorted((s, s + len(self.phrases[p])) for p, starts in found.items() if label not in self.labels[p] for s in starts)
        if not others:
            return found
        begins, longest = [s for s, _ in others], max(e - s for s, e in others)
        out: dict[int, list[int]] = {}
        for p, starts in found.items():
            if label in self.labels[p]:
                n = len(self.phrases[p])
                free = [a for a in starts if not any(e > a + n for _, e in others[bisect_left(begins, a + n - longest) : bisect_left(begins, a + n)])]
                if free:
                    out[p] = free
        return out

    def template_score(self, t: Template, phrases: list[tuple[int, int, bool]], found: dict[int, list[int]]) -> float:
        """The largest share of the template's weight whose places agree on one beginning; 0 if it falls short."""
        must = [k for k, (*_, m) in enumerate(phrases) if m]
        if not all(phrases[k][0] in found for k in must):
            return 0.0
        total, best = sum(self.weight[p] for p, *_ in phrases), 0.0
        first = phrases[must[0]]
        for start in found[first[0]]:
            begin, held = start - first[1], 0.0
            for k, (p, at, m) in enumerate(phrases):
                starts, slack = found.get(p, ()), t.slack * abs(k - must[0])
                i = bisect_left(starts, begin + at - slack)
                if i < len(starts) and starts[i] <= begin + at + slack:
                    held += self.weight[p]
                elif m:
                    break
            else:
                best = max(best, held / total if total else 1.0)
        return best if best >= t.share else 0.0


def scan_licenses(
    docs: DataFrame, base: dict[str, str] = BASE, templates: tuple[Template, ...] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: id, number of words, ``places`` (start, label) of every base phrase in order, ``labels``
    (sorted, distinct: of base phrases and templates) and ``score``: 1 with a base phrase, else the largest share of a
    template's IDF weight that was found, 0 without any. Where a phrase of one licence goes on to one of another, the longer one counts.

    A null or empty text has no words, places or labels; very long texts are read whole, in time that grows as they do;
    repeated rows give repeated rows; an empty table gives no rows. Only the two named columns are read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    idf = licence_idf(docs, _phrases(base, templates), text_col)
    place_type = pa.list_(pa.struct([("start", pa.int64()), ("label", pa.string())]))

    def make():
        index = PhraseIndex(base, templates, idf)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, places, labels, scores = [], [], [], []
            for text in batch.column(1).to_pylist():
                words = words_of(text)
                found = index.places(words)
                of_base = sorted((s, index.base[p]) for p, starts in found.items() if p in index.base for s in starts)
                held: dict[str, float] = {}
                own = {label: index.own_places(found, label) for p in found for label in index.labels[p]}
                for t, phrases in index.templates if found else ():
                    if share := index.template_score(t, phrases, own.get(t.label, {})):
                        held[t.label] = max(held.get(t.label, 0.0), share)
                n.append(len(words))
                places.append([{"start": s, "label": x} for s, x in of_base])
                labels.append(sorted({*held, *(x for _, x in of_base)}))
                scores.append(1.0 if of_base else max(held.values(), default=0.0))
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(places, place_type), pa.array(labels, pa.list_(pa.string())), pa.array(scores, pa.float64())]
            return pa.RecordBatch.from_arrays(columns, names=[id_col, "n_words", "places", "labels", "score"])

        return step

    return arrow_map(docs.select(id_col, text_col), make, SCHEMA.format(id=f"`{id_col}`", type=kind))
