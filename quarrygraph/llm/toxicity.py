"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly.

A few toxic words in a long document vanish in the document's mean, so means are taken over windows of successive
words, and a document's score is that of its most toxic window. Labels are given for documents: training first takes every
window of a toxic document as toxic, then, several times over, only those that the model so far finds most toxic.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrygraph.llm.common import arrow_map, labelled_pieces, word_windows
from quarrygraph.llm.subword import SubwordModel, train

#: Words of a window; windows of one sampled document, and of those in one training pass; character n-grams.
WINDOW, MOST, PASS, ORDERS = 8, 96, 24, (3, 4, 5, 6)
#: Rounds of choosing windows; steps of the first training and of each round's, at least, and passes over the windows at least.
ROUNDS, STEPS, PASSES, STEP_TEXTS = 3, 4000, 2, 32


@dataclass
class ToxicityModel:
    """score = 1 / (1 + exp(-(slope * lead + shift))) of the best window's lead of class 1; ``share`` of toxic rows without a model."""

    model: SubwordModel | None
    slope: float = 1.0
    shift: float = 0.0
    share: float = 0.0

    def score(self, texts: list[str]) -> np.ndarray:
        """0 to 1; 0 for texts without words."""
        if self.model is None:
            return np.full(len(texts), self.share)
        lead = self.model.best_window(texts, WINDOW)
        z = np.where(np.isfinite(lead), self.slope * lead + self.shift, 0)
        return np.where(np.isfinite(lead), 1 / (1 + np.exp(-np.clip(z, -700, 700))), 0.0)


def _cut(text: str, seed: int) -> list[str]:
    return word_windows(text, WINDOW, MOST, seed)


def _platt(lead: np.ndarray, y: np.ndarray, steps: int = 200) -> tuple[float, float]:
    """Slope and shift of a logistic fit with softened targets, by Newton's method."""
    scale = max(float(np.abs(lead).mean()), 1e-6)
    x = np.stack([lead / scale, np.ones(len(lead))], axis=1)
    n1, n0 = y.sum(), (1 - y).sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    w = np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        move = np.linalg.solve(h, x.T @ (p - t) + 1e-3 * w)
        w -= np.clip(move, -1, 1)
        if np.abs(move).max() < 1e-6:
            break
    return max(float(w[0]), 1e-3) / scale, float(w[1])


def _trained(texts: list[str], labels: list[int]) -> SubwordModel:
    """A model of as many steps whatever the number of texts, and more for many."""
    return train(texts, labels, ORDERS, epochs=max(PASSES, -(-STEPS * STEP_TEXTS // max(len(texts), 1))), batch=STEP_TEXTS)


def fit_toxicity(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", per_class: int = 2000) -> ToxicityModel:
    """Fit on at most about ``per_class`` rows of each label (0 and 1) in ``labels``, with at most ``MOST`` windows of each;
    a fifth of the rows is held back to calibrate."""
    found = [(h, int(y), p) for h, y, p in labelled_pieces(labels.where(F.col(label_col).isin(0, 1)), label_col, per_class, _cut, text_col, docs, id_col)]
    kept, back = [r for i, r in enumerate(found) if i % 5], [r for i, r in enumerate(found) if not i % 5]
    if len({y for _, y, _ in kept}) < 2:
        return ToxicityModel(None, share=float(bool(kept) and kept[0][1]))
    texts = [p for _, _, pieces in kept for p in pieces]
    y = np.array([label for _, label, pieces in kept for _ in pieces])
    of = np.array([i for i, (_, _, pieces) in enumerate(kept) for _ in pieces])
    nth = np.arange(len(of)) - np.searchsorted(of, of)
    spread = nth * PASS // np.bincount(of)[of] != (nth - 1) * PASS // np.bincount(of)[of]  # at most PASS of each document
    first = np.flatnonzero(spread)
    model = _trained([texts[i] for i in first], list(y[first]))
    for _ in range(ROUNDS):
        z = np.concatenate([model.score_texts(texts[i : i + 4096])[0] for i in range(0, len(texts), 4096)])
        order = np.lexsort((z[:, 0] - z[:, 1], of))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order)) - np.searchsorted(of[order], of[order])
        # the most toxic windows of toxic documents; of clean ones those that look most toxic, and others
        use = np.flatnonzero(np.where(y == 1, place < 2, (place < 6) | spread))
        chosen = [(texts[i], int(y[i])) for i in use]
        # a window may also be one word over and over: single words of clean windows, so that none of them counts for much
        chosen += [(words[i % len(words)], 0) for i in use if y[i] == 0 and (words := texts[i].split())]
        model = _trained([t for t, _ in chosen], [label for _, label in chosen])
    out = ToxicityModel(model)
    if len({label for _, label, _ in back}) == 2:
        lead = model.best_window([" \n ".join(pieces) for *_, pieces in back], WINDOW)
        ok = np.isfinite(lead)
        out.slope, out.shift = _platt(lead[ok], np.array([label for _, label, _ in back])[ok])
    return out


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``score`` (0 to 1, higher: toxic likelier) and ``predicted`` (1 from a score of 0.5).

    A null or empty text, or one without letters, has score 0. Without labelled rows of both kinds the score of every text
    is the one label that was seen (0 without any). Repeated rows give repeated rows; an empty table gives no rows.
    Very long texts are read whole. Only the two named columns are read.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            score = model.score([t or "" for t in batch.column(1).to_pylist()])
            columns = [batch.column(0), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32), pa.int32())]
            return pa.RecordBatch.from_arrays(columns, names=["_id", "score", "predicted"])

        return step

    return arrow_map(docs.select(id_col, text_col), make, f"_id {kind}, score double, predicted int").withColumnRenamed("_id", id_col)
