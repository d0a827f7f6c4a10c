"""Language identification by averaged hashed subword embeddings, with calibrated rejection."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrygraph.llm.common import arrow_map, crc_mod, labelled_pieces, word_windows
from quarrygraph.llm.subword import SubwordModel, softmax, train

#: Standard deviations by which the share of n-grams that training has met may lie below the least one: of few n-grams, chance explains more.
DEVIATIONS = 3.0
#: N-grams of the held-back pieces that the least share is fitted on, at least.
FITTED_GRAMS = 30


@dataclass
class LanguageModel:
    """``heat``: the temperature that fits probabilities to held-back rows. A text is rejected if its probability is below
    ``least_score``, or the share of its n-grams that training met too far below ``least_known`` for so many n-grams."""

    model: SubwordModel | None
    heat: float = 1.0
    least_score: float = 0.0
    least_known: float = 0.0

    def predict(self, texts: list[str]) -> list[tuple[str, float, bool]]:
        """(language, probability, accepted) of each text; ``und``, 0 and False without letters."""
        if self.model is None:
            return [("und", 0.0, any(c.isalpha() for c in t)) for t in texts]
        z, grams, known = self.model.score_texts(texts)
        p = softmax(z / self.heat)
        best = p.argmax(axis=1)
        out = []
        for i, text in enumerate(texts):
            if not grams[i] and not any(c.isalpha() for c in text):
                out.append(("und", 0.0, False))
                continue
            score = float(p[i, best[i]])
            chance = DEVIATIONS * np.sqrt(self.least_known * (1 - self.least_known) / max(grams[i], 1))
            sure = score >= self.least_score and known[i] + chance >= self.least_known
            out.append((self.model.classes[best[i]], score, bool(sure)))
        return out


def _cut(text: str, seed: int) -> list[str]:
    """Training pieces of a document: up to 2 of 60 words, 3 of 12, 2 of 3; the first is the one for calibration."""
    return [w for size, most in ((60, 2), (12, 3), (3, 2)) for w in word_windows(text, size, most, seed)]


def fit_languages(docs: DataFrame, per_class: int = 1000, lang_col: str = "lang", text_col: str = "text", tail: float = 0.001) -> LanguageModel:
    """Fit on at most about ``per_class`` rows of each language (chosen by the hash of their text) of ``docs``; a fifth
    of them is held back to calibrate. Rejection is set so that at most ``tail`` of held-back pieces are near it."""
    rows = labelled_pieces(docs, lang_col, per_class, _cut, text_col)
    kept = [r for i, r in enumerate(rows) if i % 5]
    back = [r for i, r in enumerate(rows) if not i % 5]
    if not kept:
        return LanguageModel(None)
    pairs = [(p, label) for _, label, pieces in kept for p in pieces]
    found = LanguageModel(train([p for p, _ in pairs], [label for _, label in pairs], (2, 3, 4)))
    place = {c: i for i, c in enumerate(found.model.classes)}
    held = [(pieces[0], place[label]) for _, label, pieces in back if label in place and pieces]
    if held:
        z, grams, known = found.model.score_texts([p for p, _ in held])
        y = np.array([k for _, k in held])
        heats = np.geomspace(0.5, 8, 25)
        loss = [-np.log(np.maximum(softmax(z / h)[np.arange(len(y)), y], 1e-9)).mean() for h in heats]
        found.heat = float(heats[int(np.argmin(loss))])
        p = softmax(z / found.heat)
        right = (p.argmax(axis=1) == y) & (grams >= FITTED_GRAMS)
        if right.any():
            found.least_score = 0.8 * float(np.quantile(p.max(axis=1)[right], tail))
            found.least_known = 0.8 * float(np.quantile(known[right], tail))
    return found


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``lang_pred``, ``score`` (calibrated probability of that language) and ``accepted``.

    A text that is null or has no letter is ``und`` with score 0, rejected. Without any labelled row to learn from, every text
    is ``und`` with score 0, and accepted if it has a letter. Repeated rows give repeated rows; an empty table gives no
    rows. Only the two named columns are read.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = model.predict([t or "" for t in batch.column(1).to_pylist()])
            columns = [pa.array([f[k] for f in found], t) for k, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            return pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["_id", "lang_pred", "score", "accepted"])

        return step

    return arrow_map(docs.select(id_col, text_col), make, f"_id {kind}, lang_pred string, score double, accepted boolean").withColumnRenamed("_id", id_col)


def keep_identified(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text the model accepts, with all their columns."""
    at = docs.columns.index(text_col)

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            return batch.filter(pa.array([ok for *_, ok in model.predict([t or "" for t in batch.column(at).to_pylist()])], pa.bool_()))

        return step

    return arrow_map(docs, make, docs.schema)


def training_rows(docs: DataFrame, id_col: str = "doc_id", folds: int = 3, held_out: int = 1) -> DataFrame:
    """The rows outside the held-out fold of the id's crc32."""
    return docs.where(F.coalesce(crc_mod(F.col(id_col), folds) != held_out, F.lit(False)))
