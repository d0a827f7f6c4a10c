"""The encoder plug point: texts to unit vectors."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrygraph.operators.loading import embedding_text
from quarrygraph.schemas import EMBEDDING_DIM

Encoder = Callable[[list[str]], np.ndarray]


def hashing_encoder(dim: int = EMBEDDING_DIM) -> Encoder:
    """A deterministic stand-in for a sentence encoder: signed hashed words, at unit length."""
    from zlib import crc32

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), np.float32)
        for i, text in enumerate(texts):
            for word in text.lower().split():
                h = crc32(word.encode())
                out[i, h % dim] += 1 if h >> 16 & 1 else -1
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(size, size, 1)

    return encode


def embedded(nodes: DataFrame, encoder: Encoder | None = None, dim: int = EMBEDDING_DIM) -> DataFrame:
    """Nodes with an ``embedding`` of their text by type; null where there is no text."""
    encode = encoder or hashing_encoder(dim)

    @F.pandas_udf("array<float>")
    def vectors(texts: pd.Series) -> pd.Series:
        have = texts.dropna()
        made = pd.Series([None] * len(texts), index=texts.index, dtype=object)
        if len(have):
            made.loc[have.index] = list(encode(list(have)))
        return made

    return nodes.withColumn("embedding", vectors(embedding_text()))
