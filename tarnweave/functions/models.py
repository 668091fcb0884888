"""Plug points and their deterministic offline defaults: embedder and summariser. Rerankers: ``operators.ranking``."""

from __future__ import annotations

import itertools
import zlib
from collections import defaultdict
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tarnweave.functions.text import truncate_tokens

Embedder = Callable[[Column], Column]
#: Texts whose words are hashed together.
ROWS = 2000


def hashing_embedder(dimensions: int = 64) -> Embedder:
    """Signed feature hashing of words, at unit length; null texts stay null, texts without words are zero."""

    def some(texts: list[str]) -> np.ndarray:
        words = [t.lower().split() for t in texts]
        ids: dict[str, int] = defaultdict(itertools.count().__next__)
        size = [len(w) for w in words]
        code = np.fromiter(map(ids.__getitem__, itertools.chain.from_iterable(words)), np.int64, sum(size))
        hashes = np.array([zlib.crc32(w.encode()) for w in ids], np.int64)
        place, sign = hashes % dimensions, np.where(hashes >> 31, 1.0, -1.0)
        at = np.repeat(np.arange(len(texts)) * dimensions, size) + (place[code] if len(code) else code)
        v = np.bincount(at, weights=sign[code] if len(code) else None, minlength=len(texts) * dimensions).reshape(len(texts), dimensions)
        n = np.sqrt((v * v).sum(axis=1, keepdims=True))  # whole numbers, so exact up to the root
        return (v / np.where(n > 0, n, 1)).astype(np.float32)

    def vectors(texts: pd.Series) -> pd.Series:
        texts = texts.tolist()
        held = [t for t in texts if t is not None]
        found = (row for i in range(0, len(held), ROWS) for row in some(held[i : i + ROWS]))
        return pd.Series([None if t is None else next(found) for t in texts], dtype=object)

    return lambda text: F.pandas_udf(vectors, "array<float>")(text)


def leading_summary(text: Column, tokens: int) -> Column:
    """The first tokens; null for texts without any."""
    return F.nullif(truncate_tokens(text, tokens), F.lit(""))
