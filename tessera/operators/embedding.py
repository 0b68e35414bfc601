"""Embedding of texts. The default is a deterministic stand-in (hashed words, unit length), not a trained model.

Any function from a list of texts to a matrix can take its place; it runs on Arrow batches inside the executors.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.operators.arrow import lists

Embedder = Callable[[list[str]], np.ndarray]
DIMENSIONS = 64


def hashed_words(texts: list[str], dimensions: int = DIMENSIONS) -> np.ndarray:
    """Signed counts of hashed words, root-scaled, at unit length."""
    out = np.zeros((len(texts), dimensions))
    for i, t in enumerate(texts):
        counts = [0] * dimensions
        for w in t.lower().split():
            h = zlib.crc32(w.encode())
            counts[h % dimensions] += 1 if h >> 31 else -1
        out[i] = counts
    out = np.sign(out) * np.sqrt(np.abs(out))
    n = np.sqrt((out * out).sum(1, keepdims=True))
    return out / np.where(n == 0, 1, n)


def letters(texts: list[str]) -> np.ndarray:
    """Counts of the letters a to z at unit length; simple enough that SQL can say it too."""
    signs = [chr(c) for c in range(ord("a"), ord("z") + 1)]
    out = np.array([[t.count(c) + t.count(c.upper()) for c in signs] for t in texts], float).reshape(len(texts), len(signs))
    n = np.sqrt((out * out).sum(1, keepdims=True))
    return out / np.where(n == 0, 1, n)


def embedded(rows: DataFrame, embedder: Embedder = hashed_words, text: str = "text", into: str = "embedding") -> DataFrame:
    """rows with a further column of vectors; a null text is embedded as an empty one."""
    at = rows.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = np.asarray(embedder([t or "" for t in b.column(at).to_pylist()]), np.float32)
            yield pa.RecordBatch.from_arrays([*b.columns, lists(v)], [*b.schema.names, into])

    return rows.mapInArrow(run, rows._jdf.schema().toDDL() + f", `{into}` array<float>")
