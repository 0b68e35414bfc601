"""Semantic chunks: a document's sentences grouped by average linkage of their embeddings, joined in story order."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators.clustering import average_linkage
from tessera.operators.embedding import Embedder, hashed_words


def semantic_chunks(docs: DataFrame, k: int = 8, embedder: Embedder = hashed_words, key: str = "doc_id") -> DataFrame:
    """key, chunk_index, n_sentences, text. One document is one unit of work: memory for its sentences' vectors, time of their square.

    Clusters are numbered by their first sentence, so chunks stand in order of their beginnings.
    """
    rows = docs.select(key, T.sentences(F.col("text")).alias("sentences")).where(F.size("sentences") > 0)

    def run(batches):
        for b in batches:
            keys, index, count, text = [], [], [], []
            for who, said in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                label = average_linkage(np.asarray(embedder(said), float), min(k, len(said)))
                for c in range(label.max() + 1):
                    own = [s for s, x in zip(said, label, strict=True) if x == c]
                    keys.append(who)
                    index.append(c)
                    count.append(len(own))
                    text.append(" ".join(own))
            yield pa.RecordBatch.from_arrays([pa.array(keys, b.column(0).type), pa.array(index, pa.int32()), pa.array(count, pa.int32()), pa.array(text, pa.string())], [key, "chunk_index", "n_sentences", "text"])

    return rows.mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, chunk_index int, n_sentences int, text string")
