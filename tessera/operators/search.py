"""Nearest neighbours: exact top-k of given queries against all rows, and approximate search by random projections.

Exact search goes through the rows once for each block of queries: a block is broadcast (its size is bounded), each
task keeps the k best a query that it has met, by matrix products of AT_ONCE queries, and only those reach the final ranking.
What several blocks have found is written before the next ones start, so a plan never holds more than TOGETHER of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.arrow import cut, matrix

BLOCK = 10_000
AT_ONCE = 256
TOGETHER = 8
ROWS = 4096


def top_k(rows: DataFrame, queries: DataFrame, k: int = 5, metric: str = "cosine", row_id: str = "vec_id", query_id: str = "query_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, row_id, score of the k nearest rows of each query; ties go to the smaller row_id.

    score: cosine similarity, or minus the squared distance for metric "l2". Rounded to 9 digits, so that order is stable.
    """
    if metric not in ("cosine", "l2"):
        raise ValueError(metric)
    found = in_blocks(queries.select(query_id, vector), lambda ids, q: _block(rows.select(row_id, vector), ids, q, k, metric, row_id, query_id), k, row_id, query_id)
    if found is None:
        return rows.sparkSession.createDataFrame([], f"{query_id} long, rank int, {row_id} {rows.schema[row_id].dataType.simpleString()}, score double")
    return found


def in_blocks(queries: DataFrame, searched: Callable[[np.ndarray, np.ndarray], DataFrame], k: int, row_id: str, query_id: str, size: int = BLOCK) -> DataFrame | None:
    """query_id, rank, row_id, score of the k best that `searched` finds for the blocks of the queries; None without queries."""
    out, n = None, 0
    order = Window.partitionBy(query_id).orderBy(F.desc("score"), row_id)
    best_of = lambda found: found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(query_id, "rank", row_id, "score")
    done: list[DataFrame] = []
    for ids, q in blocks(queries, size):
        part = searched(ids, q)
        if n == TOGETHER:
            done.append(cut(best_of(out), "top-k"))
            out, n = None, 0
        out, n = part if out is None else out.unionByName(part), n + 1
    if out is None:
        return None
    found = best_of(out)
    for part in done:
        found = found.unionByName(part)
    return found


def blocks(queries: DataFrame, size: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The queries, a bounded number at a time."""
    ids, vectors = [], []
    for r in queries.toLocalIterator():
        if r[1] is not None:
            ids.append(r[0])
            vectors.append(r[1])
        if len(ids) == size:
            yield np.array(ids, np.int64), np.array(vectors, np.float64)
            ids, vectors = [], []
    if ids:
        yield np.array(ids, np.int64), np.array(vectors, np.float64)


def unit(m: np.ndarray) -> np.ndarray:
    n = np.sqrt((m * m).sum(1, keepdims=True))
    return m / np.where(n == 0, 1, n)


def best(s: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
    """The rows of the k largest scores of each column, best first; of equal ones those with the smaller place."""
    k = min(k, len(s))
    if k == len(s):
        return np.lexsort((np.broadcast_to(place[:, None], s.shape), -s), axis=0)
    some = np.argpartition(-s, k - 1, axis=0)[:k]
    least = np.take_along_axis(s, some, 0).min(0)
    out = np.take_along_axis(some, np.lexsort((place[some], -np.take_along_axis(s, some, 0)), axis=0), 0)
    for c in np.flatnonzero((s >= least).sum(0) > k):  # the k-th score stands outside too
        at = np.flatnonzero(s[:, c] >= least[c])
        out[:, c] = at[np.lexsort((place[at], -s[at, c]))][:k]
    return out


def _block(rows: DataFrame, ids: np.ndarray, q: np.ndarray, k: int, metric: str, row_id: str, query_id: str) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast((ids, unit(q) if metric == "cosine" else q))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = shared.value
        held: list[tuple[np.ndarray, np.ndarray] | None] = [None] * -(-len(ids) // AT_ONCE)  # scores and rows, best first, of each AT_ONCE queries
        kind = None
        for b in batches:
            b = b.filter(b.column(1).is_valid())
            if not b.num_rows:
                continue
            kind, own, x = b.column(0).type, np.array(b.column(0).to_pylist()), matrix(b.column(1))
            place = np.unique(own, return_inverse=True)[1]
            x, far = (unit(x), None) if metric == "cosine" else (x, (x * x).sum(1)[:, None])
            for i in range(0, len(ids), AT_ONCE):
                part = q[i : i + AT_ONCE]
                s = x @ part.T if metric == "cosine" else -(far + (part * part).sum(1)[None] - 2 * x @ part.T)
                s = s.round(9) + 0.0
                order = best(s, place, k)
                now = np.take_along_axis(s, order, 0), own[order]
                held[i // AT_ONCE] = now if held[i // AT_ONCE] is None else merged(held[i // AT_ONCE], now, k)
        for i, found in enumerate(held):
            if found is not None:
                s, own = found
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(ids[i * AT_ONCE : (i + 1) * AT_ONCE], len(s))), pa.array(own.ravel().tolist(), kind), pa.array(s.ravel())], [query_id, row_id, "score"])

    return rows.mapInArrow(run, f"{query_id} long, {row_id} {rows.schema[row_id].dataType.simpleString()}, score double")


def merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of two lists of scores and rows a query (a column each)."""
    s, own = np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
    place = np.unique(own, return_inverse=True)[1].reshape(own.shape)
    order = np.lexsort((place, -s), axis=0)[:k]
    return np.take_along_axis(s, order, 0), np.take_along_axis(own, order, 0)


def approximate_top_k(rows: DataFrame, queries: DataFrame, k: int = 5, row_id: str = "vec_id", query_id: str = "query_id", vector: str = "embedding", bucket: float = 0.6, tables: int = 8, near: float = 1.2, seed: int = 42) -> DataFrame:
    """query_id, rank, row_id, score by locality-sensitive hashing of unit vectors (|a - b|^2 = 2 - 2 cos).

    Only pairs that share a bucket of some table and are nearer than `near` are ranked; queries that find fewer than k of them are completed by the
    exact search. Rows are hashed where they lie and meet blocks of queries there, as in `top_k`, so neither rows nor pairs are moved.
    """
    to_vector = lambda df, key: df.where(F.col(vector).isNotNull()).select(F.col(key).alias("id"), array_to_vector(F.col(vector).cast("array<double>")).alias("v"))
    a, b = to_vector(rows, row_id), to_vector(queries, query_id)
    model = BucketedRandomProjectionLSH(inputCol="v", outputCol="h", bucketLength=bucket, numHashTables=tables, seed=seed).fit(a)
    hashed = lambda df: model.transform(df).select("id", vector_to_array("v").alias("v"), F.transform("h", lambda h: vector_to_array(h)[0]).alias("h"))
    mine = hashed(a)
    found = lambda ids, q, h: _colliding(mine, ids, q, h, k, near, row_id, query_id)
    asked = hashed(b).select("id", F.concat("v", "h"))
    ranked = in_blocks(asked, lambda ids, m: found(ids, m[:, :-tables], m[:, -tables:]), k, row_id, query_id)
    if ranked is None:
        return top_k(rows, queries, k, row_id=row_id, query_id=query_id, vector=vector)
    ranked = cut(ranked)
    whole = ranked.groupBy(query_id).count().where(F.col("count") >= k)
    rest = top_k(rows, queries.join(whole, query_id, "left_anti"), k, row_id=row_id, query_id=query_id, vector=vector)
    return ranked.join(whole.select(query_id), query_id, "left_semi").select(*ranked.columns).unionByName(rest.withColumn("score", F.round("score", 6)))


def _colliding(rows: DataFrame, ids: np.ndarray, q: np.ndarray, hashes: np.ndarray, k: int, near: float, row_id: str, query_id: str) -> DataFrame:
    """The k best of each query among the rows (id, v, h) of a task that share a bucket with it and are nearer than `near`."""
    shared = rows.sparkSession.sparkContext.broadcast((ids, q, hashes))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q, hashes = shared.value
        squares = (q * q).sum(1)
        held: list[tuple[np.ndarray, np.ndarray] | None] = [None] * -(-len(ids) // AT_ONCE)
        id_type = None
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                b = whole.slice(start, ROWS)
                id_type, own, x, h = b.column(0).type, np.array(b.column(0).to_pylist()), matrix(b.column(1)), matrix(b.column(2))
                place, far = np.unique(own, return_inverse=True)[1], (x * x).sum(1)[:, None]
                for i in range(0, len(ids), AT_ONCE):
                    part = slice(i, i + AT_ONCE)
                    apart = np.sqrt(np.maximum(far + squares[part][None] - 2 * x @ q[part].T, 0))
                    meet = np.zeros(apart.shape, bool)
                    for t in range(h.shape[1]):
                        meet |= h[:, t, None] == hashes[part, t][None]
                    s = np.where(meet & (apart < near), (1 - apart**2 / 2).round(6) + 0.0, -np.inf)
                    order = best(s, place, k)
                    now = np.take_along_axis(s, order, 0), own[order]
                    held[i // AT_ONCE] = now if held[i // AT_ONCE] is None else merged(held[i // AT_ONCE], now, k)
        for i, found in enumerate(held):
            if found is not None:
                s, own = found
                some = np.isfinite(s.ravel())
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(ids[i * AT_ONCE : (i + 1) * AT_ONCE], len(s))[some]), pa.array(own.ravel()[some].tolist(), id_type), pa.array(s.ravel()[some])], [query_id, row_id, "score"])

    return rows.mapInArrow(run, f"{query_id} long, {row_id} {kind}, score double")
