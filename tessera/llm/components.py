"""Connected components of a graph held as rows of links, by alternating large and small stars.

Each task first joins the links that it reads into trees, CHUNK at a time (a combiner for graphs), so most of a
graph is settled before anything is shuffled. What is left goes through stars: a grouped minimum (combined before the
shuffle, so a hub costs no more than a leaf) and a join that Spark may split where a hub has many rows. Nothing is brought
to the driver but one number a round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common

#: Links joined into trees together.
CHUNK = 1_000_000


def trees(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the links that isn't its component's smallest, and that smallest node."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, root = at[: len(u)], at[len(u) :], np.arange(len(nodes))
    while True:
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        if (low == high).all():
            break
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
    leaf = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[leaf], nodes[root[leaf]]


def contracted(links: DataFrame) -> DataFrame:
    """The same components with fewer links u > v: each task's own links as trees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def joined() -> pa.RecordBatch:
            u, v = trees(*(np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("u", "v")))
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= CHUNK:
                yield joined()
                held, n = [], 0
        if n:
            yield joined()

    return links.select("u", "v").mapInArrow(run, "u long, v long")


def _large(e: DataFrame) -> DataFrame:
    pairs = F.array(F.struct(F.col("u").alias("a"), F.col("v").alias("b")), F.struct(F.col("v").alias("a"), F.col("u").alias("b")))
    both = e.select(F.inline(pairs)).withColumnsRenamed({"a": "u", "b": "v"})
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small(e: DataFrame) -> DataFrame:
    """Each link u > v becomes (v, least neighbour of u), and u is linked with that neighbour."""
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b")))
    return e.join(least, "u").select(F.inline(moved)).where("a <> b").withColumnsRenamed({"a": "u", "b": "v"})


def _unsettled(e: DataFrame) -> int:
    """Nodes with several parents, or with a parent and children: none in a forest of stars."""
    ends = F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("parent")), F.struct(F.col("v").alias("node"), F.lit(None).cast("long").alias("parent")))
    nodes = e.select(F.inline(ends)).groupBy("node").agg(F.min("parent").alias("low"), F.max("parent").alias("high"), F.max(F.col("parent").isNull()).alias("has"))
    return nodes.where("low < high OR low IS NOT NULL AND has").count()


def stars(links: DataFrame, work: common.Work | None = None, name: str = "stars") -> DataFrame:
    """u, v for each node u of links (columns u, v, any order, repeats allowed) that isn't its component's smallest, v."""
    work = work or common.Work(links.sparkSession, name)
    e, turn = work.keep(f"{name}-0", contracted(links)), 0
    while _unsettled(e):
        step = work.keep(f"{name}-step", _small(_large(e)))
        turn += 1
        e = work.keep(f"{name}-{turn}", contracted(step))
        work.drop(f"{name}-step", f"{name}-{turn - 1}")
    out = work.keep(name, e.distinct())
    work.drop(f"{name}-{turn}")
    return out
