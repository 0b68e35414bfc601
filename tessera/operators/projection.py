"""Principal components of wide vectors, as many as explain a share of the variance; no matrix of d x d numbers anywhere.

A block of l directions is multiplied by the covariance, a pass over the rows each time, until the variances along it stand still
(subspace iteration from random directions). A last pass takes the triangle of the projected rows: each task folds its rows, Arrow batch
by batch, into an l x l triangle by QR, triangles are folded again in groups, and the driver folds what the groups leave. Variances
come from that triangle's singular values, not from squares. If the block explains too little, it is doubled.

The driver and each task hold d x l numbers. Rows need vectors of one length; null vectors are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.arrow import lists, matrix, opened, share

BLOCK, EXTRA, GROUPS = 64, 10, 64


@dataclass
class Components:
    """axes (k x d), the variance along each, all dimensions' variance, the mean and the number of rows."""

    axes: np.ndarray
    variances: np.ndarray
    total: float
    mean: np.ndarray
    n: int

    @property
    def ratios(self) -> np.ndarray:
        return self.variances / self.total if self.total > 0 else np.zeros(len(self.variances))

    def enough(self, share_of: float) -> int:
        """The smallest number of components that explains the share (all of these if none does)."""
        return min(len(self.variances), int(np.searchsorted(np.cumsum(self.ratios), share_of - 1e-12)) + 1)

    def project(self, rows: DataFrame, vector: str = "embedding", centred: bool = False) -> DataFrame:
        """rows with the vector replaced by its coordinates along the axes; null stays null. One narrow pass."""
        shared = share(rows.sparkSession, (self.axes, self.mean if centred else np.zeros_like(self.mean)))
        kinds = ", ".join(f"`{f.name}` {'array<double>' if f.name == vector else f.dataType.simpleString()}" for f in rows.schema)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            axes, mean = opened(shared)
            for b in batches:
                at, there = b.schema.get_field_index(vector), b.column(vector).is_valid()
                new = lists((matrix(b.column(vector).filter(there)) - mean) @ axes.T) if there.true_count else pa.array([], pa.list_(pa.float64()))
                places = np.where(there.to_numpy(zero_copy_only=False), np.cumsum(there.to_numpy(zero_copy_only=False)) - 1, -1)
                new = new.take(pa.array([None if p < 0 else int(p) for p in places], pa.int64()))
                yield pa.RecordBatch.from_arrays([new if i == at else c for i, c in enumerate(b.columns)], b.schema.names)

        return rows.mapInArrow(run, kinds)


def moments(rows: DataFrame, vector: str) -> tuple[int, np.ndarray]:
    """The number of rows and their mean."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s = 0, 0.0
        for b in batches:
            if b.num_rows:
                x = matrix(b.column(0))
                n, s = n + len(x), s + x.sum(0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(s), dtype=np.int32)), pa.array(s), pa.array(np.full(len(s), n))], ["dim", "s", "n"])

    got = sorted(rows.mapInArrow(run, "dim int, s double, n long").groupBy("dim").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect(), key=lambda r: r["dim"])
    return (int(got[0]["n"]), np.array([r["s"] for r in got]) / got[0]["n"]) if got else (0, np.zeros(0))


def times_covariance(rows: DataFrame, vector: str, mean: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Sum over rows of (x - mean) (x - mean)' block. A task's sum travels as d rows of l numbers, which are added up dimension by dimension."""
    shared = share(rows.sparkSession, (mean, block))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, block = opened(shared)
        total = None
        for b in batches:
            if b.num_rows:
                x = matrix(b.column(0)) - mean
                z = x.T @ (x @ block)
                total = z if total is None else total + z
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), lists(total)], ["dim", "z"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, block = opened(shared)
        total, seen = np.zeros(block.shape), np.zeros(len(block), bool)
        for b in batches:
            if b.num_rows:
                dims = b.column(0).to_numpy()
                np.add.at(total, dims, matrix(b.column(1)))
                seen[dims] = True
        if seen.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(seen).astype(np.int32)), lists(total[seen])], ["dim", "z"])

    kinds = "dim int, z array<double>"
    out = np.zeros(block.shape)
    for r in rows.mapInArrow(part, kinds).repartition("dim").mapInArrow(add, kinds).collect():  # as many rows as dimensions
        out[r["dim"]] = r["z"]
    return out


def folded(triangle: np.ndarray | None, rows: np.ndarray) -> np.ndarray:
    """The triangle of a matrix's rows and further rows: equal to that of all of them, in any order, up to signs."""
    return np.linalg.qr(rows if triangle is None else np.vstack([triangle, rows]), mode="r")


def triangle(rows: DataFrame, vector: str, mean: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, float]:
    """The triangle of the projected, centred rows, and the sum of all rows' squares before they were projected."""
    shared = share(rows.sparkSession, (mean, block))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, block = opened(shared)
        r, squares = None, 0.0
        for b in batches:
            if b.num_rows:
                x = matrix(b.column(0)) - mean
                r, squares = folded(r, x @ block), squares + float((x * x).sum())
        if r is not None:
            group = np.full(len(r), TaskContext.get().partitionId() % GROUPS, np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(group), lists(r), pa.array(np.r_[squares, np.zeros(len(r) - 1)])], ["part", "r", "squares"])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, squares = None, 0.0
        for b in batches:
            if b.num_rows:
                r, squares = folded(r, matrix(b.column(1))), squares + float(b.column(2).to_numpy().sum())
        if r is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(r), np.int32)), lists(r), pa.array(np.r_[squares, np.zeros(len(r) - 1)])], ["part", "r", "squares"])

    kinds = "part int, r array<double>, squares double"
    got = rows.mapInArrow(first, kinds).repartition(GROUPS, "part").mapInArrow(again, kinds).collect()  # GROUPS x l rows of l numbers
    if not got:
        return np.zeros((0, block.shape[1])), 0.0
    return folded(None, np.array([r["r"] for r in got])), float(sum(r["squares"] for r in got))


def components(rows: DataFrame, share_of: float = 0.9, most: int | None = None, vector: str = "embedding", block: int = BLOCK, passes: int = 30, within: float = 1e-9, seed: int = 42) -> Components:
    """The fewest components that explain `share_of` of the variance, `most` at most.

    A block of directions is done when none of the variances looked for moves by more than `within` of the largest, or after `passes` passes over the
    rows. No rows, or rows without variance: no components.
    """
    rows = rows.where(F.col(vector).isNotNull()).select(vector)
    n, mean = moments(rows, vector)
    d = len(mean)
    limit = min(d, n, d if most is None else most)
    if not limit:
        return Components(np.zeros((0, d)), np.zeros(0), 0.0, mean, n)
    random = np.random.default_rng(seed)
    width = d if share_of >= 1 and most is None else min(d, limit + EXTRA, max(block, EXTRA + 1))
    v = np.linalg.qr(random.normal(size=(d, width)))[0]
    while True:
        sure, before = (width if width == d else width - EXTRA), None
        for _ in range(passes if width < d else 0):
            z = times_covariance(rows, vector, mean, v)
            now = np.linalg.eigvalsh(v.T @ z)[::-1][:sure]
            v = np.linalg.qr(z)[0]
            if before is not None and np.abs(now - before).max() <= within * max(now[0], 1e-300):
                break
            before = now
        r, squares = triangle(rows, vector, mean, v)
        _, s, turned = np.linalg.svd(r, full_matrices=False)
        keep = min(sure, limit, len(s))
        out = Components((v @ turned.T).T[:keep], s[:keep] ** 2 / n, squares / n, mean, n)
        if out.total <= 0:
            return Components(np.zeros((0, d)), np.zeros(0), 0.0, mean, n)
        if width == d or keep == limit or out.ratios.sum() >= share_of:
            k = out.enough(share_of)
            return Components(out.axes[:k], out.variances[:k], out.total, mean, n)
        wider = min(d, 2 * width, limit + EXTRA)
        v = np.linalg.qr(np.hstack([v, random.normal(size=(d, wider - width))]))[0]
        width = wider
