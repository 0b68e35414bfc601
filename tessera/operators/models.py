"""A fitted model that is kept: projection, scale and mixture as tables, loaded again to place new rows without refitting.

    components   cluster_id, weight, mean, spread (variances, or the covariance's rows one after another)
    scale        dim, mean, std (those of the projected rows)
    axes         component, axis; empty where rows weren't projected

All three are as large as the model. Placing new rows is one narrow pass: no join, no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.arrow import lists, matrix, opened, share
from tessera.operators.clustering import FullMixture, Mixture, column_stats


class Kept:
    """A mixture over projected (axes: components x dimensions, or None) and scaled vectors."""

    def __init__(self, mixture: Mixture, mean: np.ndarray, std: np.ndarray, axes: np.ndarray | None = None):
        self.mixture, self.mean, self.std, self.axes = mixture, mean, np.where(std > 0, std, 1.0), axes

    def prepared(self, x: np.ndarray) -> np.ndarray:
        return ((x if self.axes is None else x @ self.axes.T) - self.mean) / self.std

    def assign(self, rows: DataFrame, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
        """key, cluster_id, confidence, probabilities, log_likelihood of each row with a vector."""
        shared = share(rows.sparkSession, self)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kept = opened(shared)
            for b in batches:
                if b.num_rows:
                    r, ll = kept.mixture.responsibilities(kept.prepared(matrix(b.column(1))))
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.array(r.argmax(1).astype(np.int32)), pa.array(r.max(1)), lists(r), pa.array(ll)], [key, "cluster_id", "confidence", "probabilities", "log_likelihood"])

        kind = rows.schema[key].dataType.simpleString()
        return rows.where(F.col(vector).isNotNull()).select(key, vector).mapInArrow(run, f"{key} {kind}, cluster_id int, confidence double, probabilities array<double>, log_likelihood double")

    def save(self, spark: SparkSession, folder: str) -> None:
        m, numbers = self.mixture, lambda x: [float(v) for v in np.ravel(x)]
        full = isinstance(m, FullMixture)
        spread = m.covariances if full else m.variances
        tables = {
            "components": ([(i, float(w), numbers(a), numbers(s), full) for i, (w, a, s) in enumerate(zip(m.weights, m.means, spread, strict=True))], "cluster_id int, weight double, mean array<double>, spread array<double>, full boolean"),
            "scale": ([(i, float(a), float(s)) for i, (a, s) in enumerate(zip(self.mean, self.std, strict=True))], "dim int, mean double, std double"),
            "axes": ([(i, numbers(a)) for i, a in enumerate([] if self.axes is None else self.axes)], "component int, axis array<double>"),
        }
        for name, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{name}")

    @staticmethod
    def load(spark: SparkSession, folder: str) -> Kept:
        parts = spark.read.parquet(f"{folder}/components").orderBy("cluster_id").collect()
        weights, means, spread = (np.array([r[c] for r in parts], np.float64) for c in ("weight", "mean", "spread"))
        d = means.shape[1]
        mixture = FullMixture(weights, means, spread.reshape(-1, d, d)) if parts[0]["full"] else Mixture(weights, means, spread)
        scale = spark.read.parquet(f"{folder}/scale").orderBy("dim").collect()
        axes = np.array([r["axis"] for r in spark.read.parquet(f"{folder}/axes").orderBy("component").collect()], np.float64)
        return Kept(mixture, np.array([r["mean"] for r in scale]), np.array([r["std"] for r in scale]), axes if len(axes) else None)


def scaled_by(rows: DataFrame, vector: str = "embedding") -> tuple[np.ndarray, np.ndarray]:
    """Means and population deviations of the dimensions (a number each)."""
    got = sorted(column_stats(rows, vector).collect(), key=lambda r: r["dim"])
    return np.array([r["mean"] for r in got], np.float64), np.array([r["std"] for r in got], np.float64)
