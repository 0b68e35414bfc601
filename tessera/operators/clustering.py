"""Scaling, projection, Gaussian mixtures, silhouettes and average linkage over vectors in array columns.

Sums over rows are made in Arrow batches with numpy and added up by Spark; only sums the size of the model (clusters
x dimensions) reach the driver between two rounds of expectation-maximisation.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import vectors as V
from tessera.operators.arrow import cut, lists, matrix, opened, share
from tessera.operators.projection import components

FLOOR = 1e-6
WIDE = 4096
LOG_2PI = float(np.log(2 * np.pi))

# ---- choosing the number of clusters


def k_hierarchy(n: Column) -> Column:
    return F.greatest(F.lit(2), F.least(F.lit(8), F.floor(n / 50))).cast("int")


def k_hundredth(n: Column) -> Column:
    return F.greatest(F.lit(2), F.least(F.lit(8), F.floor(n / 100))).cast("int")


def k_root(n: Column) -> Column:
    return F.greatest(F.lit(2), F.least(F.lit(10), F.floor(F.sqrt(n / 2)))).cast("int")


def k_pages(n: Column) -> Column:
    return F.least(F.lit(10), F.greatest(F.lit(3), F.floor(n / 500))).cast("int")


# ---- columns of vectors


def column_stats(rows: DataFrame, vector: str = "embedding", by: tuple[str, ...] = ()) -> DataFrame:
    """dim, mean, std (population) of each dimension, in each group of `by`."""
    each = rows.select(*by, F.posexplode(V.doubles(F.col(vector))).alias("dim", "x"))
    return each.groupBy(*by, "dim").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))


def standardised(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """rows with the vector's dimensions at mean 0 and population deviation 1; constant dimensions become 0."""
    stats = column_stats(rows, vector).agg(F.array_sort(F.collect_list(F.struct("dim", "mean", "std"))).alias("stats"))
    scaled = F.zip_with(V.doubles(F.col(vector)), F.col("stats"), lambda x, s: (x - s["mean"]) / F.when(s["std"] > 0, s["std"]).otherwise(F.lit(1.0)))
    return rows.crossJoin(F.broadcast(stats)).withColumn(vector, scaled).drop("stats")  # one row, as wide as a vector


def covariance(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """i, j, cov (population) for all pairs of dimensions: a matrix product a batch, summed by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            x = matrix(b.column(0))
            if len(x):
                ext = np.column_stack([x, np.ones(len(x))])
                total = ext.T @ ext if total is None else total + ext.T @ ext
        if total is not None:
            d = len(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(d, dtype=np.int32), d)), pa.array(np.tile(np.arange(d, dtype=np.int32), d)), pa.array(total.ravel())], ["i", "j", "s"])

    # Kept, since all that follows names it: one pass over the rows.
    sums = cut(rows.where(F.col(vector).isNotNull()).select(vector).mapInArrow(run, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")), "covariance")
    last = sums.agg(F.max("i").alias("d"))
    ones = sums.join(F.broadcast(last), F.col("j") == F.col("d")).select(F.col("i").alias("r"), F.col("s").alias("r_sum"))  # d + 1 rows
    n = F.broadcast(ones.join(F.broadcast(last), F.col("r") == F.col("d")).select(F.col("r_sum").alias("n"), F.col("r").alias("d")))
    both = sums.join(F.broadcast(ones), F.col("i") == F.col("r")).drop("r").join(F.broadcast(ones.select(F.col("r").alias("c"), F.col("r_sum").alias("c_sum"))), F.col("j") == F.col("c"))
    return both.crossJoin(n).where("i < d AND j < d").select("i", "j", (F.col("s") / F.col("n") - F.col("r_sum") / F.col("n") * F.col("c_sum") / F.col("n")).alias("cov"))


def projected(rows: DataFrame, most: int = 50, wider_than: int = 100, more_than: int = 50, vector: str = "embedding") -> tuple[DataFrame, float | None]:
    """rows projected on min(most, n // 2) principal components, and the share of variance they explain.

    Only if vectors have more than `wider_than` dimensions and there are more than `more_than` rows; else rows and None.
    """
    return projected_with_axes(rows, most, wider_than, more_than, vector)[:2]


def projected_with_axes(rows: DataFrame, most: int = 50, wider_than: int = 100, more_than: int = 50, vector: str = "embedding", share_of: float | None = None) -> tuple[DataFrame, float | None, np.ndarray | None]:
    """As `projected`, and the axes of the components.

    With `share_of`, as many components as explain that share of the variance. These, and those of vectors of more than WIDE
    dimensions, come from projection.components, which makes no matrix of all pairs of dimensions.
    """
    n = rows.count()
    first = rows.select(vector).first()
    if first is None or len(first[0]) <= wider_than or n <= more_than:
        return rows, None, None
    if share_of is not None or len(first[0]) > WIDE:
        found = components(rows, share_of or 1.0, None if share_of else min(most, n // 2), vector)
        return found.project(rows, vector), float(found.ratios.sum()), found.axes
    with_vector = rows.withColumn("__v", array_to_vector(V.doubles(F.col(vector))))
    model = PCA(k=min(most, n // 2, len(first[0])), inputCol="__v", outputCol="__p").fit(with_vector)
    return model.transform(with_vector).withColumn(vector, vector_to_array("__p")).drop("__v", "__p"), float(model.explainedVariance.toArray().sum()), model.pc.toArray().T


# ---- Gaussian mixtures


class Mixture:
    """Weights (k), means and variances (k x d) of Gaussians with diagonal covariance."""

    def __init__(self, weights: np.ndarray, means: np.ndarray, variances: np.ndarray):
        self.weights, self.means, self.variances = weights, means, np.maximum(variances, FLOOR)

    def log_density(self, x: np.ndarray) -> np.ndarray:
        """n x k: log of weight times density."""
        inv = 1 / self.variances
        far = (x * x) @ inv.T - 2 * x @ (self.means * inv).T + (self.means**2 * inv).sum(1)
        return np.log(np.maximum(self.weights, 1e-300)) - 0.5 * (far + np.log(self.variances).sum(1) + x.shape[1] * LOG_2PI)

    def responsibilities(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """n x k posterior probabilities, n log-likelihoods."""
        z = self.log_density(x)
        top = z.max(1, keepdims=True)
        ll = top[:, 0] + np.log(np.exp(z - top).sum(1))
        return np.exp(z - ll[:, None]), ll


    def partial(self, x: np.ndarray) -> np.ndarray:
        """The sums of an M-step over rows: responsibilities, their x and x^2, the log-likelihood, the rows."""
        r, ll = self.responsibilities(x)
        return np.concatenate([r.sum(0), (r.T @ x).ravel(), (r.T @ (x * x)).ravel(), [ll.sum(), len(x)]])

    def updated(self, s: np.ndarray) -> Mixture:
        k, d = self.means.shape
        w, means = np.maximum(s[:k], 1e-10)[:, None], s[k : k + k * d].reshape(k, d)
        means, squares = means / w, s[k + k * d : k + 2 * k * d].reshape(k, d) / w
        return Mixture(s[:k] / s[-1], means, squares - means**2)


class FullMixture(Mixture):
    """Weights (k), means (k x d) and covariances (k x d x d) of Gaussians."""

    def __init__(self, weights: np.ndarray, means: np.ndarray, covariances: np.ndarray):
        self.weights, self.means, self.covariances = weights, means, covariances

    def log_density(self, x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), len(self.weights)))
        for i, (mean, cov) in enumerate(zip(self.means, self.covariances, strict=True)):
            values, axes = np.linalg.eigh(cov)
            values = np.maximum(values, FLOOR)
            far = (((x - mean) @ axes) ** 2 / values).sum(1)
            out[:, i] = -0.5 * (far + np.log(values).sum() + x.shape[1] * LOG_2PI)
        return out + np.log(np.maximum(self.weights, 1e-300))

    def partial(self, x: np.ndarray) -> np.ndarray:
        r, ll = self.responsibilities(x)
        squares = [((x * r[:, [i]]).T @ x).ravel() for i in range(r.shape[1])]
        return np.concatenate([r.sum(0), (r.T @ x).ravel(), *squares, [ll.sum(), len(x)]])

    def updated(self, s: np.ndarray) -> FullMixture:
        k, d = self.means.shape
        w, means = np.maximum(s[:k], 1e-10), s[k : k + k * d].reshape(k, d)
        means = means / w[:, None]
        squares = s[k + k * d : -2].reshape(k, d, d) / w[:, None, None]
        return FullMixture(s[:k] / s[-1], means, squares - means[:, :, None] * means[:, None, :] + FLOOR * np.eye(d))


def sums(rows: DataFrame, models: list[Mixture], vector: str) -> list[np.ndarray]:
    """For each model the sums of an M-step. A task makes one vector a model; Spark adds them as they come."""
    shared = share(rows.sparkSession, models)  # starts x the size of a model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = opened(shared)
        total = [None] * len(models)
        for b in batches:
            x = matrix(b.column(0))
            if not len(x):
                continue
            for i, m in enumerate(models):
                part = m.partial(x)
                total[i] = part if total[i] is None else total[i] + part
        found = [(i, t) for i, t in enumerate(total) if t is not None]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.int32()), lists(np.stack([t for _, t in found]))], ["start", "sums"])

    part = rows.select(vector).mapInArrow(run, "start int, sums array<double>").select("start", array_to_vector("sums").alias("sums"))
    added = part.groupBy("start").agg(Summarizer.sum(F.col("sums")).alias("sums")).collect()
    return [r["sums"].toArray() for r in sorted(added, key=lambda r: r["start"])]


def fit(rows: DataFrame, made: Callable[[np.ndarray, np.ndarray], Mixture], k: int, starts: int, rounds: int, tolerance: float, seed: int, vector: str, key: str, sample: int, begin: Mixture | None = None) -> tuple[Mixture, float, list[float]]:
    """The best of several EM runs by likelihood: model, mean log-likelihood, its history. All starts share each pass.

    Starts: k-means++ centres of a bounded sample (the smallest hashes of the key), and its variances; or the one model `begin`.
    """
    known = rows.where(F.col(vector).isNotNull()).select(vector, key).persist()
    try:
        if begin is None:
            head = known.sort(F.xxhash64(F.lit(seed), key), key).limit(sample).select(vector).collect()
            x = np.array([r[0] for r in head], np.float64)
            if not len(x):
                raise ValueError("no vectors")
            spread = np.maximum(x.var(0), FLOOR)
            models = [made(centres(x, k, np.random.default_rng(seed + i)), spread) for i in range(starts)]
        else:
            models, starts = [begin], 1
        measured, history = list(models), [[] for _ in models]  # the models that the likelihoods belong to
        open_ = list(range(starts))
        for _ in range(rounds):
            for i, s in zip(open_, sums(known, [models[i] for i in open_], vector), strict=True):
                measured[i], models[i] = models[i], models[i].updated(s)
                history[i].append(float(s[-2] / s[-1]))
            open_ = [i for i in open_ if len(history[i]) < 2 or history[i][-1] - history[i][-2] >= tolerance]
            if not open_:
                break
        best = max(range(starts), key=lambda i: (history[i][-1], -i))
        return measured[best], history[best][-1], history[best]
    finally:
        known.unpersist()


def fit_diagonal(rows: DataFrame, k: int, starts: int = 5, rounds: int = 200, tolerance: float = 1e-3, seed: int = 42, vector: str = "embedding", key: str = "vec_id", sample: int = 2000, begin: Mixture | None = None) -> tuple[Mixture, float, list[float]]:
    made = lambda means, spread: Mixture(np.full(k, 1 / k), means, np.tile(spread, (k, 1)))
    return fit(rows, made, k, starts, rounds, tolerance, seed, vector, key, sample, begin)


def fit_full(rows: DataFrame, k: int, starts: int = 10, rounds: int = 300, tolerance: float = 1e-3, seed: int = 42, vector: str = "embedding", key: str = "vec_id", sample: int = 2000, begin: Mixture | None = None) -> tuple[FullMixture, float, list[float]]:
    made = lambda means, spread: FullMixture(np.full(k, 1 / k), means, np.tile(np.diag(spread), (k, 1, 1)))
    return fit(rows, made, k, starts, rounds, tolerance, seed, vector, key, sample, begin)


def centres(x: np.ndarray, k: int, r: np.random.Generator) -> np.ndarray:
    chosen = [x[r.integers(len(x))]]
    far = ((x - chosen[0]) ** 2).sum(1)
    while len(chosen) < k:
        p = far / far.sum() if far.sum() > 0 else np.full(len(x), 1 / len(x))
        chosen.append(x[r.choice(len(x), p=p)])
        far = np.minimum(far, ((x - chosen[-1]) ** 2).sum(1))
    return np.array(chosen)


def assigned(rows: DataFrame, model: Mixture, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """key, cluster_id, confidence, probabilities, log_likelihood of each row with a vector."""
    shared = share(rows.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = opened(shared)
        for b in batches:
            if b.num_rows:
                r, ll = model.responsibilities(matrix(b.column(1)))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(r.argmax(1).astype(np.int32)), pa.array(r.max(1)), lists(r), pa.array(ll)], [key, "cluster_id", "confidence", "probabilities", "log_likelihood"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.where(F.col(vector).isNotNull()).select(key, vector).mapInArrow(run, f"{key} {kind}, cluster_id int, confidence double, probabilities array<double>, log_likelihood double")


def by_label(rows: DataFrame, label: str = "label", vector: str = "embedding") -> tuple[Mixture, list]:
    """The mixture whose components are the groups of a label (one M-step), and the labels in order."""
    n = rows.groupBy(label).count()
    stats = column_stats(rows, vector, (label,)).groupBy(label).agg(F.array_sort(F.collect_list(F.struct("dim", "mean", "std"))).alias("s"))
    got = sorted(n.join(stats, label).collect(), key=lambda r: r[label])
    total = sum(r["count"] for r in got)
    m = Mixture(np.array([r["count"] / total for r in got]), np.array([[e["mean"] for e in r["s"]] for r in got]), np.array([[e["std"] ** 2 for e in r["s"]] for r in got]))
    return m, [r[label] for r in got]


def criteria(log_likelihood, n, k: int, d: int, full: bool = False) -> tuple:
    """AIC, BIC; of numbers, or of columns."""
    p = k * d + k * d * (d + 1) // 2 + k - 1 if full else 2 * k * d + k - 1
    log_n = F.log(n.cast("double")) if isinstance(n, Column) else float(np.log(n))
    return 2 * p - 2 * log_likelihood, p * log_n - 2 * log_likelihood


# ---- silhouette


#: Groups of blocks that all blocks are sent past, while no group has over HELD numbers of its own (vectors and sums).
GROUPS, HELD = 24, 1 << 23


def packed(rows: DataFrame, label: str, vector: str, key: str, block: int) -> DataFrame:
    """block (numbered from 0), labels and vectors (as bytes, of the vectors' own type), keys: `block` rows at most in each."""
    kind, exact = rows.schema[key].dataType.simpleString(), real(rows, vector)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, block):
                part = b.slice(i, block)
                keys = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(0))
                blobs = [pa.array([x.tobytes()], pa.binary()) for x in (part.column(1).to_numpy().astype(np.int64), matrix(part.column(2)).astype(exact))]
                yield pa.RecordBatch.from_arrays([keys, *blobs], ["keys", "labels", "vectors"])

    made = rows.where(F.col(vector).isNotNull()).select(key, F.col(label).cast("long"), vector).mapInArrow(run, f"keys array<{kind}>, labels binary, vectors binary")
    made = cut(made.withColumn("at", F.monotonically_increasing_id()), "silhouette-blocks")
    number = made.select("at", (F.row_number().over(Window.orderBy("at")) - 1).alias("block"))  # a row a block
    return made.join(F.broadcast(number), "at").drop("at")


def real(rows: DataFrame, vector: str) -> type:
    """The numbers of a vector column as numpy has them."""
    return np.float32 if rows.schema[vector].dataType.simpleString() == "array<float>" else np.float64


def passes(rows: DataFrame, label: str = "label", vector: str = "embedding", key: str = "vec_id", block: int = 2000) -> tuple[DataFrame, dict[int, int]]:
    """group, passes, keys, labels, vectors: each group's own blocks (0), then all blocks (1), a task a group; and the labels' sizes."""
    sizes = {r[0]: r[1] for r in rows.where(F.col(vector).isNotNull()).groupBy(F.col(label).cast("long")).count().collect()}
    kind, exact = rows.schema[key].dataType.simpleString(), real(rows, vector)
    blocks = packed(rows, label, vector, key, min(block, max(100, sum(sizes.values()) // GROUPS + 1)))
    n, numbers = blocks.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("vectors")), F.lit(0))).first()
    numbers = numbers // np.dtype(exact).itemsize + sum(sizes.values()) * len(sizes)
    groups = max(1, min(n, max(GROUPS, -(-numbers // HELD))))
    own = blocks.select((F.col("block") % groups).cast("int").alias("group"), F.lit(0).alias("passes"), "keys", "labels", "vectors")
    other = blocks.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), F.lit(1).alias("passes"), F.lit(None).cast(f"array<{kind}>").alias("keys"), "labels", "vectors")
    return own.unionByName(other).repartitionByRange(groups, "group").sortWithinPartitions("group", "passes"), sizes


def silhouettes(rows: DataFrame, label: str = "label", vector: str = "embedding", key: str = "vec_id", block: int = 2000) -> DataFrame:
    """key, label, s of each row with a vector: exact, Euclidean.

    By nature all rows meet all rows, so the time grows as their square. A task holds a group of blocks and the sums of distances to each
    label of their rows, and all blocks go past it, one at a time. With GROUPS groups what is moved grows as the rows; a group may
    not have over HELD numbers, so very many rows (2.6 million of 64 dimensions) make more groups.
    """
    met, sizes = passes(rows, label, vector, key, block)
    labels, kind, exact = sorted(sizes), rows.schema[key].dataType.simpleString(), real(rows, vector)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []  # keys, labels' places, vectors, their squares and sums of each block of the group
        counts = np.array([sizes[v] for v in labels], float)

        def finished(keys: pa.Array, at: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
            rows = np.arange(len(at))
            inside = sums[rows, at] / np.maximum(counts[at] - 1, 1)
            away = sums / counts
            away[rows, at] = np.inf
            nearest = away.min(1)
            top = np.maximum(inside, nearest)
            with np.errstate(invalid="ignore"):
                s = np.where((counts[at] == 1) | np.isinf(nearest) | (top == 0), 0.0, (nearest - inside) / np.where(top == 0, 1, top))
            return pa.RecordBatch.from_arrays([keys, pa.array(np.array(labels)[at].astype(np.int32)), pa.array(s)], [key, label, "s"])

        for b in batches:
            for i in range(b.num_rows):
                group, passes = b.column("group")[i].as_py(), b.column("passes")[i].as_py()
                if group != now:
                    for keys, at, _, _, sums in held:
                        yield finished(keys, at, sums)
                    now, held = group, []
                at = np.searchsorted(labels, np.frombuffer(b.column("labels")[i].as_buffer(), np.int64))
                q = np.frombuffer(b.column("vectors")[i].as_buffer(), exact).reshape(len(at), -1).astype(float)
                squares = (q * q).sum(1)
                if not passes:
                    keys = pa.concat_arrays([b.column("keys")[i].values])
                    held.append((keys, at, q, squares, np.zeros((len(at), len(labels)))))
                    continue
                one = (at[:, None] == np.arange(len(labels))[None]).astype(float)
                for _, _, x, own, sums in held:
                    both = own[:, None] + squares[None]
                    far = x @ q.T
                    far *= -2
                    far += both
                    both *= 1e-12
                    far[far < both] = 0  # a row with itself
                    sums += np.sqrt(far, out=far) @ one
        for keys, at, _, _, sums in held:
            yield finished(keys, at, sums)

    return met.mapInArrow(run, f"{key} {kind}, {label} int, s double")


def silhouette_estimate(rows: DataFrame, label: str = "label", vector: str = "embedding", key: str = "vec_id", per_label: int = 400, seed: int = 42) -> tuple[float, float]:
    """The mean silhouette by a sample of each label, and half its 95 % confidence interval; one pass over the rows.

    A label's `per_label` rows with the smallest hashes of the key are held against all rows, so each one's silhouette is exact and the
    work grows as the rows, not as their square. Labels of at most per_label rows count whole; if all do, the mean is exact and the interval 0.
    """
    known = rows.where(F.col(vector).isNotNull()).select(F.col(label).cast("long").alias("l"), vector, key)
    sizes = {r[0]: r[1] for r in known.groupBy("l").count().collect()}
    if len(sizes) < 2:
        return 0.0, 0.0
    labels = sorted(sizes)
    draw = Window.partitionBy("l").orderBy(F.xxhash64(F.lit(seed), key), key)
    drawn = known.withColumn("i", F.row_number().over(draw)).where(F.col("i") <= per_label).select("l", vector).collect()  # per_label a label
    mine, x = np.array([r[0] for r in drawn]), np.array([r[1] for r in drawn], np.float64)
    shared = rows.sparkSession.sparkContext.broadcast((x, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, labels = shared.value
        sums, own = np.zeros((len(x), len(labels))), (x * x).sum(1)[:, None]
        for b in batches:
            if b.num_rows:
                theirs, q = np.searchsorted(labels, b.column(0).to_numpy()), matrix(b.column(1))
                one = (theirs[:, None] == np.arange(len(labels))[None]).astype(float)
                for i in range(0, len(x), 256):
                    both = own[i : i + 256] + (q * q).sum(1)[None]
                    far = both - 2 * x[i : i + 256] @ q.T
                    far[far < 1e-12 * both] = 0  # a row with itself
                    sums[i : i + 256] += np.sqrt(far) @ one
        yield pa.RecordBatch.from_arrays([lists(sums.reshape(1, -1))], ["sums"])

    part = known.select("l", vector).mapInArrow(run, "sums array<double>").select(array_to_vector("sums").alias("sums"))
    sums = part.agg(Summarizer.sum(F.col("sums"))).first()[0].toArray().reshape(len(x), len(labels))
    counts, at, each = np.array([sizes[v] for v in labels], float), np.searchsorted(labels, mine), np.arange(len(x))
    inside, away = sums[each, at] / np.maximum(counts[at] - 1, 1), sums / counts
    away[each, at] = np.inf
    nearest = away.min(1)
    top = np.maximum(inside, nearest)
    s = np.where((counts[at] == 1) | (top == 0), 0.0, (nearest - inside) / np.where(top == 0, 1, top))
    share, mean, variance = counts / counts.sum(), 0.0, 0.0
    for i in range(len(labels)):
        own = s[at == i]
        mean += share[i] * own.mean()
        if len(own) < counts[i]:
            variance += share[i] ** 2 * own.var(ddof=1) / len(own) * (1 - len(own) / counts[i])
    return float(mean), float(1.96 * np.sqrt(variance))


# ---- average linkage


#: Numbers that a block of similarities holds at most; rounds of merges go on while they merge a SHARE of what is left.
AT_ONCE, SHARE = 1 << 22, 1 / 16


def average_linkage(x: np.ndarray, k: int) -> np.ndarray:
    """Labels of k clusters by average linkage on cosine distance; numbered by first member.

    The mean cosine of two clusters is the product of their sums of unit vectors over both sizes, so n x d numbers are
    enough and no n x n matrix is made. Equal rows merge first; then all pairs that are each other's nearest merge in rounds,
    which average linkage allows (a merge brings no cluster nearer to a third one); where rounds find few pairs, chains of nearest neighbours
    finish in time of the square. The n - k lowest merges make the clusters.
    """
    n = len(x)
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    sums = x / np.where(norm == 0, 1, norm)
    size, alive, merges = np.ones(n), np.ones(n, bool), []
    seen: dict[bytes, int] = {}
    first = np.array([seen.setdefault(row.tobytes(), i) for i, row in enumerate(sums + 0.0)], np.int64)  # of equal rows; -0.0 is 0.0
    for i in np.flatnonzero((first != np.arange(n)) & (norm[:, 0] > 0)).tolist():
        merges.append((0.0, int(first[i]), i))
        sums[first[i]] += sums[i]
        size[first[i]] += 1
        alive[i] = False

    def nearest(rows: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each of the clusters `rows` the nearest other one of `among` (sorted), and its distance."""
        near, far = np.empty(len(rows), np.int64), np.empty(len(rows))
        means = sums[among] / size[among][:, None]
        step = max(1, AT_ONCE // len(among))
        for i in range(0, len(rows), step):
            own = rows[i : i + step]
            d = (1 - (sums[own] / size[own][:, None]) @ means.T).round(12)
            d[np.arange(len(own)), np.searchsorted(among, own)] = np.inf
            at = d.argmin(1)
            near[i : i + step], far[i : i + step] = among[at], d[np.arange(len(own)), at]
        return near, far

    def merge(d: float, i: int, j: int) -> None:
        merges.append((d, i, j))
        sums[i] += sums[j]
        size[i] += size[j]
        alive[j] = False

    near, far, stale = np.zeros(n, np.int64), np.zeros(n), alive.copy()
    while (left := np.flatnonzero(alive)).size > 1:
        again = np.flatnonzero(stale & alive)
        near[again], far[again] = nearest(again, left)
        pairs = left[(near[near[left]] == left) & (left < near[left])]
        if len(pairs) < SHARE * len(left):
            break
        changed = np.zeros(n, bool)
        for i in pairs.tolist():
            changed[[i, near[i]]] = True
            merge(far[i], i, int(near[i]))
        stale = changed | changed[near]
    chain: list[int] = []
    left = np.flatnonzero(alive)
    held, sizes = sums[left], size[left]
    while len(left) > 1:
        if not chain:
            chain.append(int(left[0]))
        i = chain[-1]
        d = (1 - held @ sums[i] / (sizes * size[i])).round(12)
        d[np.searchsorted(left, i)] = np.inf
        at = int(d.argmin())
        if len(chain) > 1 and d[np.searchsorted(left, chain[-2])] <= d[at]:
            at = int(np.searchsorted(left, chain[-2]))
        j = int(left[at])
        if len(chain) < 2 or j != chain[-2]:
            chain.append(j)
            continue
        del chain[-2:]
        merge(d[at], min(i, j), max(i, j))
        kept, gone = np.searchsorted(left, [min(i, j), max(i, j)])
        held[kept], sizes[kept] = sums[min(i, j)], size[min(i, j)]
        for a in (left, held, sizes):
            a[gone:-1] = a[gone + 1 :]
        left, held, sizes = left[:-1], held[:-1], sizes[:-1]
    merges.sort(key=lambda m: m[0])  # stable: of equal ones the earlier first, so members come before their cluster
    up = list(range(n))
    for _, a, b in merges[: max(0, n - max(k, 1))]:
        while up[a] != a:
            a = up[a]
        while up[b] != b:
            b = up[b]
        up[max(a, b)] = min(a, b)
    root = np.array(up, np.int64)
    while (root[root] != root).any():
        root = root[root]
    return pd.factorize(root)[0]
