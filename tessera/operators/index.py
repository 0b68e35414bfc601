"""A kept search index: an inverted file of k-means cells with residual codes, as Parquet tables.

    index/centres   cell, centre: made once from a bounded sample
    index/settings  probes: how many cells a search reads unless told otherwise; kind: the type of keys
    index/rows      cell (a Parquet partition each), keys, codes: blocks of at most BLOCK rows

A row lies in the cell of its nearest centre; its code is the difference from that centre, a byte a dimension. A search
finds each query's nearest cells, reads their partitions only, ranks by codes, and ranks the best `ef` of each query again by
their vectors. Adding rows only finds their cells and appends. All rows are indexed, whatever the sample was.

How many cells a search must read depends on how the vectors lie, so it is measured when the index is made: among the sample's rows, the
nearest neighbours of some of them should be in their nearest cells in RECALL of all cases. Rows of the whole table
lie closer together than the sample's, so their neighbours are found at least as often.

A cell that many rows share (copies, say) is many blocks: writing balances them over tasks, and a search sends its queries, a bounded
number at a time, to the blocks. So no task holds a cell.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.arrow import cut, lists, matrix
from tessera.operators.clustering import centres as spread_out
from tessera.operators.search import in_blocks, top_k, unit

#: Rows of a block of the index, queries compared with one at once, and cells at most.
BLOCK, QUERIES, MOST_CELLS = 1024, 256, 4096
#: Queries sent to the index at once, and candidates that a task keeps of them, at most.
ASKED_AT_ONCE, KEPT = 10_000, 2_000_000
#: Vectors that centres are made from, and rounds of k-means over them.
SAMPLE, ROUNDS = 40_000, 12
#: Share of neighbours that the probed cells should hold, measured with so many rows and neighbours of each.
RECALL, ASKED, NEIGHBOURS = 0.97, 400, 10
#: Steps of a code on either side of its centre.
STEPS = 127


def k_means(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 42) -> np.ndarray:
    """Unit centres of k groups of unit vectors; fewer if there are fewer different ones."""
    made = np.unique(spread_out(x, min(k, len(x)), np.random.default_rng(seed)), axis=0)
    for _ in range(rounds):
        own = np.concatenate([(x[i : i + 4096] @ made.T).argmax(1) for i in range(0, len(x), 4096)])
        sums = np.zeros_like(made)
        np.add.at(sums, own, x)
        some = np.bincount(own, minlength=len(made)) > 0
        made[some] = unit(sums[some])
    return made


def probes_for(x: np.ndarray, made: np.ndarray, recall: float = RECALL) -> int:
    """How many of its nearest cells hold `recall` of a unit vector's nearest neighbours, measured among the vectors x."""
    if len(x) < 2:
        return 1
    asked = np.linspace(0, len(x) - 1, min(ASKED, len(x))).astype(int)
    own = np.concatenate([(x[i : i + 4096] @ made.T).argmax(1) for i in range(0, len(x), 4096)])
    s = x[asked] @ x.T
    s[np.arange(len(asked)), asked] = -np.inf
    n = min(NEIGHBOURS, len(x) - 1)
    near = np.argpartition(-s, n - 1, axis=1)[:, :n]
    place = np.argsort(np.argsort(-(x[asked] @ made.T), axis=1), axis=1)  # of each cell, by nearness
    needed = np.sort(np.take_along_axis(place, own[near], 1).ravel())
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]) + 1


def encoded(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Differences from the centre (none over 2, for unit vectors) as bytes; the root keeps small ones apart."""
    d = (x - centre) / 2
    return np.rint(np.sign(d) * np.sqrt(np.abs(d)) * STEPS).astype(np.int8)


def decoded(codes: np.ndarray, centre: np.ndarray) -> np.ndarray:
    r = codes.astype(np.float32) / STEPS
    return centre + 2 * np.sign(r) * r * r


class Index:
    """An index in a folder over rows of (key, vector); cosine similarity."""

    def __init__(self, spark: SparkSession, folder: str, key: str = "vec_id", vector: str = "embedding"):
        self.spark, self.folder, self.key, self.vector = spark, folder, key, vector

    # ---- making it

    def create(self, rows: DataFrame, cells: int | None = None, sample: int = SAMPLE, seed: int = 42) -> Index:
        """Make the centres and add the rows. `cells`: about the root of the number of rows, unless given."""
        known = rows.where(F.col(self.vector).isNotNull()).select(self.key, self.vector)
        cells = cells or max(1, min(MOST_CELLS, int(known.count() ** 0.5)))
        head = known.sort(F.xxhash64(F.lit(seed), self.key), self.key).limit(max(sample, cells)).select(self.vector).collect()
        x = unit(np.array([r[0] for r in head], np.float64)) if head else np.zeros((0, 0))
        made = k_means(x, cells, seed=seed) if head else x
        self.spark.createDataFrame([(probes_for(x, made), rows.schema[self.key].dataType.simpleString())], "probes int, kind string").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/settings")
        table = self.spark.createDataFrame([(i, [float(v) for v in c]) for i, c in enumerate(made)], "cell int, centre array<double>")
        table.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/centres")
        self._write(known, "overwrite")
        return self

    def add(self, rows: DataFrame) -> None:
        """Further rows: they are assigned and appended, nothing else is read or moved."""
        self._write(rows.where(F.col(self.vector).isNotNull()).select(self.key, self.vector), "append")

    def exists(self) -> bool:
        """Whether an index was made here, to its end."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/rows/_SUCCESS")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def keys(self) -> DataFrame:
        """The keys of all indexed rows; no codes are read."""
        return self.spark.read.schema(f"keys array<{self.settings()['kind']}>").parquet(f"{self.folder}/rows").select(F.explode("keys").alias(self.key))

    def update(self, rows: DataFrame) -> None:
        """Make the index of rows or, where there is one, add those that it lacks: keys are compared, so it may break off and run again."""
        if self.exists():
            self.add(cut(rows.select(self.key, self.vector).join(self.keys(), self.key, "left_anti"), "index-new"))
        else:
            self.create(rows)

    def centres(self) -> np.ndarray:
        """As large as MOST_CELLS vectors at most."""
        got = self.spark.read.parquet(f"{self.folder}/centres").orderBy("cell").collect()
        return np.array([r["centre"] for r in got], np.float64)

    def settings(self) -> dict:
        return self.spark.read.parquet(f"{self.folder}/settings").first().asDict()

    def nearest(self, rows: DataFrame, probes: int) -> DataFrame:
        """rows (id, vector) once for each of the `probes` cells nearest to them: cell, id, and the unit vector."""
        shared, id_kind = self.spark.sparkContext.broadcast(self.centres()), rows.schema[0].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            made = shared.value
            n = min(probes, len(made))
            for b in batches:
                if not b.num_rows or not n:
                    continue
                x = unit(matrix(b.column(1)))
                s = x @ made.T
                cell = np.argpartition(-s, n - 1, axis=1)[:, :n]
                at = np.repeat(np.arange(len(x)), n)
                yield pa.RecordBatch.from_arrays([pa.array(cell.ravel().astype(np.int32)), b.column(0).take(pa.array(at)), lists(x[at].astype(np.float32))], ["cell", "id", "v"])

        return rows.mapInArrow(run, f"cell int, id {id_kind}, v array<float>")

    def _write(self, rows: DataFrame, mode: str) -> None:
        kind = rows.schema[self.key].dataType.simpleString()
        shared = self.spark.sparkContext.broadcast(self.centres())

        def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for cell, keys, x in runs(batches, BLOCK):
                codes = encoded(x, shared.value[cell])
                yield pa.RecordBatch.from_arrays([pa.array([cell], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys), pa.array([codes.tobytes()], pa.binary())], ["cell", "keys", "codes"])

        placed = self.nearest(rows, 1).hint("rebalance", "cell").sortWithinPartitions("cell")
        placed.mapInArrow(blocks, f"cell int, keys array<{kind}>, codes binary").write.mode(mode).partitionBy("cell").parquet(f"{self.folder}/rows")

    # ---- searching it

    def blocks(self, cells: list[int]) -> DataFrame:
        """The blocks of some cells: their partitions alone are read."""
        schema = f"keys array<{self.settings()['kind']}>, codes binary, cell int"
        return self.spark.read.schema(schema).parquet(f"{self.folder}/rows").where(F.col("cell").isin(cells))

    def candidates(self, queries: DataFrame, ef: int, probes: int | None = None, query_id: str = "query_id") -> DataFrame:
        """query_id, key and the score by codes of the best `ef` rows in the `probes` cells nearest to each query.

        A block of queries is sent to the index, whose tasks keep the best `ef` of each as they go: neither queries nor codes are
        moved for the pairs that they make.
        """
        known, made = self.settings(), self.centres()
        key, kind, n_probes = self.key, known["kind"], min(probes or known["probes"], len(made))

        def searched(ids: np.ndarray, q: np.ndarray) -> DataFrame:
            asked = unit(q)
            wanted = np.zeros((len(made), len(ids)), bool)  # of each cell, the queries that probe it
            for i in range(0, len(ids) if n_probes else 0, QUERIES):
                cell = np.argpartition(-(asked[i : i + QUERIES] @ made.T), n_probes - 1, axis=1)[:, :n_probes]
                wanted[cell.ravel(), i + np.repeat(np.arange(len(cell)), n_probes)] = True
            shared = self.spark.sparkContext.broadcast((ids, asked.astype(np.float32), made.astype(np.float32), np.packbits(wanted, axis=1)))

            def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                ids, asked, made, bits = shared.value
                best, own, id_type = np.full((len(ids), ef), -np.inf, np.float32), np.zeros((len(ids), ef), object), None
                for b in batches:
                    for i in range(b.num_rows):
                        cell, keys = b.column("cell")[i].as_py(), b.column("keys")[i].values
                        id_type, names = keys.type, np.array(keys.to_pylist(), object)
                        x = decoded(np.frombuffer(b.column("codes")[i].as_py(), np.int8).reshape(len(keys), -1), made[cell])
                        whom = np.flatnonzero(np.unpackbits(bits[cell], count=len(ids)))
                        for j in range(0, len(whom), QUERIES):
                            at = whom[j : j + QUERIES]
                            s = asked[at] @ x.T
                            n = min(ef, len(keys))
                            top = np.argpartition(-s, n - 1, axis=1)[:, :n]
                            both, named = np.concatenate([best[at], np.take_along_axis(s, top, 1)], 1), np.concatenate([own[at], names[top]], 1)
                            top = np.argpartition(-both, ef - 1, axis=1)[:, :ef]
                            best[at], own[at] = np.take_along_axis(both, top, 1), np.take_along_axis(named, top, 1)
                at, place = np.nonzero(np.isfinite(best))
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(own[at, place].tolist(), id_type), pa.array(best[at, place].astype(float))], [query_id, key, "score"])

            return self.blocks(np.flatnonzero(wanted.any(1)).tolist()).mapInArrow(compare, f"{query_id} long, {key} {kind}, score double")

        found = in_blocks(queries.where(F.col(self.vector).isNotNull()).select(query_id, self.vector), searched, ef, key, query_id, max(QUERIES, min(ASKED_AT_ONCE, KEPT // ef)))
        if found is None:
            return self.spark.createDataFrame([], f"{query_id} long, {key} {kind}, by_code double")
        return found.select(query_id, key, F.col("score").alias("by_code"))

    def search(self, rows: DataFrame, queries: DataFrame, k: int = 5, ef: int = 50, probes: int | None = None, query_id: str = "query_id") -> DataFrame:
        """query_id, rank, key, score of the k nearest rows of each query among its candidates, by their vectors in `rows`.

        Rows that were indexed but are no longer in `rows` are not found. A query may find fewer than k; see `search_all`.
        """
        found = cut(self.candidates(queries, max(ef, k), probes, query_id), "candidates")
        dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda t, x: t + x)
        length = lambda v: F.sqrt(dot(v, v))
        own = rows.select(self.key, F.col(self.vector).alias("v"), length(F.col(self.vector)).alias("v_length"))
        wanted = queries.select(query_id, F.col(self.vector).alias("q"), length(F.col(self.vector)).alias("q_length"))
        both = found.join(own, self.key).join(wanted, query_id)
        scored = both.select(query_id, self.key, F.round(F.coalesce(F.try_divide(dot(F.col("v"), F.col("q")), F.col("v_length") * F.col("q_length")), F.lit(0.0)), 9).alias("score"))
        order = Window.partitionBy(query_id).orderBy(F.desc("score"), self.key)
        return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(query_id, "rank", self.key, "score")

    def search_all(self, rows: DataFrame, queries: DataFrame, k: int = 5, ef: int = 50, probes: int | None = None, query_id: str = "query_id") -> DataFrame:
        """As `search`, but queries that find fewer than k rows in their cells are searched exactly."""
        near = cut(self.search(rows, queries, k, ef, probes, query_id), "index-search")
        whole = near.where(F.col("rank") == k).select(query_id)
        rest = top_k(rows, queries.join(whole, query_id, "left_anti"), k, row_id=self.key, query_id=query_id, vector=self.vector)
        return near.join(whole, query_id, "left_semi").select(*near.columns).unionByName(rest)


def runs(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[int, pa.Array, np.ndarray]]:
    """cell, ids and vectors of rows sorted by cell, `most` at a time."""
    held: list[pa.RecordBatch] = []
    now, n = None, 0

    def out() -> tuple[int, pa.Array, np.ndarray]:
        b = pa.concat_batches(held) if len(held) > 1 else held[0]
        return now, b.column("id"), matrix(b.column("v"))

    for b in batches:
        if not b.num_rows:
            continue
        cells = b.column("cell").to_numpy()
        edges = [0, *(np.flatnonzero(cells[1:] != cells[:-1]) + 1).tolist(), len(cells)]
        for a, z in zip(edges[:-1], edges[1:], strict=True):
            if held and int(cells[a]) != now:
                yield out()
                held, n = [], 0
            now = int(cells[a])
            while a < z:
                part = b.slice(a, min(z - a, most - n))
                held.append(part)
                n, a = n + part.num_rows, a + part.num_rows
                if n == most:
                    yield out()
                    held, n = [], 0
    if held:
        yield out()
