"""What the operators of this subpackage share: shipping code, cutting lineage, small hashes."""

from __future__ import annotations

import pickle
import sys
import tempfile
import types
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Functions travel by value, so executors need no copy of this repository.
cloudpickle.register_pickle_by_value(sys.modules["tessera.llm"])

ASCII_SPACE = " \t\n\x0b\x0c\r"
#: What counts as white space in every contract here, as a Java and Python class.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of a batch that goes to a Python worker, or comes back, in the operators that move whole texts and sets.
BATCH = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bound batches by their bytes, not by 10,000 rows alone: the JVM and the worker both hold them outside the heap, for each task."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(BATCH))  # for good, as rows are made later


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own on a single machine (tests)."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    now = sc._jsc.sc().getCheckpointDir()
    if named is None and now.isEmpty() and not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
    if now.isEmpty():
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tessera-checkpoint-"))
    return named or sc._jsc.sc().getCheckpointDir().get()


class Work:
    """The tables between the steps of one run, as Parquet in the shared folder.

    Lineage ends at each; Spark knows their sizes, so it broadcasts the small ones by its own threshold; the shuffle
    files of a step go when its table is written, and a table that is no longer read is dropped by its path. What is left, which a
    result may still read, goes when the session's JVM ends.
    """

    CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        spark.conf.set(self.CLEANUP, "true")  # for good: turned back, it would be off for a query of another thread
        path, files = self.at("")
        files.mkdirs(path)
        files.deleteOnExit(path)

    def at(self, name: str) -> tuple:
        """The path of a table, and its file system."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        df.write.parquet(f"{self.folder}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            path, files = self.at(name)
            files.delete(path, True)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Run df once and keep its rows in the shared folder: lineage ends, lost executors cost nothing."""
    return Work(df.sparkSession, name).keep("rows", df)


@dataclass
class Renamed:
    """A DataFrame under neutral column names, so that columns an operator adds can't clash with a user's."""

    df: DataFrame
    names: list[str]

    def of(self, name: str) -> str:
        return f"c{self.names.index(name)}"

    def col(self, name: str) -> Column:
        return F.col(self.of(name))

    def restored(self) -> list[Column]:
        return [F.col(f"c{i}").alias(n) for i, n in enumerate(self.names)]

    def ddl(self) -> str:
        return self.df._jdf.schema().toDDL()


def renamed(df: DataFrame) -> Renamed:
    return Renamed(df.toDF(*[f"c{i}" for i in range(len(df.columns))]), df.columns)


def per_worker() -> dict:
    """A dict that lives as long as the Python worker (functions shipped by value have no module of their own)."""
    return sys.modules.setdefault("_tessera_worker", types.ModuleType("_tessera_worker")).__dict__


def share(spark: SparkSession, value: object) -> Broadcast:
    """A broadcast of an object and its class, for `opened`; a plain one names the class, which executors would have to import."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def opened(shared: Broadcast) -> object:
    return pickle.loads(shared.value)


def column_bytes(column: pa.Array) -> list[bytes | None]:
    """A string column's values as UTF-8 bytes."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `most` bytes of text each, so that working memory is bounded."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        column = batch.column(text)
        if column.nbytes <= most:
            yield batch
            continue
        start, held = 0, 0
        lengths = pa.compute.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False)
        for i, n in enumerate(lengths):
            if held and held + n > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(n)
        yield batch.slice(start)
