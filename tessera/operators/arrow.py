"""Helpers for operators that work on Arrow batches."""

from __future__ import annotations

import pickle
import sys
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, cloudpickle
from pyspark.sql import DataFrame, SparkSession

# Functions of these modules travel by value, so executors need no copy of this repository.
cloudpickle.register_pickle_by_value(sys.modules["tessera.operators"])


def share(spark: SparkSession, value: object) -> Broadcast:
    """A broadcast of an object and its class, for `opened`; a plain one names the class, which executors would have to import."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def opened(shared: Broadcast) -> object:
    return pickle.loads(shared.value)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share: below spark.checkpoint.dir, or one of our own on a single machine (tests).

    It goes when the session's JVM ends.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc._jsc.sc().getCheckpointDir().get()
    if named is None and not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
    folder = f"{named or tempfile.mkdtemp(prefix='tessera-')}/{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return folder


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Run df once and keep its rows in the shared folder: lineage ends, and Spark knows the size."""
    path = f"{shared_folder(df.sparkSession, name)}/rows"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as an n x d matrix of doubles."""
    if not len(column):
        return np.empty((0, 0))
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1).astype(np.float64)


def lists(m: np.ndarray) -> pa.Array:
    """The rows of a matrix as a list column."""
    ends = np.arange(0, m.size + 1, max(1, m.shape[1]), dtype=np.int32) if m.size else np.zeros(len(m) + 1, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(m.ravel()))
