"""Which keys a table holds already, without reading all of them: Bloom filters by hash prefix over key files in partitions.

    keys/rows/batch=N/prefix=P   level, chunk_key of an append, by prefix of their hash
    keys/filters/N               prefix, word, bits: the filters of all batches up to N, each 64 bits a row; written last

New keys are looked up in the filters; where a filter says that it may know a key, the key files of that prefix are read, and no others. Filters
merge by bitwise or. They are widened, with more prefixes, as keys become more than they were made for; key files are
merged every MERGE appends.

An append notes its keys before its rows are written and its filters after. If it breaks off between, the next one finds a batch without
filters, and keeps of its keys those whose rows are there. One writer at a time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.arrow import cut

#: Bits of a filter, probes of a key, prefixes at first; keys that a filter is made for (about 1 in 500 unknown keys then looks known).
BITS, PROBES, PREFIXES, FULL = 1 << 17, 6, 16, 10_000
MERGE = 16
KEY = ["level", "chunk_key"]
SCHEMA = "level int, chunk_key string, batch int, prefix int"


def hashed(rows: DataFrame, prefixes: int) -> DataFrame:
    """level, chunk_key, prefix of rows."""
    return rows.select(F.col("level").cast("int").alias("level"), "chunk_key").withColumn("prefix", F.pmod(F.xxhash64(F.lit(0), *KEY), F.lit(prefixes)).cast("int"))


def probes() -> Column:
    """The places of a key's bits in its filter: two hashes, one added to the other again and again."""
    a, b = (F.pmod(F.xxhash64(F.lit(i), *KEY), F.lit(BITS)) for i in (1, 2))
    return F.explode(F.array(*[F.pmod(a + F.lit(i) * (b * 2 + 1), F.lit(BITS)).cast("int") for i in range(PROBES)]))


class Keys:
    """The keys of a table in a folder. `stored` reads the keys (level, chunk_key) of the rows that are there, or says None."""

    def __init__(self, spark: SparkSession, folder: str, stored: Callable[[], DataFrame | None]):
        self.spark, self.folder, self.stored = spark, folder, stored

    # ---- files

    def _files(self, path: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{path}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, path: str) -> list[str]:
        path, files = self._files(path)
        return [s.getPath().getName() for s in files.listStatus(path)] if files.exists(path) else []

    def _there(self, path: str) -> bool:
        path, files = self._files(path)
        return files.exists(path)

    def _drop(self, path: str) -> None:
        path, files = self._files(path)
        files.delete(path, True)

    # ---- state

    def latest(self) -> int:
        """The number of the last append that ended; -1 if there is none."""
        return max((int(n) for n in self._names("filters") if self._there(f"filters/{n}/_SUCCESS")), default=-1)

    def filters(self, n: int) -> DataFrame:
        return self.spark.read.schema("prefix int, word int, bits long, prefixes int, n_keys long").parquet(f"{self.folder}/filters/{n}")

    def size(self, n: int) -> tuple[int, int]:
        """Prefixes and keys of the filters."""
        first = self.filters(n).first() if n >= 0 else None
        return (first["prefixes"], first["n_keys"]) if first else (PREFIXES, 0)

    def rows(self, n: int) -> DataFrame:
        """The keys of all batches up to n."""
        return self.spark.read.schema(SCHEMA).parquet(f"{self.folder}/rows").where(F.col("batch") <= n)

    # ---- an append

    def unknown(self, rows: DataFrame) -> DataFrame:
        """Those of rows (level, chunk_key, ...; each key once) whose keys are not there."""
        n = self.recovered()
        prefixes, n_keys = self.size(n)
        if not n_keys:
            return rows
        keyed = hashed(rows, prefixes).withColumn("at", probes()).withColumn("word", F.expr("at div 64").cast("int"))
        seen = keyed.join(self.filters(n).select("prefix", "word", "bits"), ["prefix", "word"]).where("getbit(bits, at % 64) = 1")
        hit = seen.groupBy("prefix", *KEY).agg(F.count("*").alias("n")).where(F.col("n") == PROBES)
        some = [r["prefix"] for r in hit.select("prefix").distinct().collect()]  # as many as prefixes, at most
        return rows.join(self.rows(n).where(F.col("prefix").isin(some)).select(*KEY), KEY, "left_anti") if some else rows

    def added(self, rows: DataFrame, write: Callable[[], None]) -> None:
        """Note the keys of rows, write the rows, note that it is done; then merge what has become much."""
        n = self.latest()
        prefixes, n_keys = self.size(n)
        self._note(n + 1, rows, prefixes)
        write()
        n_keys = self._done(n + 1, prefixes, n_keys, self.filters(n) if n >= 0 else None)
        if n_keys > prefixes * FULL or len(self._names("rows")) > MERGE:
            self.merge()

    def merge(self) -> None:
        """All keys as one batch, in more prefixes if they have become many. Breaking off at any place loses none."""
        n = self.latest()
        keys = cut(self.rows(n).select(*KEY).distinct(), "keys")
        self._note(n + 1, keys, self.wide(keys.count()))
        self._done(n + 1, self.wide(keys.count()), 0, None)
        for old in self._names("rows"):
            if old != f"batch={n + 1}":
                self._drop(f"rows/{old}")

    def recovered(self) -> int:
        """The last append that ended, after mending one that didn't, or after a first look at rows that were there before."""
        n, stored = self.latest(), self.stored()
        broken = f"batch={n + 1}" in self._names("rows")
        if not broken and (n >= 0 or stored is None):
            return n
        if stored is None:
            self._drop(f"rows/batch={n + 1}")
            return n
        if n >= 0:
            noted = self.spark.read.schema("level int, chunk_key string").parquet(f"{self.folder}/rows/batch={n + 1}")
            stored = stored.join(noted, KEY, "left_semi")
        keys = cut(stored.select(*KEY).distinct(), "keys")
        prefixes, n_keys = self.size(n) if n >= 0 else (self.wide(keys.count()), 0)
        self._drop(f"rows/batch={n + 1}")
        self._note(n + 1, keys, prefixes)
        self._done(n + 1, prefixes, n_keys, self.filters(n) if n >= 0 else None)
        return n + 1

    def wide(self, n_keys: int) -> int:
        """The number of prefixes for so many keys."""
        prefixes = PREFIXES
        while n_keys > prefixes * FULL // 2:
            prefixes *= 4
        return prefixes

    def _note(self, n: int, rows: DataFrame, prefixes: int) -> None:
        hashed(rows, prefixes).repartition("prefix").write.mode("overwrite").partitionBy("prefix").parquet(f"{self.folder}/rows/batch={n}")

    def _done(self, n: int, prefixes: int, n_keys: int, before: DataFrame | None) -> int:
        """Write the filters of the batches up to n: those before and batch n's. How many keys they hold."""
        new = self.rows(n).where(F.col("batch") == n)
        n_keys += new.count()
        bits = new.withColumn("at", probes()).select("prefix", F.expr("at div 64").cast("int").alias("word"), F.expr("shiftleft(1L, at % 64)").alias("bits"))
        bits = bits if before is None else bits.unionByName(before.select("prefix", "word", "bits"))
        bits = bits.groupBy("prefix", "word").agg(F.bit_or("bits").alias("bits"))
        bits.select("*", F.lit(prefixes).alias("prefixes"), F.lit(n_keys).cast("long").alias("n_keys")).write.mode("overwrite").parquet(f"{self.folder}/filters/{n}")
        for old in self._names("filters"):
            if int(old) != n:
                self._drop(f"filters/{old}")
        return n_keys
