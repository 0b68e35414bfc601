"""The store: Parquet tables of chunks (partitioned by level), assignments and summaries, and files for export.

A failed write fails its job. Chunk keys are made from document, position and text, so adding a document again
changes nothing.
"""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators.arrow import cut
from tessera.operators.embedding import Embedder, embedded
from tessera.sources.keys import KEY, Keys


#: Hexadecimal digits of a key's hash. SHORT ones of different texts meet by chance once a document's name has some 100,000 texts.
SHORT, LONG = 8, 32


def chunk_key(source: Column, chunk_id: Column, text: Column, digits: int = SHORT) -> Column:
    return F.concat_ws("_", source, chunk_id, F.substring(F.md5(F.concat_ws("|", source, chunk_id, text)), 1, digits))


def stored_chunks(chunks: DataFrame, document: str = "source", once: bool = True, digits: int = SHORT) -> DataFrame:
    """Chunks as they are stored (`document` is the column that names theirs): key, preview and time beside what they have.

    Each stands once, told by document, chunk_id and text, since different texts may share a short key. An append sees to that
    by itself, but by the key alone: what is only appended needn't be shuffled for it (`once`), and wants LONG `digits`.
    """
    out = chunks.withColumn("chunk_key", chunk_key(F.col(document).cast("string"), F.col("chunk_id").cast("string"), F.col("text"), digits))
    out = out.withColumn("chunk_preview", T.preview(F.col("text"))).withColumn("added_timestamp", F.current_timestamp())
    return out.dropDuplicates(["chunk_key", document, "chunk_id", "text"]) if once else out


# What a collection is searched by, unless it was created otherwise. An exact search needs no ef_search.
COLLECTIONS = {"chunks": {"space": "cosine", "ef_search": 200, "max_neighbors": 32}, "summaries": {"space": "cosine", "ef_search": 100, "max_neighbors": 16}}
SETTINGS = "name string, space string, ef_search int, max_neighbors int"


class Store:
    """Tables under one folder. With an embedder, chunks get their vectors as they are added."""

    def __init__(self, spark: SparkSession, folder: str, embedder: Embedder | None = None):
        self.spark, self.folder, self.embedder = spark, folder, embedder

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def exists(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def collection(self, name: str, **settings) -> dict:
        """The settings of a collection, which is created with those given (and the defaults) unless it is there."""
        if self.exists("collections"):
            known = self.read("collections").where(F.col("name") == name).first()
            if known:
                return known.asDict()
        made = {"space": "cosine", "ef_search": 100, "max_neighbors": 16} | COLLECTIONS.get(name, {}) | settings
        if made["space"] not in ("cosine", "l2"):
            raise ValueError(made["space"])
        self.write("collections", self.spark.createDataFrame([(name, made["space"], made["ef_search"], made["max_neighbors"])], SETTINGS), "append")
        return {"name": name} | made

    def keys(self) -> Keys:
        """The keys of the stored chunks, filters before them."""
        read = lambda: self.spark.read.schema("chunk_key string, level int").parquet(self.path("chunks")).select("level", "chunk_key")
        return Keys(self.spark, self.path("keys"), lambda: read() if self.exists("chunks") else None)

    def digits(self) -> int:
        """Digits of the keys' hashes: LONG, but SHORT in a store that was begun with such, so that a chunk keeps its key."""
        first = self.chunks().select("chunk_key").first() if self.exists("chunks") else None
        return LONG if first is None or re.search(rf"_[0-9a-f]{{{LONG}}}\Z", first[0]) else SHORT

    def append_chunks(self, chunks: DataFrame) -> None:
        """Add chunks whose keys their level doesn't have yet, so a batch that runs twice adds nothing.

        Of the keys that are stored only those are read that filters can't rule out (see Keys); one writer at a time. Chunks
        without a level are of level 0; one without a key is an error. What is compared and noted are keys alone: texts are
        moved once, and only if there is anything new among them; not at all if each is new and stands once.
        """
        rows = chunks if "level" in chunks.columns else chunks.withColumn("level", F.lit(0))
        rows = rows.withColumn("level", F.coalesce("level", F.lit(0))).withColumn("chunk_key", F.coalesce("chunk_key", F.raise_error(F.lit("a chunk without a key"))))
        keys = self.keys()
        given = cut(rows.groupBy(*KEY).agg(F.count("*").alias("n")), "append")
        new = keys.unknown(given)
        if new is not given:
            new = cut(new, "new")
        n_given, n_rows = given.agg(F.count("*"), F.sum("n")).first()
        n_new = new.count()
        if not n_new:
            return
        wanted = rows if n_new == n_given else rows.join(new.select(*KEY), KEY, "left_semi")
        if n_new < n_given or n_rows > n_given:
            wanted = wanted.dropDuplicates(KEY)
        if self.embedder and "embedding" not in wanted.columns:
            wanted = embedded(wanted, self.embedder)
        keys.added(new, lambda: wanted.write.mode("append").partitionBy("level").parquet(self.path("chunks")))

    def chunks(self, level: int | None = None) -> DataFrame:
        """All chunks, or a level's: its partition alone is read."""
        rows = self.spark.read.parquet(self.path("chunks"))
        return rows if level is None else rows.where(F.col("level") == level)

    def write(self, name: str, rows: DataFrame, mode: str = "overwrite") -> None:
        rows.write.mode(mode).parquet(self.path(name))

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def label_chunks(self, assigned: DataFrame, run: str = "labels") -> DataFrame:
        """Write a run's labels (chunk_key, cluster_id, confidence) and return the chunks with them.

        Labels are a narrow table of their own, so texts and vectors aren't written again; labelling a run again replaces its labels only.
        """
        assigned.select("chunk_key", "cluster_id", "confidence").write.mode("overwrite").parquet(self.path(f"labels/run={run}"))
        return self.labelled(run)

    def labelled(self, run: str = "labels", level: int | None = None) -> DataFrame:
        """Chunks (of a level) with the labels of a run; null where it has none."""
        return with_labels(self.chunks(level), self.read(f"labels/run={run}"))


def with_labels(chunks: DataFrame, assigned: DataFrame, key: str = "chunk_key") -> DataFrame:
    """chunks with their cluster_id and cluster_confidence; null where there is none."""
    labels = assigned.select(key, "cluster_id", F.col("confidence").alias("cluster_confidence"))
    return chunks.join(labels, key, "left")


def export_csv(rows: DataFrame, path: str) -> None:
    """CSV with a header; nested columns as JSON. Quotes, line breaks and white space at the ends survive a read with multiLine."""
    flat = [F.to_json(c).alias(c) if kind.startswith(("array", "struct", "map")) else F.col(c) for c, kind in rows.dtypes]
    rows.select(*flat).write.mode("overwrite").option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def import_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').schema(schema).csv(path)


def export_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def session_export(records: DataFrame, session: str = "session", model: str = "none") -> DataFrame:
    """A row a session (the column of records that names it): session, model, total_queries and the conversation in order.

    A session is bounded by its user's patience; sessions are as many rows.
    """
    turns = F.array_sort(F.collect_list(F.struct("query_id", "question", "answer", "sources")))
    out = records.groupBy(F.col(session).cast("string").alias("session")).agg(F.count("*").alias("total_queries"), turns.alias("conversation"))
    return out.select("session", F.lit(model).alias("model"), "total_queries", "conversation")


def default_name(kind: str, now: datetime | None = None) -> str:
    """The name of an export that wasn't given one: its kind and the time."""
    return f"{kind}_{(now or datetime.now()).strftime('%Y%m%d_%H%M%S')}.json"
