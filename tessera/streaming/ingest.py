"""Ingest of arriving documents: the batch chunkers over a stream, written to the store batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.chunking import sliding
from tessera.sources.store import Store, stored_chunks

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def chunk_stream(spark: SparkSession, folder: str, schema: str = SCHEMA, files_a_batch: int = 100) -> DataFrame:
    """Chunks of the documents in Parquet files as they arrive; stateless, so nothing grows with the stream."""
    docs = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(folder)
    return sliding(docs, keep=("doc_id", "source"))


def ingest(spark: SparkSession, folder: str, store: Store, checkpoint: str) -> StreamingQuery:
    """Append chunks of all files that are there, then stop. A batch that runs twice is made good by the chunks' keys."""
    write = lambda batch, _: store.append_chunks(stored_chunks(batch, "doc_id", once=False))
    return chunk_stream(spark, folder).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
