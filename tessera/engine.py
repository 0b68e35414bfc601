"""The engine over one store: add files, build the hierarchy, ask, look around, export.

    engine = Engine(spark, folder)
    engine.ingest(["a.txt", "b.tex"])
    engine.build()
    engine.ask(["What is it about?"]).show()
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import chunking, hierarchy, reports, retrieval
from tessera.operators.calls import Answers
from tessera.operators.embedding import Embedder, embedded, hashed_words
from tessera.operators.generation import Model, extractive
from tessera.operators.index import Index
from tessera.operators.models import Kept
from tessera.sources import readers
from tessera.sources.store import SHORT, Store, default_name, export_csv, stored_chunks

CHUNKERS = {"paragraphs": chunking.paragraphs, "sliding": chunking.sliding}


def chunked(documents: DataFrame, how: str = "paragraphs", once: bool = True, digits: int = SHORT) -> DataFrame:
    """Documents (source, text) that have any text, as chunks ready to be stored."""
    texts = documents.where(F.col("text").isNotNull() & ~T.is_blank(F.col("text")))
    return stored_chunks(CHUNKERS[how](texts, keep=("source",)), once=once, digits=digits)


class Engine:
    """A store, an embedder, a generator and one conversation. With `keep`, answers to equal prompts are kept in the store, by model_name.

    With `approximate`, questions go through a kept index of the chunks (cosine only): the collection's ef_search is the
    number of candidates compared by their vectors. max_neighbors belongs to graph indexes and is only kept.
    """

    def __init__(self, spark: SparkSession, folder: str, embedder: Embedder = hashed_words, model: Model = extractive, k: int = 5, with_summaries: bool = True, model_name: str = "extractive", keep: bool = False, approximate: bool = False):
        self.spark, self.store = spark, Store(spark, folder, embedder)
        self.embedder, self.k, self.with_summaries, self.model_name = embedder, k, with_summaries, model_name
        self.model = self.kept(model, "answers") if keep else model
        self.conversation: list[dict] = []
        self.session = datetime.now().strftime("%Y-%m-%d %H:%M:%S")
        self.settings = self.store.collection("chunks")
        self.index = Index(spark, self.store.path("index"), "chunk_key") if approximate else None
        if approximate and self.settings["space"] != "cosine":
            raise ValueError(self.settings["space"])

    def kept(self, model: Model, name: str) -> Answers:
        """The model with its answers kept in a table of the store."""
        return Answers(self.spark, self.store.path(name), model, self.model_name)

    # ---- building

    def ingest(self, paths: list[str], pages_of: Callable | None = None, how: str = "paragraphs") -> int:
        """Read files, clean and chunk them, embed and store what is new; how many chunks that is."""
        before = self.n_chunks(0)
        self.store.append_chunks(chunked(readers.read_documents(self.spark, paths, pages_of), how, once=False, digits=self.store.digits()))
        self.reindex()
        return self.n_chunks(0) - before

    def reindex(self) -> None:
        """Bring the index, if there is to be one, up to the stored chunks."""
        if self.index is not None and self.n_chunks(0):
            self.index.update(self.store.chunks(0))

    def build(self, most_levels: int = 3, least_gain: float = 0.05, run: str | None = None, **options) -> DataFrame:
        """Run the level loop over the stored chunks; its history. The newest run is what questions see.

        `run` names a run that was broken off, which then goes on.
        """
        run = run or f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"  # names sort by time
        rows = self.store.chunks(0).select("chunk_key", "text", "source", "embedding")
        history = hierarchy.run(self.spark, rows, self.store.path("runs"), most_levels, least_gain, self.embedder, run_id=run, **options)
        self.store.write("history", history.select(F.lit(run).alias("run"), "*"), "append")
        return history

    def newest(self) -> str | None:
        return self.store.read("history").agg(F.max("run")).first()[0] if self.store.exists("history") else None

    def assign(self, chunks: DataFrame, level: int = 0) -> DataFrame:
        """chunk_key, cluster_id, confidence, ... of chunks (chunk_key, embedding) by the model that the newest run kept of a level."""
        return Kept.load(self.spark, self.store.path(f"runs/{self.newest()}/models/level={level}")).assign(chunks, key="chunk_key")

    def keywords(self, level: int = 0, k: int = 10, counted: bool = False) -> DataFrame:
        """cluster_id, rank, word, n: the most frequent words under each cluster of a level of the newest run."""
        return hierarchy.level_keywords(self.spark, self.store.path(f"runs/{self.newest()}"), level, k, counted)

    # ---- asking

    def chunks(self) -> DataFrame:
        """Level 0 with the clusters of the newest run."""
        rows, run = self.store.chunks(0), self.newest()
        if run is None:
            return rows
        return rows.join(self.store.read(f"runs/{run}/assignments").where("level = 0").select("chunk_key", "cluster_id"), "chunk_key", "left")

    def summaries(self) -> DataFrame | None:
        run = self.newest()
        if run is None:
            return None
        return self.store.read(f"runs/{run}/summaries").withColumn("run", F.lit(run)).withColumn("created_at", F.col("created_at").cast("string"))

    def questions(self, questions: list[str]) -> DataFrame:
        return self.spark.createDataFrame(list(enumerate(questions)), "query_id long, question string")

    def ask(self, questions: list[str] | DataFrame) -> DataFrame:
        """A record a question (query_id, question), all in one pass and without history."""
        rows = self.questions(questions) if isinstance(questions, list) else questions
        return retrieval.ask(rows, self.chunks(), self.summaries() if self.with_summaries else None, self.k, self.embedder, self.model, self.settings["space"], index=self.index, ef=self.settings["ef_search"])

    def chat(self, question: str) -> dict:
        """Answer in the light of the conversation so far, and add to it."""
        began, rows = time.time(), self.questions([question])
        hits = retrieval.found(rows, self.chunks(), self.k, self.embedder, self.settings["space"], index=self.index, ef=self.settings["ef_search"])
        context = retrieval.contexts(rows, hits, self.summaries() if self.with_summaries else None)
        past = self.spark.createDataFrame([([(x["question"], x["answer"]) for x in self.conversation[-retrieval.TURNS :]],)], "history array<struct<question:string,answer:string>>")
        record = retrieval.answers(context.join(F.broadcast(past)), self.model, history=True).first().asDict()  # one row each
        record |= {"response_time": time.time() - began}
        if not (record["answer"] or "").startswith("Error: "):
            self.conversation.append({"question": question, "answer": record["answer"] or "", "timestamp": datetime.now().isoformat(), "sources": record["sources"]})
            record["conversation_turns"] = len(self.conversation)
        return record

    def by_level(self, question: str, level: int | None = None, k: int = 5) -> DataFrame:
        """The summaries nearest to a question, of one level or all."""
        made = self.summaries().select(F.col("summary_id").alias("chunk_key"), "level", F.col("summary").alias("text"), F.concat_ws(", ", "sources").alias("source"), "cluster_id")
        made = made if level is None else made.where(F.col("level") == level)
        return retrieval.found(self.questions([question]), embedded(made, self.embedder), k, self.embedder)

    # ---- looking around

    def n_chunks(self, level: int | None = None) -> int:
        return self.store.chunks(level).count() if self.store.exists("chunks") else 0

    def stats(self) -> dict:
        made = self.summaries()
        return {"chunks": self.n_chunks(), "summaries": made.count() if made is not None else 0, "session_queries": len(self.conversation)}

    def sources(self) -> DataFrame:
        return reports.source_counts(self.store.chunks(0)).orderBy("source")

    def clusters(self) -> DataFrame | None:
        made = self.summaries()
        return reports.summary_tree(made) if made is not None else None

    # ---- exports

    def export_conversation(self, path: str | None = None) -> str | None:
        """Session, model, total_queries and the conversation as one JSON file; None if nothing was asked."""
        if not self.conversation:
            return None
        path = path or default_name("conversation")
        with open(path, "w", encoding="utf-8") as f:
            json.dump({"session": self.session, "model": self.model_name, "total_queries": len(self.conversation), "conversation": self.conversation}, f, indent=2, ensure_ascii=False)
        return path

    def export_batch(self, questions: list[str], path: str | None = None) -> str:
        """The records of a list of questions as one JSON file (a user's list, so it fits in the driver)."""
        path = path or default_name("batch_results")
        records = [r.asDict() for r in self.ask(questions).orderBy("query_id").collect()]
        with open(path, "w", encoding="utf-8") as f:
            json.dump(records, f, indent=2, ensure_ascii=False)
        return path

    def export_tables(self, folder: str) -> None:
        """The summary tree and the history as CSV, nested columns as JSON."""
        export_csv(self.clusters(), f"{folder}/hierarchical_summaries")
        export_csv(self.store.read("history"), f"{folder}/clustering_history")
