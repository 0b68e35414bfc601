"""From hits to an answer: context, summaries of the hits' clusters, sources, history, prompt, generation, record.

A question's context is a handful of rows, so the arrays built here are bounded by k.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators.calls import Answers, count_tokens, tried
from tessera.operators.embedding import Embedder, embedded, hashed_words
from tessera.operators.generation import extractive
from tessera.operators.index import Index
from tessera.operators.search import top_k

# The texts of the prompt, in its order.
SYSTEM = (
    "You are a knowledgeable assistant. Answer the question based ONLY on the provided context.\n\nINSTRUCTIONS:\n"
    "- Answer based only on the information in the context\n"
    '- If the context doesn\'t contain the answer, say "I don\'t have enough information to answer that"\n'
    "- Be concise but thorough\n- When quoting sources, mention the document name\n- Use a helpful, friendly tone\n"
)
SOURCES, TOPICS, CONTENT, HISTORY, QUESTION, ANSWER = "\n📚 SOURCES: ", "\n📊 HIGH-LEVEL TOPIC SUMMARIES:", "\n📄 RELEVANT CONTENT:", "\n💬 CONVERSATION HISTORY:", "\n❓ QUESTION: ", "\n✅ ANSWER:"
NOTHING = "No relevant chunks found"
SUMMARY_CHARS, ANSWER_CHARS, TURNS = 500, 200, 3


def cluster_summaries(hits: DataFrame, summaries: DataFrame, level: int | None = None, mode: str = "assigned") -> DataFrame:
    """query_id, cluster_id, level, chunks_count, summary: for each cluster among the hits its newest run's lowest summary.

    mode "assigned": the clusters that the hits were assigned to; "strict": only those of hits that are summaries themselves
    (column is_summary).
    """
    if mode not in ("assigned", "strict"):
        raise ValueError(mode)
    hits = hits.where("is_summary") if mode == "strict" else hits
    clusters = hits.where("cluster_id IS NOT NULL").select("query_id", "cluster_id").distinct()
    best = Window.partitionBy("cluster_id").orderBy(F.desc("run"), "level", "summary_id")
    one = (summaries if level is None else summaries.where(F.col("level") == level)).withColumn("__i", F.row_number().over(best)).where("__i = 1")
    return clusters.join(one.select("cluster_id", "level", "chunks_count", F.substring("summary", 1, SUMMARY_CHARS).alias("summary")), "cluster_id").select("query_id", "cluster_id", "level", "chunks_count", "summary")


def exchanges(turns: DataFrame) -> DataFrame:
    """conv_id, turn, question, answer: each user turn that an assistant answers next."""
    along = Window.partitionBy("conv_id").orderBy("turn")
    nxt = turns.withColumn("next_role", F.lead("role").over(along)).withColumn("answer", F.lead("text").over(along))
    return nxt.where("role = 'user' AND next_role = 'assistant'").select("conv_id", "turn", F.col("text").alias("question"), "answer")


def last_exchanges(turns: DataFrame, n: int = TURNS) -> DataFrame:
    """The last n exchanges of each conversation, with `back` counting from 1 for the latest."""
    latest = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return exchanges(turns).withColumn("back", F.row_number().over(latest)).where(F.col("back") <= n)


def contexts(questions: DataFrame, hits: DataFrame, summaries: DataFrame | None = None, mode: str = "assigned") -> DataFrame:
    """A row a question: success, message, n_chunks, sources, and arrays of chunks and topics in order.

    hits: query_id, rank, score, text, source, cluster_id (and is_summary, for mode "strict"; see cluster_summaries). A question
    without hits is kept, with success false.
    """
    chunk = F.struct("rank", "score", F.coalesce("source", F.lit("Unknown")).alias("source"), "text")
    got = hits.groupBy("query_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(chunk)).alias("chunks"), F.array_sort(F.collect_set("source")).alias("sources"))
    out = questions.join(got, "query_id", "left")
    if summaries is not None:
        topics = cluster_summaries(hits, summaries, mode=mode).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("cluster_id", "level", "chunks_count", "summary"))).alias("topics"))
        out = out.join(topics, "query_id", "left")
    else:
        out = out.withColumn("topics", F.lit(None).cast("array<struct<cluster_id:int,level:int,chunks_count:bigint,summary:string>>"))
    n = F.coalesce("n", F.lit(0))
    return out.select("query_id", "question", (n > 0).alias("success"), F.when(n == 0, F.lit(NOTHING)).alias("message"), n.alias("n_chunks"), F.coalesce("sources", F.array().cast("array<string>")).alias("sources"), "chunks", "topics")


def prompt(history: bool = False) -> Column:
    """The prompt of a context row; with `history`, of its column history (array of question, answer; latest last)."""
    some = lambda c: F.size(F.coalesce(F.col(c), F.array())) > 0
    source = F.when(some("sources"), F.concat(F.lit(SOURCES), F.array_join("sources", ", ")))
    topic = lambda t: F.concat(F.lit("\nTopic "), t["cluster_id"].cast("string"), F.lit(" (Level "), t["level"].cast("string"), F.lit(", "), t["chunks_count"].cast("string"), F.lit(" chunks):\n"), t["summary"])
    topics = F.when(some("topics"), F.concat(F.lit(TOPICS + "\n"), F.array_join(F.transform("topics", topic), "\n")))
    chunk = lambda c: F.concat(F.lit("\n["), c["rank"].cast("string"), F.lit("] (Source: "), c["source"], F.lit(", Relevance: "), T.percent(c["score"]), F.lit(")\n"), c["text"])
    content = F.when(some("chunks"), F.concat(F.lit(CONTENT + "\n"), F.array_join(F.transform("chunks", chunk), "\n"))).otherwise(F.lit(CONTENT))
    turn = lambda h: F.concat(F.lit("Q: "), h["question"], F.lit("\nA: "), T.truncated(h["answer"], ANSWER_CHARS, always=True))
    past = [F.when(some("history"), F.concat(F.lit(HISTORY + "\n"), F.array_join(F.transform("history", turn), "\n")))] if history else []
    return F.concat_ws("\n", F.lit(SYSTEM), source, topics, content, *past, F.concat(F.lit(QUESTION), F.col("question")), F.lit(ANSWER))


RECORD = "query_id long, question string, answer string, sources array<string>, context_chunks long, relevance_scores array<double>, tokens_generated long, response_time double"


def answers(context_rows: DataFrame, model: Callable[[str], str] | Answers = extractive, history: bool = False, failures: bool = False) -> DataFrame:
    """A record a question: answer, sources, context_chunks, relevance_scores, tokens_generated, response_time.

    A question without context, or a failing model, gives an answer that begins with "Error: " and null details; with
    `failures` a column of that name says which: no_context, timeout or error. Answers ask equal prompts once and keep
    what is said.
    """
    rows = context_rows.withColumn("prompt", prompt(history)).withColumn("scores", F.transform("chunks", lambda c: c["score"])).select("query_id", "question", "success", "message", "prompt", "sources", "n_chunks", "scores")
    if isinstance(model, Answers):
        return kept_answers(rows, model, failures)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                began = time.time()
                if r["success"]:
                    said, kind, message = tried(model, r["prompt"], 1, 0)
                else:
                    said, kind, message = None, "no_context", r["message"]
                details = (r["sources"], r["n_chunks"], r["scores"], count_tokens(said)) if kind is None else ([], 0, None, None)
                out.append((r["query_id"], r["question"], said if kind is None else f"Error: {message}", *details, time.time() - began, kind))
            kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.string()), pa.int64(), pa.list_(pa.float64()), pa.int64(), pa.float64(), pa.string()]
            names = ["query_id", "question", "answer", "sources", "context_chunks", "relevance_scores", "tokens_generated", "response_time", "failures"]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    records = rows.mapInArrow(run, RECORD + ", failures string")
    return records if failures else records.drop("failures")


def kept_answers(rows: DataFrame, model: Answers, failures: bool) -> DataFrame:
    """The records of `answers` by a model whose answers are kept."""
    got = model.ask(rows.withColumn("prompt", F.when(F.col("success"), F.col("prompt"))).withColumnRenamed("message", "missing"))
    kind = F.when(~F.col("success"), F.lit("no_context")).otherwise(F.col("failure"))
    ok = lambda c, other: F.when(kind.isNull(), F.col(c)).otherwise(other)
    out = got.select(
        "query_id", "question", ok("answer", F.concat(F.lit("Error: "), F.coalesce("message", "missing", F.lit("")))).alias("answer"), ok("sources", F.array().cast("array<string>")).alias("sources"),
        ok("n_chunks", F.lit(0)).cast("long").alias("context_chunks"), ok("scores", F.lit(None)).alias("relevance_scores"), F.col("tokens").alias("tokens_generated"), F.coalesce("response_time", F.lit(0.0)).alias("response_time"), kind.alias("failures"),
    )
    return out if failures else out.drop("failures")


def displayed(hits: DataFrame, n: int = 3) -> DataFrame:
    """The first n hits of each question as shown: rank, percent, the source's first 40 characters."""
    return hits.where(F.col("rank") <= n).select("query_id", "rank", T.percent(F.col("score")).alias("relevance"), F.substring(F.coalesce("source", F.lit("Unknown")), 1, 40).alias("source"))


def found(questions: DataFrame, chunks: DataFrame, k: int = 5, embedder: Embedder = hashed_words, metric: str = "cosine", key: str = "chunk_key", index: Index | None = None, ef: int = 50) -> DataFrame:
    """query_id, rank, score, text, source, cluster_id of the k chunks nearest to each question (query_id, question).

    With an index (cosine only), the cells nearest to a question are searched and its `ef` best candidates compared by their vectors; a
    question for which they hold fewer than k is searched exactly.
    The questions are embedded here; chunks carry key, text, source, embedding and, where they are clustered, cluster_id.
    Only the rows found are joined with their texts.
    """
    asked = embedded(questions.where("question IS NOT NULL").select("query_id", F.col("question").alias("text")), embedder)
    if index is not None and metric != "cosine":
        raise ValueError(metric)
    asked = asked.select("query_id", "embedding")
    near = top_k(chunks, asked, k, metric, key) if index is None else index.search_all(chunks, asked, k, ef)
    cluster = F.col("cluster_id") if "cluster_id" in chunks.columns else F.lit(None).cast("int").alias("cluster_id")
    return near.join(chunks.select(key, "text", "source", cluster), key).select("query_id", "rank", "score", "text", "source", "cluster_id")


def ask(questions: DataFrame, chunks: DataFrame, summaries: DataFrame | None = None, k: int = 5, embedder: Embedder = hashed_words, model: Callable[[str], str] | Answers = extractive, metric: str = "cosine", key: str = "chunk_key", index: Index | None = None, ef: int = 50) -> DataFrame:
    """From questions to records (see answers): embed, search (see found), attach summaries, build the prompt, generate."""
    hits = found(questions, chunks, k, embedder, metric, key, index, ef)
    return answers(contexts(questions, hits, summaries), model)
