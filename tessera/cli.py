"""The command line: python -m tessera --db-path FOLDER [--ingest FILE ...] [--build] [--query Q | --batch FILE]

Without --query or --batch it reads questions and commands from standard input.
"""

from __future__ import annotations

import argparse
import os
import sys
from collections.abc import Callable, Iterable

from pyspark.sql import SparkSession

from tessera.engine import Engine
from tessera.operators.generation import available, named

COMMANDS = {"/clear": "Clear the conversation's history", "/stats": "Show what the store holds", "/sources": "Show all documents", "/clusters": "Show the clusters' summaries", "/help": "Show this help", "/quit": "Leave"}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tessera", description="Questions to a hierarchical store of documents")
    p.add_argument("--db-path", default="./tessera_store", help="the store's folder")
    p.add_argument("--model", default="extractive", help="extractive, http://host:port#name, or module:function")
    p.add_argument("--chunks", type=int, default=5, help="chunks to retrieve")
    p.add_argument("--no-summaries", action="store_true", help="leave the clusters' summaries out")
    p.add_argument("--temperature", type=float, default=0.3, help="the model's temperature")
    p.add_argument("--keep-answers", action="store_true", help="ask the model no prompt twice: keep its answers in the store")
    p.add_argument("--approximate", action="store_true", help="search a kept index instead of all chunks")
    p.add_argument("--quiet", action="store_true", help="say less")
    p.add_argument("--query", help="one question")
    p.add_argument("--batch", help="a file of questions, one a line")
    p.add_argument("--export", help="a file for the conversation, or the batch's results")
    p.add_argument("--ingest", nargs="+", default=[], metavar="FILE", help="files to add first")
    p.add_argument("--build", action="store_true", help="cluster and summarise first")
    return p


def shown(engine: Engine, record: dict, say: Callable[[str], None], quiet: bool) -> None:
    say(record["answer"] or "")
    if record["sources"]:
        say(f"Sources: {', '.join(record['sources'])}")
    if not quiet and record["relevance_scores"]:
        say(f"Retrieved {record['context_chunks']} chunks: {', '.join(f'{s:.2%}' for s in record['relevance_scores'][:3])} ({record['response_time']:.2f}s, {record['tokens_generated']} tokens)")


def command(engine: Engine, line: str, say: Callable[[str], None]) -> bool:
    """Run one of COMMANDS; False to leave."""
    name = line.lower()
    if name == "/quit":
        say("Goodbye!")
        return False
    if name == "/clear":
        engine.conversation.clear()
        say("Conversation history cleared")
    elif name == "/stats":
        s = engine.stats()
        say(f"Chunks: {s['chunks']}, summaries: {s['summaries']}, session queries: {s['session_queries']}")
    elif name == "/sources":
        for r in engine.sources().toLocalIterator():
            say(f"{r['source']}: {r['n']} chunks")
    elif name == "/clusters":
        tree = engine.clusters()
        for r in tree.toLocalIterator() if tree is not None else ():
            say(f"Level {r['level']}, cluster {r['cluster_id']}: {r['chunks_count']} chunks, silhouette {r['silhouette_score']:.3f}, {r['summary_preview'][:100]}...")
    elif name == "/help":
        for c, what in COMMANDS.items():
            say(f"{c:10} {what}")
    return True


def interact(engine: Engine, lines: Iterable[str], say: Callable[[str], None], quiet: bool = False) -> None:
    """Commands and questions, one a line. An error is said and the next line read; anything that is no command is a question."""
    for line in lines:
        line = line.strip()
        if not line:
            continue
        try:
            if line.lower() in COMMANDS:
                if not command(engine, line, say):
                    return
            else:
                shown(engine, engine.chat(line), say, quiet)
        except KeyboardInterrupt:
            say("Goodbye!")
            return
        except Exception as e:
            say(f"Error: {e}")


def main(args: list[str] | None = None, spark: SparkSession | None = None, lines: Iterable[str] | None = None, say: Callable[[str], None] = print) -> int:
    a = parser().parse_args(args)
    if not a.ingest and not os.path.exists(a.db_path):
        say(f"No store at {a.db_path}. Add documents first: --ingest FILE ...")
        return 1
    if a.batch and not os.path.exists(a.batch):
        say(f"Batch file not found: {a.batch}")
        return 1
    model = named(a.model, a.temperature)
    there, why = available(model)
    if not there or not a.quiet:
        say(why)
    spark = spark or SparkSession.builder.appName("tessera").getOrCreate()
    engine = Engine(spark, a.db_path, model=model, k=a.chunks, with_summaries=not a.no_summaries, model_name=f"{a.model} at {a.temperature}" if a.keep_answers else a.model, keep=a.keep_answers, approximate=a.approximate)
    if a.ingest:
        say(f"Added {engine.ingest(a.ingest)} chunks")
    elif engine.n_chunks():
        engine.reindex()  # of a store that had none
    if not engine.n_chunks():
        say("The store is empty. Add documents first: --ingest FILE ...")
        return 0
    if a.build:
        for r in engine.build().collect():
            say(f"Level {r['level']}: {r['n_clusters']} clusters, silhouette {r['silhouette']:.3f}, items {r['n_items']}")
    if a.query:
        shown(engine, engine.chat(a.query), say, a.quiet)
    elif a.batch:
        with open(a.batch, encoding="utf-8") as f:
            questions = [line.strip() for line in f if line.strip()]
        say(f"Results saved to {engine.export_batch(questions, a.export)}")
    elif lines is not None or not (a.ingest or a.build):
        interact(engine, sys.stdin if lines is None else lines, say, a.quiet)
        if a.export:
            said = engine.export_conversation(a.export)
            say(f"Conversation exported to {said}" if said else "No conversation to export")
    return 0
