"""A training corpus from raw documents in five stages; each one's rows are written as Parquet and read again by the next.

Each stage takes (spark, docs, sf_dir) and returns documents with all their columns; the last one adds `copy` (with underscores
where that name is taken), which numbers the copies that the mix takes of a document.

Cases: null or empty texts fail the rules and go in the first stage; a null doc_id is a document without a number, judged by
its text; a null source is a source of its own in the mix; very long texts are read whole by every stage; rows that repeat a
doc_id are judged by their own text and mixed each by itself, but are one document for near duplicates; exact ties stand as the operators
define them; a document whose lines all go stays with an empty text; an empty table, and one whose documents all go, give an empty
result with the same columns; further columns pass all stages, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common, decontamination, line_dedup, minhash, mixing, quality_rules


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    return quality_rules.filter_documents(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten or more of them hold; n_chars follows the text."""
    out = line_dedup.line_dedup(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the smallest doc_id."""
    return minhash.keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item."""
    return decontamination.decontaminate(docs, common.table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them."""
    return mixing.mix(docs, scanned=True)


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("minhash", near_duplicates),
    ("decontamination", benchmark),
    ("mixing", mixture),
]

#: SQL expresses neither the fitted rules nor signatures nor seeds; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what lies between them is in the shared folder, one stage at a time."""
    work, docs = common.Work(spark, "pipeline"), common.table(spark, sf_dir, "documents")
    names = [f"{i}-{name}" for i, (name, _) in enumerate(STAGES)]
    for i, (_, stage) in enumerate(STAGES):
        docs = work.keep(names[i], stage(spark, docs, sf_dir))
        work.drop(*names[max(0, i - 1) : i])
    return docs
