"""Summaries of groups of texts: keywords, the input and the default of a summariser, and the summariser's plug.

`by` names the group, `order` the columns that put a group's texts in order. Only the first texts of a group are ever
brought together; counts are aggregated (see `keywords`).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators.calls import Answers
from tessera.operators.keywords import keywords

# The texts of the summariser's prompt and of the summary made without one.
SEPARATOR = "\n\n---\n\n"
SUMMARY = ("Cluster Summary:\n- Total chunks: ", "\n- Key themes: ", "\n- Sample content: ", "...\n\nThis cluster contains content related to these key concepts.")
FIRST_TEXTS, MOST_CHARS, SAMPLE_CHARS, SHOWN = 15, 4000, 200, 8


def null_safe(left: DataFrame, right: DataFrame, by: str) -> DataFrame:
    """A left join in which the null group meets itself."""
    return left.join(right.withColumnRenamed(by, "__key"), F.col(by).eqNullSafe(F.col("__key")), "left").drop("__key")


def first_texts(rows: DataFrame, by: str, order: str, n: int, text: str = "text") -> DataFrame:
    """by, order, at, text of the first n texts of each group."""
    w = Window.partitionBy(by).orderBy(order)
    return rows.select(by, order, text).withColumn("at", F.row_number().over(w)).where(F.col("at") <= n)


def summary_input(rows: DataFrame, by: str, order: str, n: int = FIRST_TEXTS, most: int = MOST_CHARS, text: str = "text") -> DataFrame:
    """by, input: the first n texts, joined, cut after `most` characters."""
    head = first_texts(rows, by, order, n, text).withColumn(text, F.substring(text, 1, most + 1))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", text))), lambda x: x[text]), SEPARATOR)
    return head.groupBy(by).agg(joined.alias("input")).select(by, T.truncated(F.col("input"), most).alias("input"))


def fallback_summaries(rows: DataFrame, by: str, order: str, text: str = "text", counted: DataFrame | None = None) -> DataFrame:
    """by, chunks_count, summary: the summary made without a model. `counted` has the groups' keywords, if they are known."""
    words = (keywords(rows, by, order, SHOWN, text) if counted is None else counted).where(F.col("rank") <= SHOWN).groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda x: x["word"]), ", ").alias("themes"))
    sample = first_texts(rows, by, order, 1, text).select(F.col(by).alias("__by"), F.substring(text, 1, SAMPLE_CHARS).alias("sample"))
    out = null_safe(null_safe(rows.groupBy(by).agg(F.count("*").alias("chunks_count")), words, by), sample.withColumnRenamed("__by", by), by)
    summary = F.concat(F.lit(SUMMARY[0]), F.col("chunks_count").cast("string"), F.lit(SUMMARY[1]), F.coalesce("themes", F.lit("")), F.lit(SUMMARY[2]), F.col("sample"), F.lit(SUMMARY[3]))
    return out.select(by, "chunks_count", T.strip(summary).alias("summary"))


def summaries(rows: DataFrame, by: str, order: str, model: Callable[[str], str] | Answers | None = None, text: str = "text", counted: DataFrame | None = None) -> DataFrame:
    """by, chunks_count, summary. `model` maps an input to a summary; if it fails or says nothing, the default stands in.

    With Answers, equal inputs are asked once, several at a time, and never again once they are answered.
    """
    default = fallback_summaries(rows, by, order, text, counted)
    if model is None:
        return default
    both = null_safe(default, summary_input(rows, by, order, text=text), by)
    if isinstance(model, Answers):
        return model.ask(both, "input").select(by, "chunks_count", F.coalesce(F.nullif(T.strip(F.col("answer")), F.lit("")), "summary").alias("summary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for given, otherwise in zip(b.column("input").to_pylist(), b.column("summary").to_pylist(), strict=True):
                try:
                    said = (model(given) or "").strip()
                except Exception:
                    said = ""
                out.append(said or otherwise)
            yield pa.RecordBatch.from_arrays([b.column(by), b.column("chunks_count"), pa.array(out, pa.string())], [by, "chunks_count", "summary"])

    return both.mapInArrow(run, f"`{by}` {rows.schema[by].dataType.simpleString()}, chunks_count long, summary string")
