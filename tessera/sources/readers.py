"""Readers of documents by extension, of question files, of chunk tables, and of a store's layout."""

from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.sources import pdf

# Functions of these modules travel by value, so executors need no copy of this repository.
cloudpickle.register_pickle_by_value(sys.modules["tessera.sources"])

TEXT, LATEX, PDF = (".txt", ".md"), (".sty", ".tex"), (".pdf",)


def kind(path: Column) -> Column:
    """text, latex or pdf by the lower-cased extension; other extensions raise."""
    ext = T.extension(path)
    return F.when(ext.isin(*TEXT), "text").when(ext.isin(*LATEX), "latex").when(ext.isin(*PDF), "pdf").otherwise(F.raise_error(F.concat(F.lit("Unsupported file type: "), ext)).cast("string"))


def read_texts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path, text: whole UTF-8 files. A missing path raises, as Spark does."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def read_decoded(spark: SparkSession, path: str) -> DataFrame:
    """path, text: whole files as UTF-8, as Latin-1 where they aren't valid UTF-8."""
    files = spark.read.format("binaryFile").load(path)
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    return files.select("path", F.when(valid, F.decode("content", "UTF-8")).otherwise(F.decode("content", "ISO-8859-1")).alias("text"))


def read_latex(spark: SparkSession, path: str | list[str], plain: bool = False) -> DataFrame:
    clean = T.clean_latex_plain if plain else T.clean_latex
    return read_texts(spark, path).withColumn("text", clean(F.col("text")))


def read_pdf(spark: SparkSession, path: str | list[str], pages_of: Callable[[bytes], list[str | None]] | None = None) -> DataFrame:
    """path, text: the pages' texts one after another, without what is empty.

    `pages_of` extracts them on the executors, from a file's bytes; without one, `pdf.pages_of` reads simple files.
    """
    pages_of = pages_of or pdf.pages_of

    def run(batches):
        import pyarrow as pa

        for b in batches:
            texts = ["".join(p for p in pages_of(bytes(c)) if p) for c in b.column("content").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(texts, pa.string())], ["path", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, text string")


def read_documents(spark: SparkSession, paths: list[str], pages_of: Callable[[bytes], list[str | None]] | None = None) -> DataFrame:
    """source, kind, text of files of several kinds, one scan a kind. Unknown extensions raise before anything is read."""
    unknown = [p for p in paths if not p.lower().endswith(TEXT + LATEX + PDF)]
    if unknown or not paths:
        raise ValueError(f"Unsupported file type: {unknown}")
    out = None
    for suffixes, name, reader in ((TEXT, "text", read_texts), (LATEX, "latex", read_latex), (PDF, "pdf", lambda s, p: read_pdf(s, p, pages_of))):
        own = [p for p in paths if p.lower().endswith(suffixes)]
        if own:
            part = reader(spark, own).select(T.basename(F.col("path")).alias("source"), F.lit(name).alias("kind"), "text")
            out = part if out is None else out.unionByName(part)
    return out


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """question: lines of a file, stripped, without blank ones."""
    return spark.read.text(path).select(T.strip(F.col("value")).alias("question")).where("question <> ''")


def storage_sizes(spark: SparkSession, path: str) -> DataFrame:
    """folder, files, bytes of all files below a path; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    folder = F.regexp_replace("path", "/[^/]*$", "")
    return files.groupBy(folder.alias("folder")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


def describe_tables(spark: SparkSession, paths: dict[str, str], sample: int = 3) -> DataFrame:
    """name, columns, rows and a sample (JSON) of Parquet tables."""
    rows = []
    for name, path in sorted(paths.items()):
        t = spark.read.parquet(path)
        head = [r["j"] for r in t.limit(sample).select(F.to_json(F.struct("*")).alias("j")).collect()]
        rows.append((name, [f"{c}: {k}" for c, k in t.dtypes], t.count(), head))
    return spark.createDataFrame(rows, "name string, columns array<string>, n_rows long, sample array<string>")


def describe_catalog(spark: SparkSession, sample: int = 3) -> DataFrame:
    """The same of the session catalog's tables and views."""
    rows = []
    for t in spark.catalog.listTables():
        df = spark.table(t.name)
        head = [r["j"] for r in df.limit(sample).select(F.to_json(F.struct("*")).alias("j")).collect()]
        rows.append((t.name, [f"{c.name}: {c.dataType}" for c in spark.catalog.listColumns(t.name)], df.count(), head))
    return spark.createDataFrame(rows, "name string, columns array<string>, n_rows long, sample array<string>")
