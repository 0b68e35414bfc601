"""Chunking operators: each document becomes an array of chunks inside its own row, then rows. No shuffle, no window.

Windows are cut from consecutive blocks of `step` characters (one regular-expression pass over the text), so a long
document costs its length and not its square.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T

PARAGRAPHS_FROM = 10_000


def blocks(text: Column, step: int) -> Column:
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{step}}}"), F.lit(0))


def computed(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is computed once a row; a plain one would be pasted into lambdas and run for each element."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def _windows(df: DataFrame, column: str, size: int, overlap: int, ahead: int = 0) -> DataFrame:
    """df with `w`, the windows; the blocks are computed once a row."""
    step = size - overlap
    if step <= 0:
        raise ValueError("the overlap must be smaller than the window")
    more = -(-(overlap + ahead) // step)
    with_blocks = computed(df, "__blocks", blocks(F.col(column), step))

    def window(b: Column, i: Column) -> Column:
        reach = F.concat(b, *[F.coalesce(F.get("__blocks", i + k), F.lit("")) for k in range(1, more + 1)])
        fields = [(i * step).alias("start"), F.substring(reach, 1, size).alias("text")]
        return F.struct(*fields, *([F.substring(reach, size + 1, ahead).alias("ahead")] if ahead else []))

    return computed(with_blocks, "w", F.transform("__blocks", window)).drop("__blocks")


def sliding(docs: DataFrame, size: int = 500, overlap: int = 50, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Windows that aren't blank. The name has the start offset; chunk_index counts the windows kept."""
    kept = _windows(docs, "text", size, overlap).withColumn("w", F.filter("w", lambda w: ~T.is_blank(w["text"])))
    out = kept.select(*keep, F.posexplode("w").alias("chunk_index", "c"))
    return out.select(*keep, T.chunk_name(F.col("c.start")).alias("chunk_id"), "chunk_index", F.lit(0).alias("level"), F.col("c.start").alias("position"), F.col("c.text").alias("text"))


def fixed(docs: DataFrame, size: int = 300, overlap: int = 50, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Windows over the text with white space collapsed; none is dropped, the last may lie inside the one before."""
    clean = docs.select(*keep, T.collapse_spaces(F.col("text")).alias("text"))
    out = _windows(clean, "text", size, overlap).select(*keep, F.posexplode("w").alias("chunk_id", "c"))
    start, text = F.col("c.start"), F.col("c.text")
    return out.select(*keep, "chunk_id", text.alias("text"), start.alias("start_index"), (start + F.length(text)).alias("end_index"))


def boundary(docs: DataFrame, size: int = 50, overlap: int = 5, ahead: int = 10, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Windows that reach on to the next sentence end within `ahead` characters.

    Blank windows are skipped; the first other window that reaches the text's end is the last. A window can be blank only in a text with
    a run of white space as long as a step, or one that ends with white space: only there are windows tried
    one by one. The windows themselves become rows at once and are worked on as plain columns.
    """
    step = size - overlap
    if step <= 0:
        raise ValueError("the overlap must be smaller than the window")
    text, n = F.col("text"), F.col("__n")
    head = docs.select(*keep, "text", F.length("text").alias("__n"), T.file_type(text).alias("file_type"))
    head = computed(head, "__blocks", blocks(text, step))
    more = range(1, -(-(overlap + ahead) // step) + 1)
    reach = lambda b, i: F.concat(b, *[F.coalesce(F.get("__blocks", i + k), F.lit("")) for k in more])
    tried = F.filter(F.transform("__blocks", lambda b, i: F.when(T.is_blank(F.substring(reach(b, i), 1, size)), i)), lambda i: i.isNotNull())
    suspect = F.rlike(text, F.lit(rf"(?U)\s{{{step}}}|\s\z"))
    head = computed(head, "__blank", F.when(suspect, tried).otherwise(F.array().cast("array<int>")))
    reaches = F.greatest(F.lit(0), F.ceil((n - size) / step)).cast("int")
    ends = F.when(reaches < F.size("__blocks"), F.sequence(reaches, F.size("__blocks") - 1)).otherwise(F.array().cast("array<int>"))
    last = F.when(F.size("__blank") == 0, reaches).otherwise(F.array_min(F.array_except(ends, "__blank")))
    shifted = [F.slice("__blocks", F.lit(k + 1), F.greatest(F.size("__blocks"), F.lit(1))).alias(f"b{k}") for k in (0, *more)]
    rows = head.select(*keep, "__n", "file_type", "__blank", F.coalesce(last, F.lit(2**31 - 1)).alias("__last"), F.posexplode(F.arrays_zip(*shifted)).alias("__i", "__w"))
    blank = F.size("__blank") > 0
    rows = rows.where((F.col("__i") <= F.col("__last")) & ~(blank & F.array_contains("__blank", F.col("__i"))))
    index = F.when(blank, F.col("__i") - F.size(F.filter("__blank", lambda x: x < F.col("__i")))).otherwise(F.col("__i"))
    start = F.col("__i") * step
    whole = F.concat(*[F.coalesce(F.col(f"__w.b{k}"), F.lit("")) for k in (0, *more)])
    rows = rows.select(*keep, "file_type", index.alias("chunk_index"), start.alias("start_position"), "__n", whole.alias("__reach"))
    start = F.col("start_position")
    rest = F.regexp_extract(F.substring("__reach", size + 1, ahead), r"^[^.!?]*[.!?]", 0)
    inside = (start > 0) & (start + size < n)
    rows = rows.withColumn("text", F.concat(F.substring("__reach", 1, size), F.when(inside, rest).otherwise(F.lit(""))))
    end = start + F.length("text")
    return rows.select(*keep, T.span_name(start, end).alias("chunk_id"), "chunk_index", "start_position", end.alias("end_position"), F.length("text").alias("chunk_size"), "file_type", "text")


def packed(paragraphs: Column, size: int, separator: str) -> Column:
    """Paragraphs joined greedily: a chunk closes before the paragraph that would take it over `size` characters."""
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def add(acc: Column, p: Column) -> Column:
        now = acc["now"]
        full = (F.length(now) + F.length(p) > size) & (now != "")
        joined = F.when(now != "", F.concat(now, F.lit(separator), p)).otherwise(p)
        done = F.when(full, F.concat(acc["done"], F.array(T.strip(now)))).otherwise(acc["done"])
        return F.struct(done.alias("done"), F.when(full, p).otherwise(joined).alias("now"))

    def close(acc: Column) -> Column:
        return F.when(acc["now"] != "", F.concat(acc["done"], F.array(T.strip(acc["now"])))).otherwise(acc["done"])

    return F.aggregate(paragraphs, empty, add, close)


def paragraphs(docs: DataFrame, size: int = 500, overlap: int = 50, separator: str = "\n\n", at_least: int = PARAGRAPHS_FROM, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Paragraph packing for texts of several paragraphs over `at_least` characters; sliding windows for the others."""
    parts = F.split("text", f"\\Q{separator}\\E")
    long = (F.size(parts) > 1) & (F.length("text") > at_least)
    out = docs.where(long).select(*keep, F.posexplode(packed(parts, size, separator)).alias("chunk_index", "text"))
    out = out.select(*keep, T.chunk_name(F.col("chunk_index")).alias("chunk_id"), "chunk_index", F.lit(0).alias("level"), F.lit(None).cast("int").alias("position"), "text")
    return out.unionByName(sliding(docs.where(~long), size, overlap, keep))


def deduplicated(chunks: DataFrame, key: tuple[str, ...] = ("doc_id", "chunk_id")) -> DataFrame:
    return chunks.dropDuplicates(list(key))
