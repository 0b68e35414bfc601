"""How far the sources of a language lie apart in their words: group-blocks against group-blocks, chunk by chunk of the vocabulary.

A group is a (lang, source). Each term kept in a language has a share p of a group's words, in billionths, smoothed by 2 and
rounded down; two shares lie (p - q)^2 / (p + q) apart, rounded down. All of it is integer arithmetic.

1. A task counts its documents' terms by group; the counts meet once, dealt by (lang, term), where documents are summed too.
2. A language's kept terms fall into chunks of about CHUNK by a hash and are numbered inside them. What a group has in a chunk
   is one packed vector (places, counts), so no row holds more than a chunk.
3. The groups of a language stand in blocks of BLOCK. A vector is sent to each pair of blocks that its own takes part in; the
   task of a pair works through the chunks in order, two blocks of vectors in memory at a time, and holds one submatrix
   of sums. A language with many chunks is cut into stripes of STRIPE chunks, whose submatrices Spark adds.
4. A group's most typical terms need no pairs: its share against its language's, ranked in its own window.

The result has a row for each ordered pair of sources of a language, so it grows with the square of a language's sources.

Cases: null text, lang and source count as ''; a text without terms adds none, but its group is there; a language that
keeps no term has value 0 for every pair; a language of one source has no pairs; ties in value go to the item whose UTF-8
comes first; rows that repeat a doc_id are documents of their own, as doc_id isn't read; very long texts are read
whole; an empty table gives an empty result; other columns do not matter, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import common

#: Documents of a language that a kept term is in, at least; what smooths a count; terms listed a group.
LEAST, SMOOTH, TOP = 10, 2, 10
#: Terms in a chunk (about), chunks in a stripe, groups in a block.
CHUNK, STRIPE, BLOCK = 4096, 4, 16
#: Counts that a task holds before it hands them on.
HELD = 400_000
#: ASCII letters in lower case and all bytes of other letters; all else parts terms.
LETTERS = bytes(c | 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def term_counts(docs: DataFrame, held: int = HELD) -> DataFrame:
    """lang, source, term, n (occurrences), d (documents) by task; a row with a null term for each group that a task met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def packed() -> pa.RecordBatch:
            each = [(*g, len(n) + 1) for g, (n, _) in found.items()]
            of = lambda i: pa.array([x for *names, k in each for x in [names[i]] * k], pa.string())
            terms, n, d = [], [], []
            for many, docs in found.values():
                terms += [None, *many]
                n += [0, *many.values()]
                d += [0, *map(docs.__getitem__, many)]
            return pa.RecordBatch.from_arrays([of(0), of(1), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(d, pa.int64())], ["lang", "source", "term", "n", "d"])

        for b in common.slices(batches):
            for lang, source, text in zip(b.column("lang").to_pylist(), b.column("source").to_pylist(), common.column_bytes(b.column("text")), strict=True):
                many, docs = found.setdefault((lang, source), (Counter(), Counter()))
                words = text.translate(LETTERS).split()
                many.update(words)
                docs.update(set(words))
            if sum(len(n) for n, _ in found.values()) > held:
                yield packed()
                found = {}
        if found:
            yield packed()

    rows = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    return rows.mapInArrow(run, "lang string, source string, term string, n long, d long")


def kept_counts(parts: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, source, term, n, total (of the language), first (one row a term has it) of kept terms; a row with a null term for each group."""
    # Dealt once: what follows groups by these keys, or more of them.
    counts = parts.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    same = Window.partitionBy("lang", "term")
    counts = counts.withColumn("df", F.sum("d").over(same)).withColumn("total", F.sum("n").over(same))
    counts = counts.withColumn("first", F.row_number().over(same.orderBy("source")) == 1)
    return counts.where((F.col("df") >= least) | F.col("term").isNull()).select("lang", "source", "term", "n", "total", "first")


def groups_of(counts: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """lang, source, its number among the language's sources, words (of kept terms), and the language's groups, words, terms and chunks."""
    some = F.col("term").isNotNull()
    groups = counts.groupBy("lang", "source").agg(F.sum("n").alias("words"))
    langs = counts.groupBy("lang").agg(F.sum("n").alias("lang_words"), F.sum(F.when(some & F.col("first"), 1).otherwise(0)).alias("terms"))
    own = Window.partitionBy("lang")  # a row a source
    out = groups.join(langs, "lang").withColumn("number", (F.row_number().over(own.orderBy("source")) - 1).cast("int"))
    return out.withColumn("groups", F.count("*").over(own)).withColumn("chunks", F.greatest(F.lit(1), F.ceil(F.col("terms") / chunk)).cast("int"))


def numbered(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """The kept terms' counts with their group's facts, the chunk and the place in it of each term."""
    rows = counts.where("term IS NOT NULL").join(groups, ["lang", "source"]).withColumn("chunk", F.pmod(F.xxhash64("term"), F.col("chunks")).cast("int"))
    return rows.withColumn("place", (F.dense_rank().over(Window.partitionBy("lang", "chunk").orderBy("term")) - 1).cast("int"))


def vectors(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """A packed vector (places, counts) of each group and chunk of its language, empty ones too; width: the terms of the chunk."""
    packed = rows.groupBy("lang", "number", "chunk").agg(F.sort_array(F.collect_list(F.struct("place", "n"))).alias("v"))  # a chunk's terms at most
    packed = packed.select("lang", "number", "chunk", F.col("v.place").alias("places"), F.col("v.n").alias("counts"))
    chunks = rows.groupBy("lang", "chunk").agg((F.max("place") + 1).alias("width"))
    every = groups.select("lang", "number", "groups", "words", "terms").join(chunks, "lang", "left").withColumn("chunk", F.coalesce("chunk", F.lit(0)))
    return every.withColumn("width", F.coalesce("width", F.lit(0))).join(packed, ["lang", "number", "chunk"], "left")


def shares(count: np.ndarray, words: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 (count + 2) / (words + 2 terms)), by long division in thousands, which no sum under 9 x 10^15 overflows."""
    left, out, whole = count + SMOOTH, 0, words + SMOOTH * terms
    for _ in range(3):
        left = left * 1000
        out = out * 1000 + left // whole
        left = left % whole
    return out + 1


def share(count: str, words: str, terms: str) -> Column:
    """`shares` of columns."""
    left, out = f"({count} + {SMOOTH})", "0L"
    whole = f"({words} + {SMOOTH} * {terms})"
    for _ in range(3):
        out, left = f"({out} * 1000 + {left} * 1000 div {whole})", f"({left} * 1000 % {whole})"
    return F.expr(f"{out} + 1")


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def pair_sums(vectors: DataFrame, block: int = BLOCK, stripe: int = STRIPE) -> DataFrame:
    """lang, i, j, value of each two groups (by number, i < j): one task a pair of blocks and stripe, chunk after chunk."""
    keys = ("lang", "row", "column", "stripe")

    def submatrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, members, total, chunk, held = None, set(), None, None, []

        def add() -> None:
            """The chunk that is held, into the submatrix."""
            p = np.zeros((2, block, held[0]["width"]), np.int64)
            for r in held:
                side, at = int(r["number"] // block != now[1]), r["number"] % block
                count = np.zeros(r["width"], np.int64)
                if r["places"] is not None:
                    count[r["places"]] = r["counts"]
                p[side, at] = shares(count, r["words"], r["terms"]) if r["width"] else 0
            same = now[1] == now[2]
            here = sorted({r["number"] % block for r in held if r["number"] // block == now[1]})
            there = np.array(here if same else sorted({r["number"] % block for r in held if r["number"] // block == now[2]}), int)
            for i in here:
                others = there[there > i] if same else there
                if len(others):
                    total[i, others] += apart(p[0, i][None], p[0 if same else 1, others]).sum(1)

        def ended() -> pa.RecordBatch:
            lang, row, column, _ = now
            first, second = (sorted(x for x in members if x // block == b) for b in (row, column))
            pairs = [(i, j) for i in first for j in second if i < j]
            values = [int(total[i % block, j % block]) for i, j in pairs]
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(pairs), pa.string()), *[pa.array([x[k] for x in pairs], pa.int32()) for k in (0, 1)], pa.array(values, pa.int64())], ["lang", "i", "j", "value"])

        for b in batches:
            places, counts = b.column("places"), b.column("counts")
            facts = [b.column(c).to_pylist() for c in (*keys, "chunk", "number", "width", "words", "terms")]
            for k, (lang, row, column, part, at, number, width, words, terms) in enumerate(zip(*facts, strict=True)):
                key = (lang, row, column, part)
                if held and (key != now or at != chunk):
                    add()
                    held = []
                if key != now:
                    if now is not None:
                        yield ended()
                    now, members, total = key, set(), np.zeros((block, block), np.int64)
                chunk = at
                members.add(number)
                some = places[k].is_valid
                held.append({"number": number, "width": width, "words": words, "terms": terms, "places": places[k].values.to_numpy() if some else None, "counts": counts[k].values.to_numpy() if some else None})
        if held:
            add()
            yield ended()

    own = F.floor(F.col("number") / block).cast("int")
    sent = vectors.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("groups") / block) - 1).cast("int"))))
    sent = sent.select("lang", F.least("own", "other").alias("row"), F.greatest("own", "other").alias("column"), F.floor(F.col("chunk") / stripe).cast("int").alias("stripe"), "chunk", "number", "width", "words", "terms", "places", "counts")
    parts = sent.repartition(*keys).sortWithinPartitions(*keys, "chunk", "number").mapInArrow(submatrices, "lang string, i int, j int, value long")
    return parts.groupBy("lang", "i", "j").agg(F.sum("value").alias("value"))


def divergence(docs: DataFrame, least: int = LEAST, top: int = TOP, chunk: int = CHUNK, stripe: int = STRIPE, block: int = BLOCK) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank: how far the other sources of a language lie from one, and what is typical of it."""
    work = common.Work(docs.sparkSession, "divergence")
    counts = work.keep("counts", kept_counts(term_counts(docs), least))
    groups = work.keep("groups", groups_of(counts, chunk))
    rows = work.keep("numbered", numbered(counts, groups))
    work.drop("counts")
    sums = work.keep("sums", pair_sums(vectors(rows, groups), block, stripe))

    both = sums.select("lang", "value", F.explode(F.array(F.struct(F.col("i").alias("own"), F.col("j").alias("other")), F.struct(F.col("j").alias("own"), F.col("i").alias("other")))).alias("of"))
    names = lambda number, name: groups.select("lang", F.col("number").alias(number), F.col("source").alias(name))
    pairs = both.select("lang", "value", "of.own", "of.other").join(names("own", "source"), ["lang", "own"]).join(names("other", "item"), ["lang", "other"])
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))

    terms = rows.where("n > 0").select("lang", "source", F.col("term").alias("item"), share("n", "words", "terms").alias("p"), share("total", "lang_words", "terms").alias("q")).where("p > q")
    terms = terms.select("lang", "source", "item", F.expr("(p - q) * (p - q) div (p + q)").alias("value")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.unionByName(terms.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(common.table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH docs AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents
), words AS (
  SELECT lang, source, r, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs
), kept AS (
  SELECT lang, term, count(*) AS total FROM words GROUP BY lang, term HAVING count(DISTINCT r) >= 10
), counts AS (
  SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY lang, source, term
), groups AS (
  SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS n_words FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN counts c USING (lang, source) GROUP BY g.lang, g.source
), langs AS (
  SELECT l.lang, count(k.term) AS v, coalesce(sum(k.total), 0) AS n_words FROM (SELECT DISTINCT lang FROM docs) l LEFT JOIN kept k USING (lang) GROUP BY l.lang
), p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000 :: HUGEINT * (coalesce(c.n, 0) + 2) // (g.n_words + 2 * l.v) AS p,
         1 + 1000000000 :: HUGEINT * (k.total + 2) // (l.n_words + 2 * l.v) AS q
  FROM groups g JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), sums AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // (p + q) AS BIGINT) FROM p WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM parts
)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 10
"""
