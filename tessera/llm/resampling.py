"""Importance resampling toward a target: hashed runs of words, counted and weighed in word tries, and a draw by Gumbel scores.

A feature is a run of 1 to `longest` words; its bucket is the CRC of its bytes. A bucket's gain is the log-ratio of its
smoothed shares in the target and in the documents; a document's weight is the mean gain of its features.

1. A task keeps a trie of its documents' words: a node is a run of words, and holds its count and the state of the CRC, which a
   child goes on from with one more word. When a task ends (or its trie is full) the counts go to their buckets; Spark adds
   up `buckets` numbers a task, and only their sums reach the driver.
2. The gains, a number a bucket, are broadcast. A second pass walks each document through a trie whose nodes have their
   gains attached when they are made.
3. A Gumbel number of the doc_id's hash is added to the weight; the highest scores are a sample without replacement in
   proportion to the exponentials of the weights. A histogram of scores (they span a bounded range, whatever the data) says below which
   none is drawn; the few above are dealt by ranges of (score, doc_id), sorted, and numbered by the sums of earlier ranges.

Cases: null or empty text, or one without words, has no features and weight 0; a null doc_id is hashed as `null` and stands after
all others in ties; rows that repeat a doc_id are documents of their own, in any order among themselves; an empty target
table leaves smoothed gains; an empty table gives an empty result; very long texts are read whole; other columns do not
matter, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import common

LONGEST, BUCKETS, LEAST_WORDS, PERCENT, SEED = 1, 10_000, 20, 10, 2024
#: Nodes that a trie holds before it starts anew.
NODES = 400_000
#: Scores are counted by so many at a time (a power of two).
STEP = 8
#: ASCII digits and letters in lower case and all bytes of other letters; all else parts words.
LETTERS = bytes(c | 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(LETTERS).split() if text else []


class Level(dict):
    """The nodes of one depth, by word (depth 1) or by (parent, word); a missing one grows."""

    def __init__(self, trie: Trie, deep: bool):
        super().__init__()
        self.trie, self.deep = trie, deep

    def __missing__(self, key):
        trie = self.trie
        state = zlib.crc32(b" " + key[1], trie.states[key[0]]) if self.deep else zlib.crc32(key)
        self[key] = node = len(trie.states)
        trie.states.append(state)
        trie.bucket.append(state % trie.buckets)
        if trie.gains is not None:
            trie.gain.append(trie.gains[state % trie.buckets])
        return node


class Trie:
    """Runs of words: each node's CRC state, bucket, and gain (if gains are given) or count."""

    def __init__(self, longest: int = LONGEST, buckets: int = BUCKETS, gains: list[int] | None = None):
        self.buckets, self.gains = buckets, gains
        self.states: list[int] = []
        self.bucket: list[int] = []
        self.gain: list[int] = []
        self.count = np.zeros(0, np.int64)
        self.levels = [Level(self, k > 0) for k in range(longest)]

    def walk(self, words: list[bytes]) -> list[int]:
        """The nodes of all runs of a document."""
        now = list(map(self.levels[0].__getitem__, words))
        out = now
        for k, level in enumerate(self.levels[1:], 1):
            now = list(map(level.__getitem__, zip(now, words[k:], strict=False)))
            out = out + now
        return out

    def add(self, nodes: list[int]) -> None:
        more = np.bincount(np.array(nodes, np.int64), minlength=len(self.states))
        more[: len(self.count)] += self.count
        self.count = more

    def totals(self) -> np.ndarray:
        """The features counted, by bucket."""
        out = np.zeros(self.buckets, np.int64)
        np.add.at(out, np.array(self.bucket, np.int64), self.count)
        return out


def bucket_totals(texts: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, most: int = NODES) -> np.ndarray:
    """How many features of all texts (column `text`) each bucket holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, trie = np.zeros(buckets, np.int64), Trie(longest, buckets)
        for b in common.slices(batches):
            trie.add([node for text in common.column_bytes(b.column(0)) for node in trie.walk(words_of(text))])
            if len(trie.states) > most:
                total += trie.totals()
                trie = Trie(longest, buckets)
        total += trie.totals()
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in texts.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # `buckets` rows at most
        out[r["bucket"]] = r["n"]
    return out


def gains(own: np.ndarray, target: np.ndarray) -> list[int]:
    """floor(1000 ln) of each bucket's smoothed share in the target over that in the documents."""
    whole, goal, n = int(own.sum()), int(target.sum()), len(own)
    return [math.floor(1000 * math.log(float((t + 1) * (whole + n)) / float((s + 1) * (goal + n)))) for s, t in zip(own.tolist(), target.tolist(), strict=True)]


def noise(doc_id: int | None, seed: int = SEED) -> int:
    """A Gumbel number of the doc_id, in thousandths."""
    h = int(hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: list[int], longest: int = LONGEST, seed: int = SEED, most: int = NODES) -> DataFrame:
    """at (a number of its own), doc_id, n_words, n_features, weight and score of each row of docs."""
    shared, buckets = docs.sparkSession.sparkContext.broadcast(gain), len(gain)  # a number a bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(longest, buckets, shared.value)
        for b in common.slices(batches):
            ids, n_words, n_features, weight = b.column("doc_id").to_pylist(), [], [], []
            for text in common.column_bytes(b.column("text")):
                words = words_of(text)
                nodes = trie.walk(words)
                n_words.append(len(words))
                n_features.append(len(nodes))
                weight.append(sum(map(trie.gain.__getitem__, nodes)) // len(nodes) if nodes else 0)
                if len(trie.states) > most:
                    trie = Trie(longest, buckets, shared.value)
            score = [w + noise(i, seed) for w, i in zip(weight, ids, strict=True)]
            made = [pa.array(x, pa.int64()) for x in (n_words, n_features, weight, score)]
            yield pa.RecordBatch.from_arrays([b.column("at"), b.column("doc_id"), *made], ["at", "doc_id", "n_words", "n_features", "weight", "score"])

    rows = docs.select(F.monotonically_increasing_id().alias("at"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "at long, doc_id long, n_words long, n_features long, weight long, score long")


def ranked(rows: DataFrame, work: common.Work) -> DataFrame:
    """rows with their rank from 1: score descending, doc_id ascending."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        for b in batches:
            if b.num_rows:
                own = [pa.array(np.full(b.num_rows, part, np.int32)), pa.array(np.arange(n, n + b.num_rows))]
                n += b.num_rows
                yield pa.RecordBatch.from_arrays([*b.columns, *own], [*b.schema.names, "part", "nth"])

    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("at")]  # no two rows are equal, so that any group can be divided
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    kept = work.keep("ranges", dealt.mapInArrow(number, rows._jdf.schema().toDDL() + ", part int, nth long"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    before = kept.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return kept.join(before, "part").withColumn("rank", F.col("before") + F.col("nth") + 1).select(*rows.columns, "rank")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, longest: int = LONGEST, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank (null: not drawn) of each row of docs; `percent` of those of least_words words are drawn."""
    work = common.Work(docs.sparkSession, "resampling")
    gain = gains(bucket_totals(docs, longest, buckets), bucket_totals(target, longest, buckets))
    rows = work.keep("scored", scored(docs, gain, longest, seed))
    able = F.col("n_words") >= least_words
    steps = rows.where(able).groupBy(F.shiftright("score", STEP).alias("step")).agg(F.count("*").alias("n")).collect()  # gains and noise span under 600 steps
    draw, lowest, above = percent * sum(r["n"] for r in steps) // 100, None, 0
    for r in sorted(steps, key=lambda r: -r["step"]):
        if above >= draw:
            break
        lowest, above = r["step"] << STEP, above + r["n"]
    drawn = able & (F.col("score") >= lowest) if lowest is not None else F.lit(False)
    above_all = ranked(rows.where(drawn), work).withColumn("rank", F.when(F.col("rank") <= draw, F.col("rank")))
    out = above_all.unionByName(rows.where(~drawn).withColumn("rank", F.lit(None).cast("long")))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


#: The CRC's table is made from its polynomial; only distinct words are put through it.
ORACLE = r"""
WITH RECURSIVE turned AS (
  SELECT i AS b, 0 AS k, CAST(i AS UBIGINT) AS c FROM range(256) t(i)
  UNION ALL
  SELECT b, k + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, CAST(3988292384 AS UBIGINT)) ELSE c >> 1 END FROM turned WHERE k < 8
), crc_table AS (
  SELECT list(c ORDER BY b) AS t FROM turned WHERE k = 8
), texts AS (
  SELECT true AS own, row_number() OVER () AS r, doc_id, text FROM documents UNION ALL SELECT false, 0, NULL, text FROM benchmark
), split AS (
  SELECT own, r, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM texts
), crcs AS (
  SELECT w, xor(list_reduce(list_transform(range(0, len(hex(encode(w))) // 2), lambda i: CAST(('0x' || substr(hex(encode(w)), CAST(2 * i + 1 AS BIGINT), 2)) AS UBIGINT)),
                            lambda c, x: xor(c >> 8, t[CAST(xor(c & 255, x) AS BIGINT) + 1]), CAST(4294967295 AS UBIGINT)), CAST(4294967295 AS UBIGINT)) % 10000 AS bucket
  FROM (SELECT DISTINCT w FROM split), crc_table
), counts AS (
  SELECT own, r, bucket, count(*) AS n FROM split JOIN crcs USING (w) GROUP BY ALL
), sums AS (
  SELECT b.bucket, coalesce(sum(n) FILTER (own), 0) AS s, coalesce(sum(n) FILTER (NOT own), 0) AS t FROM range(10000) b(bucket) LEFT JOIN counts c ON c.bucket = b.bucket GROUP BY b.bucket
), gains AS (
  SELECT bucket, CAST(floor(1000 * ln(CAST(t + 1 AS DOUBLE) * CAST(sum(s) OVER () + 10000 AS DOUBLE) / (CAST(s + 1 AS DOUBLE) * CAST(sum(t) OVER () + 10000 AS DOUBLE)))) AS BIGINT) AS gain FROM sums
), weights AS (
  SELECT r, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS total FROM counts JOIN gains USING (bucket) WHERE own GROUP BY r
), scores AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features,
         CASE WHEN n_features IS NULL THEN 0 ELSE (total - ((total % n_features) + n_features) % n_features) // n_features END AS weight,
         CAST(floor(-1000 * ln(-ln((CAST(('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8)) AS BIGINT) + 0.5 :: DOUBLE) / 4294967296 :: DOUBLE))) AS BIGINT) AS noise
  FROM texts LEFT JOIN weights USING (r) WHERE own
), able AS (
  SELECT *, weight + noise AS score, n_features >= 20 AS able FROM scores
), ordered AS (
  SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id ASC NULLS LAST) AS place, 10 * count(*) FILTER (able) OVER () // 100 AS draw FROM able
)
SELECT doc_id, n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score, CASE WHEN able AND place <= draw THEN place END AS rank FROM ordered
"""
