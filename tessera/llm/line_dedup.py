"""Line dedup: lines found in many documents go, everywhere or but for their first occurrence.

Each line's key (stripped, A-Z lower-cased) becomes a 128-bit hash. Rows (hash, document, position) are partitioned by
range over hash *and* document and sorted, so a line that a third of all documents hold spreads over as many range
partitions as it fills. One stream over each partition meets the occurrences of a key in order of document and position,
holds at most HELD rows of an undecided run, and emits the lines to drop. A run at a partition's edge, which can
continue in its neighbours, and one that is longer than HELD but still in few documents are emitted as open, with one summary
row a key and partition; the summaries (two a partition, and one for every HELD rows at most) settle them. The result is a compressed keep bitmap per document that
loses a line; no text is ever shuffled by line, and texts move once if the bitmaps are applied.

Cases: null or empty text is one empty line; blank keys (under min_chars code points) never go; a null doc_id
is one document; rows repeating a doc_id count as one document, each text of it with its own bitmap; repeated lines
inside a document count once towards min_docs and go together; very long texts and lines are hashed whole; an empty
table gives an empty result; other columns are kept by apply_bitmaps, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common

DROP, OPEN, OPEN_FIRST, SUMMARY = 0, 1, 2, 3
HELD = 1 << 16
NO_ID = -(1 << 63)


def occurrences(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """h1, h2, doc, th, pos: a row for each line with a key of min_chars code points or more; doc is NO_ID for null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest = xxhash.xxh3_128_digest
        for batch in common.slices(batches, most=4 << 20):
            keys, row, pos = [], [], []
            for i, text in enumerate(common.column_bytes(batch.column("text"))):
                for j, line in enumerate((text or b"").split(b"\n")):
                    key = line.strip().lower()  # of bytes: ASCII only
                    if key and (min_chars == 1 or len(key.decode("utf-8", "replace")) >= min_chars) or not min_chars:
                        keys.append(digest(key))
                        row.append(i)
                        pos.append(j)
            h = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
            at = np.array(row, np.int64)
            ids = [batch.column(c).to_numpy(zero_copy_only=False)[at] for c in ("doc", "th")]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(h[:, 0])), pa.array(np.ascontiguousarray(h[:, 1])), *[pa.array(x, pa.int64()) for x in ids], pa.array(pos, pa.int32())], ["h1", "h2", "doc", "th", "pos"])

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64("text").alias("th"), F.col("text"))
    return rows.mapInArrow(run, "h1 long, h2 long, doc long, th long, pos int")


class Stream:
    """One pass over a sorted partition; see the module's text. Rows are an n x 5 array: h1, h2, doc, th, pos."""

    def __init__(self, min_docs: int, keep_first: bool, part: int):
        self.min_docs, self.keep_first, self.part = min_docs, keep_first, part
        self.key = None  # of the run that is being emitted as it comes
        self.kind, self.docs, self.last = OPEN, 0, None
        self.held = np.empty((0, 5), np.int64)  # an undecided run
        self.edge_open = True  # the partition's first run may have begun in another one
        self.out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def emit(self, rows: np.ndarray, kind: np.ndarray | int, docs: int = 0) -> None:
        if len(rows):
            self.out.append((rows, np.broadcast_to(np.asarray(kind, np.int8), len(rows)), np.full(len(rows), docs, np.int64)))

    def summary(self) -> None:
        if self.key is not None:
            self.emit(np.array([[*self.key, 0, 0, -1]], np.int64), SUMMARY, self.docs)

    def go_on(self, rows: np.ndarray) -> int:
        """Emit the rows that continue the run being emitted; how many there are."""
        other = (rows[:, 0] != self.key[0]) | (rows[:, 1] != self.key[1])
        n = int(other.argmax()) if other.any() else len(rows)
        if n:
            run = rows[:n]
            self.docs += int((run[1:, 2] != run[:-1, 2]).sum()) + int(self.last is None or run[0, 2] != self.last)
            self.last = run[-1, 2]
            self.emit(run, self.kind)
        return n

    def add(self, rows: np.ndarray) -> None:
        if not len(rows):
            return
        if self.edge_open:  # the first run: all open
            self.edge_open = False
            self.key, self.kind = (rows[0, 0], rows[0, 1]), OPEN
            self.docs, self.last = 1, rows[0, 2]
            self.emit(rows[:1], OPEN_FIRST)
            rows = rows[1:]
        if self.key is not None and len(rows):
            n = self.go_on(rows)
            rows = rows[n:]
            if len(rows):
                if self.kind == OPEN:
                    self.summary()
                self.key = None
        if not len(rows):
            return
        rows = np.concatenate([self.held, rows]) if len(self.held) else rows
        new = np.flatnonzero((rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 1] != rows[:-1, 1])) + 1
        starts = np.concatenate([[0], new])
        changes = np.concatenate([[1], ((rows[1:, 2] != rows[:-1, 2])).astype(np.int64)])
        changes[starts] = 1
        docs = np.add.reduceat(changes, starts)
        last = starts[-1]
        often = docs >= self.min_docs
        lengths = np.diff(np.append(starts, len(rows)))
        drop = np.repeat(often, lengths)
        if self.keep_first:
            drop[starts] = False
        self.emit(rows[drop], DROP)
        self.held = rows[:0]
        if often[-1]:
            self.key, self.kind, self.docs, self.last = (rows[last, 0], rows[last, 1]), DROP, int(docs[-1]), rows[-1, 2]
        else:
            self.held = rows[last:].copy()
            if len(self.held) > HELD:
                self.open_held()

    def open_held(self) -> None:
        """Emit an undecided run as open; the rows that continue it follow as they come."""
        h, self.held = self.held, self.held[:0]
        self.key, self.kind, self.last = (h[0, 0], h[0, 1]), OPEN, h[-1, 2]
        self.docs = int((h[1:, 2] != h[:-1, 2]).sum()) + 1
        self.emit(h[:1], OPEN_FIRST)
        self.emit(h[1:], OPEN)

    def end(self) -> None:
        if self.key is not None:
            self.summary()
        elif len(self.held):
            self.open_held()
            self.summary()

    def taken(self) -> Iterator[pa.RecordBatch]:
        for rows, kind, docs in self.out:
            columns = [pa.array(np.ascontiguousarray(rows[:, i])) for i in range(4)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(rows[:, 4].astype(np.int32)), pa.array(kind), pa.array(np.full(len(rows), self.part, np.int32)), pa.array(docs)], ["h1", "h2", "doc", "th", "pos", "kind", "part", "docs"])
        self.out = []


def keep_bitmaps(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep: str = "none") -> DataFrame:
    """doc_id, th (hash of the text), n_dropped and keep_bits of each document that loses a line.

    keep_bits: zlib-compressed bits, most significant first, 1 for a line that stays; lines after its end stay.
    keep: "none" drops every occurrence of a line that min_docs documents hold, "first" spares the first one
    in order of doc_id and position.
    """
    if keep not in ("none", "first"):
        raise ValueError(keep)
    common.bounded_batches(docs.sparkSession)
    first = keep == "first"

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Stream(min_docs, first, TaskContext.get().partitionId())
        for b in batches:
            if b.num_rows:
                s.add(np.column_stack([b.column(i).to_numpy().astype(np.int64) for i in range(5)]))
                yield from s.taken()
        s.end()
        yield from s.taken()

    rows = occurrences(docs, min_chars).repartitionByRange("h1", "h2", "doc").sortWithinPartitions("h1", "h2", "doc", "th", "pos")
    work = common.Work(docs.sparkSession, "line-dedup")
    found = work.keep("found", rows.mapInArrow(stream, "h1 long, h2 long, doc long, th long, pos int, kind byte, part int, docs long"))
    totals = found.where(F.col("kind") == SUMMARY).groupBy("h1", "h2").agg(F.sum("docs").alias("total"), F.min("part").alias("first_part")).where(F.col("total") >= min_docs)
    totals = work.keep("totals", totals)  # a written table has a known size: small ones are broadcast, so a frequent line's rows stay where they are
    spared = (F.lit(first)) & (F.col("kind") == OPEN_FIRST) & (F.col("part") == F.col("first_part"))
    settled = found.where(F.col("kind").isin(OPEN, OPEN_FIRST)).join(totals, ["h1", "h2"]).where(~spared)
    drops = found.where(F.col("kind") == DROP).select("doc", "th", "pos").unionByName(settled.select("doc", "th", "pos"))
    by_doc = drops.groupBy("doc", "th").agg(F.collect_list("pos").alias("at"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits, n = [], []
            for at in b.column("at"):
                at = np.unique(at.values.to_numpy())
                stays = np.ones(int(at[-1]) // 8 * 8 + 8, bool)  # whole bytes: what pads them stays
                stays[at] = False
                bits.append(zlib.compress(np.packbits(stays).tobytes()))
                n.append(len(at))
            yield pa.RecordBatch.from_arrays([b.column("doc"), b.column("th"), pa.array(n, pa.int64()), pa.array(bits, pa.binary())], ["doc", "th", "n_dropped", "keep_bits"])

    return by_doc.mapInArrow(pack, "doc long, th long, n_dropped long, keep_bits binary").select(F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id"), "th", "n_dropped", "keep_bits")


def kept_text(text: bytes | None, bits: bytes | None) -> tuple[bytes, int, int]:
    """The text that is left, its lines before and the lines dropped."""
    text = text or b""
    lines = text.split(b"\n")
    if bits is None:
        return text, len(lines), 0
    stays = np.unpackbits(np.frombuffer(zlib.decompress(bits), np.uint8))[: len(lines)]
    gone = set(np.flatnonzero(stays == 0).tolist())
    return b"\n".join([x for i, x in enumerate(lines) if i not in gone]), len(lines), len(gone)


def joined(docs: DataFrame, bitmaps: DataFrame) -> tuple[common.Renamed, DataFrame]:
    inner = common.renamed(docs)
    b = bitmaps.select(F.col("doc_id").alias("b_id"), F.col("th").alias("b_th"), "keep_bits")
    on = inner.col("doc_id").cast("long").eqNullSafe(F.col("b_id")) & (F.xxhash64(inner.col("text")) == F.col("b_th"))
    return inner, inner.df.join(b, on, "left").drop("b_id", "b_th")


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """docs with the lines that the bitmaps drop taken out of text; null texts stay null."""
    common.bounded_batches(docs.sparkSession)
    inner, both = joined(docs, bitmaps)
    text = inner.names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches, f"c{text}"):
            out = [t if bits is None else kept_text(t, bits)[0] for t, bits in zip(common.column_bytes(b.column(f"c{text}")), b.column("keep_bits").to_pylist(), strict=True)]
            columns = b.columns[:-1]
            columns[text] = pa.array(out, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(columns, b.schema.names[:-1])

    return both.mapInArrow(run, inner.ddl()).select(*inner.restored())


def line_dedup(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep: str = "none") -> DataFrame:
    """docs without the lines that min_docs documents or more hold."""
    return apply_bitmaps(docs, keep_bitmaps(docs, min_docs, min_chars, keep))


def report(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of each row of docs."""
    _, both = joined(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), bitmaps)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches, "c1"):
            rows = [kept_text(t, bits) for t, bits in zip(common.column_bytes(b.column("c1")), b.column("keep_bits").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("c0"), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array([hashlib.sha256(r[0]).hexdigest() for r in rows])], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    return both.mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return report(docs, keep_bitmaps(docs))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), often AS (
  SELECT k FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10
), marked AS (
  SELECT keyed.*, often.k IS NOT NULL AS gone FROM keyed LEFT JOIN often USING (k)
)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
