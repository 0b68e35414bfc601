"""Removal of passages that repeat across documents: suffixes sampled by a difference cover, names, merge, adjacent prefixes.

A byte goes if it is covered by a string of LENGTH bytes that also starts in a document with a smaller doc_id. Only
prefixes of LENGTH bytes ever matter, so suffixes are sorted by that much and no further, and one level of names is
enough where a full suffix array would recurse:

0. A text that a smaller doc_id has whole loses all its bytes; such copies (by 128-bit names) take no further part.
1. Texts are ordered by doc_id (range partitions over doc_id and text) and packed into slices. A doc_id with many rows is many
   slices; a name's *order* is the first doc_id that has it in a slice, or what stands for those that no other slice has.
2. Offsets whose residue modulo PERIOD lies in COVER are sampled. For any two offsets i, j some shift below PERIOD takes
   both to sampled ones, so equal strings of LENGTH bytes share a sampled tuple of TUPLE = LENGTH - PERIOD + 1 bytes at
   equal places. The tuples' names (hashes) are sorted; a name that occurs once in the corpus is dropped here.
3. The remaining suffixes are merged back: only starts with a repeated sampled tuple within the next PERIOD places
   are kept, sampled or not. They are sorted by the name of their LENGTH-byte prefix (56 or 64 bits beside those of the bucket, so that no false match is to be expected).
4. Neighbours with equal prefixes are compared by order: a start is marked if an earlier order has the same prefix.

Sorting happens in buckets of names. A slice sends each distinct name of a bucket once, sorted and packed (2 to 8 bytes each), so
a passage of a third of all documents arrives once a slice, not once a document; the bucket answers with one bit a name.
The number of buckets follows the bytes of the corpus, so a bucket's size doesn't. Texts move twice for the answers.

Cases: null or empty text has no bytes; texts shorter than LENGTH lose nothing; a null doc_id comes before all others, as one
document; rows that repeat a doc_id never remove each other's bytes, wherever they stand; a document longer than a slice is
worked on in overlapping pieces; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import common

LENGTH = 50
#: A perfect difference set: every residue is the difference of two members.
PERIOD, COVER = 21, (3, 6, 7, 12, 14)
TUPLE = LENGTH - PERIOD + 1
SLICE = 1 << 20
#: Documents of a slice, and whole copies beside them, at most: texts can be empty.
IDS = 100_000
NAMES_IN_BUCKET = 1_500_000
NO_ID = -(1 << 63)
SALTS = 32
U64 = np.uint64
MULTIPLIERS = [U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB), U64(0xD6E8FEB86659FD93), U64(0xFF51AFD7ED558CCD), U64(0xC4CEB9FE1A85EC53), U64(0x2545F4914F6CDD1D)]
ANSWERS = "slice long, piece int, class int, bucket int, bits binary"


PACKED = "slice long, n_bytes long, edges int, ids binary, lengths binary, copies binary, data binary"
#: What a slice may share with its neighbours, and the classes of its names: of its first doc_id, of its last, of others.
FIRST_SHARED, LAST_SHARED = 1, 2
OTHERS, FIRST, LAST = 0, 1, 2


def text_names(docs: DataFrame) -> DataFrame:
    """doc (NO_ID: null), text and its 128-bit name x, y."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), "text")
    return rows.select("doc", F.xxhash64(F.lit(1), "text").alias("x"), F.xxhash64(F.lit(2), "text").alias("y"), "text")


def whole_copies(named: DataFrame) -> DataFrame:
    """doc, x, y of each row whose whole text a smaller doc_id has: all its bytes go.

    A text that a third of all rows have meets itself by salt first, then once a salt.
    """
    narrow = named.where(F.octet_length("text") >= LENGTH).select("doc", "x", "y", F.pmod(F.xxhash64(F.lit(3), "doc"), F.lit(SALTS)).alias("salt")).distinct()
    parts = narrow.groupBy("x", "y", "salt").agg(F.min("doc").alias("low"), F.max("doc").alias("high"))
    whole = Window.partitionBy("x", "y")  # at most SALTS rows
    parts = parts.select("x", "y", "salt", F.min("low").over(whole).alias("low"), "high").where("low < high")
    return narrow.join(parts, ["x", "y", "salt"]).where("doc > low").select("doc", "x", "y")


def pack_documents(docs: DataFrame, work: common.Work, size: int = SLICE) -> DataFrame:
    """slice, n_bytes, edges, ids, lengths, data (compressed): texts in order of doc_id.

    `edges` says whether the first or last doc_id may be in other slices too. Whole copies stay out of data; `copies` has
    their ids and lengths. Their marks travel with the texts, in one shuffle.
    """
    named = text_names(docs)
    marks = work.keep("copies", whole_copies(named)).select("doc", "x", "y", F.lit(None).cast("string").alias("text"), F.lit(False).alias("real"))
    rows = marks.unionByName(named.withColumn("real", F.lit(True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        part, k = TaskContext.get().partitionId(), 0
        squeeze = zstandard.ZstdCompressor(level=3).compress
        ids, texts, copies, held, marked, before = [], [], [], 0, None, None

        def packed(following: int | None) -> pa.RecordBatch:
            # At a partition's ends, what the neighbour holds is not known: an id there may be shared.
            edges = FIRST_SHARED * (k == 0 or before == ids[0]) + LAST_SHARED * (following is None or following == ids[-1]) if ids else 0
            of = [pa.array([(part << 32) + k]), pa.array([held]), pa.array([edges], pa.int32()), *[pa.array([np.array(x, np.int64).tobytes()], pa.binary()) for x in (ids, [len(t) for t in texts], copies)], pa.array([squeeze(b"".join(texts))], pa.binary())]
            return pa.RecordBatch.from_arrays(of, ["slice", "n_bytes", "edges", "ids", "lengths", "copies", "data"])

        for b in common.slices(batches):
            columns = [b.column(c).to_pylist() for c in ("doc", "x", "y", "real")]
            for doc, x, y, real, text in zip(*columns, common.column_bytes(b.column("text")), strict=True):
                if not real:
                    marked = (doc, x, y)
                    continue
                text = text or b""
                if (ids and held + len(text) > size) or len(ids) >= IDS or len(copies) >= 2 * IDS:
                    yield packed(doc)
                    before = ids[-1] if ids else before
                    ids, texts, copies, held, k = [], [], [], 0, k + 1
                if (doc, x, y) == marked:
                    copies += [doc, len(text)]
                    continue
                ids.append(doc)
                texts.append(text)
                held += len(text)
        if ids or copies:
            yield packed(None)

    return rows.repartitionByRange("doc", "x", "y").sortWithinPartitions("doc", "x", "y", "real").mapInArrow(run, PACKED)


class Piece:
    """Some documents' bytes, side by side, or a stretch of one long document; offsets count from a document's start."""

    def __init__(self, data: bytes, lengths: np.ndarray, ids: np.ndarray, first: int = 0, own: int | None = None):
        self.n = len(data) if own is None else own  # starts beyond belong to the next piece
        self.bytes = np.frombuffer(data + bytes(64), np.uint8)
        self.words = np.ndarray((len(data) + 56,), "<u8", self.bytes, strides=(1,))
        self.ids = ids
        total = len(data)
        ends = np.cumsum(lengths)
        self.row = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        place = np.arange(total, dtype=np.int32)
        self.room = np.repeat(ends.astype(np.int32), lengths) - place
        self.residue = ((place - np.repeat((ends - lengths).astype(np.int32), lengths) + np.int32(first % PERIOD)) % PERIOD).astype(np.int8)

    def names(self, at: np.ndarray, length: int, block: int = 1 << 17) -> tuple[np.ndarray, np.ndarray]:
        """Two independent hashes of the `length` bytes at each place; worked out a block at a time."""
        out_h, out_g = np.empty(len(at), U64), np.empty(len(at), U64)
        for a in range(0, len(at), block):
            part = at[a : a + block]
            h = np.full(len(part), length, U64)
            g = np.zeros(len(part), U64)
            for k, i in enumerate([*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]):
                w = self.words[part + i]
                h = (h ^ w) * MULTIPLIERS[k % 7]
                h ^= h >> U64(29)
                g += (w ^ (w >> U64(32))) * MULTIPLIERS[(k + 3) % 7]
            h *= MULTIPLIERS[2]
            g ^= g >> U64(31)
            out_h[a : a + block], out_g[a : a + block] = h ^ (h >> U64(32)), g * MULTIPLIERS[5]
        return out_h, out_g

    def sampled(self) -> np.ndarray:
        within = np.zeros(PERIOD, bool)
        within[list(COVER)] = True
        return np.flatnonzero(within[self.residue] & (self.room >= TUPLE))

    def starts(self, alive: np.ndarray) -> np.ndarray:
        """The starts with one of the places `alive` among the next PERIOD."""
        some = np.zeros(len(self.row) + PERIOD + 1, np.int32)
        some[alive + 1] = 1
        np.cumsum(some, out=some)
        near = some[PERIOD:-1] > some[: -PERIOD - 1]
        return np.flatnonzero(near[: self.n] & (self.room[: self.n] >= LENGTH))


def pieces(row: dict, size: int = SLICE) -> Iterator[tuple[int, Piece]]:
    """(where it begins in the slice, piece): one, or several overlapping ones of a single long document."""
    data, lengths, ids = row["data"], row["lengths"], row["ids"]
    if len(ids) > 1 or len(data) <= 2 * size:
        yield 0, Piece(data, lengths, ids)
        return
    for i in range(0, len(data), size):
        part = data[i : i + size + LENGTH - 1]
        yield i, Piece(part, np.array([len(part)]), ids, i, min(size, len(part)))


def unpack(r: dict) -> dict:
    import zstandard

    numbers = {c: np.frombuffer(r[c], np.int64) for c in ("ids", "lengths", "copies")}
    return numbers | {"edges": r["edges"], "data": zstandard.ZstdDecompressor().decompress(r["data"])}


def encode(keys: np.ndarray, low: int, high_bits: int) -> bytes:
    """Sorted distinct numbers: the low bytes as they are, the rest as how far apart they lie (a bit each step)."""
    keys = np.ascontiguousarray(keys, "<u8")
    high = (keys >> U64(8 * low)).astype(np.int64)
    steps = np.zeros(len(keys) + (1 << high_bits), np.uint8)
    steps[high + np.arange(len(keys))] = 1
    return bytes([low]) + len(keys).to_bytes(4, "little") + np.ascontiguousarray(keys.view(np.uint8).reshape(-1, 8)[:, :low]).tobytes() + np.packbits(steps).tobytes()


def decode(blob: bytes) -> np.ndarray:
    low, n = blob[0], int.from_bytes(blob[1:5], "little")
    out = np.zeros((n, 8), np.uint8)
    out[:, :low] = np.frombuffer(blob, np.uint8, n * low, 5).reshape(n, low)
    steps = np.flatnonzero(np.unpackbits(np.frombuffer(blob, np.uint8, -1, 5 + n * low)))[:n]
    return out.view("<u8").ravel() | ((steps - np.arange(n)).astype(U64) << U64(8 * low))


class Names:
    """The distinct names at some places of a piece, by bucket; for each place which name it has.

    Names whose first doc_id may be in other slices too are classes of their own: their order is that very doc_id.
    """

    def __init__(self, bucket: np.ndarray, key: np.ndarray, row: np.ndarray, ids: np.ndarray, edges: int = 0):
        order = np.argsort(key)
        order = order[np.argsort(bucket[order].astype(np.uint16 if len(bucket) and bucket.max() < 1 << 16 else np.int32), kind="stable")]
        b, k = bucket[order], key[order]
        new = np.ones(len(order), bool)
        new[1:] = (b[1:] != b[:-1]) | (k[1:] != k[:-1])
        first = np.flatnonzero(new)
        self.group = np.empty(len(order), np.int32)
        self.group[order] = np.cumsum(new, dtype=np.int32) - 1
        self.keys, self.buckets = k[first], b[first]
        # Documents stand in order of their ids, so rows can stand for ids, but for rows that share one.
        docs = row[order]
        self.first_doc = ids[np.minimum.reduceat(docs, first)] if len(first) else ids[:0]
        self.several = self.first_doc != ids[np.maximum.reduceat(docs, first)] if len(first) else np.empty(0, bool)
        changes = np.flatnonzero(np.append(True, self.buckets[1:] != self.buckets[:-1])) if len(first) else np.empty(0, np.int64)
        self.ranges = {int(self.buckets[a]): (int(a), int(z)) for a, z in zip(changes, np.append(changes[1:], len(first))[: len(changes)], strict=True)}
        shared = [(c, ids[at]) for c, flag, at in ((LAST, LAST_SHARED, -1), (FIRST, FIRST_SHARED, 0)) if edges & flag and len(ids)]
        self.classes = np.zeros(len(self.keys), np.int8) if shared else None
        for c, doc in shared:
            self.classes[self.first_doc == doc] = c
        own = ids[~np.isin(ids, [doc for _, doc in shared])] if shared else ids
        self.order = {c: int(doc) for c, doc in shared} | ({OTHERS: int(own[0])} if len(own) else {})

    def parts(self) -> Iterator[tuple[int, int, slice | np.ndarray, int]]:
        """bucket, class, where its names are, how many."""
        for b, (a, z) in self.ranges.items():
            if self.classes is None:
                yield b, OTHERS, slice(a, z), z - a
                continue
            for c in np.unique(self.classes[a:z]).tolist():
                at = a + np.flatnonzero(self.classes[a:z] == c)
                yield b, c, at, len(at)

    def answer(self, answers: dict[tuple[int, int], bytes]) -> np.ndarray:
        """The bit of each name."""
        out = np.zeros(len(self.keys), bool)
        for b, c, at, n in self.parts():
            if (b, c) in answers:
                out[at] = np.unpackbits(np.frombuffer(answers[b, c], np.uint8), count=n)
        return out


def to_bucket(g: np.ndarray, buckets: int) -> np.ndarray:
    return ((g >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int32)


def width(starts: int, buckets: int) -> int:
    """Bytes of a name, beside its bucket's number: enough that among so many starts a false match is not to be expected."""
    return 7 if starts**2 < buckets << 51 else 8


def tuple_names(piece: Piece, buckets: int) -> tuple[np.ndarray, Names]:
    at = piece.sampled()
    h, g = piece.names(at, TUPLE)
    return at, Names(to_bucket(g, buckets), h >> U64(36), piece.row[at], piece.ids)


def start_names(piece: Piece, at: np.ndarray, names: Names, answers: dict[tuple[int, int], bytes], buckets: int, wide: int, edges: int) -> tuple[np.ndarray, Names]:
    alive = (names.several | names.answer(answers))[names.group]
    starts = piece.starts(at[alive])
    h, g = piece.names(starts, LENGTH)
    return starts, Names(to_bucket(g, buckets), h >> U64(64 - 8 * wide), piece.row[starts], piece.ids, edges)


def sent(slice_id: int, k: int, names: Names, low: int, high: int) -> list[dict]:
    """A message a bucket and class."""
    return [{"bucket": b, "slice": slice_id, "piece": k, "class": c, "order": names.order[c], "names": encode(names.keys[at], low, high)} for b, c, at, _ in names.parts()]


SENT = pa.schema([("bucket", pa.int32()), ("slice", pa.int64()), ("piece", pa.int32()), ("class", pa.int32()), ("order", pa.int64()), ("names", pa.binary())])
MESSAGES = "bucket int, slice long, piece int, class int, order long, names binary"


def meet(exact: bool):
    """What a bucket answers: is a name in several pieces (of the sampled tuples), or in an earlier document (of the starts)?"""

    def run(table: pa.Table) -> pa.Table:
        orders, each = table.column("order").to_numpy(), [decode(x) for x in table.column("names").to_pylist()]
        sizes = [len(x) for x in each]
        keys = np.concatenate(each)
        del each
        rank = np.unique(orders, return_inverse=True)[1].astype(np.int32)
        of = np.repeat(rank, sizes)
        order = np.argsort(keys)
        k = keys[order]
        del keys
        new = np.ones(len(k), bool)
        new[1:] = k[1:] != k[:-1]
        first = np.flatnonzero(new)
        group = np.cumsum(new, dtype=np.int32) - 1
        del k
        if exact:
            bit_sorted = of[order] > np.minimum.reduceat(of[order], first)[group]
        else:
            bit_sorted = (np.diff(np.append(first, len(order))) > 1)[group]
        bit = np.empty(len(order), bool)
        bit[order] = bit_sorted
        ends = np.cumsum([0, *sizes])
        bits = [np.packbits(bit[a:z]).tobytes() for a, z in zip(ends[:-1], ends[1:], strict=True)]
        return pa.table({c: table.column(c) for c in ("slice", "piece", "class", "bucket")} | {"bits": pa.array(bits, pa.binary())})

    return run


def by_piece(table: pa.Table) -> dict[int, dict[tuple[int, int], bytes]]:
    out: dict[int, dict[tuple[int, int], bytes]] = {}
    for r in table.to_pylist():
        out.setdefault(r["piece"], {})[r["bucket"], r["class"]] = r["bits"]
    return out


def slice_of(table: pa.Table) -> tuple[int, dict]:
    r = table.to_pylist()[0]
    return r["slice"], unpack(r)


def spans(covered: np.ndarray) -> int:
    return int(covered[0]) + int((covered[1:] & ~covered[:-1]).sum()) if len(covered) else 0


def repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row of docs."""
    if length != LENGTH:
        raise ValueError(f"the cover is made for {LENGTH} bytes")
    spark = docs.sparkSession
    work = common.Work(spark, "suffix-dedup")
    packed = work.keep("packed", pack_documents(docs, work))
    total = packed.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = max(4, int(total * len(COVER) / PERIOD / NAMES_IN_BUCKET))
    wide = width(total, buckets)

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                for k, (_, piece) in enumerate(pieces(unpack(r))):
                    yield pa.RecordBatch.from_pylist(sent(r["slice"], k, tuple_names(piece, buckets)[1], 2, 12), SENT)

    names = packed.mapInArrow(sample, MESSAGES)
    alive = work.keep("alive", names.groupBy("bucket").applyInArrow(meet(False), ANSWERS))

    def merge(left: pa.Table, right: pa.Table) -> pa.Table:
        number, row = slice_of(left)
        answers, out = by_piece(right), []
        for k, (_, piece) in enumerate(pieces(row)):
            at, names = tuple_names(piece, buckets)
            out += sent(number, k, start_names(piece, at, names, answers.get(k, {}), buckets, wide, row["edges"])[1], wide - 1, 8)
        return pa.Table.from_pylist(out, SENT)

    starts = packed.groupBy("slice").cogroup(alive.groupBy("slice")).applyInArrow(merge, MESSAGES)
    marks = work.keep("marks", starts.groupBy("bucket").applyInArrow(meet(True), ANSWERS))

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        number, row = slice_of(left)
        is_mark = right.column("kind").to_numpy(zero_copy_only=False) == 1
        alive, marks = (by_piece(right.filter(pa.array(x))) for x in (~is_mark, is_mark))
        change = np.zeros(len(row["data"]) + LENGTH + 1, np.int32)
        for k, (begin, piece) in enumerate(pieces(row)):
            at, names = tuple_names(piece, buckets)
            where, names = start_names(piece, at, names, alive.get(k, {}), buckets, wide, row["edges"])
            own = piece.ids[piece.row[where]]
            hit = where[names.answer(marks.get(k, {}))[names.group] | (names.first_doc[names.group] < own)] + begin
            change[hit] += 1
            change[hit + LENGTH] -= 1
        gone = np.cumsum(change)[: len(row["data"])] > 0
        data, out, start = np.frombuffer(row["data"], np.uint8), [], 0
        for doc, n in row["copies"].reshape(-1, 2).tolist():
            out.append({"doc": doc, "n_bytes": n, "n_removed": n, "n_spans": 1, "kept_sha256": hashlib.sha256(b"").hexdigest()})
        for doc, n in zip(row["ids"].tolist(), row["lengths"].tolist(), strict=True):
            g = gone[start : start + n]
            out.append({"doc": doc, "n_bytes": n, "n_removed": int(g.sum()), "n_spans": spans(g), "kept_sha256": hashlib.sha256(data[start : start + n][~g].tobytes()).hexdigest()})
            start += n
        return pa.Table.from_pylist(out, pa.schema([("doc", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]))

    both = alive.withColumn("kind", F.lit(0)).unionByName(marks.withColumn("kind", F.lit(1)))
    out = packed.groupBy("slice").cogroup(both.groupBy("slice")).applyInArrow(finish, "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return out.select(F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(common.table(spark, sf_dir, "documents"))


#: Every string of LENGTH bytes of every text, as hexadecimal digits (cut in parts first: a long text is not searched from its start each time).
ORACLE = r"""
WITH bytes AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n FROM documents
), cut AS (
  SELECT doc_id, n, h, list_transform(range(0, n, 4000), lambda a: substr(h, CAST(2 * a + 1 AS BIGINT), 8098)) AS parts FROM bytes
), part AS (
  SELECT doc_id, unnest(parts) AS p, unnest(range(len(parts))) AS k FROM cut
), starts AS (
  SELECT doc_id, 4000 * k + i AS pos, substr(p, CAST(2 * i + 1 AS BIGINT), 100) AS s
  FROM (SELECT doc_id, k, p, unnest(range(0, least(4000, len(p) // 2 - 49))) AS i FROM part)
), first AS (
  SELECT doc_id, pos, min(doc_id) OVER (PARTITION BY s) < doc_id AS gone FROM starts
), marked AS (
  SELECT doc_id, pos, lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM first WHERE gone
), numbered AS (
  SELECT doc_id, pos, sum(CASE WHEN before IS NULL OR pos > before + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS span FROM marked
), spans AS (
  SELECT doc_id, span, min(pos) AS a, max(pos) + 50 AS z FROM numbered GROUP BY doc_id, span
), between_ AS (
  SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS b FROM spans
), kept AS (
  SELECT s.doc_id, sum(z - a) AS gone, count(*) AS n_spans, string_agg(substr(h, CAST(2 * b + 1 AS BIGINT), CAST(2 * (a - b) AS BIGINT)), '' ORDER BY a) AS head, max(z) AS last
  FROM between_ s JOIN bytes USING (doc_id) GROUP BY s.doc_id
)
SELECT doc_id, n AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(head, '') || substr(h, CAST(2 * coalesce(last, 0) + 1 AS BIGINT)))) AS kept_sha256
FROM bytes LEFT JOIN kept USING (doc_id)
"""
