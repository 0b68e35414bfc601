"""Near-duplicate documents by circulant MinHash, bands, and exact Jaccard similarity of full shingle sets.

A document's set holds its distinct 5-word shingles. One permutation (a 64-bit mix) scatters a shingle over a circle of
2**32 places; a second one, shifted along the circle by k places, gives the k-th coordinate of the signature as its
minimum: two permutations serve all coordinates. BANDS bands of ROWS coordinates make buckets: a pair at the threshold
0.75 shares none with a chance of (1 - 0.75**4)**32 = 5e-6.

Rows with equal sets form a class, a node of the graph; only one row of a class goes on. Two passes find all links that
matter for the components:

1. Pivots: every member of a bucket is compared with the bucket's first member. A group of a million near copies costs a
   million comparisons a bucket, not their square, and is mostly connected after it.
2. The rest: in buckets whose members still lie in several components, those outside the bucket's largest component are
   laid side by side with all members, in cells of bounded size (a hot bucket becomes a grid of cells, dealt by hash). Bitmaps
   of the sets bound the similarity of a pair from above (two sets differ in at least as many elements as their bitmaps in
   bits), so most texts that are merely related are ruled out, losing none, before a set moves. Members of what is left
   meet with their full sets, and each pair in different components is compared unless links already connect it.

So every pair that shares a bucket is either compared or connected; a pair is seen in the first bucket it shares. Only a bucket of very many
texts that are related but *not* alike nears the square of its size, spread over its cells.

Sets, links and components stay in tables in the shared folder, a fixed number of them, whatever the data.

Cases: null text, or text without words, has an empty set and is linked with nothing; with 1 to 4 words the whole
sequence is the one shingle; very long texts are hashed whole; rows that share a doc_id are one document, whose links are
those of all its texts. A row with a null doc_id is a document without a number, and those with equal sets are one: it links others
but never names a component; a component without any doc_id has a null component_id, and its first class is kept. An empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import common
from tessera.llm.components import stars

BANDS, ROWS = 32, 4
SHINGLE, PERCENT = 5, 75
#: Bits of a set's bitmap.
BITS = 2048
#: A cell holds about so many shingles a side; a set counts as LIGHTEST at least, which bounds the members too.
CELL, LIGHTEST = 1 << 20, 512
#: Rows of a class or a doc_id go to so many places before they meet.
SALTS = 32
HOME, AWAY, ASKS = 0, 1, 2
U64 = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers (the finaliser of a well-known generator)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def around(p: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """The second permutation of the circle of 2**32 places, shifted: shifts x places."""
    x = p[None, :] + shift[:, None]  # uint32: wraps round the circle
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


class Shingler:
    """Shingle sets of texts as sorted arrays of 64-bit hashes; remembers words' hashes, a bounded number of them."""

    def __init__(self, size: int = SHINGLE, remembered: int = 150_000):
        import xxhash

        self.hash, self.size, self.words, self.most = xxhash.xxh3_64_intdigest, size, {}, remembered
        self.factors = mix64(np.arange(1, size + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)

    def __call__(self, text: bytes | None) -> np.ndarray:
        words = text.lower().split() if text else []  # of bytes: ASCII letters and spaces only
        n = len(words)
        if not n:
            return np.empty(0, U64)
        if len(self.words) > self.most:
            self.words = {}
        known, digest = self.words, self.hash
        try:
            w = np.array([known[x] for x in words], U64)
        except KeyError:
            for x in words:
                if x not in known:
                    known[x] = digest(x)
            w = np.array([known[x] for x in words], U64)
        k = min(self.size, n)
        h = np.full(n - k + 1, k, U64)
        for i in range(k):
            h += w[i : n - k + 1 + i] * self.factors[i]
        return np.unique(mix64(h))


def signature(shingles: np.ndarray, coordinates: int = BANDS * ROWS, block: int = 1024) -> np.ndarray:
    places = (mix64(shingles ^ U64(0xA5A5A5A55A5A5A5A)) >> U64(32)).astype(np.uint32)
    shift = np.arange(coordinates, dtype=np.uint32)
    out = around(places[:block], shift).min(axis=1)
    for i in range(block, len(places), block):
        np.minimum(out, around(places[i : i + block], shift).min(axis=1), out=out)
    return out


def bands(sign: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A 64-bit name of each band's bucket; the band's number is part of it."""
    s = sign.astype(U64).reshape(-1, rows)
    h = np.arange(1, len(s) + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)
    for i in range(rows):
        h = mix64(h ^ s[:, i]) + U64(i)
    return h.view(np.int64)


def text_name() -> list[Column]:
    """A 128-bit name of the text, null for null."""
    return [F.when(F.col("text").isNotNull(), F.xxhash64(F.lit(i), "text")).alias(c) for i, c in ((1, "x"), (2, "y"))]


def sketches(docs: DataFrame, n_bands: int = BANDS, rows: int = ROWS, shingle: int = SHINGLE) -> DataFrame:
    """row (a number of its own), doc, x, y (128-bit name of the text), n (set size), f1, f2 (128-bit name of the set) and buckets of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        sets = Shingler(shingle)
        for b in common.slices(batches):
            n, names, buckets = [], [], []
            for text in common.column_bytes(b.column("text")):
                s = sets(text)
                n.append(len(s))
                names.append(xxhash.xxh3_128_digest(s))
                buckets.append(bands(signature(s, n_bands * rows), rows) if len(s) else np.empty(0, np.int64))
            f = np.frombuffer(b"".join(names), np.int64).reshape(-1, 2)
            ends = np.cumsum([0, *map(len, buckets)], dtype=np.int32)
            made = [pa.array(n, pa.int64()), pa.array(np.ascontiguousarray(f[:, 0])), pa.array(np.ascontiguousarray(f[:, 1])), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(buckets)))]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], *made], ["row", "doc", "x", "y", "n", "f1", "f2", "buckets"])

    rows_in = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc"), *text_name(), "text")
    return rows_in.mapInArrow(run, "row long, doc long, x long, y long, n long, f1 long, f2 long, buckets array<long>")


def classes(sketch: DataFrame) -> DataFrame:
    """doc, x, y, n, node (the first row of its class), low (the smallest doc_id of the class) of each row; buckets only of the node's row.

    A class may hold a third of all rows: its rows are grouped by salt first and meet again by salt.
    """
    salt = F.pmod("row", F.lit(SALTS))
    parts = sketch.where("n > 0").groupBy("f1", "f2", salt.alias("salt")).agg(F.min("row").alias("first"), F.min("doc").alias("low"))
    whole = Window.partitionBy("f1", "f2")  # at most SALTS rows
    parts = parts.select("f1", "f2", "salt", F.min("first").over(whole).alias("node"), F.min("low").over(whole).alias("low"))
    both = sketch.withColumn("salt", salt).join(parts, ["f1", "f2", "salt"], "left")
    own = F.when((F.col("row") == F.col("node")) & (F.col("n") > 0), F.col("buckets"))
    return both.select("doc", "x", "y", "n", F.when(F.col("n") > 0, F.col("node")).otherwise(F.col("row")).alias("node"), F.when(F.col("n") > 0, F.col("low")).otherwise(F.col("doc")).alias("low"), own.alias("buckets"))


def same_document(members: DataFrame) -> DataFrame:
    """Links u, v between the classes of rows that share a doc_id."""
    several = members.where("doc IS NOT NULL").groupBy("doc").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a < b").select("doc", "a")
    return members.join(several, "doc").where("node > a").select(F.col("node").alias("u"), F.col("a").alias("v")).distinct()


def buckets_shared(members: DataFrame) -> DataFrame:
    """bucket, node, n and pivot (the first node) of each member of a bucket that several classes share."""
    spread = members.where("buckets IS NOT NULL").select("node", "n", F.explode("buckets").alias("bucket"))
    shared = spread.groupBy("bucket").agg(F.count("*").alias("many"), F.min("node").alias("pivot")).where("many > 1")
    return spread.join(shared, "bucket").select("bucket", "node", "n", "pivot")


def shingle_sets(docs: DataFrame, members: DataFrame, inside: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """node, n, its set (sorted 64-bit hashes, as bytes), a bitmap of it and its buckets, for each node in a shared bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, had = Shingler(shingle), set()
        for b in common.slices(batches):
            nodes = b.column("node").to_pylist()
            new = [i for i, x in enumerate(nodes) if not (x in had or had.add(x))]  # rows alike in doc_id and text
            b = b.take(pa.array(new, pa.int64()))
            each = [sets(t) for t in common.column_bytes(b.column("text"))]
            bits = np.zeros((len(each), BITS), bool)
            for i, x in enumerate(each):
                bits[i, (x >> U64(64 - BITS.bit_length() + 1)).astype(np.int64)] = True
            maps = np.packbits(bits, axis=1)
            places = [np.array(x, np.int64).tobytes() for x in b.column("buckets").to_pylist()]
            made = [pa.array([len(x) for x in each], pa.int64()), *[pa.array(x, pa.binary()) for x in ([x.tobytes() for x in each], [m.tobytes() for m in maps], places)]]
            yield pa.RecordBatch.from_arrays([b.column("node"), *made], ["node", "n", "shingles", "bits", "buckets"])

    ids = inside.select("node").distinct()
    wanted = members.where("buckets IS NOT NULL").join(ids, "node").select(F.col("doc").alias("w_doc"), F.col("x").alias("w_x"), F.col("y").alias("w_y"), "node", "buckets")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), *text_name(), "text")
    on = (F.col("x") == F.col("w_x")) & (F.col("y") == F.col("w_y")) & F.col("doc").eqNullSafe(F.col("w_doc"))
    rows = texts.join(wanted, on).select("node", "buckets", "text")
    return rows.repartition("node").mapInArrow(run, "node long, n long, shingles binary, bits binary, buckets binary")


def matrix(column: pa.Array, kind=U64) -> np.ndarray:
    """A column of equally long byte strings as a matrix."""
    blobs = column.to_pylist()
    return np.frombuffer(b"".join(blobs), kind).reshape(len(blobs), -1)


def may_be_alike(n: np.ndarray, m: np.ndarray, bits: np.ndarray, other: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Whether sets of n and m elements with these bitmaps can reach the threshold (never false for those that do)."""
    far = np.bitwise_count(bits ^ other).sum(-1, dtype=np.int64)
    return (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & ((100 + percent) * far <= (100 - percent) * (n + m))


def alike(x: np.ndarray, y: np.ndarray, percent: int = PERCENT) -> bool:
    if not len(x) or not len(y):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def with_pivots(inside: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links u, v between the members of a bucket and its pivot. Spark may split the joins where one pivot is in many pairs."""

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                n, m = b.column("n").to_numpy(), b.column("p_n").to_numpy()
                ok = may_be_alike(n, m, matrix(b.column("bits")), matrix(b.column("p_bits")), percent)
                yield b.select(["u", "v"]).filter(pa.array(ok))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [alike(np.frombuffer(x, U64), np.frombuffer(y, U64), percent) for x, y in zip(b.column("a").to_pylist(), b.column("b").to_pylist(), strict=True)]
            yield b.select(["u", "v"]).filter(pa.array(ok, pa.bool_()))

    facts = sets.select(F.col("node").alias("u"), "n", "bits")
    pivots = sets.select(F.col("node").alias("v"), F.col("n").alias("p_n"), F.col("bits").alias("p_bits"))
    # Dealt by the member, whose pairs are few: repeated ones meet, and so does what is known of it.
    pairs = inside.where("node <> pivot").select(F.col("node").alias("u"), F.col("pivot").alias("v")).repartition("u").distinct()
    near = pairs.join(facts, "u").join(pivots, "v").select("u", "v", "n", "p_n", "bits", "p_bits").mapInArrow(possible, "u long, v long")
    both = near.join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("a")), "u").join(sets.select(F.col("node").alias("v"), F.col("shingles").alias("b")), "v")
    return both.select("u", "v", "a", "b").mapInArrow(compare, "u long, v long")


def cells(inside: DataFrame, found: DataFrame) -> DataFrame:
    """bucket, i, j, role, node, component: what is left to compare after `found` (u, v: a node and its component).

    Those outside a bucket's largest component are dealt over i and stand in all j, in role ASKS; the members the other
    way round, in role HOME or AWAY. Of equally large components the one with the largest number is home. There are as many parts as keep a cell's sets to about CELL shingles a side.
    """
    weight = F.greatest(F.col("n"), F.lit(LIGHTEST))
    now = inside.join(found.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").withColumn("component", F.coalesce("component", "node"))
    parts = now.groupBy("bucket", "component").agg(F.sum(weight).alias("weight"))
    open_ = parts.groupBy("bucket").agg(F.count("*").alias("many"), F.sum("weight").alias("all"), F.max("weight").alias("most"), F.max_by("component", F.struct("weight", "component")).alias("home")).where("many > 1")
    open_ = open_.select("bucket", "home", F.ceil(F.col("all") / CELL).cast("int").alias("js"), F.ceil((F.col("all") - F.col("most")) / CELL).cast("int").alias("is"))
    rows = now.join(open_, "bucket")
    deal = lambda seed, parts: F.pmod(F.xxhash64(F.lit(seed), "node"), F.col(parts)).cast("int")
    every = lambda parts: F.sequence(F.lit(0), F.col(parts) - 1)
    role = F.when(F.col("component") == F.col("home"), F.lit(HOME)).otherwise(F.lit(AWAY))
    asking = rows.where("component <> home").select("bucket", deal(1, "is").alias("i"), F.explode(every("js")).alias("j"), F.lit(ASKS).alias("role"), "node", "component")
    return asking.unionByName(rows.select("bucket", F.explode(every("is")).alias("i"), deal(2, "js").alias("j"), role.alias("role"), "node", "component"))


def groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """The runs of rows with equal keys in sorted batches; a run is held until it ends."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        k = np.column_stack([b.column(c).to_numpy().astype(np.int64) for c in keys])
        edges = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1).tolist(), b.num_rows]
        for a, z in zip(edges[:-1], edges[1:], strict=True):
            if held and tuple(k[a]) != last:
                yield pa.concat_batches(held) if len(held) > 1 else held[0]
                held = []
            held.append(b.slice(a, z - a))
            last = tuple(k[a])
    if held:
        yield pa.concat_batches(held) if len(held) > 1 else held[0]


def pairs_of(cell: pa.RecordBatch, percent: int = PERCENT) -> Iterator[tuple[int, np.ndarray]]:
    """(row, rows) of a cell: one that asks and those it may be alike, in other components, if this is their first common bucket.

    Of two outside the largest component, which meet in both roles, the larger one asks.
    """
    node, component, n, role = (cell.column(c).to_numpy() for c in ("node", "component", "n", "role"))
    asking, members = np.flatnonzero(role == ASKS), np.flatnonzero(role != ASKS)
    if not len(asking) or not len(members):
        return
    bits, places, bucket = matrix(cell.column("bits")), matrix(cell.column("buckets"), np.int64), cell.column("bucket")[0].as_py()
    home = role[members] == HOME
    for o in asking.tolist():
        at = members[(component[members] != component[o]) & (home | (node[members] < node[o]))]
        at = at[may_be_alike(n[o], n[at], bits[o], bits[at], percent)]
        if len(at):
            at = at[places[o][(places[at] == places[o]).argmax(1)] == bucket]
        if len(at):
            yield o, at


def rest(inside: DataFrame, found: DataFrame, sets: DataFrame, work: common.Work, percent: int = PERCENT) -> DataFrame | None:
    """Links u, v that connect what `found` leaves apart; None if no pair is left."""
    grid, keys = "bucket long, i int, j int, role int, node long, component long", ("bucket", "i", "j")

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartition(*keys).sortWithinPartitions(*keys)

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in groups(batches, keys):
            keep = np.zeros(cell.num_rows, bool)
            for o, at in pairs_of(cell, percent):
                keep[o] = True
                keep[at] = True
            if keep.any():
                yield cell.select([*keys, "role", "node", "component"]).filter(pa.array(keep))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in groups(batches, keys):
            node, component = cell.column("node").to_pylist(), cell.column("component").to_pylist()
            sets = [np.frombuffer(x, U64) for x in cell.column("shingles").to_pylist()]
            root, found = {c: c for c in component}, []

            def find(c, root=root):
                while root[c] != c:
                    root[c] = c = root[root[c]]
                return c

            for o, at in pairs_of(cell, percent):
                for k in at.tolist():
                    a, b = find(component[o]), find(component[k])
                    if a != b and alike(sets[o], sets[k], percent):
                        root[max(a, b)] = min(a, b)
                        found.append((node[o], node[k]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["u", "v"])

    facts = sets.select("node", "n", "bits", "buckets")
    left = work.keep("cells", dealt(cells(inside, found).join(facts, "node").select(*keys, "role", "node", "component", "n", "bits", "buckets")).mapInArrow(possible, grid))
    if not left.count():
        return None
    full = left.join(sets, "node").select(*keys, "role", "node", "component", "n", "bits", "buckets", "shingles")
    return dealt(full).mapInArrow(compare, "u long, v long")


def near_duplicates(docs: DataFrame, percent: int = PERCENT, n_bands: int = BANDS, rows: int = ROWS, shingle: int = SHINGLE) -> DataFrame:
    """doc, x, y (128-bit name of the text), n, component (the smallest doc_id that links lead to) and kept of each row of docs."""
    common.bounded_batches(docs.sparkSession)
    work = common.Work(docs.sparkSession, "minhash")
    members = work.keep("members", classes(work.keep("sketches", sketches(docs, n_bands, rows, shingle))))
    work.drop("sketches")
    inside = work.keep("inside", buckets_shared(members))
    sets = work.keep("sets", shingle_sets(docs, members, inside, shingle))
    found = stars(work.keep("links", same_document(members).union(with_pivots(inside, sets, percent))), work, "found")
    more = rest(inside, found, sets, work, percent)
    if more is not None:
        found = stars(work.keep("more", found.union(more)), work, "all")
    work.drop("inside", "sets", "links", "cells", "more")

    # A component's smallest doc_id, by its nodes; of rows, only members are joined, once.
    nodes = found.select(F.col("u").alias("node"), F.col("v").alias("root")).union(found.select("v", "v").distinct())
    lowest = nodes.join(members.where("buckets IS NOT NULL OR n = 0").select("node", "low"), "node").groupBy("root").agg(F.min("low").alias("lowest"))
    named = work.keep("named", nodes.join(lowest, "root").select("node", "root", "lowest"))
    out = members.join(named, "node", "left").withColumn("component", F.coalesce("lowest", "low"))
    nameless = F.col("doc").isNull() & F.col("component").isNull() & F.coalesce(F.col("node") == F.col("root"), F.lit(True))
    return out.select("doc", "x", "y", "n", "component", (F.coalesce(F.col("doc") == F.col("component"), F.lit(False)) | nameless).alias("kept"))


def report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row of docs."""
    return near_duplicates(docs, **options).select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), "kept")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs whose document stands for its component, with all their columns."""
    work = common.Work(docs.sparkSession, "minhash-kept")
    gone = work.keep("gone", near_duplicates(docs, **options).where("NOT kept").select("doc", "x", "y").distinct())
    inner = common.renamed(docs)
    numbered = work.keep("numbered", gone.where("doc IS NOT NULL").select("doc").distinct())
    nameless = work.keep("nameless", gone.where("doc IS NULL").select("x", "y"))
    text, doc = inner.of("text"), inner.col("doc_id").cast("long")
    out = inner.df.join(numbered, doc == F.col("doc"), "left_anti")
    named = [F.when(doc.isNull(), F.xxhash64(F.lit(i), text)) for i in (1, 2)]
    out = out.join(nameless, (named[0] == F.col("x")) & (named[1] == F.col("y")), "left_anti")
    return out.select(*inner.restored())


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(common.table(spark, sf_dir, "documents"))


#: Sets of shingle strings, joined on equal shingles; components by recursion.
ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                                 ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
  FROM words
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), links AS (
  SELECT p.u, p.v FROM (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS both FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL) p
  JOIN sizes x ON x.doc_id = p.u JOIN sizes y ON y.doc_id = p.v
  WHERE 100 * p.both >= 75 * (x.n + y.n - p.both)
), reached AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION
  SELECT r.doc_id, l.v FROM reached r JOIN links l ON r.other = l.u
), lowest AS (
  SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id
)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, l.component_id, d.doc_id = l.component_id AS kept
FROM documents d JOIN lowest l USING (doc_id) LEFT JOIN sizes s USING (doc_id)
"""
