"""Benchmark decontamination by spaced seeds.

A seed is a fixed mask over consecutive tokens that looks at some positions and ignores the others, so a hit
survives substitutions at ignored places. Seeds of the test items and of the training texts are joined on their hashes; the
texts round a hit are laid side by side in all ways, and a stretch (+1 for an equal token, -2 for another, above 0
from its first token on) must hold enough equal tokens. The masks are all the ways in which such a stretch can begin: none is
missed. Of an item of which SHARE is enough, equal tokens count in all places, however the others lie, and it has masks of its
own (SHORT); an item of fewer than LEAST tokens must occur as it is. Tokens are words lower-cased and stripped of what is
neither letter nor digit.

1. Items, cut into overlapping pieces that any stretch's deciding part fits in, become a table of pieces and seeds.
2. A bitmap of the seeds' hashes, of 2**MOST_BITS bits at most however large the benchmark, goes to all tasks. A text's
   place goes on only if the bitmap has its seed; masks with the same first ROOT positions share one hash that rules out
   nearly all places first. What goes on are regions: some tokens round near hits, with the hits' hashes.
3. Regions and pieces are joined on hashes and their pairs verified, each pair once. Spark may split the joins where a passage
   is in many texts.

Texts are neither shuffled nor sorted. A pair costs at most REGION x PIECE steps, in numpy, whatever repeats in it.

Cases: null or empty text holds nothing; an item without tokens is not searched; very long texts and items are searched whole;
repeated rows and items give repeated hits; several items in one text are all found; rows with a null doc_id are reported together
but dropped by their own text; with an empty table nothing is found; other columns of either table stay or are not read,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common

U64 = np.uint64
LEAST, ENOUGH, SHARE = 5, 12, 0.8
#: Tokens of a piece of an item, and of those that it shares with the next one.
PIECE, SHARED = 512, 32
#: A region begins BACK tokens before its first hit, ends AHEAD after its last, and spans REGION places of hits; hits farther
#: apart than AHEAD are in different ones. ENOUGH equal tokens with a score above 0 lie within 17; a short item has 15.
BACK, AHEAD, REGION = 15, 32, 4096
#: Places that are looked at together: working memory follows this, not the texts.
WINDOW = 1 << 17
#: Bits of the bitmap: 64 a seed, between these powers of 2.
LEAST_BITS, MOST_BITS = 18, 28


def beginnings(weight: int) -> tuple[str, ...]:
    """How a stretch whose score stays above 0 can begin, up to its weight-th equal token."""
    out = [("1", 1)]
    for _ in range(weight - 1):
        out = [(m + "0" * k + "1", score - 2 * k + 1) for m, score in out for k in range((score + 1) // 2)]
    return tuple(m for m, _ in out)


MASKS, ROOT = beginnings(7), 4
#: For items of which SHARE is enough: with so few tokens replaced, wherever, one of these fits between them.
SHORT = (*beginnings(5), "110111", "101111", "1111001")


def root(mask: str) -> str:
    """The mask up to its ROOT-th position looked at."""
    return mask[: [i for i, c in enumerate(mask) if c == "1"][:ROOT][-1] + 1]


class Words:
    """Hashes of normalised tokens; remembers a bounded number of spellings. 0 stands for no token."""

    def __init__(self, remembered: int = 150_000):
        import xxhash

        self.hash, self.known, self.most = xxhash.xxh3_64_intdigest, {}, remembered

    def one(self, word: bytes) -> int:
        text = word.decode("utf-8", "replace").lower()
        start, end = 0, len(text)
        while start < end and not text[start].isalnum():
            start += 1
        while end > start and not text[end - 1].isalnum():
            end -= 1
        return self.hash(text[start:end]) or 1 if end > start else 0

    def __call__(self, text: bytes | None) -> np.ndarray:
        words = text.split() if text else []
        if len(self.known) > self.most:
            self.known = {}
        known = self.known
        try:
            out = np.array([known[w] for w in words], U64)
        except KeyError:
            for w in words:
                if w not in known:
                    known[w] = self.one(w)
            out = np.array([known[w] for w in words], U64)
        return out[out != 0]


def seeds(tokens: np.ndarray, mask: str, at: np.ndarray | None = None, grown: tuple[str, np.ndarray] | None = None) -> np.ndarray:
    """The hash of each place's seed under the mask, or of the places `at`; `grown` is a beginning of the mask and its hashes there."""
    n = max(0, len(tokens) - len(mask) + 1)
    done, h = grown or ("", np.full(n if at is None else len(at), 0x9E3779B97F4A7C15, U64))
    for i, c in enumerate(mask):
        if c == "1" and i >= len(done):
            h = (h ^ (tokens[i : i + n] if at is None else tokens[at + i])) * U64(0xFF51AFD7ED558CCD)
            h ^= h >> U64(32)
    return h


def salt(mask: str, kind: str = "seed") -> np.uint64:
    import xxhash

    return U64(xxhash.xxh3_64_intdigest(f"{kind}:{mask}"))


def scattered(h: np.ndarray, by: np.uint64) -> np.ndarray:
    """The hash that is looked up and joined: it knows its mask, and all its bits are worth the same."""
    h = (h ^ by) * U64(0x9E3779B97F4A7C15)
    return (h ^ (h >> U64(29))) * U64(0xBF58476D1CE4E5B9)


def short(n: int, enough: int = ENOUGH, share: float = SHARE) -> bool:
    return share * n <= enough


def needed(n: int, enough: int = ENOUGH, share: float = SHARE) -> int:
    """Equal tokens that tell an item of n tokens."""
    return n if n < LEAST else max(LEAST, min(enough, int(np.ceil(share * n))))


def kind_of(n: int) -> int:
    """What tells which masks an item of n tokens has: n itself, or LEAST (short) or more."""
    return min(n, LEAST) if short(n) else LEAST + 1


def masks_of(kind: int) -> tuple[str, ...]:
    return ("1" * kind,) if kind < LEAST else SHORT if kind == LEAST else MASKS


def all_masks(kinds: Iterable[int]) -> dict[str, list[str]]:
    """root: its masks, of items of these kinds."""
    out: dict[str, list[str]] = {}
    for m in dict.fromkeys(m for kind in sorted(kinds) for m in masks_of(kind)):
        out.setdefault(root(m), []).append(m)
    return out


def pieces_of(tokens: np.ndarray) -> list[np.ndarray]:
    """An item's tokens in pieces; each run of SHARED tokens lies in one."""
    return [tokens[i : i + PIECE] for i in range(0, max(1, len(tokens) - SHARED), PIECE - SHARED)]


def keys_of(piece: np.ndarray, masks: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of a piece's seeds, and those of their roots."""
    whole = [scattered(seeds(piece, m), salt(m)) for m in masks]
    first = [scattered(seeds(piece, r), salt(r, "root")) for r in dict.fromkeys(map(root, masks))]
    return np.unique(np.concatenate(whole)), np.unique(np.concatenate(first))


def equal_tokens(doc: np.ndarray, piece: np.ndarray, is_short: bool) -> int:
    """The most equal tokens in a stretch whose score stays above 0, or in a whole short item, over all ways to lay both side by side."""
    n, m = len(doc), len(piece)
    padded = np.concatenate([np.zeros(m - 1, U64), doc, np.zeros(m - 1, U64)])
    ways = n + m - 1
    score, equal, best = (np.zeros(ways, np.int32) for _ in range(3))
    for i in range(m):
        same = padded[i : i + ways] == piece[i]
        if is_short:
            best += same
            continue
        score += np.where(same, 1, -2).astype(np.int32)
        equal += same
        ended = score <= 0
        score[ended] = 0
        equal[ended] = 0
        np.maximum(best, equal, out=best)
    return int(best.max())


class Finder:
    """Looks for places of texts whose seeds a bitmap of 2**bits bits has; kinds are those of the items."""

    def __init__(self, bitmap: np.ndarray, bits: int, kinds: Iterable[int]):
        self.bitmap, self.shift = bitmap, U64(64 - bits)
        self.masks = [(r, salt(r, "root"), [(m, salt(m)) for m in own]) for r, own in all_masks(kinds).items()]

    def maybe(self, keys: np.ndarray) -> np.ndarray:
        at = keys >> self.shift
        return (self.bitmap[at >> U64(3)] >> (at & U64(7)).astype(np.uint8)) & 1 == 1

    def hits(self, every: np.ndarray, ends: np.ndarray, low: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of hits among WINDOW places from `low` on, and their hashes; ends are those of the texts in `every`."""
        for first, by, own in self.masks:
            s = seeds(every[low : low + WINDOW + len(first) - 1], first)
            at = np.flatnonzero(self.maybe(scattered(s, by)))
            if not len(at):
                continue
            s, at = s[at], at + low
            row = np.searchsorted(ends, at, "right")
            for mask, seed_by in own:
                inside = at + len(mask) <= ends[row]
                p = at[inside]
                k = scattered(seeds(every, mask, p, (first, s[inside])), seed_by)
                there = self.maybe(k)
                if there.any():
                    yield p[there], k[there]

    def regions(self, docs: list[np.ndarray]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(row, first token's place in it, tokens, distinct hashes of the hits) of each region."""
        ends = np.cumsum([len(d) for d in docs])
        every = np.concatenate(docs) if docs else np.empty(0, U64)
        places, keys = [], []
        for low in range(0, len(every), WINDOW):
            for p, k in self.hits(every, ends, low):
                places.append(p)
                keys.append(k)
        p, k = (np.concatenate(x) if x else np.empty(0, U64) for x in (places, keys))
        if not len(p):
            return
        order = np.argsort(p, kind="stable")
        p, k = p[order], k[order]
        row = np.searchsorted(ends, p, "right")
        new = np.append(True, (row[1:] != row[:-1]) | (p[1:] - p[:-1] > AHEAD))
        run = np.cumsum(new) - 1
        part = (p - p[new][run]) // REGION
        starts = np.flatnonzero(new | np.append(True, part[1:] != part[:-1]))
        for a, z in zip(starts, np.append(starts[1:], len(p)), strict=True):
            r = int(row[a])
            begin = int(ends[r]) - len(docs[r])
            low, high = max(begin, int(p[a]) - BACK), min(int(ends[r]), int(p[z - 1]) + AHEAD)
            yield r, low - begin, every[low:high], np.unique(k[a:z])


def items(benchmark: DataFrame, work: common.Work) -> DataFrame:
    """k, item_id, tokens, is_short, enough, kind, seeds, roots of each piece of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for b in common.slices(batches):
            out = []
            for i, text in zip(b.column("item_id").to_pylist(), common.column_bytes(b.column("text")), strict=True):
                tokens = words(text)
                for piece in pieces_of(tokens) if len(tokens) else ():
                    found = keys_of(piece, masks_of(kind_of(len(tokens))))
                    out.append((i, piece.tobytes(), short(len(tokens)), needed(len(tokens)), kind_of(len(tokens)), *[x.view(np.int64) for x in found]))
            kinds = [pa.int64(), pa.binary(), pa.bool_(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            names = ["item_id", "tokens", "is_short", "enough", "kind", "seeds", "roots"]
            yield pa.RecordBatch.from_arrays([pa.array([o[j] for o in out], kind) for j, kind in enumerate(kinds)], names)

    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    made = rows.mapInArrow(run, "item_id long, tokens binary, is_short boolean, enough int, kind int, seeds array<long>, roots array<long>")
    return work.keep("items", made.select(F.monotonically_increasing_id().alias("k"), "*"))


def finder(pieces: DataFrame) -> Finder:
    """The bitmap of all seeds and roots, made by the executors in blocks of 4 KB."""
    by_kind = pieces.groupBy("kind").agg(F.sum(F.size("seeds") + F.size("roots"))).collect()  # LEAST + 1 kinds at most
    bits = min(MOST_BITS, max(LEAST_BITS, int(64 * sum(r[1] for r in by_kind)).bit_length()))
    at = pieces.select(F.explode(F.concat("seeds", "roots")).alias("key")).select(F.shiftrightunsigned("key", 64 - bits).alias("at"))
    block = at.groupBy(F.shiftright("at", 15).alias("block")).agg(F.bitmap_construct_agg(F.pmod("at", F.lit(1 << 15))).alias("bits"))
    bitmap = np.zeros(1 << (bits - 3), np.uint8)
    for r in block.collect():  # at most 2**(MOST_BITS - 15) blocks
        bitmap[r["block"] << 12 : (r["block"] + 1) << 12] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return Finder(bitmap, bits, [r[0] for r in by_kind])


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, x, y (128-bit name of the text), item_id, n_equal (in one region) for each text and each item of which it holds enough."""
    common.bounded_batches(docs.sparkSession)
    work = common.Work(docs.sparkSession, "decontamination")
    pieces = items(benchmark, work)
    shared = common.share(docs.sparkSession, finder(pieces))  # 2**(MOST_BITS - 3) bytes at most

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, finder = Words(), common.opened(shared)
        for b in common.slices(batches):
            found = list(finder.regions([words(t) for t in common.column_bytes(b.column("text"))]))
            if found:
                own = b.select(["row", "doc_id", "x", "y"]).take(pa.array([f[0] for f in found], pa.int64()))
                ends = np.cumsum([0, *[len(f[3]) for f in found]], dtype=np.int32)
                keys = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([f[3] for f in found]).view(np.int64)))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array([f[1] for f in found], pa.int64()), pa.array([f[2].tobytes() for f in found], pa.binary()), keys], [*own.schema.names, "at", "region", "keys"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = [b.column(c).to_pylist() for c in ("region", "tokens", "is_short")]
            n = pa.array([equal_tokens(np.frombuffer(r, U64), np.frombuffer(t, U64), s) for r, t, s in zip(*columns, strict=True)], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.select(["doc_id", "x", "y", "item_id", "enough"]).columns, n], ["doc_id", "x", "y", "item_id", "enough", "n_equal"])

    names = [F.when(F.col("text").isNotNull(), F.xxhash64(F.lit(i), "text")).alias(c) for i, c in ((1, "x"), (2, "y"))]
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), *names, "text")
    regions = work.keep("regions", rows.mapInArrow(look, "row long, doc_id long, x long, y long, at long, region binary, keys array<long>"))
    hits = regions.select("row", "at", F.explode("keys").alias("key")).join(pieces.select("k", F.explode("seeds").alias("key")), "key")
    pairs = hits.select("row", "at", "k").distinct()
    both = pairs.join(regions.drop("keys"), ["row", "at"]).join(pieces.select("k", "item_id", "tokens", "is_short", "enough"), "k")
    checked = both.select("doc_id", "x", "y", "item_id", "enough", "region", "tokens", "is_short").mapInArrow(verify, "doc_id long, x long, y long, item_id long, enough int, n_equal long")
    return work.keep("leaks", checked.where("n_equal >= enough").groupBy("doc_id", "x", "y", "item_id").agg(F.max("n_equal").alias("n_equal")))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_items, item_ids, n_equal (of the item held most) of each contaminated document."""
    return leaks(docs, benchmark).groupBy("doc_id").agg(F.count_distinct("item_id").alias("n_items"), F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.max("n_equal").alias("n_equal"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no test item, with all their columns."""
    gone = leaks(docs, benchmark).select(F.col("doc_id").alias("g_doc"), "x", "y").distinct()
    gone = common.Work(docs.sparkSession, "decontaminated").keep("gone", gone)
    inner = common.renamed(docs)
    doc, text = inner.col("doc_id").cast("long"), inner.col("text")
    on = doc.eqNullSafe(F.col("g_doc")) & (F.xxhash64(F.lit(1), text) == F.col("x")) & (F.xxhash64(F.lit(2), text) == F.col("y"))
    return inner.df.join(gone, on, "left_anti").select(*inner.restored())


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
