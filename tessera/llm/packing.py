"""Best-fit packing of tokenised documents into sequences by large-item matching.

Documents are cut only where they are longer than a sequence. How pieces are best laid together depends on nothing but how
many there are of each length, and there are no more lengths than tokens in a sequence; so the driver plans with
one count a length, however many documents there are, and the plan says in runs what happens to the first, second, ...
piece of a length:

1. Two pieces of over a third of the capacity at most share a sequence. From the longest down, each takes the longest
   partner that still fits: the matching that leaves the fewest alone.
2. Shorter pieces, from the longest down, go where they leave the smallest gap; where none has room, a new sequence begins.

A piece finds its place by its number among those of its length: its task counts its own pieces, and the sums over earlier
tasks are joined. No window, sort or task sees all the pieces of a length.

Tokens: most pre-tokens come again and again, so a worker remembers the ids of those it has seen, as bytes, and joins
them; the tokenizer merges only new ones. In texts of Latin letters one regular expression finds the pre-tokens; others are cut
by the tokenizer's own pre-tokenizer; those that hold a special token's string go to it whole.

Cases: null or empty text is one piece of the end token alone; documents longer than the capacity are cut in pieces of it,
the first one shorter unless it divides the length; very long texts are read whole; rows that repeat a doc_id, or have none, are
documents of their own; equal lengths are interchangeable, so ties decide only which of them lies where; an empty table gives
an empty result; other columns do not matter, whatever their names.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import common
from tessera.llm.token_counts import byte_alphabet

CAPACITY, END = 1024, 2
#: Code points that every engine sorts into letters, numbers, spaces and others alike, as ranges.
PLAIN = ((0x09, 0x0D), (0x20, 0x7E), (0xA1, 0xAC), (0xAE, 0x24F), (0x2010, 0x2027), (0x2030, 0x205E), (0x20AC, 0x20AC))


class Encoder:
    """Token ids of texts, as bytes of unsigned 32-bit numbers; `remembered` bounds the memory of pre-tokens."""

    def __init__(self, tokenizer_json: str, pattern: str, remembered: int = 400_000):
        import re

        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(tokenizer_json)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.letters, self.most = [c for _, c in sorted(byte_alphabet().items())], remembered
        plain = [chr(c) for a, z in PLAIN for c in range(a, z + 1)]
        of = lambda kind: "".join(re.escape(c) for c in plain if unicodedata.category(c)[0] == kind)
        numbers, letters = of("N"), of("L")
        pattern = pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^\s{letters}{numbers}]").replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{numbers}]")
        try:
            found = re.compile(pattern)
            self.find, self.iterate = found.findall, found.finditer
            self.odd = re.compile("[^" + "".join(f"\\u{a:04x}-\\u{z:04x}" for a, z in PLAIN) + "]").search
        except re.error:  # a pattern that needs more than letters and numbers: the tokenizer cuts all texts
            self.odd = lambda text: True
        self.whole = self.tok.normalizer is not None
        self.known: dict[str, bytes] = {}
        self.known_letters: dict[str, bytes] = {}

    def merged(self, letters: str) -> bytes:
        return np.array([t.id for t in self.tok.model.tokenize(letters)], "<u4").tobytes()

    def joined(self, pieces: list[str], known: dict[str, bytes], raw: bool) -> bytes:
        try:
            return b"".join(map(known.__getitem__, pieces))
        except KeyError:
            if len(known) > self.most:
                known.clear()
            for p in pieces:
                if p not in known:
                    known[p] = self.merged("".join([self.letters[b] for b in p.encode()]) if raw else p)
            return b"".join(map(known.__getitem__, pieces))

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.whole or any(s in text for s in self.special):
            return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if self.odd(text):
            return self.joined([p for p, _ in self.tok.pre_tokenizer.pre_tokenize_str(text)], self.known_letters, False)
        if len(text) <= 1 << 20:
            return self.joined(self.find(text), self.known, True)
        out, some = [], []
        for m in self.iterate(text):  # not all pre-tokens of a very long text at once
            some.append(m[0])
            if len(some) == 1 << 16:
                out.append(self.joined(some, self.known, True))
                some = []
        return b"".join([*out, self.joined(some, self.known, True)])


def lengths(n: int, capacity: int = CAPACITY) -> list[int]:
    """The lengths of the pieces of a document of n tokens; only the first may be shorter than the capacity."""
    if n <= capacity:
        return [n]
    first = n % capacity
    return [first] * bool(first) + [capacity] * (n // capacity)


def pieces(docs: DataFrame, tokenizer_path: str, pattern: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids (unsigned 32-bit, little-endian), and the piece's number `nth` among those of its length in its task `part`."""
    with open(tokenizer_path, encoding="utf-8") as f:
        source = f.read()
    shared = docs.sparkSession.sparkContext.broadcast((source, pattern))  # as large as the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, key = common.per_worker(), ("packing", hash(shared.value[0]), pattern)
        if key not in kept:
            kept[key] = Encoder(*shared.value)
        encode, part, seen = kept[key], TaskContext.get().partitionId(), [0] * (capacity + 1)
        last = int(end).to_bytes(4, "little")
        for b in common.slices(batches, most=4 << 20):
            doc, number, start, length, ids, nth = [], [], [], [], [], []
            for who, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                data, at = encode(text) + last, 0
                for k, n in enumerate(lengths(len(data) // 4, capacity)):
                    doc.append(who)
                    number.append(k)
                    start.append(at)
                    length.append(n)
                    ids.append(data[4 * at : 4 * (at + n)])
                    nth.append(seen[n])
                    seen[n] += 1
                    at += n
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary()), pa.array([part] * len(doc), pa.int32()), pa.array(nth, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids", "part", "nth"],
            )

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary, part int, nth long")


@dataclass
class Plan:
    """Where the pieces of each length go, in runs: `count` pieces from the `first`-th on fill sequences from `sequence` on, `each` to one, from `offset`."""

    capacity: int
    runs: list[tuple[int, int, int, int, int]] = field(default_factory=list)  # length, first, sequence, each, offset
    sequences: int = 0

    def __post_init__(self) -> None:
        self.placed: dict[int, int] = {}
        self.gaps: dict[int, list[tuple[int, int]]] = {}  # room -> (first sequence, how many)

    def place(self, length: int, count: int, sequence: int, each: int, room: int) -> None:
        first = self.placed.get(length, 0)
        self.runs.append((length, first, sequence, each, self.capacity - room))
        self.placed[length] = first + count

    def opened(self, count: int) -> int:
        self.sequences += count
        return self.sequences - count

    def leave(self, room: int, sequence: int, count: int) -> None:
        if room and count:
            self.gaps.setdefault(room, []).append((sequence, count))

    def match(self, left: dict[int, int]) -> None:
        """Pieces of over a third of the capacity, two at most to a sequence."""
        for a in sorted(left, reverse=True):
            while left[a]:
                partners = [b for b in left if left[b] > (b == a) and b <= min(a, self.capacity - a)]
                b = max(partners, default=None)
                if b is None:
                    count, left[a] = left[a], 0
                    sequence = self.opened(count)
                    self.place(a, count, sequence, 1, self.capacity)
                    self.leave(self.capacity - a, sequence, count)
                    continue
                count = left[a] // 2 if a == b else min(left[a], left[b])
                sequence = self.opened(count)
                if a == b:
                    self.place(a, 2 * count, sequence, 2, self.capacity)
                else:
                    self.place(a, count, sequence, 1, self.capacity)
                    self.place(b, count, sequence, 1, self.capacity - a)
                left[a] -= count
                left[b] -= count
                self.leave(self.capacity - a - b, sequence, count)

    def fill(self, length: int, left: int) -> None:
        """`left` shorter pieces of one length, each where it leaves the smallest gap."""
        while left:
            room = min((r for r, groups in self.gaps.items() if groups and r >= length), default=None)
            if room is None:
                room, each = self.capacity, self.capacity // length
                sequence, many = self.opened(-(-left // each)), -(-left // each)
            else:
                each = room // length
                sequence, many = self.gaps[room].pop()
            full = min(many, left // each)
            if full:
                self.place(length, full * each, sequence, each, room)
                self.leave(room - each * length, sequence, full)
                left -= full * each
            if full < many and 0 < left < each:
                self.place(length, left, sequence + full, left, room)
                self.leave(room - left * length, sequence + full, 1)
                left, full = 0, full + 1
            self.leave(room, sequence + full, many - full)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """The plan for so many pieces of each length (1 to capacity)."""
    out = Plan(capacity)
    out.match({n: c for n, c in counts.items() if 3 * n > capacity})
    for n in sorted((n for n in counts if 3 * n <= capacity), reverse=True):
        out.fill(n, counts[n])
    return out


def pack(docs: DataFrame, tokenizer_path: str, pattern: str, capacity: int = CAPACITY, end: int = END, carried: Column | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids, sequence_id, offset of each piece of each document.

    `carried` is what goes along in place of ids, an expression over them.
    """
    work = common.Work(docs.sparkSession, "packing")
    carried = F.col("ids") if carried is None else carried
    cut = work.keep("pieces", pieces(docs, tokenizer_path, pattern, capacity, end).select("doc_id", "piece", "start", "length", carried, "part", "nth"))
    name = cut.columns[4]
    found = work.keep("counts", cut.groupBy("length", "part").agg(F.count("*").alias("n")))
    made = plan({r["length"]: r["n"] for r in found.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)  # `capacity` rows at most
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a task
    starts = found.select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    runs = np.array(sorted(made.runs), np.int64).reshape(-1, 5)
    shared = docs.sparkSession.sparkContext.broadcast(runs)  # its size depends on the capacity, not on the documents

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = shared.value
        begins = (runs[:, 0] << 48) + runs[:, 1]
        for b in batches:
            if not b.num_rows:
                continue
            length, number = b.column("length").to_numpy(), b.column("nth").to_numpy() + b.column("before").to_numpy()
            run = runs[np.searchsorted(begins, (length << 48) + number, "right") - 1]
            number = number - run[:, 1]
            made = [pa.array(run[:, 2] + number // run[:, 3]), pa.array(run[:, 4] + number % run[:, 3] * length)]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], *made], [*b.schema.names[:5], "sequence_id", "offset"])

    rows = cut.join(starts, ["length", "part"]).select("doc_id", "piece", "start", "length", name, "nth", "before")
    kind = cut.schema[name].dataType.simpleString()
    return rows.mapInArrow(place, f"doc_id long, piece int, start long, length long, `{name}` {kind}, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, n_pieces and ids of each sequence: its pieces, side by side. `packed` is what `pack` returns with ids."""
    parts = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))  # a sequence's pieces: as many as it has tokens, at most
    return parts.select("sequence_id", F.size("parts").alias("n_pieces"), F.aggregate("parts.ids", F.lit(b""), lambda a, x: F.concat(a, x)).alias("ids"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, carried=F.crc32("ids").alias("ids_crc32"))
