"""Token counts by the whole-token shortcut.

A byte-level BPE tokenizer first cuts a text into pre-tokens and then merges bytes inside each. Most
pre-tokens of running text are themselves vocabulary entries. Offline, on the driver, each vocabulary
string is put through the tokenizer alone: those that stay one pre-token and come out as exactly their own
id are *proved*; meeting one in a text adds 1 and needs no merging. Every other pre-token is merged once
per worker and remembered.

Cases: null text counts as empty (0 bytes, 0 tokens); a special token's string inside a text is one token,
as is the library's default; repeated rows give repeated results; any further columns are ignored.
Texts with code points on which two regular-expression engines could differ are cut by the tokenizer's own
pre-tokenizer, and the shortcut goes on from there; only texts that hold a special token's string go to it whole. Very long
texts are read whole; ties do not arise; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessera.llm import common

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte: itself where it is visible Latin-1, else the next code point from 256 on."""
    visible = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def proved_tokens(tokenizer_json: str) -> frozenset[str]:
    """The vocabulary strings that, alone, encode as one token: their own."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_str(tokenizer_json)
    back = {c: b for b, c in byte_alphabet().items()}
    special = {t.content for t in tok.get_added_tokens_decoder().values()}
    texts, ids = [], []
    for piece, i in tok.get_vocab(with_added_tokens=False).items():
        try:
            text = bytes(back[c] for c in piece).decode()
        except (KeyError, UnicodeDecodeError):
            continue
        if text and text not in special:
            texts.append(text)
            ids.append(i)
    encoded = tok.encode_batch(texts, add_special_tokens=False)
    alone = (t for t, i, e in zip(texts, ids, encoded, strict=True) if e.ids == [i])
    return frozenset(t for t in alone if len(tok.pre_tokenizer.pre_tokenize_str(t)) == 1)


class Counter:
    """Counts tokens of texts with one tokenizer; `remembered` bounds the memory of merged pre-tokens."""

    def __init__(self, tokenizer_json: str, pattern: str, proved: frozenset[str], remembered: int = 200_000):
        import regex
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(tokenizer_json)
        self.find = regex.compile(pattern).findall
        self.iterate = regex.compile(pattern).finditer
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.model, self.letters = self.tok.model, [c for _, c in sorted(byte_alphabet().items())]
        self.known = dict.fromkeys(proved, 1)
        self.most = len(proved) + remembered
        self.proved = proved
        self.stand_ins = dict.fromkeys(map(self.stand_in, proved), 1)  # the same in the pre-tokenizer's own letters
        self.cuts = self.tok.pre_tokenizer.pre_tokenize_str if self.tok.normalizer is None else None
        # Latin letters, digits, punctuation and the six ASCII spaces: here every engine agrees.
        self.odd = regex.compile(r"[^\x09-\x0D\x20-\x7E¡-¬®-ɏ‐-‧‰-⁞€]").search

    def stand_in(self, piece: str) -> str:
        return "".join([self.letters[b] for b in piece.encode()])

    def odd_pieces(self, text: str) -> int:
        """Tokens of a text that the tokenizer itself cuts into pre-tokens."""
        total, known = 0, self.stand_ins
        for p, _ in self.cuts(text):
            n = known.get(p)
            if n is None:
                n = len(self.model.tokenize(p))
                if len(p) <= 64:
                    if len(known) >= self.most:
                        known = self.stand_ins = dict.fromkeys(map(self.stand_in, self.proved), 1)
                    known[p] = n
            total += n
        return total

    def merge(self, piece: str) -> int:
        n = len(self.model.tokenize(self.stand_in(piece)))
        if len(piece) <= 64:
            if len(self.known) >= self.most:
                self.known = dict.fromkeys(self.proved, 1)
            self.known[piece] = n
        return n

    def pieces(self, pieces) -> int:
        total, get, merge = 0, self.known.get, self.merge
        for p in pieces:
            n = get(p)
            total += merge(p) if n is None else n
        return total

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        if any(s in text for s in self.special) or self.cuts is None:
            return len(self.tok.encode(text, add_special_tokens=False).ids)
        if self.odd(text):
            return self.odd_pieces(text)
        if len(text) > 1 << 20:
            return self.pieces(m[0] for m in self.iterate(text))
        return self.pieces(self.find(text))


def token_counts(docs: DataFrame, tokenizer_path: str, pattern: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of each row of docs. One narrow pass, no shuffle."""
    with open(tokenizer_path, encoding="utf-8") as f:
        source = f.read()
    shared = docs.sparkSession.sparkContext.broadcast((source, pattern, proved_tokens(source)))  # as large as the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, key = common.per_worker(), ("token_counts", hash(shared.value[0]), pattern)
        if key not in kept:
            kept[key] = Counter(*shared.value)
        count = kept[key]
        for batch in common.slices(batches):
            texts = batch.column("text").to_pylist()
            n = [count(t) for t in texts]
            size = pa.compute.binary_length(batch.column("text")).fill_null(0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), size, pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
