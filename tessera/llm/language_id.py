"""Language identification by a byte convolutional network.

A text is cut into windows of WINDOW bytes (the last one ends with the text), so all of it is read. Each byte becomes a
small vector; filters of several widths slide over the window; each filter's maximum over the window goes through a
rectifier into a softmax over the languages. The windows' log-probabilities, weighted by their bytes, are averaged over
the document. The network is trained here, in numpy, on the driver, from a bounded sample of labelled documents
(`per_lang` of each language, fewer where there are so many languages that they would pass MOST together, at least one;
WINDOWS windows each; the smallest hashes of doc_id, ties by doc_id and text hash, so reruns agree).

Cases: null text, or text without a letter, is `und` with score 0; a null lang is never learned; a null doc_id is never
learned from and never held out; very long texts are read whole, in bounded pieces; of languages that score alike the first by name is said; repeated rows get equal results;
without any labelled document every text is `und`; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import common

WINDOW, WIDTHS, FILTERS, EMBED = 192, (2, 3, 4, 5), 12, 8
WIDEST = max(WIDTHS)
PER_LANG, WINDOWS, MOST = 400, 6, 80_000


class Network:
    """Embedding -> filters of several widths (one matrix, zero beyond a filter's width) -> maximum -> softmax."""

    def __init__(self, n_out: int, seed: int = 7):
        r = np.random.default_rng(seed)
        n = FILTERS * len(WIDTHS)
        self.embed = r.normal(0, 0.5, (256, EMBED)).astype(np.float32)
        self.embed[0] = 0  # the padding
        self.mask = np.zeros((WIDEST, EMBED, n), np.float32)
        for i, w in enumerate(WIDTHS):
            self.mask[:w, :, i * FILTERS : (i + 1) * FILTERS] = 1
        self.mask = self.mask.reshape(WIDEST * EMBED, n)
        self.filters = (r.normal(0, 0.3, self.mask.shape) * self.mask).astype(np.float32)
        self.bias = np.zeros(n, np.float32)
        self.out = r.normal(0, 0.1, (n, n_out)).astype(np.float32)
        self.out_bias = np.zeros(n_out, np.float32)

    def columns(self, x: np.ndarray) -> np.ndarray:
        """x: windows x WINDOW bytes -> (windows, places, WIDEST * EMBED)."""
        padded = np.zeros((len(x), WINDOW + WIDEST - 1, EMBED), np.float32)
        padded[:, :WINDOW] = self.embed[x]
        s = padded.strides
        return np.ascontiguousarray(np.lib.stride_tricks.as_strided(padded, (len(x), WINDOW, WIDEST * EMBED), (s[0], s[1], s[2])))

    def log_probabilities(self, x: np.ndarray, block: int = 64) -> np.ndarray:
        out = []
        for i in range(0, len(x), block):
            c = self.columns(x[i : i + block])
            peak = (c.reshape(-1, c.shape[2]) @ self.filters).reshape(c.shape[0], WINDOW, -1).max(1)
            out.append(self.softmax(np.maximum(peak + self.bias, 0)))
        return np.concatenate(out) if out else np.empty((0, len(self.out_bias)), np.float32)

    def softmax(self, hidden: np.ndarray) -> np.ndarray:
        z = hidden @ self.out + self.out_bias
        z -= z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 8, batch: int = 64, rate: float = 3e-3, seed: int = 11) -> Network:
        r, step = np.random.default_rng(seed), 0
        names = ["embed", "filters", "bias", "out", "out_bias"]
        first = {k: np.zeros_like(getattr(self, k)) for k in names}
        second = {k: np.zeros_like(getattr(self, k)) for k in names}
        for epoch in range(epochs):
            order = r.permutation(len(x))
            for i in range(0, len(x), batch):
                at = order[i : i + batch]
                xb, yb = x[at].copy(), y[at]
                cut = r.random(len(xb)) < 0.3  # short texts occur too
                for k in np.flatnonzero(cut):
                    xb[k, r.integers(8, WINDOW) :] = 0
                c = self.columns(xb)
                z = (c.reshape(-1, c.shape[2]) @ self.filters).reshape(len(xb), WINDOW, -1)
                place = z.argmax(1)
                peak = np.take_along_axis(z, place[:, None], 1)[:, 0] + self.bias
                hidden = np.maximum(peak, 0)
                d = np.exp(self.softmax(hidden))
                d[np.arange(len(yb)), yb] -= 1
                d /= len(yb)
                back = (d @ self.out.T) * (peak > 0)
                seen = np.take_along_axis(c, place[:, :, None], 1)  # windows x filters x (WIDEST * EMBED)
                g = {"out": hidden.T @ d, "out_bias": d.sum(0), "bias": back.sum(0)}
                g["filters"] = np.einsum("bfk,bf->kf", seen, back) * self.mask
                to_bytes = (back[:, :, None] * self.filters.T[None]).reshape(len(xb), -1, WIDEST, EMBED)
                g["embed"] = np.zeros_like(self.embed)
                where = place[:, :, None] + np.arange(WIDEST)
                which = np.where(where < WINDOW, np.take_along_axis(xb, np.minimum(where, WINDOW - 1).reshape(len(xb), -1), 1).reshape(where.shape), 0)
                np.add.at(g["embed"], which.ravel(), to_bytes.reshape(-1, EMBED))
                g["embed"][0] = 0
                step += 1
                pace = rate * (1 - 0.9 * step / (epochs * -(-len(x) // batch)))
                for k in names:
                    first[k] = 0.9 * first[k] + 0.1 * g[k]
                    second[k] = 0.999 * second[k] + 0.001 * g[k] ** 2
                    move = (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
                    setattr(self, k, (getattr(self, k) - pace * move).astype(np.float32))
        return self


def windows(text: bytes) -> list[bytes]:
    """All of the text in windows; the last one ends with the text (and repeats bytes of the one before)."""
    if len(text) <= WINDOW:
        return [text.ljust(WINDOW, b"\0")]
    out = [text[i : i + WINDOW] for i in range(0, len(text) - WINDOW + 1, WINDOW)]
    return out + [text[-WINDOW:]] if len(text) % WINDOW else out


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, per_lang: int = PER_LANG, n: int = WINDOWS) -> list[tuple[str, list[str]]]:
    """lang and n pieces of text of at most per_lang documents of each language, the smallest hashes of doc_id."""
    learn = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    draw = F.xxhash64(F.lit(5), F.col("doc_id").cast("long"))
    langs = sorted(tuple(r) for r in learn.groupBy("lang").count().collect())  # one row a language
    if not langs:
        return []
    wanted = min(per_lang, max(1, MOST // len(langs)))
    # A share of all hashes that holds four times the wanted number or so; then the smallest of those.
    share = {a: min(1.0, (4 * wanted + 100) / c) for a, c in langs}
    bound = F.create_map(*[F.lit(v) for a, s in share.items() for v in (a, min(int((2 * s - 1) * (1 << 63)), (1 << 63) - 1))])
    start = lambda i: F.pmod(F.xxhash64(F.lit(i), F.col("doc_id").cast("long")), F.greatest(F.lit(1), F.length("text") - WINDOW)) + 1
    pieces = F.array(*[F.substring(F.col("text"), start(i).cast("int"), F.lit(WINDOW)) for i in range(n)])
    rows = learn.where(draw <= F.element_at(bound, F.col("lang"))).select("lang", draw.alias("draw"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("name"), pieces.alias("pieces"))
    first = Window.partitionBy("lang").orderBy("draw", "doc_id", "name")  # with the limit, a task sends no more than `wanted` of a language
    rows = rows.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= wanted).collect()
    return [(r["lang"], r["pieces"]) for r in sorted(rows, key=lambda r: (r["lang"], r["rank"]))]


def train(rows: list[tuple[str, list[str]]]) -> tuple[list[str], Network | None]:
    langs = sorted({a for a, _ in rows})
    if not langs:
        return [], None
    x, y = [], []
    for lang, pieces in rows:
        for p in dict.fromkeys(pieces):
            if any(c.isalpha() for c in p):
                x.append(p.encode()[:WINDOW].ljust(WINDOW, b"\0"))
                y.append(langs.index(lang))
    if not x:
        return [], None
    return langs, Network(len(langs)).train(np.frombuffer(b"".join(x), np.uint8).reshape(-1, WINDOW), np.array(y))


def predict(network: Network, texts: list[bytes]) -> np.ndarray:
    """Mean log-probabilities of each text, weighted by the windows' bytes."""
    cut = [windows(t) for t in texts]
    row = np.repeat(np.arange(len(texts)), [len(c) for c in cut])
    x = np.frombuffer(b"".join([w for c in cut for w in c]), np.uint8).reshape(-1, WINDOW)
    weight = np.maximum((x != 0).sum(1), 1).astype(np.float64)
    p = network.log_probabilities(x).astype(np.float64) * weight[:, None]
    total = np.zeros((len(texts), p.shape[1]))
    np.add.at(total, row, p)
    return total / np.bincount(row, weight, len(texts))[:, None]


def language_id(docs: DataFrame, per_lang: int = PER_LANG) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row of docs. One narrow pass over the texts."""
    langs, network = train(sample(docs, per_lang))
    shared = common.share(docs.sparkSession, (langs, network))  # 256 bytes, 48 filters, an output a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, network = common.opened(shared)
        for b in common.slices(batches, most=2 << 20):
            texts = b.column("text").to_pylist()
            known = [i for i, t in enumerate(texts) if t and network and any(c.isalpha() for c in t)]
            lang, score = ["und"] * len(texts), [0.0] * len(texts)
            if known:
                p = predict(network, [texts[i].encode() for i in known])
                best = p.argmax(1)
                total = np.exp(p).sum(1)
                for i, k, q in zip(known, best, np.exp(p[np.arange(len(known)), best]) / total, strict=True):
                    lang[i], score[i] = langs[k], float(min(1.0, q))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(lang), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(common.table(spark, sf_dir, "documents"))


