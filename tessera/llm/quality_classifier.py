"""Quality classifier with hierarchical empirical Bayes over sites.

Two logistic regressions on hashed words and a few shape features (trained here, in numpy, on a bounded sample of the
labels) give each document evidence for "good" and for "toxic". Sites lend it context: with labels where there are any and
the classifier's probabilities where not, summed by host and by (host, path), a host's rate of good documents is a Beta posterior
round the global rate, a path's one round its host's; the priors' strengths are estimated from how much hosts
and paths really differ (method of moments), so sites with few documents stay near the level above. A document's own
evidence then meets its path's rate in place of the global one; the rate is that of the *other* documents, so nothing counts twice.

A fifth of all documents (by a checksum of doc_id) is held out: their labels neither train nor enter a rate.

Grouped aggregation combines before it shuffles, and the join that brings the rates back is on a table of one row
a site, which Spark may broadcast if it is small or split where one host holds a third of all rows.

Cases: null or empty text has only the bias as evidence; null host or path is a site of its own; a null label or a label
without its document teaches nothing; of labels that disagree on a doc_id the worse one holds (the smaller quality, the larger toxic);
without labels every document has p_good 0.5 and p_toxic 0.1, and is kept; very long texts are read whole, in training too;
repeated rows get equal results; where sampled documents tie, the smaller doc_id and text hash come first; an empty table
gives an empty result; other columns, of documents or labels, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common

BITS = 18
SAMPLE = 8000
PREFIXES = (4, 5, 6, 7, 8)
#: Each regression looks at so many features of the sample, those whose share of positives is furthest from chance.
TELLING = 4000
SHAPES = 6


def hashed(text: bytes | None, known: dict[bytes, tuple[int, ...]]) -> np.ndarray:
    """The distinct words of a text and their beginnings of PREFIXES bytes, as numbers under 2**BITS.

    Words are lower-cased, without punctuation round them; beginnings carry over to forms the sample doesn't have.
    """
    import xxhash

    digest, out = xxhash.xxh3_64_intdigest, set()
    for w in set(text.split()) if text else ():
        n = known.get(w)
        if n is None:
            bare = w.lower().strip(b".,;:!?()[]{}\"'*#$%&|<>-_/")
            n = known[w] = tuple({digest(x) >> (64 - BITS) for x in [bare, *[b"^" + bare[:k] for k in PREFIXES if len(bare) >= k]]} if bare else ())
        out.update(n)
    return np.fromiter(out, np.int64, len(out))


def shape(text: bytes | None) -> np.ndarray:
    """Shares of symbols, capitals, marks and repeated words, in [0, 1], and two steps of the number of words."""
    words = text.split() if text else []
    n = len(words)
    if not n:
        return np.zeros(SHAPES)
    symbols = len(text) - len(text.translate(None, b"#*$%&|<>"))
    capitals = len(text) - len(text.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    marks = len(text) - len(text.translate(None, b"!?"))
    return np.array([min(1, 4 * symbols / n), min(1, 2 * capitals / len(text)), min(1, 2 * marks / n), 1 - len(set(words)) / n, n < 20, n < 60], float)


class Model:
    """Weights of both regressions: word weights, shape weights, bias. Evidence is a log-odds ratio to the base rate."""

    def __init__(self, words: np.ndarray, shapes: np.ndarray, bias: np.ndarray, base: np.ndarray):
        self.words, self.shapes, self.bias, self.base = words, shapes, bias, base

    def evidence(self, text: bytes | None, known: dict[bytes, tuple[int, ...]]) -> np.ndarray:
        return self.words[:, hashed(text, known)].sum(1) + self.shapes @ shape(text) + self.bias - logit(self.base)


def logit(p):
    return np.log(p) - np.log1p(-p)


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def tally(word: np.ndarray, weight: np.ndarray | None = None, row: np.ndarray | None = None, block: int = 1 << 20) -> np.ndarray:
    """How often each number under 2**BITS is there, or its sum of weight[row]; in blocks, as numpy works on copies of 8 bytes a number."""
    out = np.zeros(1 << BITS)
    for i in range(0, len(word), block):
        out += np.bincount(word[i : i + block], None if weight is None else weight[row[i : i + block]], 1 << BITS)
    return out


def marked(word: np.ndarray, those: np.ndarray, block: int = 1 << 20) -> np.ndarray:
    """those[word], in blocks."""
    out = np.empty(len(word), bool)
    for i in range(0, len(word), block):
        out[i : i + block] = those[word[i : i + block]]
    return out


def fit_one(row: np.ndarray, word: np.ndarray, shapes: np.ndarray, y: np.ndarray, steps: int = 600, rate: float = 0.05, l1: float = 5e-4) -> tuple[np.ndarray, np.ndarray, float]:
    """Logistic regression, classes weighted alike, by proximal Adam: the l1 penalty leaves few words with weight."""
    n, size = len(y), 1 << BITS
    held = tally(word)
    surprise = (tally(word, y, row) - held * y.mean()) ** 2 / np.maximum(held, 1)
    told = np.zeros(size, bool)
    told[np.argsort(-surprise, kind="stable")[:TELLING]] = True
    told &= held > 0
    kept = marked(word, told)
    row, word = row[kept], word[kept]
    seen, at = np.flatnonzero(told), (np.cumsum(told) - 1)[word]
    w, s, b = np.zeros(len(seen)), np.zeros(SHAPES), 0.0
    weight = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    m, v = np.zeros(len(seen) + SHAPES + 1), np.zeros(len(seen) + SHAPES + 1)
    for t in range(1, steps + 1):
        z = np.bincount(row, w[at], n) + shapes @ s + b
        e = weight * (sigmoid(z) - y)
        g = np.concatenate([np.bincount(at, e[row], len(seen)), shapes.T @ e, [e.sum()]])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-6)
        w = w - move[: len(seen)]
        pull = l1 * rate / (np.sqrt(v[: len(seen)] / (1 - 0.999**t)) + 1e-6)
        w = np.sign(w) * np.maximum(np.abs(w) - pull, 0)
        s, b = s - move[len(seen) : -1], b - move[-1]
    out = np.zeros(size)
    out[seen] = w
    return out, s, float(b)


def train(rows: list[tuple[np.ndarray, np.ndarray, int, int]]) -> Model:
    """rows: hashed words, shape, quality, toxic."""
    y = np.array([r[2:] for r in rows], float).reshape(-1, 2)
    base = np.clip((y.sum(0) + [1.0, 0.5]) / (len(y) + np.array([2.0, 2.0])), 0.01, 0.99)
    if not rows:
        return Model(np.zeros((2, 1 << BITS)), np.zeros((2, SHAPES)), logit(np.array([0.5, 0.1])), np.array([0.5, 0.1]))
    words = [r[0] for r in rows]
    row, word = np.repeat(np.arange(len(rows), dtype=np.int32), [len(w) for w in words]), np.concatenate(words)
    often = marked(word, tally(word) >= 3)
    row, word = row[often], word[often]
    shapes = np.array([r[1] for r in rows])
    fits = [fit_one(row, word, shapes, y[:, k]) for k in (0, 1)]
    # Trained on classes of equal weight, the log-odds are evidence beside any base rate; the bias moves it to ours.
    return Model(np.stack([f[0] for f in fits]), np.stack([f[1] for f in fits]), np.array([f[2] for f in fits]) + logit(base), base)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 4, F.lit(False))


def settled(labels: DataFrame) -> DataFrame:
    """doc_id, quality, toxic: one row a doc_id that isn't held out; of labels that disagree the worse one."""
    doc, quality, toxic = (F.col(c).cast(k).alias(c) for c, k in (("doc_id", "long"), ("quality", "int"), ("toxic", "int")))
    known = labels.select(doc, quality, toxic).where("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL").where(~held_out(F.col("doc_id")))
    return known.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))


def packed(words: np.ndarray) -> bytes:
    """Numbers under 2**BITS as they are, or as a bitmap where that is shorter: 32 KB at most, however long the text."""
    if 32 * len(words) <= 1 << BITS:
        return b"n" + words.astype("<i4").tobytes()
    there = np.zeros(1 << BITS, bool)
    there[words] = True
    return b"b" + np.packbits(there).tobytes()


def unpacked(blob: bytes) -> np.ndarray:
    if blob[:1] == b"n":
        return np.frombuffer(blob, "<i4", offset=1)
    return np.flatnonzero(np.unpackbits(np.frombuffer(blob, np.uint8, offset=1))).astype(np.int32)


def sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> list[tuple[np.ndarray, np.ndarray, int, int]]:
    """Hashed words, shape, quality and toxic of `most` labelled documents at most: those with the smallest hashes of doc_id.

    Features are made of whole texts where the texts are; at most 32 KB a document come to the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches):
            known: dict[bytes, tuple[int, ...]] = {}
            texts = common.column_bytes(b.column("text"))
            made = [pa.array([packed(np.sort(hashed(t, known))) for t in texts], pa.binary()), pa.array([shape(t).tolist() for t in texts], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *made], [*b.schema.names[:-1], "words", "shape"])

    draw = F.xxhash64(F.lit(3), F.col("doc_id"))
    chosen = settled(labels).sort(draw, "doc_id").limit(most)
    rows = docs.where("text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("name"), "text").join(F.broadcast(chosen), "doc_id")  # at most `most` rows
    made = rows.select("doc_id", "name", "quality", "toxic", "text").mapInArrow(run, "doc_id long, name long, quality int, toxic int, words binary, shape array<double>")
    got = made.sort(draw, "doc_id", "name").limit(most).select("words", "shape", "quality", "toxic").toArrow()
    return [(unpacked(w.as_py()), np.array(s.as_py()), q, t) for w, s, q, t in zip(got["words"], got["shape"], got["quality"].to_pylist(), got["toxic"].to_pylist(), strict=True)]


def evidence(docs: DataFrame, model: Model, host: str, path: str) -> DataFrame:
    """doc_id, host, path and the log-odds of good and toxic that each row's text gives."""
    shared = common.share(docs.sparkSession, model)  # 2 x 2**BITS weights, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, tuple[int, ...]] = {}
        model = common.opened(shared)
        for b in common.slices(batches):
            if len(known) > 500_000:
                known = {}
            e = np.array([model.evidence(t, known) for t in common.column_bytes(b.column("text"))]).round(6)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("host"), b.column("path"), pa.array(e[:, 0]), pa.array(e[:, 1])], ["doc_id", "host", "path", "good", "toxic"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), F.col(path).cast("string").alias("path"), "text")
    return rows.mapInArrow(run, "doc_id long, host string, path string, good double, toxic double")


def strength(between: str, mean: str, n: str) -> str:
    """Beta prior strength from the variance of rates between groups: m(1-m)/var - 1, kept in [1, 10000].

    The groups' own sampling variance m(1-m)/n is taken off first.
    """
    spread = f"{mean} * (1 - {mean})"
    return f"least(10000D, greatest(1D, coalesce({spread} / nullif(greatest({between} - {spread} / greatest({n}, 1D), 1e-9), 0) - 1, 10000D)))"


KINDS = ("good", "toxic")


def believed(scored: DataFrame, known: DataFrame, base: np.ndarray) -> DataFrame:
    """scored (doc_id, host, path, evidence good and toxic) with s_good and s_toxic: the label, or the classifier's probability."""
    out = scored.join(known.withColumnsRenamed({"quality": "l_good", "toxic": "l_toxic"}), "doc_id", "left")
    for k, c in enumerate(KINDS):
        out = out.withColumn(f"s_{c}", F.coalesce(F.col(f"l_{c}").cast("double"), F.expr(f"1 / (1 + exp(-greatest(-40D, least(40D, {c} + {float(logit(base[k]))}D))))")))
    return out.drop("l_good", "l_toxic")


def site_sums(soft: DataFrame) -> DataFrame:
    """host, path with its rows n and sums, its host's, everything's, and the strengths of both priors: one row a site."""
    paths = soft.groupBy("host", "path").agg(F.count("*").cast("double").alias("n"), *[F.sum(f"s_{c}").alias(f"path_{c}") for c in KINDS])
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), *[F.sum(f"path_{c}").alias(f"host_{c}") for c in KINDS])
    spread = [F.var_pop(F.col(f"host_{c}") / F.col("host_n")).alias(f"hosts_{c}") for c in KINDS]
    whole = hosts.agg(F.sum("host_n").alias("all_n"), *[F.sum(f"host_{c}").alias(f"all_{c}") for c in KINDS], *spread, (F.count("*") / F.sum(1 / F.col("host_n"))).alias("hosts_n"))
    out = hosts.withColumnRenamed("host", "h").crossJoin(F.broadcast(whole))  # one row of sums
    for c in KINDS:
        mean = f"(all_{c} / all_n)"
        out = out.withColumn(f"host_k_{c}", F.expr(strength(f"hosts_{c}", mean, "hosts_n")))
        out = out.withColumn(f"rate_{c}", F.expr(f"(host_{c} + host_k_{c} * {mean}) / (host_n + host_k_{c})"))
    inside = paths.join(out, F.col("host").eqNullSafe(F.col("h"))).drop("h")
    differ = inside.agg(*[F.avg((F.col(f"path_{c}") / F.col("n") - F.col(f"rate_{c}")) ** 2).alias(f"paths_{c}") for c in KINDS], (F.count("*") / F.sum(1 / F.col("n"))).alias("paths_n"))
    inside = inside.crossJoin(F.broadcast(differ))  # one row of sums
    for c in KINDS:
        inside = inside.withColumn(f"path_k_{c}", F.expr(strength(f"paths_{c}", f"rate_{c}", "paths_n")))
    return inside.select("host", "path", "n", "host_n", "all_n", *[f"{a}_{c}" for c in KINDS for a in ("path", "host", "all", "host_k", "path_k")])


def rate_of_others(c: str, base: float) -> Column:
    """The posterior rate of a document's path, of all documents but itself (s_good or s_toxic is its own share).

    Everything is worth one document of the base rate more, so that a lone document has a rate too.
    """
    everything = f"((all_{c} - s_{c} + {base}D) / all_n)"
    host = f"((host_{c} - s_{c} + host_k_{c} * {everything}) / (host_n - 1 + host_k_{c}))"
    return F.expr(f"least(0.99D, greatest(0.002D, (path_{c} - s_{c} + path_k_{c} * {host}) / (n - 1 + path_k_{c})))")


def quality_classifier(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", threshold: float = 0.5, toxic_from: float = 0.4, most: int = SAMPLE) -> DataFrame:
    """doc_id, p_good, p_toxic, site_good, site_toxic, toxic, kept, held_out of each row of docs."""
    model = train(sample(docs, labels, most))
    work = common.Work(docs.sparkSession, "quality-classifier")
    scored = work.keep("scored", believed(evidence(docs, model, host, path), settled(labels), model.base))
    sites = site_sums(scored).withColumnsRenamed({"host": "h", "path": "p"})
    out = scored.join(sites, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("p")), "left")
    for k, c in enumerate(KINDS):
        out = out.withColumn(f"site_{c}", rate_of_others(c, float(model.base[k])))
        out = out.withColumn(f"p_{c}", F.expr(f"round(1 / (1 + exp(-greatest(-40D, least(40D, {c} + ln(site_{c} / (1 - site_{c})))))), 6)"))
    out = out.withColumn("is_toxic", F.col("p_toxic") > toxic_from)
    return out.select("doc_id", "p_good", "p_toxic", *[F.round(f"site_{c}", 6).alias(f"site_{c}") for c in KINDS], F.col("is_toxic").alias("toxic"), ((F.col("p_good") >= threshold) & ~F.col("is_toxic")).alias("kept"), held_out(F.col("doc_id")).alias("held_out"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
