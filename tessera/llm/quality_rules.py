"""Quality rules under weak supervision.

Each rule looks at counts of one document and votes good (+1) or bad (-1), or abstains (0). Nobody labels
anything: expectation-maximisation over the histogram of vote patterns estimates how often each rule is
right, and a document's posterior probability of being good replaces "must pass every rule". The histogram
covers all documents and has at most 3**len(RULES) rows, whatever the corpus, so the driver may hold it.

Cases: null or empty text has no words, all counts 0, and fails the base rules; very long texts are counted
whole; a count right at a rule's limit abstains, a posterior right at the threshold keeps; repeated rows get equal results; an empty table gives an empty result; other columns pass untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_lines", "n_distinct", "n_upper_words", "n_marks"]
SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS + MORE)
SYMBOLS = b"#*$%&|<>"

#: name, value (SQL over the counts), bad if above, good if below; between them the rule abstains.
RULES = [
    ("symbols", "n_symbols / n_words", 0.10, 0.02),
    ("symbol_share", "n_symbols / word_chars", 0.02, 0.004),
    ("repeated_words", "n_repeat_words / n_words", 0.30, 0.10),
    ("repeated_lines", "n_dup_lines / greatest(n_lines, 1)", 0.30, 0.01),
    ("long_words", "word_chars / n_words", 12.0, 9.0),
    ("short_words", "-word_chars / n_words", -2.5, -3.5),
    ("shouting", "n_upper_words / n_words", 0.50, 0.20),
    ("marks", "n_marks / n_words", 0.50, 0.15),
    ("few_words_kinds", "-n_distinct / sqrt(n_words)", -2.0, -4.0),
]


def count(text: bytes | None) -> tuple[int, ...]:
    """The counts of one text. bytes.split() cuts at exactly the six ASCII spaces."""
    words = text.split() if text else []
    n = len(words)
    if not n:
        return (0,) * len(COUNTS + MORE)
    bare = text.translate(None, common.ASCII_SPACE.encode())
    chars = len(bare.decode("utf-8", "replace"))
    symbols = len(bare) - len(bare.translate(None, SYMBOLS))
    marks = len(bare) - len(bare.translate(None, b"!?"))
    lines = [x for x in text.split(b"\n") if x.strip()]
    ids: dict[bytes, int] = {}
    w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.int64, n)
    repeated = 0
    if n > 3 and len(ids) < n:
        k = len(ids)
        if k < 2_000_000:
            three = (w[:-2] * k + w[1:-1]) * k + w[2:]
        else:  # the products would pass 63 bits: name the pairs first
            pairs = np.unique(w[:-1] * k + w[1:], return_inverse=True)[1]
            three = pairs[:-1] * k + w[2:]
        _, where, often = np.unique(three, return_inverse=True, return_counts=True)
        at = often[where] > 1
        covered = np.zeros(n, bool)
        for i in range(3):
            covered[i : n - 2 + i] |= at
        repeated = int(covered.sum())
    upper = sum(x.isupper() and len(x) > 1 for x in words)
    return n, chars, symbols, len(lines) - len(set(lines)), repeated, len(lines), len(ids), upper, marks


def counts(docs: DataFrame) -> DataFrame:
    """doc_id and all counts of each row of docs; one pass, no shuffle."""
    common.bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            rows = [count(t) for t in common.column_bytes(batch.column("text"))]
            columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", *COUNTS, *MORE])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, SCHEMA)


def pattern():
    """The votes as one string, a character a rule: + good, - bad, 0 abstains."""
    votes = [F.expr(f"CASE WHEN n_words = 0 THEN '0' WHEN {v} > {bad} THEN '-' WHEN {v} < {good} THEN '+' ELSE '0' END") for _, v, bad, good in RULES]
    return F.concat(*votes)


def base_failed():
    return F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words")


#: What is believed of a rule before any document is seen: how a rule votes (good, abstains, bad) on good and on bad
#: documents. A rule sees one kind of defect, so it is rarely wrong about good documents and misses many bad ones.
BELIEF = np.array([[0.96, 0.03, 0.01], [0.60, 0.10, 0.30]])


def coded(patterns: list[str]) -> np.ndarray:
    """patterns x rules x 3: which of the three votes was cast."""
    at = np.array([["+0-".index(c) for c in p] for p in patterns], int).reshape(-1, len(RULES))
    return np.eye(3)[at]


def fit(patterns: list[tuple[str, int]], rounds: int = 500, weight: float = 0.02, least: float = 20.0, most: float = 1000.0) -> tuple[float, np.ndarray]:
    """The share of good documents and how[class, rule, vote], the chance of each vote on good and on bad documents, by EM.

    The belief counts as much as `weight` of all documents, between `least` and `most` documents, so enough data outweigh
    it; it also fixes which class is "good".
    how[0, :, 0] is a rule's accuracy on good documents, how[1, :, 2] its accuracy on bad ones.
    """
    cast = coded([p for p, _ in patterns])
    n = np.array([k for _, k in patterns], float)
    strength = min(most, max(least, weight * n.sum()))
    share, how = 0.8, np.repeat(BELIEF[:, None, :], len(RULES), axis=1)
    for _ in range(rounds):
        p = posterior(cast, share, how)
        new = np.stack([np.einsum("i,ijk->jk", n * q, cast) + strength * b for q, b in zip((p, 1 - p), BELIEF, strict=True)])
        new /= new.sum(2, keepdims=True)
        new_share = float(np.clip((n @ p + 0.8 * strength) / (n.sum() + strength), 0.05, 0.98))
        done = abs(new_share - share) + abs(new - how).max() < 1e-10
        share, how = new_share, new
        if done:
            break
    return share, how


def posterior(cast: np.ndarray, share: float, how: np.ndarray) -> np.ndarray:
    odds = np.log(share / (1 - share)) + np.einsum("ijk,jk->i", cast, np.log(how[0]) - np.log(how[1]))
    return 1 / (1 + np.exp(-odds))


def verdicts(spark: SparkSession, counted: DataFrame) -> DataFrame:
    """vote_pattern and p_good for each pattern that occurs (at most 3**len(RULES) rows)."""
    seen = [(r[0], r[1]) for r in counted.groupBy(pattern().alias("vote_pattern")).count().collect()]
    seen.sort()
    share, how = fit(seen)
    p = posterior(coded([a for a, _ in seen]), share, how)
    return spark.createDataFrame([(a, float(round(x, 9))) for (a, _), x in zip(seen, p, strict=True)], "vote_pattern string, p_good double")


def judged(counted: DataFrame, threshold: float = 0.5) -> DataFrame:
    """counted with vote_pattern, p_good, base_failed and kept. The join's small side is bounded by the number of rules."""
    spark = counted.sparkSession
    out = counted.withColumn("vote_pattern", pattern()).join(F.broadcast(verdicts(spark, counted)), "vote_pattern", "left")
    return out.withColumn("base_failed", base_failed()).withColumn("kept", F.expr(f"NOT base_failed AND p_good >= {threshold}"))


def quality_rules(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row per row of docs: the counts, base_failed, p_good and kept. Texts are read once."""
    return judged(common.cut(counts(docs), "quality-rules"), threshold).select("doc_id", *COUNTS, "base_failed", "kept", "p_good", "vote_pattern")


def filter_documents(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns.

    The counts are made twice (once for the histogram, once beside the text), which is cheaper than moving the texts.
    """
    spark = docs.sparkSession
    common.bounded_batches(spark)
    good = verdicts(spark, counts(docs)).where(f"p_good >= {threshold}").select("vote_pattern")
    inner = common.renamed(docs)
    text, extra = inner.of("text"), ", ".join(f"{c} long" for c in COUNTS + MORE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, text):
            rows = [count(t) for t in common.column_bytes(batch.column(text))]
            columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *COUNTS, *MORE])

    wide = inner.df.mapInArrow(run, inner.ddl() + ", " + extra)
    kept = wide.where(~base_failed()).withColumn("vote_pattern", pattern()).join(F.broadcast(good), "vote_pattern", "left_semi")
    return kept.select(*inner.restored())


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(common.table(spark, sf_dir, "documents"))
