"""Metrics of answers: token F1, context relevance, an approximation of the hallucination rate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T


def token_f1(answer: Column, reference: Column) -> Column:
    """2 |A n R| / (|A| + |R|) over the sets of lower-cased words; 0 if both are empty."""
    a, r = F.array_distinct(T.words(F.coalesce(answer, F.lit("")))), F.array_distinct(T.words(F.coalesce(reference, F.lit(""))))
    return F.coalesce(F.try_divide(2.0 * F.size(F.array_intersect(a, r)), F.size(a) + F.size(r)), F.lit(0.0))


def context_relevance(hits: DataFrame) -> DataFrame:
    """query_id, relevance: the share of hits that are relevant (boolean column)."""
    return hits.groupBy("query_id").agg(F.avg(F.when(F.col("relevant"), 1.0).otherwise(0.0)).alias("relevance"))


def unsupported_share(answer: Column, context: Column, least: float = 0.5) -> Column:
    """The share of an answer's sentences under `least` of whose distinct words the context has; 0 without sentences."""
    known = F.array_distinct(T.words(F.coalesce(context, F.lit(""))))
    said = T.sentences(F.coalesce(answer, F.lit("")))

    def bare(s: Column) -> Column:
        own = F.array_distinct(T.words(s))
        return F.size(F.array_intersect(own, known)) < least * F.size(own)

    return F.coalesce(F.try_divide(F.size(F.filter(said, bare)).cast("double"), F.size(said)), F.lit(0.0))


def aligned(answers: DataFrame, passages: DataFrame, most: int = 3, longer_than: int = 3) -> DataFrame:
    """query_id, claim, sentence, rank, score: each sentence of an answer beside the passage that supports it best.

    answers: query_id, answer; passages: query_id, rank, text, those retrieved for the query. A sentence meets the passages with
    which it shares a rare word (of over `longer_than` characters, in `most` of the query's passages at most); the score is the share of its
    different words that the passage has. A sentence that meets none has no rank and score 0.
    """
    claims = answers.select("query_id", F.posexplode(T.sentences(F.coalesce("answer", F.lit("")))).alias("claim", "sentence"))
    own = claims.select("query_id", "claim", F.explode(F.array_distinct(T.words(F.col("sentence")))).alias("word"))
    held = passages.where("text IS NOT NULL").select("query_id", "rank", F.explode(F.array_distinct(T.words(F.col("text")))).alias("word"))
    many = held.groupBy("query_id", "word").agg(F.collect_list("rank").alias("ranks"))  # k passages at most
    rare = (F.length("word") > longer_than) & (F.size("ranks") <= most)
    meet = own.join(many, ["query_id", "word"]).select("query_id", "claim", rare.alias("rare"), F.explode("ranks").alias("rank"))
    shared = meet.groupBy("query_id", "claim", "rank").agg(F.count("*").alias("shared"), F.max("rare").alias("rare")).where("rare")
    sizes = claims.withColumn("n", F.size(F.array_distinct(T.words(F.col("sentence")))))
    scored = sizes.join(shared, ["query_id", "claim"], "left").withColumn("score", F.coalesce(F.col("shared") / F.col("n"), F.lit(0.0)))
    best = Window.partitionBy("query_id", "claim").orderBy(F.desc("score"), "rank")
    return scored.withColumn("i", F.row_number().over(best)).where("i = 1").select("query_id", "claim", "sentence", "rank", "score")


def hallucination_rate(answers: DataFrame, passages: DataFrame, least: float = 0.3) -> DataFrame:
    """query_id, n_claims, unsupported: the share of an answer's sentences that no retrieved passage supports to `least`."""
    return aligned(answers, passages).groupBy("query_id").agg(F.count("*").alias("n_claims"), F.avg(F.when(F.col("score") < least, 1.0).otherwise(0.0)).alias("unsupported"))
