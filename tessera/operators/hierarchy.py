"""The level loop: cluster a level's chunks, summarise the clusters, make the summaries the next level's chunks, repeat.

The driver holds a level's model and one history row; chunks, assignments, models and summaries are tables in the store. A run
has its own run_id, so a repeated run leaves no rows of an earlier one behind. What a step has found is noted last, in the
run's manifest; a run that was killed goes on, under its run_id, after the last step noted there.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import clustering as C
from tessera.operators import keywords as W
from tessera.operators.embedding import Embedder, embedded, hashed_words
from tessera.operators.models import Kept, scaled_by
from tessera.operators.reports import cluster_sources
from tessera.operators.summaries import SHOWN, summaries

LEAST = 3
HISTORY = "level int, n_clusters int, silhouette double, silhouette_within double, n_items long, summaries map<int,string>, improvement double, converged boolean, stop_reason string"


def k_for(n: int) -> int:
    return max(2, min(8, n // 50))


def cluster_level(level_rows: DataFrame, k: int | None = None, starts: int = 5, rounds: int = 200, seed: int = 42, key: str = "chunk_key", estimate_above: int | None = None, share_of: float | None = None) -> dict | None:
    """Model, assignments and mean silhouette of rows (key, embedding); None under LEAST rows.

    The silhouette is exact, so its work grows as the square of the rows; above `estimate_above` rows, if that is given, it is
    estimated from a sample of each cluster. `within` is then half its 95 % confidence interval. With `share_of`, wide vectors are projected
    on as many components as explain that share of their variance, instead of 50.
    """
    n = level_rows.count()
    if n < LEAST:
        return None
    rows, explained, axes = C.projected_with_axes(level_rows.select(key, "embedding"), share_of=share_of)
    mean, std = scaled_by(rows)
    scaled = C.standardised(rows).persist()
    try:
        mixture, ll, _ = C.fit_diagonal(scaled, k or k_for(n), starts=starts, rounds=rounds, seed=seed, key=key)
        found = C.assigned(scaled, mixture, key=key).persist()
        score, within = 0.0, 0.0
        if found.select("cluster_id").distinct().count() > 1:
            labelled = scaled.join(found.select(key, "cluster_id"), key)
            if estimate_above is not None and n > estimate_above:
                score, within = C.silhouette_estimate(labelled, "cluster_id", "embedding", key)
            else:
                score = C.silhouettes(labelled, "cluster_id", "embedding", key).agg(F.avg("s")).first()[0]
        model = Kept(mixture, mean, std, axes)
        return {"n": n, "k": len(mixture.weights), "model": model, "log_likelihood": ll * n, "assigned": found, "silhouette": float(score), "within": within, "explained": explained}
    finally:
        scaled.unpersist()


def summary_id(level: int) -> Column:
    return F.format_string("level_%d_cluster_%d", F.lit(level), F.col("cluster_id"))


class Manifest:
    """What the steps of a run have found, by level and step: a one-row table each, written when the step's tables are."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def once(self, level: int, step: str, make: Callable[[], dict]) -> dict:
        """What the step found when it was done, now or in an earlier attempt."""
        at = f"{self.folder}/level={level}/{step}"
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{at}/_SUCCESS")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            self.spark.createDataFrame([(json.dumps(make()),)], "found string").coalesce(1).write.mode("overwrite").parquet(at)
        return json.loads(self.spark.read.parquet(at).first()[0])


def run(
    spark: SparkSession, chunks: DataFrame, folder: str, most_levels: int = 5, least_gain: float = 0.05, embedder: Embedder = hashed_words, model=None, starts: int = 5, rounds: int = 200, run_id: str | None = None, estimate_above: int | None = None, share_of: float | None = None
) -> DataFrame:
    """Build the hierarchy over chunks (chunk_key, text, source, embedding); returns its history.

    Writes under folder/run_id: chunks (by level), assignments, models, keywords and summaries. Texts are read for words once, at level 0;
    higher levels merge the keyword sketches of their parts. Stops at an improvement under least_gain
    (converged), at a level under LEAST rows, or after most_levels. The history's summaries are those of the level's
    clusters, eight at most. With the run_id of a run that didn't end, its finished steps aren't done again.
    """
    at = f"{folder}/{run_id or uuid.uuid4().hex}"
    noted = Manifest(spark, f"{at}/manifest")
    level_rows = chunks.select("chunk_key", "text", F.array(F.coalesce("source", F.lit("unknown"))).alias("sources"), F.col("embedding").cast("array<float>").alias("embedding"))
    history, before = [], 0.0
    for level in range(most_levels):
        own = lambda name, level=level: f"{at}/{name}/level={level}"
        put = lambda name, rows, own=own: rows.write.mode("overwrite").parquet(own(name))

        def clustered() -> dict:
            result = cluster_level(spark.read.parquet(own("chunks")), starts=starts, rounds=rounds, estimate_above=estimate_above, share_of=share_of)
            if result is None:
                return {}
            put("assignments", result["assigned"].select("chunk_key", "cluster_id", "confidence"))
            result["assigned"].unpersist()
            result["model"].save(spark, own("models"))
            return {c: result[c] for c in ("k", "n", "silhouette", "within")}

        def worded() -> dict:
            found = spark.read.parquet(own("assignments")).select("chunk_key", "cluster_id")
            if level:
                parts = spark.read.parquet(f"{at}/keywords/level={level - 1}").withColumn("chunk_key", F.concat(F.lit("summary_"), summary_id(level - 1))).drop("cluster_id")
                put("keywords", W.merged(parts.join(F.broadcast(found), "chunk_key"), "chunk_key", "cluster_id"))  # a level above the first has few rows
            else:
                put("keywords", W.sketch(spark.read.parquet(own("chunks")).select("chunk_key", "text").join(W.placed(found, "chunk_key"), "chunk_key"), "cluster_id", "place"))
            return {}

        def summarised() -> dict:
            found = spark.read.parquet(own("assignments"))
            both = spark.read.parquet(own("chunks")).join(found, "chunk_key")
            sources = cluster_sources(both.select("cluster_id", "confidence", F.explode("sources").alias("source"))).select("cluster_id", "sources")
            confidence = found.groupBy("cluster_id").agg(F.avg("confidence").alias("avg_confidence"))
            counted = None if level else W.ranked(spark.read.parquet(own("keywords")), "cluster_id", SHOWN)  # the words of summaries aren't those of what they sum up
            made = summaries(both.select("cluster_id", "chunk_key", "text"), "cluster_id", "chunk_key", model, counted=counted).join(sources, "cluster_id").join(confidence, "cluster_id")
            made = made.withColumn("summary_id", summary_id(level)).withColumn("silhouette_score", F.lit(result["silhouette"])).withColumn("created_at", F.current_timestamp())
            put("summaries", made)
            return {r["cluster_id"]: r["summary"] for r in spark.read.parquet(own("summaries")).select("cluster_id", "summary").collect()}

        noted.once(level, "chunks", lambda: put("chunks", level_rows) or {})
        result = noted.once(level, "clusters", clustered)
        if not result:
            if history:
                history[-1] = (*history[-1][:-1], "too few items above")
            break
        noted.once(level, "keywords", worded)
        texts = {int(c): t for c, t in noted.once(level, "summaries", summarised).items()}
        gain = result["silhouette"] - before if level else 1.0
        stop = level > 0 and gain < least_gain
        history.append((level, result["k"], result["silhouette"], result["within"], result["n"], texts, gain, stop, "converged" if stop else None))
        if stop:
            break
        before = result["silhouette"]
        nxt = spark.read.parquet(own("summaries")).select(F.concat(F.lit("summary_"), "summary_id").alias("chunk_key"), F.col("summary").alias("text"), "sources")
        level_rows = embedded(nxt, embedder)
    else:
        if history:
            history[-1] = (*history[-1][:-1], history[-1][-1] or "most levels")
    return spark.createDataFrame(history, HISTORY)


def beneath(spark: SparkSession, at: str, level: int) -> DataFrame:
    """chunk_key, cluster_id: the chunks of level 0 under each cluster of a level, in the run at a folder."""
    found = spark.read.parquet(f"{at}/assignments/level={level}").select("chunk_key", "cluster_id")
    for lower in range(level - 1, -1, -1):
        parts = spark.read.parquet(f"{at}/assignments/level={lower}").select(F.col("chunk_key").alias("__part"), "cluster_id")
        parts = parts.select("__part", F.concat(F.lit("summary_"), summary_id(lower)).alias("chunk_key"))
        found = parts.join(F.broadcast(found), "chunk_key").select(F.col("__part").alias("chunk_key"), "cluster_id")  # a row a cluster of the level below
    return found


def level_keywords(spark: SparkSession, at: str, level: int, k: int = W.KEYWORDS, counted: bool = False) -> DataFrame:
    """cluster_id, rank, word, n: the most frequent words of all chunks under each cluster of a level.

    From the sketches alone, n is what is known for sure. `counted` counts the words that may be among the first in the texts.
    """
    sketched = spark.read.parquet(f"{at}/keywords/level={level}")
    if not counted:
        return W.ranked(sketched, "cluster_id", k)
    rows = spark.read.parquet(f"{at}/chunks/level=0").select("chunk_key", "text").join(beneath(spark, at, level), "chunk_key")
    return W.exact(rows, sketched, "cluster_id", "chunk_key", k)
