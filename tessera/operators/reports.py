"""Reports on clusters, sources and the summary tree: grouped aggregates and first-n windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T


def cluster_report(assigned: DataFrame) -> DataFrame:
    c = F.col("confidence")
    return assigned.groupBy("cluster_id").agg(F.count("*").alias("n"), F.round(F.avg(c), 3).alias("mean_confidence"), F.round(F.min(c), 3).alias("min_confidence"), F.round(F.max(c), 3).alias("max_confidence"))


def cluster_samples(assigned: DataFrame, n: int = 3, order: str = "chunk_index") -> DataFrame:
    """Distinct chunks of each cluster (the first of a repeated chunk_id), their statistics, the first n."""
    once = Window.partitionBy("cluster_id", "chunk_id").orderBy(order)
    rows = assigned.withColumn("__i", F.row_number().over(once)).where("__i = 1").drop("__i")
    stats = rows.groupBy("cluster_id").agg(F.count("*").alias("n_unique"), F.round(F.avg("confidence"), 3).alias("mean_confidence"), F.round(F.min("confidence"), 3).alias("min_confidence"), F.round(F.max("confidence"), 3).alias("max_confidence"))
    first = Window.partitionBy("cluster_id").orderBy(order, "chunk_id")
    head = rows.withColumn("sample", F.row_number().over(first)).where(F.col("sample") <= n)
    return head.join(stats, "cluster_id").select("cluster_id", "n_unique", "mean_confidence", "min_confidence", "max_confidence", "sample", "chunk_id", F.round("confidence", 3).alias("confidence"))


def cluster_chunks(assigned: DataFrame, n: int = 10, order: str = "chunk_index") -> DataFrame:
    """The first n chunks of each cluster in order, how many more there are, and the mean confidence."""
    stats = assigned.groupBy("cluster_id").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 3).alias("mean_confidence"))
    first = Window.partitionBy("cluster_id").orderBy(order)
    head = assigned.withColumn("place", F.row_number().over(first)).where(F.col("place") <= n)
    return head.join(stats, "cluster_id").select("cluster_id", "place", "chunk_id", "n", F.greatest(F.col("n") - n, F.lit(0)).alias("more"), "mean_confidence")


def with_full_text(assigned: DataFrame, chunks: DataFrame) -> DataFrame:
    """assigned with the text of the chunk at its chunk_index, N/A if there is none."""
    texts = chunks.select("chunk_index", F.col("text").alias("__text"))
    return assigned.join(texts, "chunk_index", "left").withColumn("full_text", F.coalesce("__text", F.lit("N/A"))).drop("__text")


def cluster_distribution(assigned: DataFrame) -> DataFrame:
    """n, percent and bar (a block for each two percent) of each cluster."""
    counts = assigned.groupBy("cluster_id").agg(F.count("*").alias("n"))
    share = 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy())  # one row a cluster
    return counts.withColumn("p", share).select("cluster_id", "n", F.round("p", 6).alias("percent"), F.expr("repeat('█', cast(floor(p / 2) as int))").alias("bar"))


def mapping_table(assigned: DataFrame, n: int = 20, order: str = "chunk_index") -> DataFrame:
    head = assigned.orderBy(order, "chunk_id").limit(n)
    return head.select("chunk_id", "cluster_id", T.fixed3(F.col("confidence")).alias("confidence"), T.preview(F.col("preview"), 50).alias("preview"))


def source_counts(chunks: DataFrame, source: str = "source", default: str = "Unknown") -> DataFrame:
    return chunks.groupBy(F.coalesce(F.col(source), F.lit(default)).alias("source")).agg(F.count("*").alias("n"))


def cluster_sources(assigned: DataFrame, source: str = "source", default: str = "unknown") -> DataFrame:
    """Distinct sources of each cluster; sources are few beside rows."""
    return assigned.groupBy("cluster_id").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("avg_confidence"), F.array_sort(F.collect_set(F.coalesce(F.col(source), F.lit(default)))).alias("sources"))


def at_level(chunks: DataFrame, level: int | None) -> DataFrame:
    """Chunks of a level (0 if it isn't set); all if level is None."""
    return chunks if level is None else chunks.where(F.coalesce("level", F.lit(0)) == level)


def summary_tree(summaries: DataFrame) -> DataFrame:
    """Summaries by level and cluster, with defaults for what is missing."""
    c = lambda name, default: F.coalesce(name, F.lit(default)).alias(name)
    return summaries.select("summary_id", c("level", -1), c("cluster_id", -1), c("chunks_count", 0), c("silhouette_score", 0.0), F.substring("summary", 1, 100).alias("summary_preview"), c("created_at", "")).orderBy("level", "cluster_id")


def hierarchy(tree: DataFrame) -> DataFrame:
    """A row a level with its clusters nested, in order."""
    row = F.struct("cluster_id", "chunks_count", T.fixed3(F.col("silhouette_score")).alias("silhouette"), F.concat(F.substring("summary_preview", 1, 80), F.lit("...")).alias("preview"))
    return tree.groupBy("level").agg(F.count("*").alias("n_clusters"), F.array_sort(F.collect_list(row)).alias("clusters"))


def level_history(assigned: DataFrame) -> DataFrame:
    """level, n_clusters, n_items."""
    return assigned.groupBy("level").agg(F.count_distinct("cluster_id").alias("n_clusters"), F.count("*").alias("n_items"))


def improvements(history: DataFrame, least: float = 0.05) -> DataFrame:
    """history (level, silhouette) with improvement over the level below (1 for the first) and whether to stop there."""
    before = F.lag("silhouette").over(Window.partitionBy().orderBy("level"))  # one row a level
    return history.withColumn("improvement", F.when(before.isNull(), F.lit(1.0)).otherwise(F.col("silhouette") - before)).withColumn("stop", F.col("improvement") < least)


def store_counts(**tables: DataFrame) -> dict[str, int]:
    return {name: t.count() for name, t in tables.items()}
