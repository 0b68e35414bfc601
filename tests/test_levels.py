"""What the level loop moves."""

from pyspark.sql import functions as F
from pyspark.sql import types as t

from tessera.operators import hierarchy
from tessera.operators import keywords as W
from tessera.plans import queries as Q


def test_places_of_keys(spark):
    keys = [f"chunk_{i * 37 % 501:06d}" for i in range(501)] + ["chunk_000007", "é", "z", "~", "Z"]
    rows = spark.createDataFrame([(k, i % 3) for i, k in enumerate(keys)], "chunk_key string, cluster_id int").repartition(7)
    got = W.placed(rows, "chunk_key").collect()
    place = {r.chunk_key: r.place for r in got}
    assert len(got) == len(keys) and len({(r.chunk_key, r.place) for r in got}) == len(place) == len(set(place.values())) == len(set(keys))
    assert sorted(place, key=place.get) == sorted(set(keys), key=lambda k: k.encode())
    texts = rows.select("chunk_key", F.concat_ws(" ", F.lit("same word"), F.reverse("chunk_key"), "chunk_key", F.lit("word last")).alias("text")).dropDuplicates(["chunk_key"])
    one = rows.dropDuplicates(["chunk_key"])
    by = lambda sketched: {(r.cluster_id, r["rank"], r.word, r.n) for r in W.ranked(sketched, "cluster_id", 40).collect()}
    assert by(W.sketch(texts.join(W.placed(one, "chunk_key"), "chunk_key"), "cluster_id", "place")) == by(W.sketch(texts.join(one, "chunk_key"), "cluster_id", "chunk_key"))


def test_words_of_a_level_are_shuffled_once(spark, tmp_path, monkeypatch):
    """Words meet by group, not by text first, and numbers say where they stand."""
    seen, sketch = [], W.sketch
    monkeypatch.setattr(W, "sketch", lambda rows, by, order, **more: seen.append((rows.schema[order].dataType, sketch(rows, by, order, **more))) or seen[-1][1])
    rows = [(f"c{i:03d}", f"river{i % 5} water bridge{i % 2}", "s", [float(i % 2), i / 60]) for i in range(60)]
    hierarchy.run(spark, spark.createDataFrame(rows, "chunk_key string, text string, source string, embedding array<float>"), str(tmp_path), most_levels=1, starts=1, rounds=5)
    (kind, made), = seen
    assert isinstance(kind, t.IntegralType)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and plan.count("hashpartitioning(cluster_id") <= 2


def test_texts_without_vectors_stay(spark, tmp_path, monkeypatch):
    docs = [(i, f"text {i}", "en", None if i == 2 else "s", 6) for i in range(20)] + [(None, "none", "en", "s", 4)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, [float(i or 0), 1.0], 0) for i in (1, 2, 5, 99, None)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = []
    monkeypatch.setattr(hierarchy, "run", lambda spark, chunks, folder: got.append(chunks) or chunks)
    rows = Q.queries()["hierarchy_run"](spark, str(tmp_path)).collect()
    assert {(r.chunk_key, r.text, r.source, tuple(r.embedding)) for r in rows} == {("chunk_000001", "text 1", "s", (1.0, 1.0)), ("chunk_000002", "text 2", None, (2.0, 1.0)), ("chunk_000005", "text 5", "s", (5.0, 1.0))} and len(rows) == 3
    assert "LeftSemi" in got[0]._jdf.queryExecution().optimizedPlan().toString()
