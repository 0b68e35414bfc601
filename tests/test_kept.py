"""What is kept: a search index, a fitted model, a run's manifest; and work below the square of the rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.engine import Engine
from tessera.operators import clustering as C
from tessera.operators import evaluation, hierarchy, retrieval, search
from tessera.operators.index import Index, decoded, encoded
from tessera.operators.models import Kept, scaled_by
from tessera.sources import store


@pytest.fixture(scope="module")
def blobs(spark):
    r = np.random.default_rng(3)
    x = np.concatenate([r.normal(m, 0.6, (60, 6)) for m in (-3, 0, 3)]).astype(np.float32)
    return x.astype(float), spark.createDataFrame([(i, [float(v) for v in row], i // 60) for i, row in enumerate(x)], "vec_id long, embedding array<float>, label int").repartition(3).cache()


def nearest(df):
    return {(r.query_id, r["rank"]): (r[2], r.score) for r in df.collect()}


# ---- index


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")


def test_index_recall(spark, vectors, tmp_path):
    kept = Index(spark, str(tmp_path)).create(vectors)
    q = vectors.select(F.col("vec_id").alias("query_id"), "embedding")
    pairs = lambda df: {(r.query_id, r.vec_id) for r in df.collect()}
    want, got = pairs(search.top_k(vectors, q)), pairs(kept.search_all(vectors, q))
    assert len(got) == len(want) and len(got & want) >= 0.9 * len(want)
    exact = nearest(search.top_k(vectors, q.where("query_id < 20")))
    assert nearest(kept.search(vectors, q.where("query_id < 20"), ef=400, probes=4096)) == exact


def test_index_reads_the_cells_it_probes(spark, vectors, tmp_path):
    kept = Index(spark, str(tmp_path)).create(vectors)
    plan = kept.blocks([3, 5])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan and kept.blocks([3, 5]).select("cell").distinct().count() == 2
    read = {f.split("cell=")[1].split("/")[0] for f in kept.blocks([3, 5]).inputFiles()}
    assert read <= {str(i) for i in range(4096)} and len({x for x in read}) >= 2
    few = vectors.where("vec_id = 7").select(F.col("vec_id").alias("query_id"), "embedding")
    assert {r[0] for r in kept.nearest(few.select("query_id", "embedding"), 4).select("cell").collect()} == {r[0] for r in kept.nearest(few.select("query_id", "embedding"), 4).collect()}
    assert kept.candidates(few, 1000, 2).count() < 1000 < vectors.count()


def test_index_of_copies_and_strings(spark, tmp_path):
    """A cell that holds most rows, rows without a vector or of length 0, keys that are strings, rows added later."""
    r = np.random.default_rng(0)
    rows = [(f"copy{i}", [1.0, 0.0, 0.5]) for i in range(3000)] + [(f"k{i}", [float(v) for v in r.normal(0, 1, 3)]) for i in range(300)] + [("none", None), ("zero", [0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "id string, v array<double>").repartition(4)
    kept = Index(spark, str(tmp_path), "id", "v").create(df.where("id <> 'k7'"), cells=10)
    kept.add(df.where("id = 'k7'"))
    assert kept.blocks(list(range(10))).select(F.explode("keys")).distinct().count() == 3301
    q = df.where("id IN ('k7', 'k8', 'zero')").select(F.xxhash64("id").alias("query_id"), "v")
    got = nearest(kept.search_all(df, q, k=4, ef=4000, probes=10))
    assert got == nearest(search.top_k(df, q, 4, row_id="id", vector="v"))
    assert kept.search_all(df, q.where("v IS NULL"), 4).count() == 0


def test_index_without_rows(spark, vectors, tmp_path):
    kept = Index(spark, str(tmp_path)).create(vectors.limit(0))
    q = vectors.where("vec_id < 3").select(F.col("vec_id").alias("query_id"), "embedding")
    assert kept.search_all(vectors.limit(0), q).count() == 0


def test_codes():
    r = np.random.default_rng(1)
    x, c = r.normal(0, 0.2, (50, 8)), r.normal(0, 0.2, 8)
    assert np.abs(decoded(encoded(x, c), c) - x).max() < 0.02


# ---- exact search


def test_top_k_over_many_batches_and_blocks(spark, monkeypatch):
    r = np.random.default_rng(2)
    x = r.integers(-2, 3, (900, 3)).astype(float)  # many ties
    df = spark.createDataFrame([(f"r{i:04d}", row.tolist()) for i, row in enumerate(x)], "id string, v array<double>").repartition(2)
    q = df.limit(0).select(F.lit(0).cast("long").alias("query_id"), "v").unionByName(spark.createDataFrame([(i, x[i].tolist()) for i in range(70)], "query_id long, v array<double>"))
    monkeypatch.setattr(search, "BLOCK", 3)
    monkeypatch.setattr(search.blocks, "__defaults__", (3,))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        for metric in ("cosine", "l2"):
            got = nearest(search.top_k(df, q, 6, metric, "id", vector="v"))
            for i in range(70):
                if metric == "cosine":
                    u = search.unit(x)
                    s = (u @ u[i]).round(9) + 0.0
                else:
                    s = -((x - x[i]) ** 2).sum(1).round(9) + 0.0
                want = np.lexsort((np.arange(900), -s))[:6]
                assert [got[i, k + 1][0] for k in range(6)] == [f"r{j:04d}" for j in want], (metric, i)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


# ---- models


def test_kept_model(spark, blobs, tmp_path):
    x, df = blobs
    mixture, ll, history = C.fit_diagonal(C.standardised(df), 3, starts=2)
    mean, std = scaled_by(df)
    Kept(mixture, mean, std).save(spark, str(tmp_path / "m"))
    kept = Kept.load(spark, str(tmp_path / "m"))
    rows = {r.vec_id: r for r in kept.assign(df).collect()}
    for r in C.assigned(C.standardised(df), mixture).collect():
        assert rows[r.vec_id].cluster_id == r.cluster_id and rows[r.vec_id].confidence == pytest.approx(r.confidence, abs=1e-9)
    warm, again, rounds = C.fit_diagonal(C.standardised(df), 3, begin=kept.mixture)
    assert len(rounds) < len(history) and again >= ll - 1e-6 and np.allclose(warm.means, mixture.means, atol=0.1)
    plan = kept.assign(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.split("InMemoryRelation")[0] and "Join" not in plan


def test_kept_full_and_projected_models(spark, blobs, tmp_path):
    x, df = blobs
    mixture, _, _ = C.fit_full(df, 3, starts=1, rounds=5)
    Kept(mixture, np.zeros(6), np.ones(6)).save(spark, str(tmp_path / "full"))
    assert np.allclose(Kept.load(spark, str(tmp_path / "full")).mixture.responsibilities(x)[0], mixture.responsibilities(x)[0])
    rows, _, axes = C.projected_with_axes(df, most=2, wider_than=3)
    mean, std = scaled_by(rows)
    mixture, _, _ = C.fit_diagonal(C.standardised(rows), 3, starts=1, rounds=5)
    Kept(mixture, mean, std, axes).save(spark, str(tmp_path / "wide"))
    got = {r.vec_id: r.probabilities for r in Kept.load(spark, str(tmp_path / "wide")).assign(df).collect()}
    want = {r.vec_id: r.probabilities for r in C.assigned(C.standardised(rows), mixture).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[i], want[i], atol=1e-6) for i in want)


def test_a_search_moves_no_pairs(spark, tmp_path, monkeypatch):
    """A query's candidates are its best of each task, however many cells and blocks the task reads; queries aren't sent once a cell."""
    rows = spark.range(3000).select(F.col("id").alias("vec_id"), F.array(*[F.sin((F.col("id") + 1) * (i + 1.7)) for i in range(8)]).cast("array<float>").alias("embedding")).coalesce(1)
    kept = Index(spark, str(tmp_path / "few")).create(rows, cells=12)
    asked = rows.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")
    monkeypatch.setattr(Index, "nearest", None)
    got = kept.search(rows, asked, ef=200, probes=12).collect()
    want = search.top_k(rows, asked).collect()
    assert {(r.query_id, r["rank"], r.vec_id) for r in got} == {(r.query_id, r["rank"], r.vec_id) for r in want} and len(got) == 150


# ---- silhouettes


def test_what_silhouettes_move(spark):
    """All blocks go past a fixed number of groups: the rows that are moved grow as the table, not as its square."""
    moved = []
    for n in (3000, 12000):
        df = spark.range(n).select(F.col("id").alias("vec_id"), (F.col("id") % 3).cast("int").alias("label"), F.array((F.col("id") % 7).cast("float"), (F.col("id") % 11).cast("float")).alias("embedding")).repartition(8)
        assert C.silhouettes(df, block=100).count() == n
        moved.append(sum(len(v) for v in C.passes(df, block=100)[0].select("vectors").toPandas()["vectors"]))
    assert moved[1] <= 4.2 * moved[0]


def test_silhouette_estimate(spark, blobs):
    x, df = blobs
    exact = C.silhouettes(df).agg(F.avg("s")).first()[0]
    assert C.silhouette_estimate(df) == (pytest.approx(exact, abs=1e-6), 0.0)
    inside = 0
    for seed in range(10):
        mean, within = C.silhouette_estimate(df, per_label=15, seed=seed)
        assert 0 < within < 0.2
        inside += abs(mean - exact) <= within
    assert inside >= 8
    assert C.silhouette_estimate(df.where("label = 0")) == (0.0, 0.0)
    one = df.where("label = 0 OR vec_id = 170")
    assert C.silhouette_estimate(one)[0] == pytest.approx(C.silhouettes(one).agg(F.avg("s")).first()[0], abs=1e-6)


# ---- average linkage


def slow_linkage(x, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    groups = [[i] for i in range(len(x))]
    while len(groups) > k:
        far = lambda a, b: np.mean([1 - u[i] @ u[j] for i in a for j in b]).round(12)
        _, a, b = min((far(groups[a], groups[b]), a, b) for a in range(len(groups)) for b in range(a))
        groups[b] += groups.pop(a)
    label = {i: n for n, g in enumerate(sorted(groups, key=min)) for i in g}
    return [label[i] for i in range(len(x))]


@pytest.mark.parametrize("share", [1 / 16, 10.0])
def test_linkage_by_rounds_and_by_chains(monkeypatch, share):
    monkeypatch.setattr(C, "SHARE", share)
    monkeypatch.setattr(C, "AT_ONCE", 100)
    for seed in range(4):
        x = np.random.default_rng(seed).normal(0, 1, (30, 4))
        x[[5, 9, 20]] = x[2]
        for k in (1, 3, 10, 27, 29, 30, 99):
            assert C.average_linkage(x, k).tolist() == slow_linkage(x, k), (seed, k)


def test_linkage_of_many_rows():
    x = np.concatenate([np.random.default_rng(i).normal(c, 0.3, (2000, 16)) for i, c in enumerate(np.eye(16)[:4] * 6)])
    assert C.average_linkage(x, 4).tolist() == np.repeat(range(4), 2000).tolist()
    assert sorted(np.bincount(C.average_linkage(np.zeros((50, 3)), 5)).tolist())[-1] == 46  # nothing tells them apart
    assert set(C.average_linkage(np.ones((500, 3)), 1)) == {0}


# ---- the level loop


def rounded(row):
    """Sums depend on the order in which tasks end, in their last digits."""
    return tuple(round(v, 6) if isinstance(v, float) else v for v in row)


def test_a_killed_run_goes_on(spark, blobs, tmp_path, monkeypatch):
    _, df = blobs
    r = np.random.default_rng(5)
    wide = spark.createDataFrame([(f"c{i}", f"words about topic {i % 12} here", "s", [float(v) for v in r.normal(np.eye(12)[i % 12] * 9, 0.4)]) for i in range(620)], "chunk_key string, text string, source string, embedding array<float>")
    options = {"starts": 1, "rounds": 8, "least_gain": -9.0, "most_levels": 3}
    want = [rounded(x) for x in hierarchy.run(spark, wide, str(tmp_path / "whole"), run_id="r", **options).collect()]
    assert len(want) >= 2
    steps, made = [], hierarchy.summaries
    fit = hierarchy.cluster_level

    def broken(*a, **b):
        steps.append("summaries")
        if len(steps) == 2:
            raise RuntimeError("killed")
        return made(*a, **b)

    monkeypatch.setattr(hierarchy, "summaries", broken)
    with pytest.raises(RuntimeError, match="killed"):
        hierarchy.run(spark, wide, str(tmp_path / "cut"), run_id="r", **options)
    fitted = []
    monkeypatch.setattr(hierarchy, "cluster_level", lambda *a, **b: fitted.append(1) or fit(*a, **b))
    got = [rounded(x) for x in hierarchy.run(spark, wide, str(tmp_path / "cut"), run_id="r", **options).collect()]
    assert got == want and len(fitted) < len(want) + 1 and steps.count("summaries") == len(want) + 1
    for name in ("chunks", "assignments", "models", "summaries"):
        assert (tmp_path / "cut/r" / name).exists()
    again = [rounded(x) for x in hierarchy.run(spark, wide, str(tmp_path / "cut"), run_id="r", **options).collect()]
    assert again == want and len(fitted) < len(want) + 1


def test_level_by_estimate(spark, blobs):
    _, df = blobs
    rows = df.select(F.col("vec_id").cast("string").alias("chunk_key"), "embedding")
    exact, estimated = hierarchy.cluster_level(rows, 3, 1, 10), hierarchy.cluster_level(rows, 3, 1, 10, estimate_above=100)
    assert exact["within"] == 0 and estimated["silhouette"] == pytest.approx(exact["silhouette"], abs=max(estimated["within"], 1e-6))


def test_engine_assigns_new_chunks(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "store"))
    for i in range(6):
        (tmp_path / f"{i}.txt").write_text(f"Chapter {i}. " + f"word{i} tells of thing{i % 2}. " * 120)
    e.ingest([str(tmp_path / f"{i}.txt") for i in range(6)])
    e.build(most_levels=1, starts=1, rounds=5)
    old = {r.chunk_key: r.cluster_id for r in e.chunks().select("chunk_key", "cluster_id").collect()}
    got = {r.chunk_key: r.cluster_id for r in e.assign(e.store.chunks(0).select("chunk_key", "embedding")).collect()}
    assert got == old


# ---- claims, strict summaries, sessions


def test_claims_meet_passages(spark):
    answers = spark.createDataFrame([(1, "The dragon sleeps in winter. Mars is red! Of the and."), (2, None), (3, "Alone here.")], "query_id long, answer string")
    passages = spark.createDataFrame([(1, 1, "a dragon sleeps"), (1, 2, "the dragon sleeps in the winter cave"), (1, 3, None), (2, 1, "x")], "query_id long, rank int, text string")
    got = {(r.query_id, r.claim): (r["rank"], round(r.score, 3)) for r in evaluation.aligned(answers, passages).collect()}
    assert got == {(1, 0): (2, 0.8), (1, 1): (None, 0.0), (1, 2): (None, 0.0), (3, 0): (None, 0.0)}
    rate = {r.query_id: (r.n_claims, round(r.unsupported, 3)) for r in evaluation.hallucination_rate(answers, passages, 0.5).collect()}
    assert rate == {1: (3, 0.667), 3: (1, 1.0)}


def test_strict_summaries(spark):
    hits = spark.createDataFrame([(1, 1, 0.9, "t", "s", 4, False), (1, 2, 0.8, "u", "s", 5, True)], "query_id long, rank int, score double, text string, source string, cluster_id int, is_summary boolean")
    made = spark.createDataFrame([("a", 4, 1, 3, "four", 1), ("b", 5, 1, 2, "five", 1)], "summary_id string, cluster_id int, level int, chunks_count long, summary string, run long")
    q = spark.createDataFrame([(1, "what?")], "query_id long, question string")
    topics = lambda mode: [t.summary for t in retrieval.contexts(q, hits, made, mode).first().topics]
    assert topics("assigned") == ["four", "five"] and topics("strict") == ["five"]
    with pytest.raises(ValueError, match="other"):
        retrieval.cluster_summaries(hits, made, mode="other")


def test_sessions(spark):
    rows = spark.createDataFrame([("a", 2, "q2", "x", ["s"]), ("a", 1, "q1", "y", ["s"]), ("b", 1, "q", "z", [])], "session string, query_id long, question string, answer string, sources array<string>")
    got = {r.session: (r.total_queries, [c.question for c in r.conversation]) for r in store.session_export(rows).collect()}
    assert got == {"a": (2, ["q1", "q2"]), "b": (1, ["q"])}
