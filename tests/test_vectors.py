import numpy as np
import pytest
from pyspark.ml.feature import BucketedRandomProjectionLSHModel
from pyspark.sql import functions as F

from tessera.operators import clustering as C
from tessera.operators import chunking, evaluation, hierarchy, keywords, reports, retrieval, search, semantic, summaries
from tessera.operators.embedding import embedded, hashed_words


@pytest.fixture(scope="module")
def blobs(spark):
    r = np.random.default_rng(3)
    x = np.concatenate([r.normal(m, 0.6, (60, 6)) for m in (-3, 0, 3)])
    return x, spark.createDataFrame([(i, [float(v) for v in row], i // 60) for i, row in enumerate(x)], "vec_id long, embedding array<float>, label int").repartition(3).cache()


def test_top_k(blobs):
    x, df = blobs
    x = x.astype(np.float32).astype(float)
    q = df.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    got = {(r.query_id, r["rank"]): r.vec_id for r in search.top_k(df, q, 4).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for i in (0, 50, 100, 150):
        best = np.lexsort((np.arange(len(x)), -(u @ u[i]).round(9)))[:4]
        assert [got[i, k + 1] for k in range(4)] == best.tolist()
    assert search.top_k(df, q.where("query_id < 0"), 4).count() == 0


def test_approximate_top_k_moves_no_pairs(spark, monkeypatch):
    """Copies make no pairs that are moved: rows meet the queries where they lie, and each query keeps its k best there."""
    monkeypatch.setattr(search, "BucketedRandomProjectionLSH", type("Hashes", (search.BucketedRandomProjectionLSH,), {"_create_model": lambda self, java: Hashing(java)}))
    e = spark.range(900).select(F.col("id").alias("vec_id"), F.when(F.col("id") < 600, F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.cos("id"), F.sin("id"))).cast("array<float>").alias("embedding"))
    q = e.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")
    got = {(r.query_id, r["rank"]): r.vec_id for r in search.approximate_top_k(e, q).collect()}
    assert len(got) == 45 and all(got[(i, n)] == n - 1 for i in range(0, 600, 100) for n in range(1, 6)) and all(got[(i, 1)] == i for i in (600, 700, 800))


class Hashing(BucketedRandomProjectionLSHModel):
    def approxSimilarityJoin(self, *_, **__):
        raise AssertionError("all pairs of a bucket")


def test_approximate_top_k_recall(spark):
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    q = e.select(F.col("vec_id").alias("query_id"), "embedding")
    pairs = lambda df: {(r.query_id, r.vec_id) for r in df.collect()}
    want, got = pairs(search.top_k(e, q)), pairs(search.approximate_top_k(e, q))
    assert len(got) == len(want) and len(got & want) >= 0.99 * len(want)
    far = spark.createDataFrame([(0, [1.0, 0.0]), (1, [-1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert pairs(search.approximate_top_k(far, far.withColumnRenamed("vec_id", "query_id").where("query_id = 0"), 3)) == {(0, 0), (0, 1), (0, 2)}


def test_mixture(blobs):
    x, df = blobs
    model, ll, history = C.fit_diagonal(df, 3, starts=3, rounds=30)
    assert all(b >= a - 1e-9 for a, b in zip(history, history[1:], strict=False))
    rows = C.assigned(df, model).join(df.select("vec_id", "label"), "vec_id").collect()
    assert all(abs(sum(r.probabilities) - 1) < 1e-9 for r in rows)
    assert len({(r.label, r.cluster_id) for r in rows}) == 3
    aic, bic = C.criteria(ll * len(x), len(x), 3, 6)
    assert aic < bic


def test_silhouette_and_stats(blobs):
    x, df = blobs
    x = x.astype(np.float32).astype(float)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    lab = np.arange(180) // 60
    s = []
    for i in range(180):
        a = d[i, lab == lab[i]].sum() / 59
        b = min(d[i, lab == o].mean() for o in range(3) if o != lab[i])
        s.append((b - a) / max(a, b))
    got = {r.vec_id: r.s for r in C.silhouettes(df, block=70).collect()}
    assert np.allclose([got[i] for i in range(180)], s, atol=1e-6)
    cov = {(r.i, r.j): r["cov"] for r in C.covariance(df).collect()}
    assert np.allclose([[cov[i, j] for j in range(6)] for i in range(6)], np.cov(x.T, bias=True), atol=1e-6)
    z = np.array([r.embedding for r in C.standardised(df).collect()])
    assert np.allclose(z.mean(0), 0, atol=1e-9) and np.allclose(z.std(0), 1, atol=1e-9)


def test_linkage():
    x = np.array([[1, 0], [0.9, 0.1], [0, 1], [0.1, 0.9], [-1, 0]])
    assert C.average_linkage(x, 3).tolist() == [0, 0, 1, 1, 2]
    assert C.average_linkage(x, 9).tolist() == [0, 1, 2, 3, 4]


def slow_linkage(x, k):
    """Merges the two nearest clusters, all pairs looked at."""
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    groups = [[i] for i in range(len(x))]
    while len(groups) > k:
        far = lambda a, b: np.mean([1 - u[i] @ u[j] for i in a for j in b])
        _, a, b = min((far(groups[a], groups[b]), a, b) for a in range(len(groups)) for b in range(a))
        groups[b] += groups.pop(a)
    label = {i: n for n, g in enumerate(sorted(groups, key=min)) for i in g}
    return [label[i] for i in range(len(x))]


@pytest.mark.parametrize("seed", range(6))
def test_linkage_by_brute_force(seed):
    x = np.random.default_rng(seed).normal(0, 1, (25, 5))
    for k in (1, 3, 8, 24):
        assert C.average_linkage(x, k).tolist() == slow_linkage(x, k)


def test_best_with_ties():
    r = np.random.default_rng(1)
    s, place = r.integers(0, 4, (40, 7)).astype(float), r.permutation(40)
    for k in (1, 5, 39, 40, 60):
        want = np.lexsort((np.broadcast_to(place[:, None], s.shape), -s), axis=0)[:k]
        assert (search.best(s, place, k) == want).all()


def test_full_mixture(blobs):
    x, df = blobs
    model, ll, history = C.fit_full(df, 3, starts=2, rounds=25)
    assert all(b >= a - 1e-9 for a, b in zip(history, history[1:], strict=False))
    x = x.astype(np.float32).astype(float)
    density = sum(w * np.exp(-0.5 * np.einsum("ni,ij,nj->n", x - m, np.linalg.inv(c), x - m)) / np.sqrt(np.linalg.det(2 * np.pi * c)) for w, m, c in zip(model.weights, model.means, model.covariances, strict=True))
    assert ll == pytest.approx(np.log(density).mean(), abs=1e-6)
    labels = np.arange(180) // 60
    assert len(set(zip(labels, model.responsibilities(x)[0].argmax(1), strict=True))) == 3


def test_likelihood_belongs_to_the_model(blobs):
    x, df = blobs
    model, ll, _ = C.fit_diagonal(df, 3, starts=1, rounds=2)
    assert ll == pytest.approx(model.responsibilities(x.astype(np.float32).astype(float))[1].mean(), abs=1e-9)


def test_projection(blobs):
    x, df = blobs
    rows, explained = C.projected(df, most=2, wider_than=3)
    got = np.array([r.embedding for r in rows.orderBy("vec_id").collect()])
    x = x.astype(np.float32).astype(float)
    values, axes = np.linalg.eigh(np.cov(x.T))
    want = x @ axes[:, ::-1][:, :2]
    assert np.allclose(np.abs(got), np.abs(want), atol=1e-6) and explained == pytest.approx(values[::-1][:2].sum() / values.sum())
    assert C.projected(df, wider_than=100)[1] is None


def test_summaries_of_the_null_group(spark):
    rows = spark.createDataFrame([(None, 1, "river river water"), (None, 2, "river boats"), ("a", 3, "stone wall stone")], "source string, doc_id long, text string")
    got = {r.source: r.summary for r in summaries.fallback_summaries(rows, "source", "doc_id").collect()}
    assert "Key themes: river, water, boats" in got[None] and "Key themes: stone, wall" in got["a"] and "river river water" in got[None]
    asked = {r.source: r.summary for r in summaries.summaries(rows, "source", "doc_id", lambda t: t[:11]).collect()}
    assert asked == {None: "river river", "a": "stone wall"}
    ties = spark.createDataFrame([("x", 2, "later words here"), ("x", 1, "here first later")], "source string, doc_id long, text string")
    assert [r.word for r in keywords.keywords(ties, "source", "doc_id").orderBy("rank").collect()] == ["here", "later", "first", "words"]
    plan = keywords.keywords(rows, "source", "doc_id")._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan


def test_boundary_windows_by_brute_force(spark):
    r = np.random.default_rng(2)
    texts = ["", " ", "x", "a. b", " " * 120, "word " * 30 + " " * 100 + "tail. end", "x" * 50, "x" * 45 + " " * 5, "x" * 95, "ab. " * 40 + "\n" * 60, " " * 46 + "x" * 44 + " " * 46]
    texts += ["".join(r.choice(list("ab. !\n "), p=[0.3, 0.2, 0.1, 0.1, 0.05, 0.05, 0.2])  for _ in range(r.integers(1, 400))) for _ in range(30)]
    texts += ["".join("  " * int(r.integers(0, 60)) + "ab" * int(r.integers(0, 40)) for _ in range(4)) for _ in range(30)]
    got = {}
    for x in chunking.boundary(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        got.setdefault(x.doc_id, []).append((x.chunk_index, x.start_position, x.end_position, x.text))
    for i, t in enumerate(texts):
        want = []
        for start in range(0, len(t), 45):
            window = t[start : start + 50]
            if not window.strip():
                continue
            reaches = start + 50 >= len(t)
            if start > 0 and not reaches:
                ahead = t[start + 50 : start + 60]
                stops = [k for k, c in enumerate(ahead) if c in ".!?"]
                window += ahead[: stops[0] + 1] if stops else ""
            want.append((len(want), start, start + len(window), window))
            if reaches:
                break
        assert sorted(got.get(i, [])) == want, repr(t)


def test_semantic_chunks_keep_sentences(spark):
    df = spark.createDataFrame([(1, "A cat sat. A dog ran! A cat slept. Rain fell?"), (2, ""), (3, None)], "doc_id long, text string")
    got = semantic.semantic_chunks(df, 2).collect()
    assert {r.doc_id for r in got} == {1} and sum(r.n_sentences for r in got) == 4


def test_hierarchy(spark, blobs, tmp_path):
    _, df = blobs
    chunks = df.select(F.concat(F.lit("c"), F.col("vec_id").cast("string")).alias("chunk_key"), F.concat(F.lit("words about topic"), F.col("label").cast("string")).alias("text"), F.lit("s").alias("source"), "embedding")
    h = hierarchy.run(spark, chunks, str(tmp_path), starts=1, rounds=10, run_id="r").collect()
    assert h[0].level == 0 and h[0].n_items == 180 and -1 <= h[0].silhouette <= 1 and h[-1].stop_reason
    assert h[0].summaries.keys() == set(range(h[0].n_clusters)) and all("Key themes" in x for x in h[0].summaries.values())
    assert spark.read.parquet(f"{tmp_path}/r/summaries").where("level = 0").agg(F.sum("chunks_count")).first()[0] == 180


def test_retrieval_without_hits(spark):
    q = spark.createDataFrame([(1, "what?")], "query_id long, question string")
    hits = spark.createDataFrame([], "query_id long, rank int, score double, text string, source string, cluster_id int")
    c = retrieval.contexts(q, hits)
    r = retrieval.answers(c).first()
    assert r.answer == "Error: No relevant chunks found" and r.context_chunks == 0 and r.relevance_scores is None


def test_metrics(spark):
    f1 = lambda a, b: spark.range(1).select(evaluation.token_f1(F.lit(a), F.lit(b))).first()[0]
    assert f1("a b c", "B c d") == f1("B c d", "a b c") == pytest.approx(2 / 3)
    assert f1("", "") == 0
    u = spark.range(1).select(evaluation.unsupported_share(F.lit("The cat sat. Mars is red."), F.lit("the cat sat down"))).first()[0]
    assert u == 0.5


def test_reports(spark):
    a = spark.createDataFrame([(0, "x", 0, 0.5), (0, "x", 1, 0.7), (0, "y", 2, 0.9), (1, "z", 3, 1.0)], "cluster_id int, chunk_id string, chunk_index int, confidence double")
    assert {r.cluster_id: r.n_unique for r in reports.cluster_samples(a).collect()} == {0: 2, 1: 1}
    assert {r.cluster_id: (r.n, r.percent, len(r.bar)) for r in reports.cluster_distribution(a).collect()} == {0: (3, 75.0, 37), 1: (1, 25.0, 12)}


def test_embedding_is_unit(spark):
    df = embedded(spark.createDataFrame([(1, "a b"), (2, None)], "i long, text string"))
    n = {r.i: sum(v * v for v in r.embedding) for r in df.collect()}
    assert n[1] == pytest.approx(1, abs=1e-5) and n[2] == 0
    assert (hashed_words(["x"]) == hashed_words(["X"])).all()


def test_average_linkage_of_equal_rows(monkeypatch):
    """Equal rows are found by one pass over them, not by sorting rows; a zero with a sign is a zero."""
    monkeypatch.setattr(C.np, "unique", None)
    x = np.array([[1.0, 0.0], [0.0, 1.0], [1.0, -0.0], [0.0, 2.0], [-1.0, 0.0]])
    assert C.average_linkage(x, 3).tolist() == [0, 1, 0, 1, 2]
