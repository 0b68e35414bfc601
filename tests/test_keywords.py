"""Keywords and their sketches, held against counts by hand."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import hierarchy
from tessera.operators import keywords as W
from tessera.operators.arrow import cut


def by_hand(rows, k=W.KEYWORDS):
    """{group: [(rank, word, n)]} of (group, order, text)."""
    out = {}
    for g in {r[0] for r in rows}:
        n, first = Counter(), {}
        for _, order, text in sorted((r for r in rows if r[0] == g), key=lambda r: r[1]):
            for at, w in enumerate((text or "").lower().split()):
                if len(w) > 3 and w not in T.STOP_WORDS:
                    n[w] += 1
                    first.setdefault(w, (order, at))
        out[g] = [(i + 1, w, n[w]) for i, w in enumerate(sorted(n, key=lambda w: (-n[w], first[w]))[:k])]
    return {g: x for g, x in out.items() if x}


def found(df, by="g"):
    out = {}
    for r in df.orderBy("rank").collect():
        out.setdefault(r[by], []).append((r["rank"], r.word, r.n))
    return out


@pytest.fixture(scope="module")
def made():
    r = random.Random(3)
    vocabulary = [f"word{i}" for i in range(90)] + ["the", "with", "abc", "Word1"]
    rows = []
    for i in range(400):
        g = r.choice(["x", "y", None])
        some = vocabulary[:30] if g == "y" else vocabulary
        rows.append((g, r.choice("pqr"), i - 40, " ".join(some[min(int(r.paretovariate(0.6)) - 1, len(some) - 1)] for _ in range(r.randrange(0, 40)))))
    return rows + [("none", "p", 500, None), ("none", "p", 501, ""), ("none", "p", 502, "the abc")]


@pytest.mark.parametrize("order", ["long", "string"])
def test_counts(spark, made, order):
    rows = [(g, i if order == "long" else f"{i:+05d}", t) for g, _, i, t in made]
    df = spark.createDataFrame(rows, f"g string, doc_id {order}, text string")
    assert found(W.keywords(df, "g", "doc_id")) == by_hand(rows)
    plan = W.keywords(df.where("doc_id is not null"), "g", "doc_id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning") <= (2 if order == "long" else 3)


@pytest.mark.parametrize("most", [11, 14, 25, 200])
@pytest.mark.parametrize("sent", [0, 100_000])
def test_merged_sketches(spark, made, most, sent, monkeypatch):
    monkeypatch.setattr(W, "SENT", sent)
    df = spark.createDataFrame(made, "g string, part string, doc_id long, text string").withColumn("gp", F.concat_ws("|", F.coalesce("g", F.lit("?")), "part"))
    parts = cut(W.sketch(df, "gp", "doc_id", most))
    names = df.select("gp", "g").distinct()
    both = cut(W.merged(parts.join(names, "gp"), "gp", "g", most))
    rows = [(g, i, t) for g, _, i, t in made]
    want = by_hand(rows, 10**6)
    counts = {g: {w: n for _, w, n in x} for g, x in want.items()}
    seen = {}
    for r in both.collect():
        assert r.n <= counts[r.g][r.word] <= r.n + r.over
        seen.setdefault(r.g, (r.lost, set()))[1].add(r.word)
    for g, (lost, words) in seen.items():
        assert max((n for w, n in counts[g].items() if w not in words), default=0) <= lost
    assert found(W.exact(df, both, "g", "doc_id")) == by_hand(rows)
    if most == 200:
        assert both.agg(F.max("lost"), F.max("over")).first() == (0, 0)
    if most == 11:
        assert not W.candidates(both, "g").where("NOT closed").isEmpty()  # the sketch is too small, and the result whole


def test_nothing_to_count(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 1, ""), (None, 2, "of the")], "g string, doc_id long, text string")
    for rows in (df, df.limit(0)):
        s = cut(W.sketch(rows, "g", "doc_id"))
        assert s.count() == 0 and W.exact(rows, s, "g", "doc_id").count() == 0 and W.merged(s.withColumn("h", F.lit(1)), "g", "h").count() == 0


def test_levels_merge(spark, tmp_path):
    r = random.Random(4)
    rows = []
    for i in range(420):
        topic = i % 12
        rows.append((f"c{i:04d}", " ".join([f"topic{topic}"] * r.randrange(1, 4) + [f"rare{r.randrange(300)}" for _ in range(6)] + ["common"]), "s", [float(r.gauss(9 if d == topic else 0, 0.4)) for d in range(12)]))
    df = spark.createDataFrame(rows, "chunk_key string, text string, source string, embedding array<float>")
    history = hierarchy.run(spark, df, str(tmp_path), most_levels=2, least_gain=-9.0, starts=1, rounds=8, run_id="r").collect()
    assert len(history) == 2
    texts = {x[0]: x[1] for x in rows}
    for level in (0, 1):
        under = {x.chunk_key: x.cluster_id for x in hierarchy.beneath(spark, f"{tmp_path}/r", level).collect()}
        assert under.keys() == texts.keys()
        want = by_hand([(g, key, texts[key]) for key, g in under.items()])
        assert found(hierarchy.level_keywords(spark, f"{tmp_path}/r", level, counted=True), "cluster_id") == want
        sure = found(hierarchy.level_keywords(spark, f"{tmp_path}/r", level), "cluster_id")
        assert sure.keys() == want.keys() and all(x[0][1:] == want[g][0][1:] for g, x in sure.items())
