"""The engine over a kept index: it follows what is added, and answers as the exact search does."""

import pytest

from tessera import cli
from tessera.engine import Engine

WORDS = ["river", "tower", "moon", "bread", "engine", "violin", "desert", "harbour"]


@pytest.fixture()
def files(tmp_path):
    for i, w in enumerate(WORDS):
        (tmp_path / f"{w}.txt").write_text(f"The {w} is described here, number {i}. Nothing but the {w} matters.")
    return [str(tmp_path / f"{w}.txt") for w in WORDS]


def test_an_index_follows_the_store(spark, files, tmp_path):
    folder = str(tmp_path / "store")
    exact, e = Engine(spark, folder, k=3), Engine(spark, folder, k=3, approximate=True)
    exact.ingest(files[:4])  # before there is an index
    e.ingest(files[4:6])
    assert e.index.exists() and e.index.keys().count() == 6
    e.ingest(files)  # two are new
    assert {r.chunk_key for r in e.index.keys().collect()} == {r.chunk_key for r in e.store.chunks(0).collect()} and e.index.keys().count() == 8
    e.reindex()
    assert e.index.keys().count() == 8
    asked = [f"What about the {w}?" for w in WORDS]
    records = lambda x: [(r.question, r.answer, r.sources[:1], r.context_chunks) for r in x.ask(asked).orderBy("query_id").collect()]
    got, want = records(e), records(exact)
    assert all(n == 3 for *_, n in got) and sum(a == b for a, b in zip(got, want, strict=True)) >= 7
    assert e.chat("What about the moon?")["context_chunks"] == 3


def test_only_cosine_and_a_store_that_had_none(spark, files, tmp_path):
    e = Engine(spark, str(tmp_path / "l2"))
    e.store.write("collections", spark.createDataFrame([("chunks", "l2", 1, 1)], "name string, space string, ef_search int, max_neighbors int"))
    with pytest.raises(ValueError):
        Engine(spark, str(tmp_path / "l2"), approximate=True)
    folder, said = str(tmp_path / "store"), []
    Engine(spark, folder).ingest(files[:2])
    assert cli.main(["--db-path", folder, "--approximate", "--keep-answers", "--query", "What about the river?", "--chunks", "1"], spark, say=said.append) == 0
    assert any("The river is described here" in s for s in said)
