import zlib
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql.classic.dataframe import DataFrame
from pyspark.sql import functions as F

from tessera.engine import chunked
from tessera.operators import chunking
from tessera.operators.embedding import hashed_words
from tessera.plans import queries as Q
from tessera.sources import pdf, readers, store
from tessera.streaming.ingest import ingest


def test_readers(spark, tmp_path):
    (tmp_path / "a.txt").write_text("héllo\nworld")
    (tmp_path / "b.TEX").write_text("\\section{S} text % c")
    (tmp_path / "c.pdf").write_bytes(b"one|two")
    (tmp_path / "l.dat").write_bytes("caf\xe9".encode("latin-1"))
    (tmp_path / "q.txt").write_text(" first \n\n second\n")
    got = {r.source: (r.kind, r.text) for r in readers.read_documents(spark, [str(tmp_path / n) for n in ("a.txt", "b.TEX", "c.pdf")], lambda b: b.decode().split("|")).collect()}
    assert got["a.txt"] == ("text", "héllo\nworld") and got["c.pdf"] == ("pdf", "onetwo") and got["b.TEX"][1].startswith("### SECTION: S ###")
    assert readers.read_decoded(spark, str(tmp_path / "l.dat")).first().text == "café"
    assert sorted(r.question for r in readers.read_questions(spark, str(tmp_path / "q.txt")).collect()) == ["first", "second"]
    with pytest.raises(ValueError, match="Unsupported"):
        readers.read_documents(spark, [str(tmp_path / "x.doc")])
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        readers.read_texts(spark, str(tmp_path / "none.txt")).count()
    assert readers.storage_sizes(spark, str(tmp_path)).agg(F.sum("files")).first()[0] == 5


def small_pdf():
    """Two pages with text and an empty one; the second page's objects are compressed, its font has a map."""
    flate = lambda text: b"<< /Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream" % (len(zlib.compress(text)), zlib.compress(text))
    plain = b"BT /F1 12 Tf 72 700 Td (Hello \\(PDF\\) w\\366rld) Tj 0 -14 Td [(Kern) -20 (ed) -300 (words)] TJ ET"
    cmap = b"2 beginbfchar <01> <0041> <02> <00E9> endbfchar 1 beginbfrange <03> <05> <0062> endbfrange"
    packed = [(6, b"<< /Type /Page /Parent 2 0 R /Contents [7 0 R] >>"), (9, b"<< /Type /Page /Parent 2 0 R >>")]
    head, body = [], b""
    for n, b in packed:
        head.append(b"%d %d" % (n, len(body)))
        body += b + b" "
    head = b" ".join(head) + b" "
    inside = zlib.compress(head + body)
    return b"%PDF-1.5\n" + b"\n".join(
        b"%d 0 obj\n%s\nendobj" % x
        for x in [
            (1, b"<< /Type /Catalog /Pages 2 0 R >>"),
            (2, b"<< /Type /Pages /Kids [3 0 R 6 0 R 9 0 R] /Count 3 /Resources << /Font << /F1 5 0 R /F2 8 0 R >> >> >>"),
            (3, b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R >>"),
            (4, b"<< /Length %d >>\nstream\n%s\nendstream" % (len(plain), plain)),
            (5, b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>"),
            (7, flate(b"BT /F2 10 Tf <0102030405> Tj T* (\\001) ' ET")),
            (8, b"<< /Type /Font /ToUnicode 10 0 R >>"),
            (10, flate(cmap)),
            (11, b"<< /Type /ObjStm /N 2 /First %d /Filter /FlateDecode >>\nstream\n%s\nendstream" % (len(head), inside)),
        ]
    )


def test_pdf(spark, tmp_path):
    assert pdf.pages_of(small_pdf()) == ["Hello (PDF) wörld\nKerned words", "Aébcd\n\nA", ""]
    assert pdf.pages_of(b"no pdf") == []
    (tmp_path / "x.pdf").write_bytes(small_pdf())
    assert readers.read_documents(spark, [str(tmp_path / "x.pdf")]).first().text == "Hello (PDF) wörld\nKerned wordsAébcd\n\nA"


def test_store_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([(1, "s1", "some text " * 90), (2, "s2", "other")], "doc_id long, source string, text string")
    s = store.Store(spark, str(tmp_path))
    chunks = store.stored_chunks(chunking.sliding(docs, keep=("doc_id", "source")))
    s.append_chunks(chunks)
    s.append_chunks(chunks)  # adding the same again changes nothing
    n = chunks.count()
    assert s.chunks(0).count() == n and s.chunks(1).count() == 0
    plan = spark.read.parquet(s.path("chunks")).where("level = 0")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(level" in plan
    found = s.chunks().select("chunk_key", F.lit(3).alias("cluster_id"), F.lit(0.5).alias("confidence")).limit(1)
    assert s.label_chunks(found).where("cluster_id = 3").count() == 1
    files = lambda: sorted(str(p) for p in Path(s.folder).rglob("chunks/**/*.parquet"))
    before = files()
    assert s.label_chunks(found.withColumn("cluster_id", F.lit(4)), "second").where("cluster_id = 4").count() == 1
    assert s.labelled().where("cluster_id = 3").count() == 1 and s.labelled("second", 0).count() == s.chunks(0).count() and files() == before
    rows = spark.createDataFrame([(1, ' a "quoted"\nline  ', ["x"])], "i long, t string, l array<string>")
    store.export_csv(rows, str(tmp_path / "csv"))
    assert store.import_csv(spark, str(tmp_path / "csv"), "i long, t string, l string").first().t == ' a "quoted"\nline  '
    r = readers.describe_tables(spark, {"chunks": s.path("chunks")}).first()
    assert r.n_rows == n and len(r["sample"]) == min(3, n)


def test_store_embeds_and_adds_what_is_new(spark, tmp_path):
    s = store.Store(spark, str(tmp_path), hashed_words)
    rows = lambda *keys: spark.createDataFrame([(k, f"text {k}") for k in keys], "chunk_key string, text string")
    s.append_chunks(rows("a", "b", "b"))
    s.append_chunks(rows("b", "c"))
    s.append_chunks(rows("a").withColumn("level", F.lit(1)))
    assert sorted((r.chunk_key, r.level) for r in s.chunks().collect()) == [("a", 0), ("a", 1), ("b", 0), ("c", 0)]
    assert all(len(r.embedding) == 64 for r in s.chunks().collect())


def test_collections_are_made_once(spark, tmp_path):
    s = store.Store(spark, str(tmp_path))
    assert s.collection("chunks")["ef_search"] == 200 and s.collection("other", space="l2")["space"] == "l2"
    assert s.collection("other")["space"] == "l2" and s.collection("chunks", space="l2")["space"] == "cosine"
    assert s.read("collections").count() == 2
    with pytest.raises(ValueError):
        s.collection("third", space="manhattan")


def test_default_names():
    assert store.default_name("conversation", datetime(2024, 5, 6, 7, 8, 9)) == "conversation_20240506_070809.json"


def test_stream(spark, tmp_path):
    docs = spark.createDataFrame([(i, "text " * 200, "en", "s", 1000) for i in range(5)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "in"))
    s = store.Store(spark, str(tmp_path / "store"))
    ingest(spark, str(tmp_path / "in"), s, str(tmp_path / "cp")).awaitTermination(120)
    assert s.chunks(0).count() == chunking.sliding(docs).count()


def test_entry_and_queries(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 25
    assert set(e.oracle_sql()) <= set(e.queries())


def test_chunks_whose_short_keys_meet(spark, tmp_path):
    """Two texts with the same 8 digits of a hash are two chunks, in the query as in a store."""
    docs = spark.createDataFrame([(1, "text 47335", "s"), (2, "text 86592", "s"), (3, "text 86592", "s")], "doc_id long, text string, source string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = Q.queries()["ingest_chunks"](spark, str(tmp_path)).collect()
    assert {r.chunk_key for r in got} == {"s_chunk_000000_fc517414"} and sorted(r.chunk_preview for r in got) == ["text 47335", "text 86592"]
    assert chunked(docs).count() == 2
    s = store.Store(spark, str(tmp_path / "store"))
    for _ in range(2):
        s.append_chunks(chunked(docs, once=False, digits=s.digits()))
        assert sorted(r.text for r in s.chunks().collect()) == ["text 47335", "text 86592"]
    old = store.Store(spark, str(tmp_path / "old"))
    old.append_chunks(chunked(docs.where("doc_id = 1")))
    old.append_chunks(chunked(docs.where("doc_id = 1"), once=False, digits=old.digits()))
    assert [r.chunk_key for r in old.chunks().collect()] == ["s_chunk_000000_fc517414"]


def test_first_append_moves_no_texts(spark, tmp_path, monkeypatch):
    """Chunks that are all new and stand once are written where they are made; others are still kept once."""
    s = store.Store(spark, str(tmp_path / "s"))
    rows = lambda *keys: spark.createDataFrame([(k, f"text {k}") for k in keys], "chunk_key string, text string")
    once, joined = DataFrame.dropDuplicates, DataFrame.join
    monkeypatch.setattr(DataFrame, "dropDuplicates", lambda df, *a: 1 / 0 if "text" in df.columns else once(df, *a))
    monkeypatch.setattr(DataFrame, "join", lambda df, *a: 1 / 0 if "text" in df.columns else joined(df, *a))
    s.append_chunks(rows("a", "b"))
    s.append_chunks(rows("b", "a"))
    monkeypatch.undo()
    s.append_chunks(rows("b", "c", "c"))
    assert sorted((r.chunk_key, r.text) for r in s.chunks().collect()) == [(k, f"text {k}") for k in "abc"]
