import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.plans import oracle as O
from tessera.plans import queries as Q


@pytest.mark.parametrize("name", ["answer_batch", "answers_kept"])
def test_answers_equal_their_sql(spark, tmp_path, name):
    """Best hits whose 500th character is a space, one of 500 characters, one with spaces before it, one without text, and one without a document."""
    texts = {0: "w" * 499 + " and on", 100: ("ab " * 200).strip(), 200: "x" * 500, 300: " \n First one. Second", 400: None, 600: "a" * 498 + "  . " + "b" * 9, 1: "Other", 2: None, 3: "y" * 600}
    docs = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in texts.items()]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    vectors = [(i, [1.0, float(n), float(n * n)], n % 2) for n, i in enumerate(sorted([*texts, 500]))]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    with duckdb.connect() as db:
        for t in ("documents", "embeddings"):
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
        want = sorted(db.execute(O.ANSWERS).fetchall())
    got = sorted(tuple(r) for r in Q.queries()[name](spark, str(tmp_path)).collect())
    assert got == want and len(got) == 8
    by = {r[0]: r[2] for r in got}
    assert by[0] == "w" * 499 + " " and len(by[100]) == 500 and by[400] is None and by[500] is None and by[-1].startswith("Error: ")


# White space beyond ASCII, vertical tabs, lines that begin as chunks do, texts without a sentence that run on into the next heading.
ODD = ["\u00a0First\u3000one.\u2028Second. Third", "one\x0btwo \x0bthree\x1ffour\x85five. Six", "\x1f Begun. Then", "ended\u00a0", "References\n[1] Smith, 1999. On", "[1] Brown. Of", "short", "", "a\r\n[1] b\n[1] c. D", "\n \u200bx"]
# Vectors whose cosines with (1, 0) are 0.46385 and 0.12765 to nine digits.
PAIRS = [(22523, 43017), (4210, 32711)]


@pytest.mark.parametrize("name", ["answer_batch", "answers_kept"])
def test_odd_texts_equal_their_sql(spark, tmp_path, name):
    """Each odd text as a best hit; second hits have cosines whose percent stands between two roundings (0.46385 and 0.12765)."""
    docs = [(100 * i, t, "en", f"src{i % 3}", len(t)) for i, t in enumerate(ODD)] + [(100 * i + 1, f"near {i}. End", "en", "src9", 0) for i in range(len(ODD))]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    place = lambda i, x: [0.0] * (2 * i) + [float(v) for v in x] + [0.0] * (2 * len(ODD) - 2 * i - 2)
    vectors = [(100 * i, place(i, (1, 0)), 0) for i in range(len(ODD))] + [(100 * i + 1, place(i, PAIRS[i % 2]), 1) for i in range(len(ODD))]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    with duckdb.connect() as db:
        for t in ("documents", "embeddings"):
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
        want = sorted(db.execute(O.ANSWERS).fetchall())
    got = sorted(tuple(r) for r in Q.queries()[name](spark, str(tmp_path)).collect())
    assert got == want and len(got) == len(ODD) + 1
    by = {r[0]: r[2:] for r in got}
    assert by[0][0] == "\u00a0First\u3000one.\u2028Second" and by[0][3] == 1 and by[100][3] == 2 and by[400][0] == "References"
    assert "Relevance: 46.38%" in by[600][0]


def test_percent_rounds_the_double(spark):
    """Times 100, 0.46385 lies below its half, 0.00125 at it, 0.12765 above: as SQL's printf rounds them."""
    xs = [0.46385, 0.00125, 0.12765, -0.00001, 0.0, 1.0, 1234.5]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").coalesce(1).select(T.percent(F.col("x"))).collect()]
    with duckdb.connect() as db:
        assert got == [db.execute("SELECT printf('%.2f%%', CAST(? AS DOUBLE) * 100)", [x]).fetchall()[0][0] for x in xs]
    assert got[0] == "46.38%"
