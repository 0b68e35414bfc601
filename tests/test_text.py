import re

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import chunking

EDGES = ["", "   ", "a" * 49, "a" * 50, "a" * 51, "One. Two!  Three?\nFour", "é😀 x\r\ny\u00a0z", "\n\n" * 30, "end." + " " * 60, "w " * 400]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(EDGES)] + [(99, None)], "doc_id long, text string")


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_sliding_is_pythons_slicing(edges):
    want = []
    for d, t in enumerate(EDGES):
        n = 0
        for i in range(0, len(t), 15):
            if t[i : i + 20].strip():
                want.append((d, f"chunk_{i:06d}", n, 0, i, t[i : i + 20]))
                n += 1
    assert rows(chunking.sliding(edges, 20, 5), "doc_id", "chunk_index") == want


def test_overlap_beyond_step(edges):
    got = {(r.doc_id, r.position): r.text for r in chunking.sliding(edges, 20, 15).collect()}
    assert got == {(d, i): t[i : i + 20] for d, t in enumerate(EDGES) for i in range(0, len(t), 5) if t[i : i + 20].strip()}


def test_boundary_against_a_loop(edges):
    want = []
    for d, t in enumerate(EDGES):
        n = 0
        for i in range(0, len(t), 45):
            c = t[i : i + 50]
            if not c.strip():
                continue
            if i > 0 and i + 50 < len(t):
                m = re.match(r"[^.!?]*[.!?]", t[i + 50 : i + 60], re.S)
                c += m[0] if m else ""
            want.append((d, n, i, i + len(c), c))
            n += 1
            if i + 50 >= len(t):
                break
    got = chunking.boundary(edges).select("doc_id", "chunk_index", "start_position", "end_position", "text")
    assert rows(got, "doc_id", "chunk_index") == want


def test_packing_keeps_all_but_spaces(spark):
    parts = ["p%d " % i * (i % 7 * 20 + 1) for i in range(60)] + ["", "x" * 900, " "]
    text = "\n\n".join(parts)
    df = spark.createDataFrame([(1, text), (2, "short\n\ntext")], "doc_id long, text string")
    got = [r.text for r in chunking.paragraphs(df, 500, 50, at_least=1000).where("doc_id = 1").orderBy("chunk_index").collect()]
    assert "".join("".join(got).split()) == "".join(text.split())
    want, cur = [], ""
    for p in parts:
        if len(cur) + len(p) > 500 and cur:
            want.append(cur.strip())
            cur = p
        else:
            cur = cur + "\n\n" + p if cur else p
    assert got == want + [cur.strip()]


def test_fixed_collapses_spaces(edges):
    got = {(r.doc_id, r.start_index): (r.chunk_id, r.text, r.end_index) for r in chunking.fixed(edges, 30, 10).collect()}
    want = {}
    for d, t in enumerate(EDGES):
        c = " ".join(t.split())
        for k, i in enumerate(range(0, len(c), 20)):
            want[d, i] = (k, c[i : i + 30], i + len(c[i : i + 30]))
    assert got == want


def test_latex(spark):
    tex = "\\documentclass{a}% x\n\\section{One}\nText \\textbf{bold} \\cite{k} 5\\% more\n\n  \n\\newcommand{\\foo}{bar}\\end{x}"
    r = spark.createDataFrame([(tex,)], "t string").select(T.clean_latex(F.col("t")).alias("a"), T.clean_latex_plain(F.col("t")).alias("b"), T.file_type(F.col("t")).alias("f")).first()
    assert r.a.startswith("### SECTION: One ###") and "COMMAND: foo" in r.a and "\n\n" not in r.a
    assert "bold" in r.b and "[CITATION]" in r.b and r.f == "latex"


def test_small_functions(spark):
    r = spark.range(1).select(T.chunk_name(F.lit(1234567)).alias("a"), T.basename(F.lit("/x/y.TXT")).alias("b"), T.extension(F.lit("/x.d/y.TXT")).alias("c"), T.percent(F.lit(0.12345)).alias("d"), T.truncated(F.lit("abc"), 3).alias("e"), T.truncated(F.lit("abcd"), 3).alias("f"), T.preview(F.lit("a\nb")).alias("g")).first()
    assert tuple(r) == ("chunk_1234567", "y.TXT", ".txt", "12.35%", "abc", "abc...", "a b")
