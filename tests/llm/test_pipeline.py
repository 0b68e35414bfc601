import collections
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import common, decontamination, mixing, quality_rules
from test_llm import SCHEMA, components_of, held, lines_of, make, prose

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", "keep_bits", "bucket", "copy", "c0"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("pipeline"))
    r = random.Random(31)
    items = [prose(r, n) for n in (30, 20, 14)]
    rows = [(i, "Footer line\n" * (i % 2) + prose(r, r.randint(55, 160)), random.Random(i).choice(["s0", "s0", "s1", "s2", None])) for i in range(90)]
    rows += [(100 + i, rows[5][1] + f" tail{i}", "s0") for i in range(4)] + [(110 + i, rows[8][1], "s1") for i in range(3)]
    rows += [(200 + i, "### $$$ %%% " * 40 + prose(r, 60), "s1") for i in range(6)]
    rows += [(300 + i, prose(r, 60) + " " + items[i % 3] + " " + prose(r, 60), "s2") for i in range(6)]
    rows += [(400, "tiny", "s2"), (401, None, "s2"), (402, "", None), (None, prose(r, 90), "s1"), (None, prose(r, 70) + " " + items[0], "s0"), (7, prose(r, 80), "s0"), (500, prose(r, 20_000), "s2")]
    make(spark, rows).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, items


def rows_of(df):
    return [tuple(x[c] for c in COLUMNS) for x in df.collect()]


def kept_by_rules(rows):
    def votes(c):
        out = ""
        for _, value, bad, good in quality_rules.RULES:
            v = eval(value, {"greatest": max, "sqrt": np.sqrt}, c) if c["n_words"] else None
            out += "0" if v is None else "-" if v > bad else "+" if v < good else "0"
        return out

    counts = [dict(zip(quality_rules.COUNTS + quality_rules.MORE, quality_rules.count((x[1] or "").encode()), strict=True)) for x in rows]
    patterns = [votes(c) for c in counts]
    share, how = quality_rules.fit(sorted(collections.Counter(patterns).items()))
    p = quality_rules.posterior(quality_rules.coded(patterns), share, how)
    return [x for x, c, q in zip(rows, counts, p, strict=True) if c["n_words"] >= 50 and 100 * c["n_repeat_words"] <= 50 * c["n_words"] and q >= 0.5]


def without_lines(rows):
    alone = [(i, x[0], x[1]) for i, x in enumerate(rows)]
    ids = {i: d for i, d, _ in alone}
    # lines_of counts documents by id; rows that share one are one document
    often = collections.defaultdict(set)
    for i, d, t in alone:
        for line in t.split("\n"):
            often[line.strip().lower()].add(d)
    keep = lambda t: "\n".join(x for x in t.split("\n") if not x.strip() or len(often[x.strip().lower()]) < 10)
    assert len(ids) == len(rows)
    return [(x[0], keep(x[1]), x[2], x[3], len(keep(x[1])), *x[5:]) for x in rows]


def one_of_each(rows):
    lowest = components_of([(x[0], x[1]) for x in rows])
    first = {(d, n): low for d, n, low in lowest}
    size = lambda t: len({tuple(t.lower().split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))})
    return [x for x in rows if x[0] == first[x[0], size(x[1])]]


def clean(rows, items):
    words = lambda t: [w for w in (x.strip(".,!?") for x in t.lower().split()) if w]
    return [x for x in rows if not any(held(words(t), words(x[1])) for t in items)]


def test_stages_by_brute_force(spark, tables):
    """Each stage against plain Python (or SQL) on its own input."""
    d, items = tables
    docs, stages, folder = spark.read.parquet(f"{d}/documents.parquet"), dict(corpus_pipeline.STAGES), d + "/between"
    want = {"quality_rules": kept_by_rules, "line_dedup": without_lines, "minhash": one_of_each, "decontamination": lambda rows: clean(rows, items)}
    before = len(rows_of(docs))
    for name, brute in want.items():
        given = rows_of(docs)
        out = stages[name](spark, docs, d)
        assert out.columns == docs.columns
        got = rows_of(out)
        assert collections.Counter(got) == collections.Counter(brute(given)), name
        assert name == "line_dedup" or len(got) < before
        before = len(got)
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    mixed = stages["mixing"](spark, docs, d)
    assert mixed.columns == [*docs.columns, "copy_"]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/decontamination/*.parquet'")
    taken = collections.Counter()
    for x in con.execute(mixing.ORACLE.replace("SELECT t.doc_id, t.size", "SELECT t.doc_id, t.size, t.taken")).fetchall():
        if x[2]:
            taken[x[0], x[1], x[3]] += int(x[2] // x[1])
    got = collections.Counter((x.doc_id, len(x.text.split()), x.source) for x in mixed.collect())
    assert got == taken and all(x["copy_"] >= 1 for x in mixed.collect())


def test_run_is_its_stages(spark, tables):
    d, _ = tables
    got = corpus_pipeline.run(spark, d)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = common.cut(stage(spark, docs, d), "stage")
    assert sorted(map(repr, got.collect())) == sorted(map(repr, docs.collect())) and got.count() > 50


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None, None, None, None, None)] * 3, [(1, "", "", "", 0, 1, 2, "", "")]], ids=["empty", "nulls", "blank"])
def test_nothing_to_keep(spark, tables, tmp_path, rows):
    d, _ = tables
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{d}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.count() == 0 and got.columns == [*COLUMNS, "copy_"]


def test_stages_take_any_rows(spark, tables):
    """Nulls in any column, repeated rows and an empty table, in each stage by itself."""
    d, items = tables
    rows = [(None, None, None, None, None, None, None, None, None), (1, "a b c", None, None, None, None, None, None, None), (1, "a b c", None, None, None, None, None, None, None), (2, "", "en", "s", 0, 1, 1, "copy", "c")]
    docs = spark.createDataFrame(rows, SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        want = {"quality_rules": 0, "line_dedup": 4, "minhash": 4, "decontamination": 4}.get(name)
        out = stage(spark, docs, d)
        assert want is None or out.count() == want, name
        assert out.columns[: len(COLUMNS)] == COLUMNS and stage(spark, docs.limit(0), d).count() == 0
    assert decontamination.decontaminate(docs.withColumn("text", F.lit(items[0])), spark.read.parquet(f"{d}/benchmark.parquet")).count() == 0
    assert lines_of(rows)
