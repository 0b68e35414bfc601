"""Looking keys up by filters: exact whatever filters say, reading only what they can't rule out, and after appends that broke off."""

import re

import pytest
from pyspark.sql import functions as F

from tessera.sources import keys as K
from tessera.sources.store import Store


def chunks(spark, names, level=0):
    return spark.createDataFrame([(n, f"text of {n}", level) for n in names], "chunk_key string, text string, level int")


def stored(s):
    return sorted((r.level, r.chunk_key) for r in s.chunks().collect())


def looked_up(s, rows):
    """How many of rows are unknown, and the prefixes whose key files were read for it."""
    out = s.keys().unknown(rows)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    return out.count(), set(map(int, re.findall(r"\d+", plan.partition("prefix#")[2].partition(" IN ")[2].partition(")")[0] or (re.findall(r"\(prefix#\d+ = (\d+)\)", plan) or [""])[0])))


def test_what_is_there_is_known_and_little_is_read(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    s.append_chunks(chunks(spark, [f"a{i}" for i in range(300)]))
    s.append_chunks(chunks(spark, [f"a{i}" for i in range(250, 400)] + ["a0", "a0"]))
    assert stored(s) == sorted((0, f"a{i}") for i in range(400))
    s.append_chunks(chunks(spark, ["a1"], level=1))  # another level's key
    assert len(stored(s)) == 401
    assert looked_up(s, chunks(spark, [f"new{i}" for i in range(50)])) == (50, set())  # the filters know none of them: no key file is read
    n, prefixes = looked_up(s, chunks(spark, ["a7", "new"]))
    assert n == 1 and prefixes == {r.prefix for r in K.hashed(chunks(spark, ["a7"]), K.PREFIXES).collect()}  # one of sixteen


def test_many_appends_merge(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(K, "MERGE", 3)
    monkeypatch.setattr(K, "FULL", 2)  # filters that are too small at once: prefixes grow
    s = Store(spark, str(tmp_path))
    want = set()
    for i in range(6):
        names = {f"k{j}" for j in range(10 * i, 10 * i + 15)}
        s.append_chunks(chunks(spark, sorted(names)))
        want |= names
    assert stored(s) == sorted((0, n) for n in want)
    keys = s.keys()
    assert keys.size(keys.latest())[0] > K.PREFIXES and len(keys._names("rows")) <= 4 and len(keys._names("filters")) == 1
    assert keys.unknown(chunks(spark, sorted(want))).count() == 0


@pytest.mark.parametrize("where", ["before rows", "after rows"])
def test_an_append_that_broke_off(spark, tmp_path, monkeypatch, where):
    s = Store(spark, str(tmp_path))
    s.append_chunks(chunks(spark, ["a", "b"]))
    keys, rows = s.keys(), chunks(spark, ["c", "d"])
    keys._note(keys.latest() + 1, rows, K.PREFIXES)
    if where == "after rows":
        rows.write.mode("append").partitionBy("level").parquet(s.path("chunks"))
    s.append_chunks(chunks(spark, ["b", "c", "e"]))
    assert stored(s) == sorted((0, n) for n in ("abce" if where == "before rows" else "abcde"))


def test_a_merge_that_broke_off(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    for n in "abc":
        s.append_chunks(chunks(spark, [n]))
    keys = s.keys()
    keys._note(keys.latest() + 1, keys.rows(keys.latest()), 64)  # all keys as one batch, its filters not written
    s.append_chunks(chunks(spark, ["a", "b", "c", "d"]))
    assert stored(s) == [(0, n) for n in "abcd"]
    s.keys().merge()
    s.append_chunks(chunks(spark, ["a", "d"]))
    assert stored(s) == [(0, n) for n in "abcd"]


def test_a_store_that_was_there_before(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    chunks(spark, ["a", "b"]).write.partitionBy("level").parquet(s.path("chunks"))
    s.append_chunks(chunks(spark, ["b", "c"]))
    assert stored(s) == [(0, n) for n in "abc"]


def test_nothing_to_add(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    s.append_chunks(chunks(spark, []))
    s.append_chunks(chunks(spark, ["a"]))
    s.append_chunks(chunks(spark, []))
    s.append_chunks(chunks(spark, ["a"]))
    assert stored(s) == [(0, "a")] and s.chunks().where(F.col("text").isNull()).count() == 0
