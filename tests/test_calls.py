"""Calls to a model: options, kinds of failure, tries, and answers that outlive the task that asked."""

import http.server
import json
import os
import threading
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.engine import Engine
from tessera.operators import generation, retrieval, summaries
from tessera.operators.calls import Answers, tried

SCHEMA = "query_id long, prompt string"


@pytest.fixture()
def server():
    """Counts how often each prompt is asked; `busy` ones fail once, `broken` ones always, `slow` ones take too long."""
    asked, options, busy, lock = Counter(), [], [0, 0], threading.Lock()

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            p = body["prompt"]
            with lock:
                asked[p] += 1
                options.append(body["options"])
                busy[0] += 1
                busy[1] = max(busy)
            time.sleep(1.5 if "slow" in p else 0.02)
            with lock:
                busy[0] -= 1
            self.send_response(404 if "missing" in p else 500 if "broken" in p or ("busy" in p and asked[p] == 1) else 200)
            self.end_headers()
            try:
                self.wfile.write(json.dumps({"response": f" re {p} "}).encode())
            except OSError:
                pass

        def log_message(self, *_):
            pass

    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    s.url, s.asked, s.options, s.busy = f"http://127.0.0.1:{s.server_port}", asked, options, busy
    yield s
    s.shutdown()


def test_options(server):
    generation.HttpModel(server.url, "m", 0.2)("a")
    generation.HttpModel(server.url, "m", 0.2).for_summaries()("a")
    generation.HttpModel(server.url, "m", 0.2, top_k=7, top_p=None)("a")
    assert server.options == [
        {"temperature": 0.2, "num_predict": -1, "top_k": 40, "top_p": 0.9},
        {"temperature": 0.2, "num_predict": 500},
        {"temperature": 0.2, "num_predict": -1, "top_k": 7},
    ]


def test_kinds_of_failure_and_tries(server):
    m = generation.HttpModel(server.url, "m", timeout=0.5)
    assert tried(m, "busy", 3, 0.01) == ("re busy", None, None) and server.asked["busy"] == 2
    assert tried(m, "broken", 3, 0.01) == (None, "error", "API error: 500") and server.asked["broken"] == 3
    assert tried(m, "missing", 3, 0.01) == (None, "error", "API error: 404") and server.asked["missing"] == 1  # another try can't help
    assert tried(m, "slow", 2, 0.01) == (None, "timeout", "Request timeout")
    assert tried(generation.HttpModel("http://127.0.0.1:9", "m"), "x", 1, 0)[1] == "error"


def test_answers_are_kept_and_calls_bounded(spark, server, tmp_path):
    m = generation.HttpModel(server.url, "m", timeout=1)
    rows = spark.createDataFrame([(i, f"p{i % 30}") for i in range(90)] + [(90, None), (91, "broken"), (92, "slow"), (93, ""), (94, "busy")], SCHEMA).repartition(5)
    kept = Answers(spark, str(tmp_path), m, "m", in_flight=2, tasks=2, tries=2, wait=0.01)
    for attempt in (1, 2):
        got = {r.query_id: r for r in kept.ask(rows).collect()}
        assert len(got) == 95 and all(got[i].answer == f"re p{i % 30}" and got[i].tokens == 2 and got[i].failure is None for i in range(90))
        assert (got[90].answer, got[90].failure) == (None, None) and got[91].message == "API error: 500" and got[92].failure == "timeout"
        assert got[93].answer == "re" and got[94].answer == "re busy"
        assert all(n == 1 for p, n in server.asked.items() if p.startswith("p")) and len([p for p in server.asked if p.startswith("p")]) == 30
        assert server.asked["broken"] == 2 * attempt  # failures aren't kept
        assert not os.path.exists(tmp_path / "journal")
    assert server.busy[1] <= 4
    assert kept.kept().count() == 32
    other = Answers(spark, str(tmp_path), str.upper, "other")
    assert {r.answer for r in other.ask(rows.where("query_id < 30")).collect()} == {f"P{i}" for i in range(30)}
    assert kept.ask(rows.limit(0)).count() == 0


def test_a_task_that_dies_asks_nothing_twice(spark, server, tmp_path):
    m, flag = generation.HttpModel(server.url, "m"), str(tmp_path / "died")

    def dies(prompt):
        said = m(prompt)
        if prompt == "p20" and not os.path.exists(flag):
            open(flag, "w").close()
            os._exit(1)  # the answer to p20 itself is lost with the worker: it was never returned
        return said

    rows = spark.createDataFrame([(i, f"p{i}") for i in range(40)], SCHEMA)
    kept = Answers(spark, str(tmp_path / "kept"), dies, "m", in_flight=1, tasks=1)
    with pytest.raises(Exception):
        kept.ask(rows)
    assert os.path.exists(flag) and kept.kept() is None
    assert {r.answer for r in kept.ask(rows).collect()} == {f"re p{i}" for i in range(40)}
    assert {p for p, n in server.asked.items() if n > 1} <= {"p20"} and len(server.asked) == 40


def contexts(spark):
    questions = spark.createDataFrame([(1, "one"), (2, "slow"), (3, "none")], "query_id long, question string")
    hits = spark.createDataFrame([(1, 1, 0.5, "text", "a", 0), (2, 1, 0.5, "text", "b", 0)], "query_id long, rank int, score double, text string, source string, cluster_id int")
    return retrieval.contexts(questions, hits)


def test_records_say_what_failed(spark, server, tmp_path):
    m = generation.HttpModel(server.url, "m", timeout=0.7)
    for model in (m, Answers(spark, str(tmp_path), m, "m", tries=1)):
        got = {r.query_id: r for r in retrieval.answers(contexts(spark), model, failures=True).collect()}
        assert [got[i].failures for i in (1, 2, 3)] == [None, "timeout", "no_context"]
        assert got[2].answer == "Error: Request timeout" and got[3].answer == "Error: No relevant chunks found"
        assert got[1].context_chunks == 1 and got[1].relevance_scores == [0.5] and got[1].sources == ["a"] and got[2].relevance_scores is None and got[2].sources == []
        assert retrieval.answers(contexts(spark), model).columns[-1] == "response_time"


def test_summaries_by_kept_answers(spark, tmp_path):
    rows = spark.createDataFrame([(c, i, f"cluster {c} words number{i}") for c in (0, 1, None) for i in range(4)], "cluster_id int, chunk_key int, text string")

    def model(text):
        if "cluster 1" in text:
            raise RuntimeError("no")
        return "made" if "cluster 0" in text else " "

    want = sorted(summaries.summaries(rows, "cluster_id", "chunk_key", model).collect(), key=str)
    kept = Answers(spark, str(tmp_path), model, "m", tries=1)
    assert sorted(summaries.summaries(rows, "cluster_id", "chunk_key", kept).collect(), key=str) == want
    assert {r.cluster_id: r.summary for r in want}[0] == "made" and kept.kept().count() == 2


def test_engine_keeps_answers(spark, server, tmp_path):
    (tmp_path / "a.txt").write_text("The Danube flows through ten countries.")
    e = Engine(spark, str(tmp_path / "store"), model=generation.HttpModel(server.url, "m"), model_name="m", keep=True)
    e.ingest([str(tmp_path / "a.txt")])
    first, second = (e.ask(["What flows?"]).select("answer", "sources").first() for _ in range(2))
    assert first == second and sum(server.asked.values()) == 1
    assert e.chat("What flows?")["answer"].startswith("re ") and e.store.read("answers/answers").where(F.col("tokens") > 0).count() >= 1


def test_answers_end_where_they_are_cut(spark, tmp_path):
    """An answer of 500 characters that ends with a space keeps it; a best hit without text has no answer, which isn't an empty one."""
    text = "w" * 499 + " and on"
    hits = spark.createDataFrame([(1, 1, 0.9, text, "s", None), (2, 1, 0.9, None, "s", None), (2, 2, 0.8, "second", "s", None)], "query_id long, rank int, score double, text string, source string, cluster_id int")
    rows = retrieval.contexts(spark.createDataFrame([(1, "a?"), (2, "b?")], "query_id long, question string"), hits)
    kept = Answers(spark, str(tmp_path / "kept"), generation.extractive, "extractive")
    for model in (generation.extractive, kept, kept):
        got = {r.query_id: (r.answer, r.context_chunks, r.tokens_generated) for r in retrieval.answers(rows, model).collect()}
        assert got == {1: (text[:500], 1, 1), 2: (None, 2, None)}
