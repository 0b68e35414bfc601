import http.server
import json
import threading

import pytest

from tessera import cli
from tessera.engine import Engine
from tessera.operators import generation

FACTS = {
    "rivers.txt": "The Danube flows through ten countries. It ends in the Black Sea.",
    "towers.md": "The tower of Pisa leans. It was finished in the year 1372.",
    "moons.tex": "\\section{Moons} Jupiter has many moons. Ganymede is the largest of the moons. % a note",
}


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    folder = tmp_path_factory.mktemp("files")
    for name, text in FACTS.items():
        (folder / name).write_text(text)
    (folder / "empty.txt").write_text(" \n ")
    return [str(folder / n) for n in (*FACTS, "empty.txt")]


@pytest.fixture(scope="module")
def engine(spark, files, tmp_path_factory):
    e = Engine(spark, str(tmp_path_factory.mktemp("store")), k=2)
    assert e.ingest(files) == 3 and e.ingest(files) == 0  # the empty file has no chunk; nothing is added twice
    return e


def test_ingested_chunks(engine):
    rows = {r.source: r for r in engine.store.chunks(0).collect()}
    assert set(rows) == set(FACTS) and all(len(r.embedding) == 64 for r in rows.values())
    assert rows["moons.tex"].text.startswith("### SECTION: Moons ###") and "a note" not in rows["moons.tex"].text


def test_ask_in_one_pass(engine):
    asked = ["Where does the Danube end?", "Which is the largest of the moons?", "When was the tower of Pisa finished?"]
    got = {r.query_id: r for r in engine.ask(asked).collect()}
    assert "Danube" in got[0].answer and got[0].context_chunks == 2 and "rivers.txt" in got[0].sources
    assert "moons" in got[1].answer.lower() and "Pisa" in got[2].answer
    assert all(r.response_time >= 0 and r.tokens_generated == len(r.answer.split()) for r in got.values())


def test_chat_remembers(spark, engine):
    e = Engine(spark, engine.store.folder, k=1, model=lambda p: "Because " + p.partition("QUESTION: ")[2].partition("\n")[0] + ("!" if "first thing" in p.partition("HISTORY")[2] else ""))
    assert e.chat("first thing")["answer"] == "Because first thing"
    second = e.chat("and the second?")
    assert second["answer"].endswith("!") and second["conversation_turns"] == 2 and e.stats()["session_queries"] == 2


def test_exports(engine, tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    assert Engine(engine.spark, engine.store.folder).export_conversation() is None
    e = Engine(engine.spark, engine.store.folder, k=1)
    e.chat("What flows?")
    path = e.export_conversation()
    assert path.startswith("conversation_")
    said = json.loads((tmp_path / path).read_text())
    assert said["total_queries"] == 1 and said["model"] == "extractive" and set(said["conversation"][0]) == {"question", "answer", "timestamp", "sources"}
    batch = json.loads((tmp_path / e.export_batch(["a moon?", "a tower?"])).read_text())
    assert [r["question"] for r in batch] == ["a moon?", "a tower?"] and all(r["relevance_scores"] for r in batch)


def test_build_and_look_around(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "store"))
    for i in range(6):
        (tmp_path / f"f{i}.txt").write_text(("rivers and boats " if i % 2 else "stone towers ") * 60 + f"number {i}")
    e.ingest([str(tmp_path / f"f{i}.txt") for i in range(6)], how="sliding")
    assert e.clusters() is None and e.stats()["summaries"] == 0
    history = e.build(most_levels=2, starts=1, rounds=10).collect()
    assert history[0].n_items == e.n_chunks(0) and e.stats()["summaries"] >= 2
    assert {r.level for r in e.clusters().collect()} >= {0} and e.by_level("rivers", 0, 1).first().text
    record = e.ask(["rivers and boats?"]).first()
    assert record.context_chunks == 5 and not record.answer.startswith("Error")
    e.export_tables(str(tmp_path / "csv"))
    assert spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "csv/clustering_history")).count() == len(history)


def test_command_line(spark, files, tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    said = []
    run = lambda *args, **more: cli.main(["--db-path", str(tmp_path / "db"), *args], spark, say=said.append, **more)
    assert run("--query", "x") == 1 and "No store" in said[-1]
    assert run("--ingest", *files) == 0 and "Added 3 chunks" in said
    assert run("--batch", "nowhere.txt") == 1 and "not found" in said[-1]
    said.clear()
    assert run("--query", "Where does the Danube end?", "--quiet", "--chunks", "1", "--no-summaries") == 0
    assert "Danube" in said[0] and said[1] == "Sources: rivers.txt"
    (tmp_path / "q.txt").write_text("a moon?\n\na tower?\n")
    assert run("--batch", "q.txt", "--export", "out.json") == 0 and len(json.loads((tmp_path / "out.json").read_text())) == 2
    said.clear()
    lines = ["", "/help", "/stats", "/sources", "/clusters", "the tower of Pisa?", "/STATS", "/clear", "/stats", "/quit", "never read"]
    assert run("--quiet", "--export", "talk.json", lines=lines) == 0
    text = "\n".join(said)
    assert "/clusters" in text and "towers.md: 1 chunks" in text and "session queries: 1" in text and said[-2:] == ["Goodbye!", "No conversation to export"]
    assert said.count("Chunks: 3, summaries: 0, session queries: 0") == 2 and "never" not in text


def test_interaction_goes_on_after_an_error(engine):
    said = []

    def fails(_):
        raise RuntimeError("no answer")

    cli.interact(Engine(engine.spark, engine.store.folder, model=fails), ["what?", "/stats"], said.append)
    assert said[0] == "Error: no answer" and said[-1].endswith("session queries: 0")


@pytest.fixture()
def server():
    class Handler(http.server.BaseHTTPRequestHandler):
        def reply(self, body):
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(body).encode())

        def do_GET(self):
            self.reply({"models": [{"name": "small:1b"}]})

        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            self.reply({"response": f" {asked['model']} at {asked['options']['temperature']}: {len(asked['prompt'])} "})

        def log_message(self, *_):
            pass

    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


def test_models_and_availability(server, engine):
    model = generation.named(f"{server}#small:1b", 0.7)
    assert model("abc") == "small:1b at 0.7: 3" and generation.available(model)[0]
    assert not generation.available(generation.named(f"{server}#large"))[0]
    assert not generation.available(generation.HttpModel("http://127.0.0.1:9", "x"))[0]
    assert generation.available(generation.extractive) == (True, "extractive needs no service")
    assert generation.named("json:dumps") is json.dumps
    with pytest.raises(ValueError):
        generation.named("nothing")
    record = Engine(engine.spark, engine.store.folder, model=model).ask(["a moon?"]).first()
    assert record.answer.startswith("small:1b at 0.7")


def test_prompt_has_the_text_it_should():
    from tessera.operators import retrieval

    head = """You are a knowledgeable assistant. Answer the question based ONLY on the provided context.

INSTRUCTIONS:
- Answer based only on the information in the context
- If the context doesn't contain the answer, say "I don't have enough information to answer that"
- Be concise but thorough
- When quoting sources, mention the document name
- Use a helpful, friendly tone
"""
    assert retrieval.SYSTEM == head
