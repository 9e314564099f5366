"""The commands over a small site, served by this machine."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from ledgerloom import __main__ as commands
from ledgerloom import pipeline
from ledgerloom.operators import embed
from ledgerloom.sources import registry

WORDS = " ".join(f"word{i}" for i in range(30))
PAGES = {
    "/house": ("1", "amc_overview", "House", f"<main><h1>The fund house</h1><h2>Office</h2><p>The fund house is in Pune and keeps 30 people. {WORDS}</p></main>"),
    "/elss": ("2", "elss", "ELSS", f"<main><h1>ELSS tax saver</h1><h2>Exit load</h2><p>The exit load of the elss fund is 5% of units. {WORDS}</p></main>"),
    "/mid": ("3", "mid_cap", "Mid", f"<main><h1>Mid cap</h1><h2>Exit load</h2><p>The exit load of the mid cap fund is 7% of units. {WORDS}</p></main>"),
}


class Site(BaseHTTPRequestHandler):
    def do_GET(self):  # noqa: N802 - the name is the protocol's
        found = PAGES.get(self.path)
        self.send_response(200 if found or self.path == "/data" else 404)
        self.send_header("Content-Type", "application/json" if self.path == "/data" else "text/html; charset=utf-8")
        self.end_headers()
        self.wfile.write((found[3] if found else "{}").encode())

    def log_message(self, *_):
        pass


@pytest.fixture(scope="module")
def site():
    server = HTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


@pytest.fixture(scope="module")
def root(site, tmp_path_factory):
    at = tmp_path_factory.mktemp("root")
    rows = [f"{d},{s},{t},{site}{u},True" for u, (d, s, t, _) in PAGES.items()]
    (at / "sources.csv").write_text("\n".join(["doc_id,scheme,title,url,allowed", *rows, f"9,old,Gone,{site}/gone,False"]) + "\n")
    questions = {
        "in_scope": [{"id": 1, "question": "What is the exit load of the elss fund?", "expect_fact": "5%", "doc_id": "2", "scheme": "elss", "grounding": "5% of units"}, {"id": 2, "question": "What is the exit load of the mid cap fund?", "expect_fact": "7%", "doc_id": "3", "scheme": "mid_cap", "grounding": None}],
        "refusals": [{"id": 1, "question": "Should I buy the elss fund?", "why": "advice"}],
        "pii": [{"id": 1, "input": "my pan is ABCDE1234F", "why": "pan", "secrets": ["ABCDE1234F"]}],
    }
    (at / "questions.json").write_text(json.dumps(questions))
    return at


def run(*argv):
    return commands.main([str(x) for x in argv])


def test_ingest_ask_and_evaluate(spark, root, capsys):
    more = ("--root", root, "--backend", "hashed")
    assert run("ingest", *more) == 0
    said = capsys.readouterr().out
    assert "mid_cap" in said and "3 vectors" in said and "TOTAL" in said and "|v|^2 1.000000" in said and "peak memory" in said
    assert sorted(p.name.split("_")[0] for p in root.iterdir() if p.is_dir()) == ["clean", "dump", "index", "lexical", "raw"]
    index = [p.name for p in root.glob("index_*")]
    assert run("ingest", "--offline", *more) == 0 and [p.name for p in root.glob("index_*")] == index
    assert run("ingest", "--offline", "--rebuild", "--no-dump", "--no-preview", *more) == 0 and [p.name for p in root.glob("index_*")] == index
    assert run("sources", "--root", root) == 0 and "| 2 | elss | ELSS |" in capsys.readouterr().out
    assert run("ask", "--one", "What is the exit load of the mid cap fund?", *more) == 0
    said = capsys.readouterr().out
    assert said.startswith("answered:") and "7%" in said and "narrowed by scheme:mid_cap" in said and "lexical" in said
    assert run("ask", "--one", "Should I buy elss?", "--no-chunks", *more) == 0
    said = capsys.readouterr().out
    assert said.startswith("refused_advice  [advice:SHOULD_I]:") and "/elss" in said and "Retrieved" not in said
    assert run("ask", "--one", "What is the exit load of the elss fund?", "--generator", "tests.test_commands:no_key", *more) == 2
    assert "no_key" in capsys.readouterr().out
    assert run("evaluate", *more) == 0
    said = capsys.readouterr().out
    assert "RESULT: PASS" in said and "S5 right page" in said and "2/2" in said and said.count("ok  ") == 10
    assert run("evaluate", "--generator", "tests.test_commands:drift", *more) == 1 and "FAIL answered" in capsys.readouterr().out


def no_key(_):
    from ledgerloom.operators.memory import NoKey

    raise NoKey


def drift(_):
    return "You should buy it."


def test_a_conversation(spark, root, capsys, monkeypatch):
    monkeypatch.setattr("sys.stdin", iter(["What is the exit load of the elss fund?\n", "my pan is ABCDE1234F\n", "\n", "and for mid cap?\n", "quit\n", "never asked\n"]))
    seen = []
    ask = pipeline.ask

    def spy(spark, root, questions, *rest):
        seen.append(questions[0][2])
        return ask(spark, root, questions, *rest)

    monkeypatch.setattr(pipeline, "ask", spy)
    assert run("ask", "--no-chunks", "--root", root, "--backend", "hashed") == 0
    assert [len(h) for h in seen] == [0, 2, 3] and not any("ABCDE" in c for h in seen for _, c in h)


def test_what_is_missing_is_an_error(spark, root, site, tmp_path, capsys):
    src = registry.read_csv(spark, f"{root}/sources.csv")
    texts = registry.read_clean(spark, f"{root}/clean")
    with pytest.raises(FileNotFoundError, match="3_mid_cap"):
        registry.complete(texts.where("doc_id <> '3'"), src)
    assert registry.complete(texts, src).count() == 3
    (tmp_path / "7_x.txt").write_text("# T\n## A\nb\n")
    assert [tuple(r) for r in registry.read_clean(spark, str(tmp_path)).collect()] == [("7", "# T\n## A\nb\n")]
    bad = spark.createDataFrame([("5", "s", "t", f"{site}/data", True)], registry.SCHEMA)
    with pytest.raises(Exception, match="expected text/html"):
        registry.fetch(bad).collect()
    with pytest.raises(Exception, match="404"):
        registry.fetch(bad.replace(f"{site}/data", f"{site}/none")).collect()
    assert commands.main(["ingest", "--root", str(tmp_path), "--offline", "--backend", "hashed"]) == 1 and "failed" in capsys.readouterr().err
    assert registry.lookup(src, scheme="elss").first().label == "ELSS" and registry.lookup(src, url="x").count() == 0 and registry.lookup(src, doc_id="3").first().scheme == "mid_cap"


def test_embedders_by_name(caplog):
    class Broken:
        dim, name = 8, "broken"

        def encode(self, texts):
            raise OSError("no file")

    model = embed.FirstAvailable(Broken(), embed.HashedEmbedder(8))
    assert model.encode(["fund load"]).shape == (1, 8) and "broken isn't available" in caplog.text
    with pytest.raises(RuntimeError):
        embed.FirstAvailable(Broken()).encode(["x"])
    with pytest.raises(ValueError):
        embed.FirstAvailable(Broken(), embed.HashedEmbedder(9))
    with pytest.raises(ValueError):
        embed.backend("torch")


def test_an_index_without_all_vectors_is_an_error(spark, tmp_path):
    from ledgerloom.operators import store

    rows = [(0, "1", "sec", "u", "a", [1.0]), (1, "1", "sec", "u", "b", None)]
    chunks = spark.createDataFrame(rows, "chunk_index int, doc_id string, section string, url string, text string, embedding array<float>")
    with pytest.raises(RuntimeError, match="1 vectors"):
        store.build(chunks, str(tmp_path), "0badc0de", "2025-01-01")
    assert not list(tmp_path.iterdir())
