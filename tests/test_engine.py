"""Index versions, models, saved results, the command line and HTTP."""

import json
import threading
import urllib.error
import urllib.request
from http.server import ThreadingHTTPServer

import pytest

from seamline.operators import lexical
from seamline.operators.prompting import hashing_embedder
from seamline.plans import cli
from seamline.plans.engine import Engine
from seamline.sources import read_questions

TREE = {"a.py": "def retry(snapshot):\n    return snapshot\n", "b.md": "# Cache\n\nThe vocabulary cache is kept.\n", "c.py": "def tokens(text):\n    return text.split()\n"}


def _echo():
    def load():  # workers cannot import this module
        return lambda prompts: ["<think>x</think> " + json.loads(p)[1]["content"][:60] for p in prompts]

    return load


echo = _echo()


@pytest.fixture
def tree(tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    for name, text in TREE.items():
        (raw / name).write_text(text)
    return raw


def test_another_model_is_never_mixed_in(spark, tree, tmp_path):
    index = str(tmp_path / "index")
    a = Engine(spark, index, hashing_embedder(64), "a")
    a.index(str(tree), use_embedding=True)
    (tree / "c.py").write_text("def other(words):\n    return words\n")
    Engine(spark, index, hashing_embedder(64), "b").index(str(tree), incremental=True)
    meta = a.store.meta()
    assert "vectors" not in meta["tables"] and meta["model"] is None  # nothing of model a is left under the name of b
    a.index(str(tree), use_embedding=True)
    (tree / "c.py").write_text("def third(words):\n    return words\n")
    a.index(str(tree), incremental=True)
    assert a.store.meta()["model"] == "a" and a.store.read("vectors").count() == a.store.read("chunks").count()
    (tree / "a.py").write_text("x = 1\n")
    Engine(spark, index).index(str(tree), incremental=True)  # without an embedder
    assert a.store.read("chunks").where("file_path like '%a.py'").first().content == "x = 1"
    with pytest.raises((ValueError, FileNotFoundError)):
        a.hits(spark.createDataFrame([("1", "x")], "question_id string, question string"), 1, "semantic")


def test_a_failed_run_leaves_the_index(spark, tree, tmp_path, monkeypatch):
    engine = Engine(spark, str(tmp_path / "index"))
    engine.index(str(tree))
    before = engine.store.meta()
    monkeypatch.setattr(lexical, "bm25_postings", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        engine.index(str(tree))
    assert engine.store.meta() == before and engine.search("vocabulary cache")
    assert len([p for p in (tmp_path / "index").iterdir() if p.is_dir()]) == len(before["tables"])


def test_vectors_alone(spark, tree, tmp_path):
    engine = Engine(spark, str(tmp_path / "index"), hashing_embedder(64), "a")
    engine.index(str(tree), use_embedding=True, use_keywords=False)
    assert set(engine.store.meta()["tables"]) == {"chunks", "file_hashes", "vectors"} and engine.search("vocabulary cache", mode="semantic")
    with pytest.raises(ValueError):
        engine.index(str(tree), use_keywords=False)
    with pytest.warns(UserWarning, match="1 documents"):
        engine.index(spark.createDataFrame([("x.py", "y = 2", ".py"), ("n.txt", "text", ".txt")], "file_path string, content string, extension string"))


def test_cache_is_filled_and_used(spark, tree, tmp_path):
    engine = Engine(spark, str(tmp_path / "index"))
    engine.index(str(tree))
    first = engine.search("vocabulary cache", use_cache=True)
    assert engine.store.read("query_cache").count() == 1 and engine.search("vocabulary cache", use_cache=True) == first


def test_saved_results_are_answered(spark, tree, tmp_path):
    engine = Engine(spark, str(tmp_path / "index"))
    engine.index(str(tree))
    questions = tmp_path / "questions.json"
    questions.write_text(json.dumps({"rag_questions": [{"question_id": "q1", "question": "vocabulary cache?"}, {"question_id": "q2", "question": "zzz"}]}))
    found = engine.search_dataset(str(questions), k=2, save_directory=str(tmp_path / "out"))
    assert found.endswith("out/questions.json") and read_questions(spark, str(questions)).count() == 2
    monkey = engine.answer_results(found, generator=echo, save_directory=str(tmp_path / "answers"))
    rows = {r["question_id"]: r for r in json.loads(open(monkey).read())["search_results"]}
    assert rows["q1"]["answer"].startswith("Context:\n# Cache") and rows["q2"]["answer"] is None
    with pytest.raises(ValueError):
        engine.answer("zzz", echo)
    engine.answer("vocabulary", echo, save_path=str(tmp_path / "one.json"))
    assert json.loads((tmp_path / "one.json").read_text())["search_results"][0]["answer"]


def test_command_line_and_http(spark, tree, tmp_path, capsys):
    index = str(tmp_path / "index")
    assert cli.main(["usage"]) == 0 and "--max_chunk_size" in capsys.readouterr().out
    assert cli.main(["index", "--raw_path", str(tree), "--processed_path", index], spark) == 0
    assert cli.main(["search", "--query", "vocabulary cache", "--processed_path", index, "--k", "1"], spark) == 0
    assert "b.md [0:" in capsys.readouterr().out
    assert cli.main(["search", "--query", "x", "--processed_path", index, "--k", "0"], spark) == 1
    server = ThreadingHTTPServer(("127.0.0.1", 0), cli.handler(cli.Calls(spark, generator=echo)))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_address[1]}"
    assert set(json.load(urllib.request.urlopen(at))) == set(cli.CALLS)
    assert "b.md" in json.load(urllib.request.urlopen(f"{at}/search?query=vocabulary+cache&processed_path={index}"))[0]
    body = json.dumps({"query": "vocabulary cache", "processed_path": index}).encode()
    assert json.load(urllib.request.urlopen(urllib.request.Request(f"{at}/answer", data=body, method="POST")))["answer"].startswith("Context:")
    for path, status in (("/nothing", 404), ("/index", 405), ("/search?k=1", 422), ("/search?query=x&k=x", 422), ("/search?query=x&what=1", 422)):
        with pytest.raises(urllib.error.HTTPError) as error:
            urllib.request.urlopen(at + path)
        assert error.value.code == status
    server.shutdown()
