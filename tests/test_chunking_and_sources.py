"""The splitter, the file source and the engine from end to end."""

import json

import pytest
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seamline.operators import chunking, prompting
from seamline.plans.engine import Engine
from seamline.sources import read_questions, read_results, read_tree
from seamline.sources.tree import decode


@given(st.text(alphabet="ab \n\tdef:#é", max_size=600), st.sampled_from([".py", ".md"]))
@settings(max_examples=150, deadline=None)
def test_pieces_are_within_size_and_cover_the_text(text, kind):
    spans = chunking.split_text(text, kind, size=60, overlap=15)
    covered = set()
    for a, b in spans:
        assert 0 < b - a <= 60 and text[a:b] == text[a:b].strip()
        covered.update(range(a, b))
    assert all(text[i].isspace() for i in range(len(text)) if i not in covered)


@pytest.mark.parametrize("n", [1999, 2000, 2001, 5000])
def test_a_word_without_boundaries(n):
    spans = chunking.split_text("x" * n, ".py")
    assert spans[0][0] == 0 and spans[-1][1] == n and all(b - a <= 2000 for a, b in spans)
    assert len(spans) == (1 if n <= 2000 else 2 if n <= 3800 else 3)


def test_functions_start_pieces():
    body = "    x = 1\n" * 30
    text = f"import os\n\ndef one():\n{body}\ndef two():\n{body}\nclass C:\n\tdef m(self):\n{body}"
    spans = chunking.split_text(text, ".py", size=350, overlap=50)
    heads = [text[a:b].split("\n")[0] for a, b in spans]
    assert heads == ["import os", "def two():", "class C:"]


def test_chunk_documents(spark):
    data = [("a.py", "def f():\n    pass\n", ".py"), ("b.txt", "text", ".txt"), ("c.MD", "# T\n\nwords", ".MD"), ("d.py", " \n", ".py"), ("e.py", None, ".py"), ("f.md", "x", None)]
    df = spark.createDataFrame(data, "file_path string, content string, extension string")
    got = chunking.chunk_documents(df)
    assert rows(got, "file_path", "content", "start_index", "end_index") == [("a.py", "def f():\n    pass", 0, 17), ("c.MD", "# T\n\nwords", 0, 10), ("f.md", "x", 0, 1)]
    assert rows(chunking.with_chunk_ids(got), "chunk_id", "file_path") == [(1, "a.py"), (2, "c.MD"), (3, "f.md")]
    with pytest.raises(ValueError):
        chunking.chunk_documents(df, size=100)


def make_tree(root):
    files = {"a.py": b"def alpha_one():\n    return 'quick fox'\n", "__init__.py": b"# initial words\n", "_x.py": b"x = 1\n", ".hid/c.py": b"hidden = 2\n", "U.PY": b"no", "n.txt": b"no", "m.md": b"# Title\r\n\r\nlazy dog h\xc3\xa9llo w\xffx\r\n"}
    for name, raw in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(raw)
    (root / "pkg.py").mkdir()


def test_tree(spark, tmp_path):
    make_tree(tmp_path)
    got = {r.file_path.removeprefix(f"{tmp_path}/"): r for r in read_tree(spark, str(tmp_path)).collect()}
    assert set(got) == {"a.py", "__init__.py", "_x.py", ".hid/c.py", "m.md"}
    assert got["m.md"].content == "# Title\n\nlazy dog héllo wx\n"
    assert read_tree(spark, str(tmp_path / "__init__.py")).count() == 1
    assert read_tree(spark, str(tmp_path / "absent")).count() == 0
    assert decode(b"\xef\xbb\xbfa\rb") == "\ufeffa\nb"


def test_prompt_parts(spark):
    hits = spark.createDataFrame([("q", 1, "second"), ("q", 0, "first"), ("q", 2, None)], "question_id string, rank int, content string")
    assert rows(prompting.context_text(hits)) == [("q", "first\n\nsecond")]
    df = spark.createDataFrame([([1, 9, 2, 9, 3, 4],), ([1, 2],), ([],), ([9],)], "a array<int>")
    assert [list(r[0]) for r in df.select(prompting.after_last_marker(F.col("a"), 9)).collect()] == [[3, 4], [1, 2], [], []]


def test_engine(spark, tmp_path):
    def echo():  # inside, so that workers get the function itself
        return lambda prompts: [f"thinking</think> answer {len(p) > 0}" for p in prompts]

    raw = tmp_path / "raw"
    make_tree(raw)
    engine = Engine(spark, str(tmp_path / "index"), prompting.hashing_embedder(64), "hash", 64)
    with pytest.raises(ValueError):
        engine.index(str(tmp_path / "absent"))
    n = engine.index(str(raw), use_embedding=True)
    assert n == 5 and engine.index(str(raw), use_embedding=True, incremental=True) == 5
    assert engine.search("quick fox", 1)[0].startswith(f"{raw}/a.py [0:")
    for mode in ("semantic", "hybrid"):
        assert engine.search("lazy dog", 1, mode)[0].startswith(f"{raw}/m.md [")

    # an incremental run equals a full one in content
    (raw / "a.py").write_text("def alpha_two():\n    return 'slow snail'\n")
    (raw / "_x.py").unlink()
    (raw / "new.md").write_text("# Fresh\n\nbrand new page\n")
    before = engine.store.meta()["top_id"]
    assert engine.index(str(raw), use_embedding=True, incremental=True) == 5
    other = Engine(spark, str(tmp_path / "full"), prompting.hashing_embedder(64), "hash", 64)
    other.index(str(raw), use_embedding=True)
    columns = ("file_path", "content", "start_index", "end_index")
    assert rows(engine.store.read("chunks"), *columns) == rows(other.store.read("chunks"), *columns)
    assert rows(engine.store.read("postings").groupBy("term").agg(F.sum("tf"))) == rows(other.store.read("postings").groupBy("term").agg(F.sum("tf")))
    assert engine.store.read("vectors").count() == 5 and engine.store.meta()["top_id"] == before + 2
    assert engine.search("snail", 1) and not engine.search("fox", 1)

    # data sets, answers, evaluation, cache
    place = {"file_path": f"{raw}/new.md", "first_character_index": 0, "last_character_index": 23}
    data = tmp_path / "questions.json"
    data.write_text(json.dumps({"rag_questions": [{"question_id": "1", "question": "brand new page", "sources": [place], "answer": "x"}, {"question_id": "2", "question": "nothing matches zzz"}]}))
    assert read_questions(spark, str(data)).count() == 2
    out = tmp_path / "out" / "results.json"
    engine.search_dataset(str(data), str(out), k=2)
    saved = json.loads(out.read_text())
    assert saved["k"] == 2 and [len(r["retrieved_sources"]) for r in saved["search_results"]] == [1, 0]
    assert read_results(spark, str(out)).count() == 2
    assert engine.evaluate(str(out), str(data), 2)["Recall@2"] == "0.500 (50.00%)"
    engine.answer_dataset(str(data), str(tmp_path / "answers.json"), echo, k=1)
    assert json.loads((tmp_path / "answers.json").read_text())["search_results"][0]["answer"] == "answer True"
    assert engine.answer("brand new page", echo) == "answer True"
    asked = read_questions(spark, str(data)).select("question_id", "question")
    hits = engine.hits(asked, 2, "hybrid")
    engine.remember(asked, hits, 2, "hybrid")
    assert rows(engine.hits(asked, 2, "hybrid", use_cache=True), "question_id", "rank", "chunk_id") == rows(hits, "question_id", "rank", "chunk_id")
    short = tmp_path / "short.json"
    short.write_text(json.dumps({"rag_questions": []}))
    assert engine.evaluate(str(out), str(short), 1) == {"Error": "Internal Data Mismatch"}


def test_stream(spark, tmp_path):
    from seamline.streaming import follow_files, stream_terms

    schema = "path string, content string, loaded_at timestamp"
    source = tmp_path / "in"
    spark.sql("select 'a.md' path, 'first words here' content, timestamp'2024-01-01' loaded_at").coalesce(1).write.parquet(str(source))
    engine = Engine(spark, str(tmp_path / "index"))
    run = lambda: follow_files(spark.readStream.schema(schema).parquet(str(source)), engine, str(tmp_path / "cp"), str(tmp_path / "snap")).awaitTermination()
    run()
    spark.sql("select 'a.md' path, 'second words here' content, timestamp'2024-01-02' loaded_at union all select 'b.md', 'other page', timestamp'2024-01-02'").coalesce(1).write.mode("append").parquet(str(source))
    run()
    assert rows(engine.store.read("chunks"), "file_path", "content") == [("a.md", "second words here"), ("b.md", "other page")]
    q = stream_terms(spark.readStream.schema(schema).parquet(str(source)), "loaded_at", "content").writeStream.outputMode("complete").format("memory").queryName("term_stream").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select sum(n) s from term_stream where term = 'words'").first().s == 2
