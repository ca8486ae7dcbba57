"""The calls of the engine as a command line and as JSON over HTTP."""

from __future__ import annotations

import argparse
import inspect
import json
import sys
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qsl, urlsplit

from seamline.operators.prompting import chat_generator, sentence_embedder
from seamline.plans.engine import Engine

RAW, INDEX = "data/raw", "data/processed"
GREEN, PLAIN = "\033[32m", "\033[0m"


class Calls:
    """Every call takes and gives plain values. Models are loaded by name; `embedder` and `generator` replace them."""

    def __init__(self, spark, embedder: Callable | None = None, generator: Callable | None = None, dim: int = 384) -> None:
        self._spark, self._embedder, self._generator, self._dim = spark, embedder, generator, dim

    def _engine(self, processed_path: str, model: str | None = None, cache_dir: str | None = None) -> Engine:
        return Engine(self._spark, processed_path, self._embedder or (sentence_embedder(model, cache_dir) if model else None), model, self._dim)

    def _mode(self, use_hybrid: bool, use_semantic: bool) -> str:
        return "hybrid" if use_hybrid else "semantic" if use_semantic else "keyword"

    def index(self, raw_path: str = RAW, processed_path: str = INDEX, max_chunk_size: int = 2000, embedding_model_name: str = "all-MiniLM-L6-v2", use_embedding: bool = False, use_keywords: bool = True, incremental: bool = False) -> dict:
        """Index a tree of files."""
        model = embedding_model_name if use_embedding or self._embedder else None
        n = self._engine(processed_path, model).index(raw_path, max_chunk_size, use_embedding, incremental, use_keywords)
        return {"Status": "Index Success", "chunks": n}

    def search(self, query: str, k: int = 1, processed_path: str = INDEX, question_id: str = "0", use_hybrid: bool = False, use_semantic: bool = False, use_cache: bool = False, embedding_model_name: str = "all-MiniLM-L6-v2") -> list[str]:
        """Places of the best chunks for a query."""
        mode = self._mode(use_hybrid, use_semantic)
        return self._engine(processed_path, None if mode == "keyword" else embedding_model_name).search(query, k, mode, question_id, use_cache or mode == "hybrid")

    def search_dataset(self, dataset_path: str, k: int = 1, save_directory: str = "data/output/search_results", processed_path: str = INDEX, save_file: str = "", use_hybrid: bool = False, use_semantic: bool = False, embedding_model_name: str = "all-MiniLM-L6-v2") -> dict:
        """Search all questions of a file."""
        mode = self._mode(use_hybrid, use_semantic)
        place = self._engine(processed_path, None if mode == "keyword" else embedding_model_name).search_dataset(dataset_path, None, k, mode, save_directory, save_file or None)
        return {"Status": f"Search Success, Saved Under {place}"}

    def answer(self, query: str, k: int = 1, generator_model_name: str = "Qwen/Qwen3-0.6B", cache_dir: str = "", processed_path: str = INDEX, question_id: str = "0", save_path: str = "") -> dict:
        """Answer a query from the best chunks."""
        generator = self._generator or chat_generator(generator_model_name, cache_dir or None)
        return {"question_id": question_id, "answer": self._engine(processed_path).answer(query, generator, k, "keyword", question_id, save_path or None)}

    def answer_dataset(self, search_results_path: str, save_directory: str = "data/output/answers", generator_model_name: str = "Qwen/Qwen3-0.6B", cache_dir: str = "", processed_path: str = INDEX) -> dict:
        """Answer saved search results."""
        generator = self._generator or chat_generator(generator_model_name, cache_dir or None)
        place = self._engine(processed_path).answer_results(search_results_path, None, generator, save_directory)
        return {"Status": f"Answers Saved Under {place}"}

    def evaluate(self, search_results_path: str, dataset_path: str, k: int = 1) -> dict:
        """Recall of saved results against answered questions."""
        return self._engine(INDEX).evaluate(search_results_path, dataset_path, k)


CALLS = ("index", "search", "search_dataset", "answer", "answer_dataset", "evaluate")
#: Calls that only read, and so answer GET as well as POST.
READ_ONLY = ("search", "evaluate")


def parameters(call: str) -> dict[str, inspect.Parameter]:
    return {n: p for n, p in inspect.signature(getattr(Calls, call)).parameters.items() if n != "self"}


def _bool(text: str) -> bool:
    if text.lower() not in ("true", "false", "1", "0", "yes", "no"):
        raise ValueError(f"not a truth value: {text!r}")
    return text.lower() in ("true", "1", "yes")


def _typed(parameter: inspect.Parameter, value: object) -> object:
    kind = {"int": int, "bool": _bool}.get(str(parameter.annotation), str)
    return kind(value) if isinstance(value, str) else value


def usage() -> str:
    """All calls with their arguments."""
    lines = ["python -m seamline CALL [--argument value ...]", "python -m seamline serve [--port 8000]", ""]
    for call in CALLS:
        lines.append(f"{call}: {getattr(Calls, call).__doc__}")
        lines += [f"    --{n}{'' if p.default is inspect.Parameter.empty else f' (default {p.default!r})'}" for n, p in parameters(call).items()]
    return "\n".join(lines)


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="seamline", description="Index, search, answer and evaluate.")
    sub = out.add_subparsers(dest="call", required=True)
    for call in CALLS:
        one = sub.add_parser(call, help=getattr(Calls, call).__doc__)
        for name, p in parameters(call).items():
            needed = p.default is inspect.Parameter.empty
            if p.annotation == "bool":
                one.add_argument(f"--{name}", nargs="?", const=True, default=p.default, type=_bool)
            else:
                one.add_argument(f"--{name}", required=needed, default=None if needed else p.default, type=int if p.annotation == "int" else str)
    sub.add_parser("usage", help="all calls with their arguments")
    serve = sub.add_parser("serve", help="the same calls over HTTP")
    serve.add_argument("--port", type=int, default=8000)
    serve.add_argument("--host", default="127.0.0.1")
    return out


def handler(calls: Calls) -> type[BaseHTTPRequestHandler]:
    """GET / tells the calls; GET or POST /CALL with arguments in the query or a JSON body makes one."""

    class Handler(BaseHTTPRequestHandler):
        def _send(self, status: int, body: object) -> None:
            raw = json.dumps(body, ensure_ascii=False).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def _serve(self, writes: bool) -> None:
            at = urlsplit(self.path)
            call = at.path.strip("/")
            if not call:
                self._send(200, {c: {"does": getattr(Calls, c).__doc__, "arguments": [*parameters(c)], "methods": ["GET", "POST"] if c in READ_ONLY else ["POST"]} for c in CALLS})
            elif call not in CALLS:
                self._send(404, {"error": f"there is no call {call!r}"})
            elif not writes and call not in READ_ONLY:
                self._send(405, {"error": f"{call} needs POST"})
            else:
                try:
                    size = int(self.headers.get("Content-Length") or 0)
                    given = dict(parse_qsl(at.query)) | (json.loads(self.rfile.read(size)) if size else {})
                    known = parameters(call)
                    if unknown := given.keys() - known.keys():
                        raise TypeError(f"unknown arguments: {sorted(unknown)}")
                    self._send(200, getattr(calls, call)(**{n: _typed(known[n], v) for n, v in given.items()}))
                except (TypeError, ValueError, FileNotFoundError) as error:
                    self._send(422, {"error": str(error)})
                except Exception as error:  # the server goes on
                    self._send(500, {"error": str(error).split("\n")[0]})

        def do_GET(self) -> None:
            self._serve(False)

        def do_POST(self) -> None:
            self._serve(True)

        def log_message(self, *_: object) -> None:
            pass

    return Handler


def main(arguments: list[str] | None = None, spark=None, **models: object) -> int:
    given = vars(parser().parse_args(arguments))
    call = given.pop("call")
    if call == "usage":
        print(usage())
        return 0
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("seamline").getOrCreate()
    from seamline.shipping import ship_package

    ship_package(spark)
    calls = Calls(spark, **models)
    if call == "serve":
        ThreadingHTTPServer((given["host"], given["port"]), handler(calls)).serve_forever()
        return 0
    try:
        print(f"{GREEN}{call}{PLAIN}" if sys.stdout.isatty() else call, file=sys.stderr)
        print(json.dumps(getattr(calls, call)(**given), indent=2, ensure_ascii=False))
    except (TypeError, ValueError, FileNotFoundError) as error:
        print(f"Error: {error}", file=sys.stderr)
        return 1
    return 0
