"""Functions of source files paired with their documentation, by a lexer that knows strings and comments."""

from __future__ import annotations

import ast
import re
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Words that tell nothing about a function.
TRIVIAL_WORDS = frozenset("a an the this that of to for and in on it is function method todo fixme tbd doc docs docstring documentation description here add write missing placeholder".split())
LEAST_WORDS = 3
LANGUAGES = {".py": "python", ".js": "script", ".ts": "script", ".go": "go"}


class Found(NamedTuple):
    name: str
    line: int
    start: int
    end: int
    doc: str


class Token(NamedTuple):
    kind: str  # name, string, comment, number, regex, newline or the character itself
    start: int
    end: int


class Tokens(list):
    """The tokens of a text; brackets are matched once, in one pass."""

    closing: dict[int, int] | None = None


_PY = re.compile(
    r"""(?P<skip>\\\r?\n|[ \t\r\f﻿]+)|(?P<word>[^\W\d]\w*+(?!["']))|(?P<comment>\#[^\n]*)
    |(?P<string>[A-Za-z]{0,2}(?:\"\"\"(?:\\.|(?!\"\"\")[^\\])*(?:\"\"\"|\\?\Z)|'''(?:\\.|(?!''')[^\\])*(?:'''|\\?\Z)|"(?:\\.|[^"\\\n])*(?:"|(?=\n)|\\?\Z)|'(?:\\.|[^'\\\n])*(?:'|(?=\n)|\\?\Z)))
    |(?P<name>[^\W\d]\w*)|(?P<number>\d[\w.]*)|(?P<newline>\n)|(?P<other>.)""",
    re.X | re.S,
)
_GO = re.compile(
    r"""(?P<skip>[ \t\r\f﻿]+)|(?P<word>[^\W\d]\w*+)|(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))
    |(?P<string>`[^`]*(?:`|\Z)|"(?:\\.|[^"\\\n])*(?:"|(?=\n)|\\?\Z)|'(?:\\.|[^'\\\n])*(?:'|(?=\n)|\\?\Z))
    |(?P<number>\d[\w.]*)|(?P<newline>\n)|(?P<other>.)""",
    re.X | re.S,
)
_SCRIPT = re.compile(
    r"""(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))
    |(?P<string>"(?:\\.|[^"\\\n])*(?:"|(?=\n)|\\?\Z)|'(?:\\.|[^'\\\n])*(?:'|(?=\n)|\\?\Z))
    |(?P<name>[#@]?(?:[^\W\d]|\$)[\w$]*)|(?P<number>\d[\w.]*)|(?P<newline>\n)|(?P<arrow>=>)|(?P<skip>[ \t\r\f﻿]+)|(?P<other>.)""",
    re.X | re.S,
)
_REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[A-Za-z]*", re.S)
_BEFORE_REGEX = frozenset("return typeof case in of delete void throw new else do yield await instanceof".split())


def _lex(text: str, pattern: re.Pattern) -> Tokens:
    out, new = Tokens(), tuple.__new__
    for m in pattern.finditer(text):
        kind = m.lastgroup
        if kind != "skip":
            start, end = m.span()
            out.append(new(Token, ("name" if kind == "word" else text[start] if kind == "other" else kind, start, end)))
    return out


def _template_end(text: str, at: int) -> int:
    """The end of a template literal whose first backtick is at `at`, embedded expressions included."""
    depth: list[int] = []  # open braces in each embedded expression
    i, n = at + 1, len(text)
    while i < n:
        c = text[i]
        if c == "\\":
            i += 2
            continue
        if not depth or depth[-1] < 0:
            if c == "`":
                if not depth:
                    return i + 1
                depth.pop()
            elif c == "$" and text[i + 1 : i + 2] == "{":
                depth.append(0)
                i += 1
        elif c == "{":
            depth[-1] += 1
        elif c == "}":
            if depth[-1] == 0:
                depth.pop()
            else:
                depth[-1] -= 1
        elif c == "`":
            depth.append(-1)
        elif c in "\"'":
            m = re.compile(rf"{c}(?:\\.|[^{c}\\\n])*{c}", re.S).match(text, i)
            i = m.end() - 1 if m else i
        i += 1
    return n


def _lex_script(text: str) -> Tokens:
    out = Tokens()
    at, n, before = 0, len(text), None
    while at < n:
        c = text[at]
        if c == "`":
            token = Token("string", at, _template_end(text, at))
        else:
            m = _SCRIPT.match(text, at)
            kind = m.lastgroup
            if kind == "skip":
                at = m.end()
                continue
            token = Token(m.group() if kind == "other" else kind, at, m.end())
            if token.kind == "/":
                value = before is not None and (before.kind in (")", "]", "}", "number", "string") or (before.kind == "name" and text[before.start : before.end] not in _BEFORE_REGEX))
                r = None if value else _REGEX.match(text, at)
                if r:
                    token = Token("regex", at, r.end())
        out.append(token)
        at = token.end
        if token.kind not in ("comment", "newline"):
            before = token
    return out


class _Lines:
    def __init__(self, text: str) -> None:
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]

    def of(self, position: int) -> int:
        return bisect_right(self.starts, position)


def _closing(tokens: Tokens, at: int) -> int:
    """Index of the token that closes the bracket at index `at`; the last index where none does."""
    if tokens.closing is None:
        tokens.closing, opened = {}, []
        for i, token in enumerate(tokens):
            if token.kind in ("(", "[", "{"):
                opened.append(i)
            elif token.kind in (")", "]", "}") and opened:
                tokens.closing[opened.pop()] = i
    return tokens.closing.get(at, len(tokens) - 1)


def _python(text: str) -> Iterator[Found]:
    tokens, lines = _lex(text, _PY), _Lines(text)
    n = len(tokens)
    word = lambda i: text[tokens[i].start : tokens[i].end] if i < n and tokens[i].kind == "name" else ""
    for i in range(n):
        if word(i) != "def" or not word(i + 1):
            continue
        first = i - 1 if i and word(i - 1) == "async" else i
        if first and tokens[first - 1].kind != "newline":
            continue
        line_start = text.rfind("\n", 0, tokens[first].start) + 1
        if text[line_start : tokens[first].start].strip(" \t\f﻿"):
            continue
        indent = tokens[first].start - line_start
        j = i + 2
        if j < n and tokens[j].kind == "[":
            j = _closing(tokens, j) + 1
        if j >= n or tokens[j].kind != "(":
            continue
        j = _closing(tokens, j) + 1
        while j < n and tokens[j].kind not in (":", "newline"):
            j = _closing(tokens, j) + 1 if tokens[j].kind in ("(", "[", "{") else j + 1
        if j >= n or tokens[j].kind != ":":
            continue
        body = j + 1
        same_line = True
        while body < n and tokens[body].kind in ("newline", "comment"):
            same_line = same_line and tokens[body].kind != "newline"
            body += 1
        if body >= n or tokens[body].kind != "string":
            continue
        if not same_line and tokens[body].start - (text.rfind("\n", 0, tokens[body].start) + 1) <= indent:
            continue
        doc, k = "", body
        while k < n and tokens[k].kind == "string":
            part = _plain(text[tokens[k].start : tokens[k].end])
            if part is None:
                break
            doc, k = doc + part, k + 1
        if k == body or (k < n and tokens[k].kind not in ("newline", "comment", ";")):
            continue
        yield Found(word(i + 1), lines.of(tokens[i].start), tokens[first].start, _python_end(text, lines, tokens, j, indent), doc)


def _plain(literal: str) -> str | None:
    """The text of a plain or raw string literal, None for other kinds."""
    m = re.match("[A-Za-z]*", literal)
    if m.group().lower() not in ("", "r", "u"):
        return None
    try:
        return ast.literal_eval(literal.replace("\r\n", "\n").replace("\r", "\n"))
    except (SyntaxError, ValueError, MemoryError):
        return literal[m.end() :].strip("\"'")


def _python_end(text: str, lines: _Lines, tokens: list[Token], colon: int, indent: int) -> int:
    """Where the body ends: before the first later code line that is indented no deeper than the function."""
    end, depth, fresh = tokens[colon].end, 0, False
    for i in range(colon + 1, len(tokens)):
        t = tokens[i]
        if t.kind == "newline":
            fresh = depth <= 0
            continue
        if t.kind == "comment":
            continue
        if fresh and t.start - (text.rfind("\n", 0, t.start) + 1) <= indent:
            break
        fresh = False
        depth += (t.kind in ("(", "[", "{")) - (t.kind in (")", "]", "}"))
        end = t.end
    return end


def _go(text: str) -> Iterator[Found]:
    tokens, lines = _lex(text, _GO), _Lines(text)
    alone: dict[int, str] = {}
    for i, t in enumerate(tokens):
        if t.kind == "comment" and text.startswith("//", t.start) and (i == 0 or tokens[i - 1].kind == "newline"):
            alone[lines.of(t.start)] = text[t.start + 2 : t.end]
    n = len(tokens)
    for i, t in enumerate(tokens):
        if t.kind != "name" or text[t.start : t.end] != "func" or (i and tokens[i - 1].kind != "newline"):
            continue
        j = i + 1
        if j < n and tokens[j].kind == "(":
            j = _closing(tokens, j) + 1
        if j + 1 >= n or tokens[j].kind != "name" or tokens[j + 1].kind not in ("(", "["):
            continue
        line = lines.of(tokens[j].start)
        at, run = lines.of(t.start) - 1, []
        while at in alone:
            run.append(alone[at])
            at -= 1
        if run:
            yield Found(text[tokens[j].start : tokens[j].end], line, t.start, _brace_end(tokens, j), "\n".join(reversed(run)))


def _brace_end(tokens: list[Token], at: int) -> int:
    """The end of the braces that follow a signature, or of the signature where none follow."""
    end, n = tokens[at].end, len(tokens)
    while at < n and tokens[at].kind not in ("{", ";"):
        if tokens[at].kind in ("(", "["):
            at = _closing(tokens, at)
        if tokens[at].kind == "newline":
            break
        end, at = tokens[at].end, at + 1
    return tokens[_closing(tokens, at)].end if at < n and tokens[at].kind == "{" else end


_MODIFIERS = frozenset("async static get set public private protected readonly override abstract declare accessor".split())
_STATEMENT_WORDS = frozenset("export default declare else do async".split())
_NOT_METHODS = frozenset("if for while switch catch function return with super".split())


def _script(text: str) -> Iterator[Found]:
    every, lines = _lex_script(text), _Lines(text)
    docs: dict[int, str] = {}
    for t in every:
        if t.kind == "comment" and text.startswith("/**", t.start) and text.endswith("*/", 0, t.end) and t.end - t.start > 4:
            docs[lines.of(t.end - 1)] = text[t.start + 3 : t.end - 2]
    tokens = Tokens(t for t in every if t.kind not in ("comment", "newline"))
    n = len(tokens)
    word = lambda i: text[tokens[i].start : tokens[i].end] if 0 <= i < n and tokens[i].kind == "name" else ""
    stack: list[str] = []  # for each open bracket: "class" for a class body, else the bracket
    class_at = -1  # depth at which a class head waits for its brace
    assigned = False  # the present class member has an initialiser
    for i, t in enumerate(tokens):
        if t.kind == "name":
            w = word(i)
            if w == "class" and not (i and tokens[i - 1].kind == "."):
                if not (i + 1 < n and tokens[i + 1].kind in (":", ",", "=", "(", ")")):
                    class_at = len(stack)
            elif w == "function" and not (i and tokens[i - 1].kind == "."):
                j = i + 1
                if j < n and tokens[j].kind == "*":
                    j += 1
                if word(j) and j + 1 < n and tokens[j + 1].kind in ("(", "<") and _declares(text, tokens, i, lines):
                    yield from _documented(text, tokens, lines, docs, i, j)
        elif t.kind in ("(", "[", "{"):
            if t.kind == "(" and stack and stack[-1] == "class" and not assigned:
                name = _method_name(text, tokens, i, word)
                if name is not None:
                    yield from _documented(text, tokens, lines, docs, name, name)
            if t.kind == "{" and class_at == len(stack):
                stack.append("class")
                class_at, assigned = -1, False
            else:
                stack.append(t.kind)
        elif t.kind in (")", "]", "}"):
            if stack:
                stack.pop()
            if stack and stack[-1] == "class" and t.kind == "}":
                assigned = False
        elif stack and stack[-1] == "class":
            if t.kind == ";":
                assigned = False
            elif t.kind == "=":
                assigned = True
        if assigned and stack and stack[-1] == "class" and i + 1 < n and lines.of(tokens[i + 1].start) > lines.of(t.end - 1) and t.kind in ("name", "number", "string", "regex", ")", "]", "}"):
            assigned = False  # the initialiser ended with its line


def _method_name(text: str, tokens: list[Token], paren: int, word) -> int | None:
    """Index of the name of the class method whose parameters open at `paren`, or None."""
    j = paren - 1
    if j >= 0 and tokens[j].kind == ">":  # type parameters
        depth = 0
        while j >= 0:
            depth += (tokens[j].kind == ">") - (tokens[j].kind == "<")
            j -= 1
            if depth == 0:
                break
    name = word(j)
    if not name or name[0] == "@" or name in _NOT_METHODS:
        return None
    k = j - 1
    if k >= 0 and tokens[k].kind == "*":
        k -= 1
    while k >= 0 and word(k) in _MODIFIERS:
        k -= 1
    # Before a member stands the end of another one, the opening brace or a decorator.
    if k >= 0 and tokens[k].kind in (".", "=", ",", ":", "?", "arrow", "!", "&", "|", "+", "-"):
        return None
    close = _closing(tokens, paren) + 1
    if close >= len(tokens) or tokens[close].kind not in ("{", ":"):
        return None
    return j


def _declares(text: str, tokens: list[Token], at: int, lines: _Lines) -> bool:
    """Whether the word function at index `at` begins a declaration and not an expression."""
    k = at - 1
    if k >= 0 and tokens[k].kind == "name" and text[tokens[k].start : tokens[k].end] == "async":
        k -= 1
    if k < 0 or tokens[k].kind in (";", "{", "}", ")"):
        return True
    if tokens[k].kind == "name" and text[tokens[k].start : tokens[k].end] in _STATEMENT_WORDS:
        return True
    ends_value = tokens[k].kind in ("name", "number", "string", "regex", "]") and text[tokens[k].start : tokens[k].end] not in _BEFORE_REGEX
    return ends_value and lines.of(tokens[k].end - 1) < lines.of(tokens[at].start)


def _documented(text: str, tokens: list[Token], lines: _Lines, docs: dict[int, str], start: int, name: int) -> Iterator[Found]:
    line = lines.of(tokens[name].start)
    if line - 1 in docs:
        yield Found(text[tokens[name].start : tokens[name].end], line, tokens[start].start, _brace_end(tokens, name), docs[line - 1])


def summary(doc: str, language: str) -> str:
    """The first part of a documentation text: up to a blank line or a line that starts with @ or a colon."""
    rows = [r.strip() for r in doc.split("\n")]
    if language == "script":
        rows = [r.lstrip("*").strip() for r in rows]
    elif language == "go":
        rows = [r.lstrip("/").strip() for r in rows]
    while rows and not rows[0]:
        rows.pop(0)
    out = []
    for row in rows:
        if not row or row[0] in "@:":
            break
        out.append(row)
    return "\n".join(out)


_NAME_PART = re.compile("[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_ASCII_WORD = re.compile("[A-Za-z]+")


def telling(text: str, name: str) -> bool:
    """Whether enough words remain without those of the function's name and those that tell nothing."""
    own = {w.lower() for w in _NAME_PART.findall(name)} | TRIVIAL_WORDS
    return sum(w.lower() not in own for w in _ASCII_WORD.findall(text)) >= LEAST_WORDS


def documented_functions(text: str, language: str) -> list[tuple[Found, str]]:
    """(function, summary) of all functions with telling documentation, whether or not the text parses."""
    scan = {"python": _python, "script": _script, "go": _go}[language]
    out = []
    for found in scan(text):
        short = summary(found.doc, language)
        if telling(short, found.name):
            out.append((found, short))
    return out


def function_pairs(files: DataFrame, id_col: str = "file_id", path_col: str = "path", text_col: str = "content") -> DataFrame:
    """(file_id, func_name, line_no, code, description), one row per documented function.

    Files of other languages, null ids, paths and texts give no rows; repeated ids are read once; text is taken
    whole. The code reaches from the first word of the definition to its end by braces or indentation.
    """
    language = F.lower(F.regexp_extract(path_col, r"(\.[^./]+)$", 1))
    rows = files.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull() & language.isin(*LANGUAGES))
    rows = rows.select(F.col(id_col).alias("file_id"), language.alias("ext"), F.col(text_col).alias("text")).dropDuplicates(["file_id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for i, (ext, text) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                out += [(i, f.name, f.line, text[f.start : f.end], s) for f, s in documented_functions(text, LANGUAGES[ext])]
            place, names, at, code, told = (list(c) for c in zip(*out, strict=True)) if out else ([], [], [], [], [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(place, pa.int64())), pa.array(names, pa.string()), pa.array(at, pa.int64()), pa.array(code, pa.string()), pa.array(told, pa.string())],
                names=["file_id", "func_name", "line_no", "code", "description"],
            )

    id_type = rows.schema["file_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"file_id {id_type}, func_name string, line_no bigint, code string, description string")
