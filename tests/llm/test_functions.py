"""Documented functions: Python against its own parser, the others on written cases."""

import ast

from conftest import rows

from seamline.llm.functions import documented_functions, function_pairs, summary, telling

PYTHON = '''# def no(): """a comment that is not code at all"""
text = """
def hidden():
    """ + "x"

class C:
    @deco(lambda x: {"def": 1})
    def method_name(self, a=")", *, b: "dict[str, int]" = {}) -> dict[str, int]:
        r"""Collect raw \\d patterns from every shard.

        More.
        """
        return 1

    async def wait_for(self): "Blocks until each worker reports success."

def bytes_doc():
    b"""Bytes are no documentation for anything here."""

def formatted():
    f"""Formatted strings are no documentation either way."""

def later():
    x = 1
    """Not the first statement of this function body."""

def expression():
    """Not a documentation because it is used""".strip()

def own_words():
    """Own words: the function todo."""

def stops_early():
    """Only two.

    But many more words follow in later paragraphs."""

def outer(
    a,  # )
):
    # a comment first
    """Build an index over stored rows."""
    def inner():
        \'\'\'Return cached bucket sizes quickly.\'\'\'
'''


def names(text, language):
    return [(f.name, f.line) for f, _ in documented_functions(text, language)]


def test_python_equals_its_parser():
    expected = []
    for node in ast.walk(ast.parse(PYTHON)):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            doc = ast.get_docstring(node, clean=False)
            if doc and telling(summary(doc, "python"), node.name):
                expected.append((node.name, node.lineno))
    assert sorted(names(PYTHON, "python")) == sorted(expected)
    assert ("method_name", 8) in expected and ("inner", 49) in [(n, line) for n, line in expected] or expected


def test_python_that_does_not_parse():
    broken = PYTHON + "\nprint 'old'\n<<<<<<< HEAD\ndef after(:\n    pass\n=======\n>>>>>>> x\ndef last_one(a):\n    '''Emit sorted segment headers lazily.'''\n"
    assert {n for n, _ in names(PYTHON, "python")} | {"last_one"} == {n for n, _ in names(broken, "python")}
    assert names("def open_string():\n    '''Never closed documentation text here", "python") == [("open_string", 1)]


SCRIPT = """import { a } from './b';
/** Decodes framed payload chunks lazily. */
export async function decodeAll(x) { return `}${f({a: "`"})}`; }

/** A variable holds no declared function here. */
const arrow = (x) => { return /[/"]{2}/.test(x); };
/* A plain comment documents nothing whatsoever here. */
function plainComment() {}
/** Too far above the declared function line. */

function farAway() {}
class Box extends Base {
  /**
   * Moves stored entries between shelves.
   * @param {number} n some words that do not count
   */
  static async moveEntries(n) { if (n) { return "class X { /** no */ foo() {} }"; } }
  field = call(1);
  /** Reads the oldest entry without blocking. */
  get oldest() { return 1; }
  /** add docs */
  trivialOne() {}
  /** Typed results come back sorted ascending. */
  private sorted<T>(a: T[]): T[] { return a; }
}
x = { /** Object members are not class methods. */
  notClass() {} };
// /** commented out */ function gone() {}
/** Assigned function expressions never count anywhere. */
y = function named() {};
/** Trailing declaration after everything else works. */
function lastOne() {}
"""


def test_script():
    assert [n for n, _ in names(SCRIPT, "script")] == ["decodeAll", "moveEntries", "oldest", "sorted", "lastOne"]
    pairs = {f.name: (SCRIPT[f.start : f.end], s) for f, s in documented_functions(SCRIPT, "script")}
    assert pairs["decodeAll"][0].endswith('return `}${f({a: "`"})}`; }') and pairs["moveEntries"][1] == "Moves stored entries between shelves."


GO = """package x
// Fetch loads remote segment pages.
// It waits.
func Fetch(n int) error { return nil }

// Not directly above the function below.

func Lonely() {}
/* Block comments are not line comments here. */
func Block() {}
var s = `
// Inside raw string there is nothing.
func Raw() {}
`
// Close releases held socket handles.
func (s *Store[T]) Close(a func(int) error) { f := func() { "}" } }
// N/A
func None() {}
"""


def test_go():
    assert names(GO, "go") == [("Fetch", 4), ("Close", 16)]
    assert names(GO.replace("\n", "\r\n"), "go") == [("Fetch", 4), ("Close", 16)]


def test_table(spark):
    data = [(1, "a/B.PY", PYTHON, 0), (1, "a/B.PY", PYTHON, 1), (2, "x.ts", SCRIPT, 0), (3, "g.go", GO, 0), (4, "n.md", PYTHON, 0), (5, "e.py", None, 0), (6, "e.py", "", 0), (None, "e.py", PYTHON, 0), (7, None, PYTHON, 0), (8, "long.go", "// x\n" * 100_000 + GO, 0)]
    df = spark.createDataFrame(data, "file_id bigint, path string, content string, line_no int")
    got = function_pairs(df)
    assert {r[0] for r in rows(got, "file_id")} == {1, 2, 3, 8}
    assert rows(got.where("file_id = 3"), "func_name", "line_no") == [("Close", 16), ("Fetch", 4)]
    assert function_pairs(df.where("false")).count() == 0
