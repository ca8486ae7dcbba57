"""Origins of files on written cases."""

import random

from seamline.llm import source_origin as so
from seamline.llm.source_origin import file_origins

NAMES = "load store index merge shard vector window bucket record header queue cache worker socket page driver".split()


def hand(rng, repo, n=14):
    out = [f"import os\nfrom {repo}.core import base\n"]
    for _ in range(n):
        a, b, c = rng.sample(NAMES, 3)
        out.append(f"def {a}_{b}({c}, limit={rng.randint(1, 99)}):\n    # {b} before {c}\n    total_{a} = {c}.{b}(limit)\n    if total_{a} is None:\n        return {rng.randint(1, 9)}\n    return total_{a} + {rng.choice(NAMES)}\n")
    return "\n".join(out)


def mangled(rng):
    one = lambda: "".join(rng.choices("abcdefghjkqvwxyz", k=rng.randint(1, 2)))
    return "!function(){" + "".join(f"var {one()}={one()}?{one()}:{rng.randint(1, 99)};{one()}({one()});" for _ in range(120)) + "}();"


def cases():
    rng = random.Random(2)
    library = hand(rng, "otherlib", 20)
    files = {}
    for i in range(60):
        files[i] = (f"src/mod_{i}.py", hand(rng, "mine"), "mine", False)
    files |= {
        100: ("src/a.py", "# Code generated by toolgen. DO NOT EDIT.\n" + hand(rng, "mine"), "mine", True),
        101: ("src/b.py", hand(rng, "mine") + "\n# auto-generated file (gen 3)\n", "mine", True),
        102: ("web/min.js", mangled(rng), "mine", True),
        103: ("src/c.py", "# Copyright (c) 2015 The otherlib Authors.\n" + hand(rng, "otherlib"), "mine", True),
        104: ("src/d.py", library.replace("total_load", "total_loads"), "mine", True),
        105: ("src/e.py", "TABLE = [\n" + "    1.25, -0.5, 3.75,\n" * 100 + "]\n", "mine", True),
        106: ("src/f.py", "class B(object):\n" + "".join(f"    def call_{k:03d}(self, arg0):\n        return self._lib.call({k}, arg0)\n" for k in range(40)), "mine", True),
        107: ("docs/x.md", "<!-- rendered from templates/x.tmpl, your edits will be lost -->\n# Title\n", "mine", True),
        200: ("tools/min.py", hand(rng, "mine"), "mine", False),
        201: ("src/vendor/g.py", "# Copyright (c) 2020 the mine developers\n" + hand(rng, "mine"), "mine", False),
        202: ("tools/gen.py", hand(rng, "mine") + "\nTEMPLATE = '''\n# Code generated by toolgen. DO NOT EDIT.\n'''\nout.write('# @generated\\n')\n", "mine", False),
        203: ("src/h.py", "# NOTE: this module is not auto-generated; edit freely.\n" + hand(rng, "mine"), "mine", False),
        204: ("src/i.py", hand(rng, "mine") + f"\nKEY = '{'a1b2' * 150}'\n", "mine", False),
        205: ("src/j.py", "LIMITS = [1, 2, 3]\n", "mine", False),
        206: ("src/k.py", "# SPDX-License-Identifier: Apache-2.0\n" + hand(rng, "mine"), "mine", False),
        207: (None, hand(rng, "mine"), None, False),
    }
    return files, library


def test_origins(spark):
    files, library = cases()
    data = [(i, p, t, r, "x") for i, (p, t, r, _) in files.items()]
    data += [(100, *files[100][:3], "again"), (300, "e.py", None, "mine", "x"), (301, "e.py", " \n", "mine", "x"), (302, "e.py", "", "mine", "x"), (None, "e.py", "x = 1", "mine", "x")]
    df = spark.createDataFrame(data, "file_id bigint, path string, content string, repo string, language string")
    upstream = spark.createDataFrame([(1, library), (2, None)], "ref_id bigint, content string")
    got = {r.file_id: r for r in file_origins(df, upstream).collect()}
    assert set(got) == set(files)
    wrong = {i: got[i] for i, f in files.items() if f[3] != any((got[i].generated, got[i].packed, got[i].data, got[i].vendored))}
    assert not wrong
    assert got[104].vendored and got[102].packed and got[105].data and got[106].generated
    assert file_origins(df.where("false"), upstream).count() == 0
    assert file_origins(df.where("file_id < 5"), upstream.where("false")).count() == 5


def test_very_long_file(spark):
    text = "x_value = 1  # small\n" * 60_000
    df = spark.createDataFrame([(1, "a.py", text, "mine")], "file_id bigint, path string, content string, repo string")
    none = spark.createDataFrame([], "ref_id bigint, content string")
    assert file_origins(df, none).count() == 1


def test_edge_comments_of_any_type():
    far = "text\n" * 2000
    assert "tool" in so.edge_comments("a.md", "---\ntitle: x\n---\n<!-- made by tool -->\n# T\n" + far, [])
    assert "tool" in so.edge_comments("a.md", "# T\n" + far + "<!-- made by tool -->\n", [])
    assert "tool" not in so.edge_comments("a.md", "# T\n" + far + "<!-- made by tool -->\nmore\n", [])
    assert "others" in so.edge_comments("a.yaml", "# first\n# (c) others\nkey: 1  # inside\n", []) and "inside" not in so.edge_comments("a.yaml", "# first\nkey: 1  # inside\nlast: 2\n", [])
    assert "tool" in so.edge_comments("q.sql", "SELECT 1;\n-- made by tool", []) and so.edge_comments("a.unknown", "# x", []) == "" and so.edge_comments(None, "# x", []) == ""


def test_names_tell(spark):
    """Foreign modules, mangled names and repeated shapes are told by names alone; own files that use the library are not."""
    rng = random.Random(6)
    files = [(i, f"src/m{i}.py", hand(rng, "mine" if i < 40 else "yours"), "mine" if i < 40 else "yours") for i in range(80)]
    files += [(100, "lib/a.py", hand(rng, "otherlib"), "mine"), (101, "src/b.py", "import otherlib.net\n" + hand(rng, "mine"), "mine")]
    files += [(102, "web/x.js", mangled(rng), "mine"), (103, "src/t.py", "ROWS = [" + "{'a': 1, 'b': 'x'}, " * 200 + "]\n", "mine")]
    df = spark.createDataFrame(files, "file_id bigint, path string, content string, repo string")
    upstream = spark.createDataFrame([(i, f"otherlib/u{i}.py", hand(rng, "otherlib")) for i in range(6)], "ref_id bigint, path string, content string")
    got = {r.file_id: r for r in file_origins(df, upstream).collect()}
    assert {i for i, r in got.items() if r.foreign} == {100} and got[100].vendored
    assert {i for i, r in got.items() if r.low_diversity} == {103} and got[103].data
    assert got[102].packed
    assert not any(got[i].generated or got[i].packed or got[i].data or got[i].vendored for i in [*range(80), 101])
