"""Source files that nobody wrote by hand for the project: generated, minified, copied or pure data.

Names decide first. Character n-gram models, one per language and trained on the identifiers of all files, tell mangled
names by their cross-entropy. Template-like and data files repeat the same few shapes of names and literals, so their
diversity is low beside other files of the language. Vendored files name modules that are likely in the reference
copies and unlikely in the language, and none of those that mark their repository. Notices of tools and of other
authors, literals, code without spaces, and the similarity to a reference copy complete the evidence.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamline.llm import near_duplicates
from seamline.llm.functions import _GO, _PY, Token, _lex, _lex_script
from seamline.session import written

#: Kinds of files that share a model, by extension.
LANGUAGES = {".py": "python", ".pyi": "python", ".js": "script", ".ts": "script", ".jsx": "script", ".tsx": "script", ".mjs": "script", ".go": "go", ".css": "css", ".scss": "css", ".c": "c", ".h": "c", ".cc": "c", ".cpp": "c", ".java": "c", ".md": "text", ".rst": "text", ".txt": "text", ".yaml": "text", ".yml": "text"}
#: Letters of the models; all others count as the last one, so a model has at most 39 ** 3 entries.
ALPHABET = "abcdefghijklmnopqrstuvwxyz0_"
ORDER = 3

#: Mangled: so many bits per character above the median file of the language, over enough names.
MANGLED_BITS = 0.8
LEAST_NAMES = 12
#: Packed: a code line of this length, strings left out, with hardly a space in it.
PACKED_LINE = 300
PACKED_SPACES = 0.06
#: Template-like: diversity of token shapes below this part of the language's median file, over enough tokens.
LOW_DIVERSITY = 0.25
LEAST_TOKENS = 60
#: Tokens in which diversity is measured at a time, so that it doesn't fall with the length of a file.
SPAN = 400
#: Data: so much of the code is literals and brackets, and so many characters of it.
DATA_SHARE = 0.8
LEAST_DATA = 500
#: Embedded bytes: share of escapes in the text.
ESCAPES = 0.1
#: Copies: similarity of the sets of five words to a reference copy.
COPY_SIMILARITY = 0.8
#: Foreign: a module name this many bits likelier in the reference copies than in the language. A name marks its
#: repository where it is as many bits likelier there than in others and in this share of its files.
FOREIGN_BITS = 2.0
OWN_SHARE = 0.25
#: A pair of tool comments that encloses this share of the code stands for the tool's work.
ENCLOSED = 0.4

# Comment syntax by extension, for files without a lexer here: opening and closing marks.
COMMENTS = {
    "#": ((r"#", r"\n"),),
    "markup": ((r"<!--", r"-->"),),
    "--": ((r"--", r"\n"),),
    ";": ((r";", r"\n"),),
    "//": ((r"//", r"\n"), (r"/\*", r"\*/")),
}
COMMENT_STYLE = {
    **dict.fromkeys((".yaml", ".yml", ".toml", ".ini", ".cfg", ".conf", ".sh", ".rb", ".pl", ".r", ".mk", ".properties", ".tf"), "#"),
    **dict.fromkeys((".md", ".html", ".htm", ".xml", ".svg", ".vue"), "markup"),
    **dict.fromkeys((".sql", ".lua", ".hs", ".elm"), "--"),
    **dict.fromkeys((".el", ".lisp", ".clj", ".scm", ".asm"), ";"),
    **dict.fromkeys((".rs", ".swift", ".kt", ".scala", ".php", ".cs", ".dart", ".proto", ".gradle", ".less"), "//"),
}

# What tools write into the files they make, and what a person writes who denies it.
MADE = re.compile(
    r"(?i)\bauto[- ]?generated\b|@generated\b|\bgenerated (?:file|code|by|from)\b|\bcode generated\b|automatisch (?:erzeugt|generiert)|automatically (?:created|generated|produced)"
    r"|\bdo not (?:hand[- ]?)?(?:edit|modify)\b|\bmachine[- ](?:made|generated)\b|\bproduced by\b|\brendered from\b|\b(?:edits|changes) will be (?:lost|overwritten)\b|\bsource of truth is\b"
    r"|g[eé]n[eé]r[eé] automatiquement|generado autom[aá]ticamente|gerado automaticamente|сгенерирован"
)
NOT_MADE = re.compile(r"(?i)\b(?:not|never|isn't|no longer)\b[^.;\n]{0,20}(?:auto[- ]?generated|generated|machine[- ]made)|edit freely")
NOTICE = re.compile(r"(?i)\(c\)\s|copyright|©|\bcontributors\b|\bmaintainers\b|\bauthors\b|\bpart of the\b|\blicen[cs]ed? (?:to|by)\b")
# Words of notices that name nobody.
NOTICE_WORDS = frozenset("copyright c the of part all rights reserved project authors author contributors maintainers developers team inc and by to licensed under license licence mit bsd apache spdx identifier in or this file see for is".split())

_NAME = re.compile(r"[^\W\d][\w$]*")
_SPLIT = re.compile(r"[^\W_\d]+")
_BLANK = frozenset(("comment", "newline"))
_LITERAL = frozenset(("string", "number", ",", "{", "}", "[", "]", "(", ")", ":", "-", "regex"))
_NUMBERS = re.compile(r"\d+")


def language_of(path: str | None) -> str:
    m = re.search(r"(\.[^./]+)$", path or "")
    return LANGUAGES.get(m.group(1).lower(), "other") if m else "other"


def tokens_of(text: str, language: str) -> list[Token]:
    if language == "python":
        return _lex(text, _PY)
    if language == "go":
        return _lex(text, _GO)
    if language in ("script", "css", "c"):
        return _lex_script(text)
    return []


def names_of(text: str, language: str, tokens: list[Token]) -> list[str]:
    """Identifiers in the code: outside strings and comments where the language has a lexer."""
    if language == "css":
        return _NAME.findall(text)
    if tokens:
        return [text[t.start : t.end] for t in tokens if t.kind == "name"]
    return _NAME.findall(text)


def _symbols(name: str) -> str:
    return "^^" + re.sub(r"[^a-z0_]", "~", re.sub(r"\d", "0", name.lower())) + "$"


def _trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of trigrams over the different names of every file, per language and task."""
    files: Counter[tuple[str, str]] = Counter()
    counts: Counter[tuple[str, str]] = Counter()

    def spell() -> None:
        for (language, name), n in files.items():
            s = _symbols(name)
            for i in range(len(s) - ORDER + 1):
                counts[language, s[i : i + ORDER]] += n
        files.clear()

    for batch in batches:
        for language, names in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            files.update((language, name) for name in names)
            if len(files) > 200_000:
                spell()
    spell()
    if counts:
        languages, grams = zip(*counts, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(languages), pa.array(grams), pa.array(counts.values(), pa.int64())], names=["language", "gram", "n"])


class NameModel:
    """Bits of a name under the trigram model of its language, with one added to every count."""

    def __init__(self, counts: dict[str, dict[str, int]]) -> None:
        self.counts = counts
        self.context = {k: Counter() for k in counts}
        for k, grams in counts.items():
            for g, n in grams.items():
                self.context[k][g[:2]] += n

    def bits(self, name: str, language: str) -> tuple[float, int]:
        grams, context, s = self.counts.get(language, {}), self.context.get(language, {}), _symbols(name)
        total = 0.0
        for i in range(len(s) - ORDER + 1):
            g = s[i : i + ORDER]
            total -= math.log2((grams.get(g, 0) + 1) / (context.get(g[:2], 0) + len(ALPHABET) + 2))
        return total, len(s) - ORDER + 1


def train(described: DataFrame) -> NameModel:
    """A model per language from the different names (language, unique) of all files. Its size is bounded by the alphabet."""
    grams = described.select("language", "unique").mapInArrow(_trigrams, "language string, gram string, n bigint").groupBy("language", "gram").agg(F.sum("n").alias("n"))
    counts: dict[str, dict[str, int]] = {}
    for row in grams.collect():
        counts.setdefault(row.language, {})[row.gram] = row.n
    return NameModel(counts)


@functools.cache
def _edges(style: str) -> tuple[re.Pattern, re.Pattern]:
    one = "|".join(f"{start}(?:(?!{end})[\\s\\S])*(?:{end}|\\Z)" for start, end in COMMENTS[style])
    return re.compile(rf"(?:---\n(?:(?!---\n)[^\n]*\n)*---\n)?(?:\s*(?:{one}))+"), re.compile(one)


def edge_comments(path: str | None, text: str, tokens: list[Token]) -> str:
    """Comments before the first and after the last code. In files without a lexer here those of their type before the
    first other text, behind front matter as well, and after the last; unknown types have none."""
    if not tokens:
        m = re.search(r"(\.[^./]+)$", path or "")
        style = COMMENT_STYLE.get(m.group(1).lower()) if m else None
        if style is None:
            return ""
        block, one = _edges(style)
        head = block.match(text)
        last, end = [], len(text.rstrip())
        for c in reversed(list(one.finditer(text, head.end() if head else 0))):
            if text[c.end() : end].strip():
                break
            last.append(c[0])
            end = c.start()
        return "\n".join([head[0] if head else "", *reversed(last)])
    solid = [i for i, t in enumerate(tokens) if t.kind not in ("comment", "newline", "skip")]
    first, last = (solid[0], solid[-1]) if solid else (len(tokens), -1)
    return "\n".join(text[t.start : t.end] for i, t in enumerate(tokens) if t.kind == "comment" and (i < first or i > last))


def made_inside(text: str, tokens: list[Token]) -> bool:
    """Two tool comments that enclose most of the code: the tool wrote what stands between them."""
    marks = [i for i, t in enumerate(tokens) if t.kind == "comment" and MADE.search(c := text[t.start : t.end]) and not NOT_MADE.search(c)]
    if len(marks) < 2:
        return False
    solid = [i for i, t in enumerate(tokens) if t.kind not in ("comment", "newline", "skip")]
    return sum(marks[0] < i < marks[-1] for i in solid) >= ENCLOSED * len(solid)


def diversity(text: str, tokens: list[Token]) -> float | None:
    """Distinct runs of three token shapes among all, in spans of SPAN tokens; null for fewer than LEAST_TOKENS. A shape is
    a name with its numbers replaced, the kind of a literal, or a sign."""
    stems: dict[str, str] = {}
    shapes = []
    for kind, start, end in tokens:
        if kind == "name":
            name = text[start:end]
            shapes.append(stems.get(name) or stems.setdefault(name, _NUMBERS.sub("0", name)))
        elif kind not in _BLANK:
            shapes.append(kind)
    if len(shapes) < LEAST_TOKENS:
        return None
    found = total = 0
    for at in range(0, len(shapes), SPAN):
        span = shapes[at : at + SPAN + 2]
        found += len(set(zip(span, span[1:], span[2:])))
        total += max(0, len(span) - 2)
    return found / total


def roots_of(text: str, language: str) -> list[str]:
    """First parts of imported modules."""
    if language == "python":
        return re.findall(r"(?m)^(?:from|import)[ \t]+([A-Za-z_]\w*)", text)
    if language in ("script", "go"):
        return [m for m in re.findall(r"(?m)^import\b[^\n'\"]*['\"]([\w@][\w@-]*)", text)]
    return []


def features(path: str | None, text: str, repo: str | None) -> tuple:
    """What is known of one file by itself, in the order of FEATURES."""
    language = language_of(path)
    text = text.lstrip("\ufeff").replace("\r\n", "\n")
    tokens = tokens_of(text, language)
    names = names_of(text, language, tokens)
    unique = set(names)
    code = literal = 0
    for kind, start, end in tokens:
        if kind not in _BLANK:
            code += end - start
            if kind in _LITERAL:
                literal += end - start
    at, bare = 0, []
    for t in tokens:
        if t.kind in ("string", "comment"):
            bare += [text[at : t.start], '""' + "\n" * (t.kind == "comment")]
            at = t.end
    longest = max("".join([*bare, text[at:]]).split("\n"), key=len).strip() if tokens else ""
    packed = len(longest) >= PACKED_LINE and sum(c in " \t" for c in longest) <= PACKED_SPACES * len(longest)
    edge = edge_comments(path, text, tokens)
    made = (bool(MADE.search(edge)) and not NOT_MADE.search(edge)) or made_inside(text, tokens)
    head = [line for line in edge.split("\n") if NOTICE.search(line)]
    words = {w.lower() for line in head for w in _SPLIT.findall(line)} - NOTICE_WORDS
    own = {w.lower() for w in _SPLIT.findall(repo or "")} | {(repo or "").lower()}
    notice = bool(words) and not (words & own)
    return (
        language, len(names), sorted(unique), diversity(text, tokens), literal / code if code else 0.0, literal, packed,
        4 * text.count("\\x") / max(1, len(text)), made, notice, sorted(set(roots_of(text, language))),
    )


FEATURES = pa.schema(
    [("file_id", pa.int64()), ("repo", pa.string()), ("language", pa.string()), ("names", pa.int64()), ("unique", pa.list_(pa.string())), ("diversity", pa.float64()), ("data_share", pa.float64()), ("literal", pa.int64())]
    + [("packed", pa.bool_()), ("escapes", pa.float64()), ("made", pa.bool_()), ("notice", pa.bool_()), ("roots", pa.list_(pa.string()))]
)
_DDL = "file_id bigint, repo string, language string, names bigint, unique array<string>, diversity double, data_share double, literal bigint, packed boolean, escapes double, made boolean, notice boolean, roots array<string>"


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 500):
            rows = [(i, repo, *features(path, text, repo)) for path, text, i, repo in zip(*(c.to_pylist() for c in whole.slice(at, 500).columns), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), FEATURES, strict=True)], schema=FEATURES)


def _bits(model: NameModel):
    """(file_id, bits): bits per character over the different names of a file."""
    schema = pa.schema([("file_id", pa.int64()), ("bits", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cost = functools.lru_cache(maxsize=200_000)(model.bits)
        for batch in batches:
            out = []
            for language, unique in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                costs = [cost(name, language) for name in unique]
                out.append(sum(b for b, _ in costs) / sum(n for _, n in costs) if costs else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], schema=schema)

    return run


def reference_copies(files: DataFrame, references: DataFrame) -> DataFrame:
    """(file_id) of files (file_id, text) whose words nearly equal those of a reference (ref_id, content). Only pairs of a
    file and a reference are looked at."""
    both = files.select((F.col("file_id") * 2).alias("id"), F.col("text").alias("content")).unionByName(references.where(F.col("content").isNotNull()).select((F.col("ref_id") * 2 + 1).alias("id"), "content"))
    texts = near_duplicates.Texts(both, COPY_SIMILARITY, near_duplicates.SHINGLE_WORDS)
    is_reference = F.pmod("id", F.lit(2)) == 1
    known = texts.members.where(is_reference).select("digest").distinct()
    links = texts.verified(texts.candidates_with(known))
    near = known.unionByName(links.join(known.withColumnRenamed("digest", "a"), "a").select(F.col("b").alias("digest"))).unionByName(links.join(known.withColumnRenamed("digest", "b"), "b").select(F.col("a").alias("digest"))).distinct()
    return texts.members.where(~is_reference).join(near, "digest", "left_semi").select((F.col("id") / 2).cast("bigint").alias("file_id"))


def foreign_files(found: DataFrame, references: DataFrame) -> DataFrame:
    """(file_id) of files (file_id, repo, language, roots) that name modules of the references and none of their own repository.

    A module name is foreign where it is FOREIGN_BITS likelier in the files of the references (language, roots) than in
    all files of the language, and marks a repository where it is in OWN_SHARE of its files and as much likelier there than
    in those of others.
    """
    sizes = found.where(F.size("roots") > 0).groupBy("repo", "language").agg(F.count("*").alias("files"))
    whole = sizes.groupBy("language").agg(F.sum("files").alias("all_files"))
    used = found.select("repo", "language", F.explode("roots").alias("root")).groupBy("repo", "language", "root").agg(F.count("*").alias("n"))
    everywhere = used.groupBy("language", "root").agg(F.sum("n").alias("all_n")).join(whole, "language")
    in_language = (F.col("all_n") + 1) / (F.col("all_files") + 1)
    there = references.where(F.size("roots") > 0)
    ref_files = there.groupBy("language").agg(F.count("*").alias("ref_files"))
    ref_roots = there.select("language", F.explode("roots").alias("root")).groupBy("language", "root").agg(F.count("*").alias("ref_n")).join(ref_files, "language")
    foreign = ref_roots.join(everywhere, ["language", "root"]).where(F.log2((F.col("ref_n") + 1) / (F.col("ref_files") + 1) / in_language) >= FOREIGN_BITS)
    own = used.join(sizes, ["repo", "language"]).join(everywhere, ["language", "root"])
    in_repo, elsewhere = F.col("n") / F.col("files"), (F.col("all_n") - F.col("n")) / F.greatest(F.col("all_files") - F.col("files"), F.lit(1))
    own = own.where((in_repo >= OWN_SHARE) & (in_repo >= 2.0**FOREIGN_BITS * elsewhere))
    # A row for each language and for each repository: a name in a quarter of the files can only be one of a few.
    foreign = foreign.groupBy("language").agg(F.collect_set("root").alias("foreign_roots"))
    own = own.groupBy("repo", "language").agg(F.collect_set("root").alias("own_roots"))
    told = found.where(F.size("roots") > 0).join(foreign, "language").join(own, ["repo", "language"], "left")
    return told.where(F.arrays_overlap("roots", "foreign_roots") & ~F.coalesce(F.arrays_overlap("roots", "own_roots"), F.lit(False))).select("file_id")


def file_origins(files: DataFrame, references: DataFrame, id_col: str = "file_id", path_col: str = "path", text_col: str = "content", repo_col: str = "repo") -> DataFrame:
    """(file_id, generated, packed, data, vendored, mangled, low_diversity, foreign) of all distinct files with text; true
    where the file is such. The last three tell what the names alone show.

    generated: template-like shapes, or a tool's notice at an edge of the file or around its code. packed: mangled names,
    or code lines without spaces. data: shapes of low diversity or any others that are nearly all literals, or embedded
    bytes. vendored: module names of the references, a notice that names others than the repository, or a copy of a
    reference. Null or blank files and null ids give no rows; a null path means no language, a null repository no own
    name; references without a path show no foreign names; texts are read whole.
    """
    rows = files.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(path_col).alias("path"), F.col(text_col).alias("text"), F.col(id_col).cast("bigint").alias("file_id"), F.col(repo_col).alias("repo"))
    rows = written(rows.where(F.col("text").rlike(r"[^\s\x{FEFF}\x{A0}]")).dropDuplicates(["file_id"]))
    described = written(rows.select("path", "text", "file_id", "repo").mapInArrow(_describe, _DDL))
    shared = files.sparkSession.sparkContext.broadcast(train(described))
    bits = written(described.select("file_id", "language", "unique").mapInArrow(lambda it: _bits(shared.value)(it), "file_id bigint, bits double"))
    found = described.drop("unique").join(bits, "file_id")
    usual = found.groupBy("language").agg(F.percentile_approx("bits", 0.5, 10000).alias("usual_bits"), F.percentile_approx("diversity", 0.5, 10000).alias("usual_diversity"))  # one row per language
    reference_rows = references.where(F.col("content").isNotNull()).select((F.col("path") if "path" in references.columns else F.lit(None).cast("string")).alias("path"), F.col("content").alias("text"), F.col("ref_id").cast("bigint").alias("file_id"), F.lit(None).cast("string").alias("repo"))
    described_references = reference_rows.mapInArrow(_describe, _DDL).select("language", "roots")
    foreign = foreign_files(described.select("file_id", "repo", "language", "roots"), described_references).withColumn("foreign", F.lit(True))
    copies = reference_copies(rows, references).distinct().withColumn("copy", F.lit(True))
    joined = found.join(F.broadcast(usual), "language").join(foreign, "file_id", "left").join(copies, "file_id", "left")
    code = F.col("language") != "text"
    no = F.lit(False)
    mangled = F.coalesce(code & (F.col("names") >= LEAST_NAMES) & (F.col("bits") > F.col("usual_bits") + MANGLED_BITS), no)
    low = F.coalesce(code & (F.col("diversity") < LOW_DIVERSITY * F.col("usual_diversity")), no)
    literal = F.col("data_share") >= DATA_SHARE
    return joined.select(
        "file_id", F.coalesce(F.col("made") | (low & ~literal), no).alias("generated"), F.coalesce(F.col("packed") | mangled, no).alias("packed"),
        F.coalesce((literal & (low | (F.col("literal") >= LEAST_DATA))) | (F.col("escapes") > ESCAPES), no).alias("data"),
        F.coalesce(F.coalesce("foreign", no) | F.col("notice") | F.coalesce("copy", no), no).alias("vendored"),
        mangled.alias("mangled"), low.alias("low_diversity"), F.coalesce("foreign", no).alias("foreign"),
    )
