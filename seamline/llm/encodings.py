"""Text that was read in a wrong encoding: found and restored by what clean near-twins show.

A garbled passage and its clean twin agree on their ASCII characters and on what stands around them. Passages are
therefore joined, word by word in their context, on text stripped of all other characters. Where two variants of one
stripped text differ, the characters between the same ASCII characters are aligned, and the pairs of pieces and
characters that come out are voted on: what is aligned by chance is scattered, what an encoding did comes out alike in
different words. In rounds only the likeliest clean form of each garbled word by the round before keeps its votes. No
encoding is known beforehand: the mappings applied to all records are what the alignment taught.
"""

from __future__ import annotations

import functools
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seamline.llm.words import blocks
from seamline.session import written

#: Aligned pairs that leave a task at a time.
_PAIRS = 50_000
#: Texts and places in which a sequence, and a mapping of single characters, must be seen.
VOTES = 2
SINGLE_VOTES = 3
#: Part of the votes on a piece that one character needs, and part of a pair's characters that other mappings explain.
SHARE = 0.4
AGREE = 0.6
#: Probability of a character of a piece, at least: a round hands on all characters above it.
_FLOOR = 0.003
#: Votes of a sequence, at least, for each text in which others are aligned across its bounds.
CROSSED = 0.5
ROUNDS = 5
LOST = "�"

_QUOTED = re.compile(r"`[^`\n]*`")
_ENTITY = re.compile(r"&#(\d{2,6});|&#[xX]([0-9a-fA-F]{2,5});")
_SENTENCE = re.compile(r"(?<=[.!?:;])[ \t]+")
_SPACE = re.compile(r"[ \t\r\f\v]+")
_OTHER = re.compile(r"[^\x00-\x7f]")
_RUN = re.compile(r"[^\x00-\x7f]+")
_LATIN = re.compile("[A-Za-z]")
_PARTS = re.compile(r"\s")
_DIGITS = re.compile(r"[0-9]+(?:[.,][0-9]+)*")
_EDGE = " .,;:!?()[]{}\"'*_#-<>|/\\"


def _kind(c: str) -> str:
    return unicodedata.category(c)[0]


def _symbol(c: str) -> bool:
    return not c.isascii() and _kind(c) == "S"


def _printable(word: str) -> bool:
    return all(c.isprintable() or _kind(c) == "Z" for c in word)


def plain_text(text: str) -> str:
    """The text without quoted passages (between backticks), numeric character references resolved."""
    text = _QUOTED.sub("`", text)
    if "&#" in text:
        text = _ENTITY.sub(lambda m: chr(n) if (n := int(m[1]) if m[1] else int(m[2], 16)) > 127 and n < 0x110000 else m[0], text)
    return text


def _hash(key: str) -> int:
    h = xxhash.xxh64_intdigest(key)
    return h - (1 << 64) if h >> 63 else h


@functools.lru_cache(maxsize=200_000)
def _bare(word: str) -> str:
    return _DIGITS.sub("0", _OTHER.sub("", word))


def keyed_words(text: str) -> Iterator[tuple[str, str]]:
    """(key, word) of all words with characters outside ASCII.

    A word with two or more ASCII letters is known by these; another by its neighbours if they have some, else by
    the stripped sentence and its place in it.
    """
    if text.isascii() and "&#" not in text:
        return
    for line in plain_text(text).split("\n"):
        if line.isascii():
            continue
        for sentence in _SENTENCE.split(line):
            if sentence.isascii():
                continue
            words = _SPACE.split(sentence)
            stripped: list[str] | None = None
            for i, raw in enumerate(words):
                if raw.isascii():
                    continue
                word = raw.strip(_EDGE)
                own = _bare(word)
                if sum(c.isalpha() for c in own) >= 2:
                    yield "w" + own, word
                    continue
                stripped = stripped or [_bare(w).strip(_EDGE) for w in words]
                around = (stripped[i - 1] if i else "", own, stripped[i + 1] if i + 1 < len(words) else "")
                if any(c.isalpha() for c in around[0] + around[2]):
                    yield "c" + "|".join(around), word
                else:
                    yield f"s{' '.join(stripped)}#{i}", word


def _texts_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, keys, words): the different keyed words of every different text, the text as a hash."""
    schema = pa.schema([("text", pa.int64()), ("keys", pa.list_(pa.int64())), ("words", pa.list_(pa.string()))])
    seen: set[int] = set()
    for _, texts in blocks(batches, 0):
        out = []
        for text in texts:
            if text.isascii() and "&#" not in text:
                continue
            h = _hash(text)
            if h in seen:
                continue
            seen.add(h)
            pairs = {(_hash(k), w) for k, w in keyed_words(text)}
            if pairs:
                out.append((h, *zip(*pairs, strict=True)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def one_script(word: str) -> bool:
    """Not letters of two of the Latin, Cyrillic and other scripts in one word."""
    kinds = {"c" if "Ѐ" <= c <= "ӿ" else "l" if c < "ɐ" or "Ḁ" <= c <= "ỿ" else "o" for c in word if c.isalpha()}
    return len(kinds) == 1


@functools.lru_cache(maxsize=200_000)
def _looks(word: str) -> int:
    """2: letters of one script without signs other than punctuation and spaces between or symbols after them, in lower case or capitalised, and in Latin script not all
    outside ASCII; 1: the same in upper case; 0: anything else."""
    if not one_script(word) or not _printable(word):
        return 0
    places = [i for i, c in enumerate(word) if c.isalpha()]
    letters = "".join(word[i] for i in places)
    if any(not c.isascii() and not c.isalpha() and _kind(c) not in "PZ" for c in word[places[0] : places[-1]]):
        return 0
    if len(letters) > 1 and not any(c.isascii() for c in letters) and any(c < "ɐ" for c in letters):
        return 0
    if any(_symbol(x) and ((y.isalpha() and not y.isascii()) or (z.isalpha() and (len(places) > 1 or not z.isascii()))) for x, y, z in zip(word, word[1:] + " ", " " + word)):
        return 0
    if any(len(part) == 1 and not part.isascii() and part.isupper() for part in ("".join(filter(str.isalpha, x)) for x in _PARTS.split(word)) if part != letters):
        return 0
    if letters[1:] == letters[1:].lower():
        return 2
    return 1 if letters == letters.upper() else 0


def _evident(garbled: str, clean: str) -> bool:
    """Only one of the two readings looks right, so how often they occur says nothing more. Upper case stands behind
    lower case in words of four letters and more, shorter ones are names."""
    a, b = _looks(garbled), _looks(clean)
    return b > a and (a == 0 or sum(c.isalpha() for c in clean) >= 4)


@functools.lru_cache(maxsize=200_000)
def _runs(word: str) -> dict[int, str]:
    """Runs of characters outside ASCII by their place among the ASCII characters, numbers counting as one character."""
    word = _DIGITS.sub("0", word)
    out, before, last = {}, 0, 0
    for m in _RUN.finditer(word):
        before += m.start() - last
        out[before] = m[0]
        last = m.end()
    return out


def _differences(a: str, b: str) -> list[tuple[str, str]] | None:
    """The runs in which two variants of one stripped text differ, or None where one has a run and the other has none."""
    x, y = _runs(a), _runs(b)
    if x.keys() != y.keys():
        return None
    return [(g, c) for place, g in x.items() if (c := y[place]) != g and LOST not in g + c and unicodedata.normalize("NFKC", g) != unicodedata.normalize("NFKC", c)]


def pieces(garbled: str, clean: str, known: dict[str, str], forms: dict[str, list[str]]) -> list[tuple[str, str]]:
    """Pieces of a garbled run with the character that each one stands for, aligned with the clean run.

    Either the run is divided evenly, or known pieces (forms: by character) are taken off at both ends and what is left
    is; of the two the one that more known pieces agree with holds.
    """

    def divided(text: str, chars: str) -> list[tuple[str, str]]:
        if not text or not chars or len(text) % len(chars):
            return []
        step = len(text) // len(chars)
        return [(text[k * step : (k + 1) * step], c) for k, c in enumerate(chars)]

    even = divided(garbled, clean)
    left: list[tuple[str, str]] = []
    right: list[tuple[str, str]] = []
    lo, hi, i, j = 0, len(garbled), 0, len(clean)
    while i < j and (g := next((p for p in forms.get(clean[i], ()) if garbled.startswith(p, lo, hi)), "")):
        left.append((g, clean[i]))
        lo, i = lo + len(g), i + 1
    while i < j and (g := next((p for p in forms.get(clean[j - 1], ()) if garbled.endswith(p, lo, hi)), "")):
        right.append((g, clean[j - 1]))
        hi, j = hi - len(g), j - 1
    rest = divided(garbled[lo:hi], clean[i:j])
    ends = [*left, *rest, *reversed(right)] if rest or (lo == hi and i == j) else []
    return max(ends, even, key=lambda found: sum(known.get(g) == c for g, c in found))


def _forms(known: dict[str, str]) -> dict[str, list[str]]:
    """The pieces of each character, longest first."""
    out: dict[str, list[str]] = {}
    for g in sorted(known, key=lambda g: (-len(g), g)):
        out.setdefault(known[g], []).append(g)
    return out


def _sequence(piece: str, char: str) -> bool:
    """Whether a piece may be a garbled form of a character: longer than it, not signs of ordinary text alone, without
    combining marks, not small
    letters of one script, and not the character with punctuation, a space or a number added."""
    if len(piece) < 2 or all(_kind(c) in "PZ" for c in piece) or any(_kind(c) == "M" for c in piece):
        return False
    if all(c.isalpha() and c.islower() for c in piece) and one_script(piece):
        return False
    return not (char in piece and all(_kind(c) in "PZN" for c in piece.replace(char, "", 1)))


def _settled(votes: dict[str, tuple[int, str]]) -> dict[str, str]:
    """The characters of pieces (votes, character), without pieces that others make up but that say something else
    than these, and without signs before a character that do not stand before other ones as well."""
    known = {g: c for g, (_, c) in votes.items()}
    leads = Counter(g[0] for g, c in known.items() if c not in g)

    def made_of(g: str) -> set[str]:
        """What g says where it is read as two pieces and more."""
        ends: list[set[str]] = [{""}, *(set() for _ in g)]
        for end in range(1, len(g) + 1):
            for at in range(end):
                part = g[at:end]
                if part != g and ends[at] and part in known:
                    ends[end] |= {x + known[part] for x in ends[at]}
        return ends[-1]

    def good(g: str, c: str) -> bool:
        if c in g and all(_kind(x) == "S" for x in g.replace(c, "", 1)) and leads[g[0]] < 2:
            return False
        others = made_of(g)
        return not others or any(c in (x, known.get(x)) for x in others)

    return {g: c for g, c in known.items() if good(g, c)}


def _ordered(a: str, b: str) -> tuple[str, str, list[tuple[str, str]]] | None:
    """(garbled, clean, differing runs) of two variants, or None where nothing tells which is which.

    A misread passage is never shorter, and where one is longer it is the garbled one, if the other looks like a word or
    has no letters and they are not just two words. Of two equally long ones the one that alone looks like a word is clean.
    """
    runs = _differences(a, b)
    if not runs:
        return None
    sizes = {(len(g) > len(c)) - (len(g) < len(c)) for g, c in runs}
    if sizes == {0}:
        if sum(map(str.isalpha, a)) < 3 or sum(map(str.isalpha, b)) < 3:
            return None
        if _evident(a, b):
            return a, b, runs
        return (b, a, [(c, g) for g, c in runs]) if _evident(b, a) else None
    if len(sizes - {0}) != 1:
        return None
    garbled, clean, runs = (a, b, runs) if 1 in sizes else (b, a, [(c, g) for g, c in runs])
    letters = any(map(str.isalpha, clean))
    if letters and _looks(clean) == 0:
        return None
    if _looks(garbled) == 2 and (not letters or all(g.isalpha() for g, _ in runs)) and sum(map(str.isalpha, garbled)) > 1:
        return None
    return garbled, clean, runs


def _twins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(garbled, clean, single, n) of all pairs of variants of each key; n is the number of texts with the garbled one. Rows
    (key, word, n) come sorted by key and falling n. Only variants with runs in the same places can be aligned."""
    schema = pa.schema([("garbled", pa.string()), ("clean", pa.string()), ("single", pa.bool_()), ("n", pa.int64())])
    names: list[str] = schema.names
    now, hubs = None, {}

    def packed(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, schema.field(x).type) for c, x in zip(zip(*out, strict=True), names, strict=True)], schema=schema)

    out: list[tuple] = []
    for batch in batches:
        for key, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key != now:
                now, hubs = key, {}
            places = tuple(_runs(word))
            for hub, more in hubs.get(places, ()):
                if (told := _ordered(word, hub)) is not None:
                    out.append((told[0], told[1], all(len(g) == len(c) for g, c in told[2]), n if told[0] == word else more))
            if LOST not in word:
                hubs.setdefault(places, []).append((word, n))
            if len(out) >= _PAIRS:
                yield packed(out)
                out = []
    if out:
        yield packed(out)


def _across(found: list[tuple[str, str]], longest: int) -> Iterator[str]:
    """The parts of an aligned run, up to a length, that begin or end within a piece and reach into another one."""
    run = "".join(g for g, _ in found)
    bounds = {0}
    for g, _ in found:
        bounds.add(max(bounds) + len(g))
    for at in range(len(run)):
        for end in range(at + 2, min(len(run), at + longest) + 1):
            if any(b in bounds for b in range(at + 1, end)) and not (at in bounds and end in bounds):
                yield run[at:end]


def _votes(table: dict[str, dict[str, float]], known: dict[str, str], single: bool, explained: list[dict[str, str]]):
    """(piece, char, votes): texts with pairs of words that give each piece and character, per task; a null char counts
    the pairs that hold a known piece across the bounds of others. Rows (garbled, clean, n) come sorted by garbled.

    With probabilities of the round before (table: by piece and character) only the likeliest clean form of each garbled
    word votes. Words that other mappings mostly explain do not vote.
    """
    forms = _forms(known)
    longest = max(map(len, known), default=0)

    def aligned(garbled: str, clean: str) -> tuple[list[list[tuple[str, str]]], set[tuple[str, str]], float]:
        runs = _differences(garbled, clean) or []
        found = [list(zip(x, y, strict=True)) if single else pieces(x, y, known, forms) for x, y in runs]
        flat = [(g, c) for one in found for g, c in one]
        fit = sum(math.log(table.get(g, {}).get(c, _FLOOR)) for g, c in flat) / len(flat) if flat else -99.0
        return found, {(g, c) for g, c in flat if (g != c if single else _sequence(g, c))}, fit

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[tuple[str, str | None]] = Counter()

        def close(garbled: str | None, candidates: list[tuple[str, int]]) -> None:
            told = [(*aligned(garbled, clean), clean, n) for clean, n in candidates]
            if single and any(sum(t.get(g) == c for g, c in got) >= AGREE * len(got) for _, got, *_ in told for t in explained):
                return
            best = max((t[2] for t in told), default=0.0)
            for found, got, fit, clean, n in told:
                if table and fit < best - 1e-9:
                    continue
                crossed = {(p, None) for one in ([] if single else found) for p in _across(one, longest) if p in known}
                # Words without ASCII letters are brought together by their context alone: at first a pair counts once.
                weight = n if table or _LATIN.search(clean) or not any(map(str.isalpha, clean)) else 1
                for vote in got | crossed:
                    counts[vote] += weight

        now, candidates = None, []
        for batch in batches:
            for garbled, clean, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if garbled != now:
                    close(now, candidates)
                    now, candidates = garbled, []
                candidates.append((clean, n))
        close(now, candidates)
        if counts:
            names, chars = zip(*counts, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(chars, pa.string()), pa.array(counts.values(), pa.int64())], names=["piece", "char", "votes"])

    return run


def _taught(pairs: DataFrame, single: bool, explained: list[dict[str, str]]) -> dict[str, str]:
    """The character of every piece by the votes of the last round. The characters above _FLOOR are collected for each piece:
    pieces are the garbled forms of characters, so they are bounded by the alphabet, not by the records."""
    table: dict[str, dict[str, float]] = {}
    known: dict[str, str] = {}
    least = SINGLE_VOTES if single else VOTES
    turn = -1
    while turn < ROUNDS - 1:
        turn += 1
        votes = pairs.mapInArrow(_votes(table, known, single, explained), "piece string, char string, votes bigint").repartition("piece")
        votes = votes.groupBy("piece", "char").agg(F.sum("votes").alias("votes"))  # tasks have counted before; one shuffle serves both sums
        ranked = F.sort_array(F.collect_list(F.when(F.col("char").isNotNull(), F.struct("votes", "char"))), False)
        rows = votes.groupBy("piece").agg(ranked.alias("best"), F.sum(F.when(F.col("char").isNotNull(), F.col("votes"))).alias("all"), F.max(F.when(F.col("char").isNull(), F.col("votes"))).alias("crossed")).where(F.size("best") > 0)
        rows = rows.withColumn("best", F.filter("best", lambda b: b["votes"] > _FLOOR * F.col("all"))).where(F.size("best") > 0).collect()
        table = {r.piece: {b.char: b.votes / r["all"] for b in r.best} for r in rows}
        last = turn == ROUNDS - 1
        chosen = {r.piece: (r.best[0].votes, r.best[0].char) for r in rows if r.best[0].votes >= least and (not last or r.best[0].votes >= max(SHARE * r["all"], CROSSED * (r.crossed or 0)))}
        before, known = known, {g: c for g, (_, c) in chosen.items()} if single else _settled(chosen)
        table = {g: chars for g, chars in table.items() if g in known or g not in chosen}
        if not known or last:
            break
        turn = ROUNDS - 2 if known == before else turn
    return known


class Mappings:
    """What was learned: sequences to characters, tables of single characters, and whether lost characters occur."""

    def __init__(self, sequences: dict[str, str], tables: list[dict[str, str]], lost: bool) -> None:
        self.sequences, self.tables, self.lost = sequences, tables, lost
        ordered = sorted(sequences, key=lambda s: (-len(s), s))
        self.pattern = re.compile("|".join(map(re.escape, ordered))) if ordered else None

    def __reduce__(self):
        return Mappings, (self.sequences, self.tables, self.lost)

    def singly(self, word: str) -> Iterator[str]:
        """What the tables make of a word: words of one script, none that looks wrong where the given one looks right."""
        for table in self.tables:
            clean = "".join(table.get(c, c) for c in word)
            if clean != word and one_script(clean) and _printable(clean) and not _evident(clean, word):
                yield clean


def learn(records: DataFrame, text_col: str = "text") -> tuple[Mappings, DataFrame]:
    """The mappings and the table of words (key, word, n) they were learned from; n is a number of different texts."""
    # n counts different texts, so that many copies of one garbled text do not outweigh the clean ones.
    lists = records.where(F.col(text_col).isNotNull()).select(F.col(text_col).alias("text")).mapInArrow(_texts_words, "text bigint, keys array<bigint>, words array<string>").dropDuplicates(["text"])
    pairs = lists.select(F.explode(F.arrays_zip("keys", "words")).alias("p")).select(F.col("p.keys").alias("key"), F.col("p.words").alias("word"))
    words = written(pairs.groupBy("key", "word").agg(F.count("*").alias("n")))
    ordered = words.repartition("key").sortWithinPartitions("key", F.desc("n"), "word").select("key", "word", "n")
    twins = written(ordered.mapInArrow(_twins, "garbled string, clean string, single boolean, n bigint").groupBy("garbled", "clean", "single").agg(F.sum("n").alias("n")).repartition("garbled").sortWithinPartitions("garbled", "clean"))
    sequences = _taught(twins.where("not single").select("garbled", "clean", "n"), False, [])
    # Single characters are learned from words that hold no such sequence: else one garbled form votes for another.
    others = twins.where("single").select("garbled", "clean", "n").mapInArrow(_without_sequences(Mappings(sequences, [], False)), "garbled string, clean string, n bigint")
    tables: list[dict[str, str]] = []
    # One encoding each. The words that a table explains no longer vote, so the search ends: at last nothing new is found.
    while (table := _taught(others, True, tables)) and not any(table.items() <= t.items() for t in tables):
        tables.append(table)
    # A lost character stands where twins have different ones.
    lost_words = words.where(F.col("word").contains(LOST)).select("key", F.col("word").alias("damaged"))
    lost = lost_words.join(words.where(~F.col("word").contains(LOST)), "key").select("damaged").distinct().limit(VOTES).count() >= VOTES
    return Mappings(sequences, tables, lost), words


def _without_sequences(mappings: Mappings):
    """Rows (garbled, word, ...) of which neither word holds a learned sequence or a lost character."""

    def spoilt(word: str) -> bool:
        return LOST in word or bool(mappings.pattern and mappings.pattern.search(word))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [not spoilt(a) and not spoilt(b) for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield batch.filter(pa.array(good, pa.bool_()))

    return run


def _apply(mappings: Mappings):
    """Per record: whether a learned sequence or a lost character occurs, and words that single-byte chains might restore."""
    schema = pa.schema([("id", pa.int64()), ("sure", pa.bool_()), ("garbled", pa.string()), ("word", pa.string())])

    @functools.lru_cache(maxsize=200_000)
    def restorable(word: str) -> tuple[str, ...]:
        if LOST in word or (mappings.pattern and mappings.pattern.search(word)):
            return ()
        return tuple(sorted({clean for clean in mappings.singly(word) if _evident(word, clean)}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in blocks(batches, 1):
            out: list[tuple] = []
            for i, text in zip(part.column(0).to_pylist(), texts, strict=True):
                if text.isascii() and "&#" not in text:
                    continue
                plain = plain_text(text)
                if (mappings.pattern and mappings.pattern.search(plain)) or (mappings.lost and LOST in plain):
                    out.append((i, True, None, None))
                if mappings.tables:
                    for word in {word for _, word in keyed_words(text)}:
                        out += [(i, False, word, clean) for clean in restorable(word)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return run


_HITS = "id bigint, sure boolean, garbled string, word string"


def _marked(records: DataFrame, mappings: Mappings, words: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(records with sure marks, single-byte words with a known clean word) as (id) and (id, garbled, word)."""
    shared = records.sparkSession.sparkContext.broadcast(mappings)  # bounded by the alphabet
    rows = records.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    hits = written(rows.mapInArrow(lambda it: _apply(shared.value)(it), _HITS))
    counts = words.select("word").distinct()
    open_words = hits.where("not sure").select("id", "garbled", "word")
    known = open_words.join(counts.select("word"), "word", "left_semi")
    known = known.select("garbled", "word", "id").mapInArrow(_without_sequences(mappings), "garbled string, word string, id bigint")
    return hits.where("sure").select("id"), known.select("id", "garbled", "word")


def garbled_records(records: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id) of the records with a passage read in a wrong encoding, outside of backticks.

    Null ids and texts give no rows; repeated ids are returned once; texts are read whole. Nothing is found in an empty
    table, or where no garbled word has a clean twin anywhere. How many texts are garbled does not matter: a sequence of
    several characters is told by its length, a single character by the word that alone looks right. Not found is
    single-byte garbling after which a word still looks right: a letter became another one of its script and case.
    """
    mappings, words = learn(records, text_col)
    sure, known = _marked(records, mappings, words, id_col, text_col)
    return sure.unionByName(known.select("id")).distinct()


def _restore(mappings: Mappings):
    schema = pa.schema([("id", pa.int64()), ("text", pa.string()), ("restored", pa.string()), ("complete", pa.bool_())])

    def fix(text: str, table: dict[str, str]) -> str:
        parts = re.split(r"(`[^`\n]*`)", text)
        for i in range(0, len(parts), 2):
            part = parts[i]
            if "&#" in part:
                part = re.sub(r"(?:&#\d{2,6};)+", lambda m: s if mappings.pattern and mappings.pattern.search(s := plain_text(m[0])) else m[0], part)
            if mappings.pattern:
                part = mappings.pattern.sub(lambda m: mappings.sequences[m[0]], part)
            if table:
                part = re.sub(r"[^ \t\r\n\f\v]+", lambda m: m[0].replace(w, table[w]) if (w := m[0].strip(_EDGE)) in table else m[0], part)
            parts[i] = part
        return "".join(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, text, pairs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                new = fix(text, {p["garbled"]: p["word"] for p in pairs or []})
                rest = plain_text(new)
                out.append((i, text, new, LOST not in rest and not (mappings.pattern and mappings.pattern.search(rest))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return run


def restored_records(records: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, restored, complete) of the garbled records; complete is false where characters stay lost.

    Learned sequences are replaced everywhere outside of backticks. Whole words are replaced where a single-byte
    mapping leads to a known word that alone looks right, and words with lost characters by the most frequent clean word with
    the same ASCII characters and as many others in the same places.
    """
    mappings, words = learn(records, text_col)
    sure, known = _marked(records, mappings, words, id_col, text_col)
    rows = records.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))

    def shape(column: str) -> Column:
        return F.regexp_replace(column, r"[^\x00-\x7f]", LOST)

    clean = words.where(~F.col("word").contains(LOST)).groupBy("word").agg(F.sum("n").alias("n")).withColumn("shape", shape("word"))
    best = clean.groupBy("shape").agg(F.max_by("word", F.struct("n", "word")).alias("word"))
    damaged = words.where(F.col("word").contains(LOST)).select(F.col("word").alias("garbled")).distinct().withColumn("shape", shape("garbled")).join(best, "shape").where(~F.col("word").contains(LOST) & F.col("garbled").rlike("[A-Za-z].*[A-Za-z]"))
    holders = rows.where(F.col("text").contains(LOST)).select("id", F.explode(F.array_distinct(F.split("text", r"[ \t\r\n\f\x0B]+"))).alias("raw")).where(F.col("raw").contains(LOST))
    lost = holders.withColumn("garbled", F.regexp_replace("raw", r"^[ .,;:!?()\[\]{}\"'*_#<>|/\\-]+|[ .,;:!?()\[\]{}\"'*_#<>|/\\-]+$", "")).join(damaged, "garbled").select("id", "garbled", "word")
    fixes = known.unionByName(lost).groupBy("id").agg(F.collect_set(F.struct("garbled", "word")).alias("pairs"))
    found = sure.unionByName(known.select("id")).distinct()
    shared = records.sparkSession.sparkContext.broadcast(mappings)
    return rows.join(found, "id").join(fixes, "id", "left").select("id", "text", "pairs").mapInArrow(lambda it: _restore(shared.value)(it), "id bigint, text string, restored string, complete boolean")
