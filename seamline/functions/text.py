"""Text predicates and the search tokeniser."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The English stop list the scores are defined with.
STOP_WORDS = (
    "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with"
).split()

TERM_PATTERN = r"[\p{L}\p{N}_]{2,}"
#: White space in the sense of Python's str.strip; Spark's trim knows only U+0020.
NOT_BLANK = r"[^\s\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def terms(text: Column, stop_words: bool = True) -> Column:
    """Array of lower-cased terms of two or more letters, digits or underscores, repeats kept. Null text: empty."""
    found = F.regexp_extract_all(F.lower(text), F.lit(f"({TERM_PATTERN})"), F.lit(1))
    if stop_words:
        stop = F.array(*[F.lit(w) for w in STOP_WORDS])
        found = F.filter(found, lambda t: ~F.array_contains(stop, t))
    return F.coalesce(found, F.array().cast("array<string>"))


def is_blank(text: Column) -> Column:
    """True for null, empty and white-space-only text."""
    return F.coalesce(~text.rlike(NOT_BLANK), F.lit(True))


def suffix(path: Column) -> Column:
    """The last extension with its dot, case kept; empty for names such as '.py' or 'name.'."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.coalesce(F.regexp_extract(name, r"^.+(\.[^.]+)$", 1), F.lit(""))


def word_count(text: Column) -> Column:
    """White-space separated words; 0 for blank text and null."""
    trimmed = F.regexp_replace(text, r"^\s+|\s+$", "")
    return F.when(F.coalesce(F.length(trimmed), F.lit(0)) == 0, F.lit(0)).otherwise(F.size(F.split(trimmed, r"\s+")))
