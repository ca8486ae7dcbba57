"""Column functions: everything here stays inside generated JVM code."""

from seamline.functions.spans import citation, iou, span
from seamline.functions.text import STOP_WORDS, is_blank, suffix, terms, word_count
from seamline.functions.vectors import inner_product, usable_vector

__all__ = ["STOP_WORDS", "citation", "inner_product", "iou", "is_blank", "span", "suffix", "terms", "usable_vector", "word_count"]
