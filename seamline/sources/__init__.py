"""Where tables come from and go to."""

from seamline.sources.json_files import read_questions, read_results, write_results
from seamline.sources.store import IndexStore
from seamline.sources.tree import read_tree, register

__all__ = ["IndexStore", "read_questions", "read_results", "read_tree", "register", "write_results"]
