"""Token counts by a public byte-level BPE vocabulary; the file's path is a parameter."""

from __future__ import annotations

import base64
import functools
from collections.abc import Sequence

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# Fixed value: the pattern that this vocabulary was made with.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@functools.lru_cache(maxsize=2)
def encoder(path: str = VOCABULARY):
    """The encoder of a rank file, loaded once in each Python worker."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("seamline", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(texts: Sequence[str], path: str = VOCABULARY) -> list[int]:
    return [len(t) for t in encoder(path).encode_ordinary_batch(list(texts), num_threads=1)]
