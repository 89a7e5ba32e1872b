"""Public tokenizers, loaded once in each Python worker.

Vocabulary files are read from a folder that is a parameter; nothing is copied.
Special tokens are never produced: their strings in a text are ordinary text.
"""

from __future__ import annotations

import base64
import os
from functools import lru_cache

DEFAULT_FOLDER = "/opt/tokenizers"
#: The public pre-splitting pattern of the byte-level rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def byte_bpe(name: str = "byte_bpe_50k", folder: str = DEFAULT_FOLDER):
    """The byte-level BPE of ``folder/name.tiktoken`` without special tokens."""
    import tiktoken

    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=1)
def splitter():
    """The compiled pre-splitting pattern."""
    import regex

    return regex.compile(PATTERN)
