"""Encoding and decoding by a public tokenizer, Column -> Column.

``path`` names a tokenizer file in the JSON format of the ``tokenizers`` library; it has to be
there on every worker. Null and empty texts have no ids, and no ids decode to ''.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Characters, or ids, that go to the tokenizer at once: while it works it holds a hundred
#: bytes and more for each.
SLICE = 1 << 18


def slices(items: Iterable) -> Iterator[list]:
    """The items one after another in lists of at most ``SLICE`` characters or ids together; a
    greater item stands alone."""
    part, size = [], 0
    for x in items:
        if part and size + len(x) > SLICE:
            yield part
            part, size = [], 0
        part.append(x)
        size += len(x)
    if part:
        yield part


@lru_cache(maxsize=4)
def load(path: str):
    """The tokenizer of this worker. A task has one core: threads of the tokenizer's own would
    take the other tasks' and hold memory each."""
    import os

    from tokenizers import Tokenizer

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Tokenizer.from_file(path)


def _ids(texts: Iterable, path: str) -> Iterator:
    import numpy as np

    for part in slices(t or "" for t in texts):
        for e in load(path).encode_batch_fast(part, add_special_tokens=False):
            yield np.array(e.ids, dtype=np.int32)


def _texts(lists: Iterable, path: str, skip_special: bool = True) -> Iterator[str]:
    for part in slices(() if x is None else x for x in lists):
        yield from load(path).decode_batch([list(x) for x in part], skip_special_tokens=skip_special)


def encode(c: Column, path: str, vocab: int | None = None, eos: int | None = None) -> Column:
    """Ids of the whole text without special tokens; ids of ``vocab`` and above become
    ``vocab - 1``, and ``eos`` ends every text that has ids."""
    import pandas as pd

    def run(s):
        import numpy as np

        out = []
        for ids in _ids(s, path):
            ids = ids if vocab is None else np.minimum(ids, vocab - 1)
            out.append(np.append(ids, np.int32(eos)) if eos is not None and len(ids) else ids)
        return pd.Series(out, dtype=object)

    run.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "array<int>")(c)


def decode(ids: Column, path: str, skip_special: bool = True) -> Column:
    """The text of the ids; special tokens are left out."""
    import pandas as pd

    def run(s):
        return pd.Series(list(_texts(s, path, skip_special)), dtype=object)

    run.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "string")(ids)


def round_trip(c: Column, path: str) -> Column:
    """``ids`` of the text and ``text`` decoded from them, in one call: with ``decode`` of
    ``encode`` beside ``encode`` every text would be encoded twice."""
    import pandas as pd

    def run(s):
        ids = list(_ids(s, path))
        return pd.DataFrame({"ids": pd.Series(ids, dtype=object), "text": pd.Series(list(_texts(ids, path)), dtype=object)})

    run.__annotations__ = {"s": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(run, "ids array<int>, text string")(c)
