"""Token counts of texts by a tokenizer file, a batch of texts at a time."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F

#: Characters encoded in one call, about: what the library holds at once follows it.
CALL_CHARS = 1 << 18


@lru_cache(maxsize=2)
def _tokenizer(file: str):
    from tokenizers import Tokenizer

    loaded = Tokenizer.from_file(file)
    loaded.encode_special_tokens = True  # their strings in a text are ordinary text
    loaded.no_truncation()
    loaded.no_padding()
    return loaded


def _lengths(file: str, texts: list[str]):
    tokenizer = _tokenizer(file)
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size >= CALL_CHARS:
            yield from (len(e) for e in tokenizer.encode_batch(held, add_special_tokens=False))
            held, size = [], 0
    yield from (len(e) for e in tokenizer.encode_batch(held, add_special_tokens=False))


def token_counts(file: str):
    """A function of a text column that counts its tokens; null for null.  All nodes must have the file at this place.

    It is marked as not deterministic, though it is: else a filter on the count
    is pushed below the column and every text is encoded twice.
    """

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        given = texts.dropna()
        return pd.Series(list(_lengths(file, given.tolist())), index=given.index, dtype="Int64").reindex(texts.index)

    return count.asNondeterministic()
