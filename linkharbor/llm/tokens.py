"""Token counts of texts with a public tokenizer, whose vocabulary file is a parameter."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Default place of the vocabulary (tiktoken ranks); never copied into this repository.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pre-tokenizer pattern that belongs to that vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Fixed value: white space as the pattern's ``\s`` has it.  Its look-ahead steps back over a run, too deep for very long ones.
_LONG_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{1000,}")


@lru_cache(maxsize=4)
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("linkharbor", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count(text: str | None, path: str = VOCABULARY) -> int:
    """Tokens of a whole text of any length, exactly as the tokenizer gives them; 0 for NULL and empty.

    The pre-tokenizer makes a long run of white space one piece, less its last character where text follows; that piece
    is encoded by itself, and the text around it starts and ends at piece boundaries.
    """
    if not text:
        return 0
    enc, n, at = encoder(path), 0, 0
    for m in _LONG_SPACE.finditer(text):
        end = m.end() if m.end() == len(text) else m.end() - 1
        n += len(enc.encode_ordinary(text[at : m.start()])) + len(enc._encode_single_piece(text[m.start() : end]))
        at = end
    return n + len(enc.encode_ordinary(text[at:] if at else text))


def token_counts(df: DataFrame, keep: list[str], path: str = VOCABULARY) -> DataFrame:
    """``keep`` columns and ``n_tokens`` of ``text``: one pass, batches of texts, no shuffle."""

    @F.pandas_udf("long")
    def counts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder(path)
        for texts in batches:
            yield pd.Series(np.fromiter((count(t, path) for t in texts), dtype="int64", count=len(texts)))

    return df.select(*keep, counts("text").alias("n_tokens"))
