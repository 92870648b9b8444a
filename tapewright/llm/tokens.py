"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ranks of a public byte-level BPE of 50,256 tokens, and the pattern by which its tokenizer cuts text into words.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(text: Column, path: str = RANKS) -> Column:
    """Tokens of the whole text; 0 for null and empty texts. Names of special tokens are ordinary text. ``path`` must be
    readable where the tasks run."""

    @F.pandas_udf("bigint")
    def count(s: pd.Series) -> pd.Series:
        encode = _encoding(path).encode_ordinary
        return pd.Series([0 if not x else len(encode(x)) for x in s], dtype="int64")

    return count(text)
