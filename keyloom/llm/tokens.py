"""Sizes of texts in tokens of a public byte-level BPE vocabulary, given as a file of ranks."""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the vocabulary's public pattern for cutting a text into pieces.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Lines remembered by a worker, and the longest of them.
CACHED_LINES, CACHED_CHARS = 200_000, 200

# A line feed before a character that surely is no blank is a piece of its own, so a text may be counted in the parts between.
_CUT = re.compile(r"\n(?=[!-~])").split


@lru_cache(maxsize=4)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("given", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class _Lines(dict):
    def __init__(self, encode) -> None:
        super().__init__()
        self.encode = encode

    def __missing__(self, line: str) -> int:
        n = len(self.encode(line))
        if len(line) <= CACHED_CHARS:
            if len(self) >= CACHED_LINES:
                self.clear()
            self[line] = n
        return n


@lru_cache(maxsize=4)
def counter(path: str = TOKENIZER):
    """A function from text to its number of tokens, exactly as encoding the whole text gives; lines that recur are encoded once."""
    encode = encoding(path).encode_ordinary
    count = _Lines(encode).__getitem__
    newline = len(encode("\n"))

    def tokens(text: str | None) -> int:
        if not text:
            return 0
        parts = _CUT(text)
        return sum(map(count, parts)) + newline * (len(parts) - 1)

    return tokens


def n_tokens(text: Column | str, path: str = TOKENIZER) -> Column:
    """Tokens of a text column; a null or empty text has none. Whole texts of any length are counted."""

    @F.pandas_udf(T.LongType())
    def count(texts: pd.Series) -> pd.Series:
        tokens = counter(path)
        return pd.Series([tokens(t) for t in texts], dtype="int64")

    return count(text)
