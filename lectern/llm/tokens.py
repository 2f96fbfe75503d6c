"""Token counts with a public tokenizer whose vocabulary file is a parameter."""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary lies on every executor.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pre-tokenizer pattern that belongs to this vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(4)
def encoder(vocabulary: str, pattern: str):
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(vocabulary, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, text: str, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """`df` without the column `text`, with n_tokens INT in its place: the tokens of the whole text, 0 for null and empty texts."""
    keep = [c for c in df.columns if c != text]
    schema = df.select(*keep, F.lit(0).alias("n_tokens")).schema

    def run(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(vocabulary, pattern)
        for p in parts:
            out = p[keep].copy()
            out["n_tokens"] = pd.Series([len(enc.encode_ordinary(t)) if t else 0 for t in p[text]], dtype="int32", index=p.index)
            yield out

    return df.select(*keep, text).mapInPandas(run, schema)
