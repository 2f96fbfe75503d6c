"""Texts as vectors by an encoder that is given, and the table of them."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators.resolve import upsert


def hashing_encoder(dim: int = 64) -> Callable[[list[str]], np.ndarray]:
    """A model-free encoder: words hashed with signs into `dim` numbers, scaled to length 1. It stands in where no model is given."""

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), np.float32)
        for row, text in zip(out, texts):
            for w in text.lower().split():
                h = zlib.crc32(w.encode())
                row[h % dim] += 1 if h >> 31 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.maximum(norm, 1e-12)

    return encode


def encode(df: DataFrame, key: str, text: str, encoder: Callable[[list[str]], np.ndarray]) -> DataFrame:
    """(key, vector): the texts' vectors, an Arrow batch at a time on the executors. Null and blank texts have none; other columns are ignored."""
    kind = dict(df.dtypes)[key]

    def run(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            vectors = encoder(p["t"].tolist()) if len(p) else []
            yield pd.DataFrame({"k": p["k"], "vector": [np.asarray(v, np.float32) for v in vectors]})

    rows = df.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.length(F.trim("t")) > 0)
    return rows.mapInPandas(run, f"k {kind}, vector array<float>").withColumnRenamed("k", key)


def refreshed(table: DataFrame, df: DataFrame, key: str, text: str, encoder: Callable[[list[str]], np.ndarray]) -> DataFrame:
    """The embedding table `table(key, vector)` with the vectors of the given texts in place of older ones."""
    return upsert(table, encode(df, key, text, encoder), key)
