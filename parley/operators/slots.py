"""Places for models, with deterministic stand-ins that need none."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions.text import KEYWORD_TOKEN

_TOKEN = re.compile(KEYWORD_TOKEN)
#: name -> texts to vectors; one call for each Arrow batch.
EMBEDDERS: dict[str, Callable[[list[str]], np.ndarray]] = {}


def embedder(name: str):
    """Registers a function from texts to an array of vectors under a name."""

    def keep(f: Callable[[list[str]], np.ndarray]) -> Callable[[list[str]], np.ndarray]:
        EMBEDDERS[name] = f
        return f

    return keep


@embedder("hashing")
def hashed_tokens(texts: list[str], dim: int = 64) -> np.ndarray:
    """Counts of tokens in hashed places, with hashed signs, at length one; zeros for texts without tokens."""
    out = np.zeros((len(texts), dim), dtype=np.float32)
    for row, text in zip(out, texts):
        for token in _TOKEN.findall(text or ""):
            h = xxhash.xxh32_intdigest(token.lower())
            row[h % dim] += 1.0 if h >> 31 else -1.0
    size = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(size > 0, size, 1)


def embedded(df: DataFrame, text: str, out: str = "embedding", name: str = "hashing") -> DataFrame:
    """Adds the vector of each text; null texts count as empty."""
    f = EMBEDDERS[name]

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(list(f([t or "" for t in texts])))

    return df.withColumn(out, run(F.col(text)))


def extractive_answer(context: Column) -> Column:
    """The first sentences of the best context, or the sign that there is none."""
    return F.when(F.trim(F.coalesce(context, F.lit(""))) == "", "NO_MATCH").otherwise(F.substring(F.trim(context), 1, 300))
