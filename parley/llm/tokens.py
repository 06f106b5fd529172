"""Token sizes of texts, by a public tokenizer or by the plain word rule."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Folder of the public vocabularies. It is read on every executor and never copied into the repository.
TOKENIZER_DIR = os.environ.get("PARLEY_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: The public pre-tokenization pattern that belongs to VOCABULARY.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A word, or a single other character that is not blank.
WORD_TOKEN = r"[\p{L}\p{M}\p{Nd}_]+|[^\s\p{L}\p{M}\p{Nd}_]"


@lru_cache(maxsize=4)
def encoding(path: str):
    """The byte-level BPE at path, loaded once in each Python worker."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("public", pat_str=PRE_TOKEN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=2)
def pieces_of(path: str) -> frozenset[str]:
    """The pieces of the byte-level vocabulary at path that are texts by themselves."""
    out = set()
    with open(path, "rb") as lines:
        for a, _ in map(bytes.split, lines):
            try:
                out.add(base64.b64decode(a).decode())
            except UnicodeDecodeError:
                continue
    return frozenset(out)


def default_path() -> str:
    return os.path.join(TOKENIZER_DIR, VOCABULARY)


def with_token_count(df: DataFrame, text: str = "text", out: str = "n_tokens", path: str | None = None) -> DataFrame:
    """Adds out: the number of tokens of the column text; 0 for null and empty texts.

    Whole texts are counted. Work per row depends on its text alone, so no shuffle takes place.
    """
    where = path or default_path()

    @F.pandas_udf("int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoding(where).encode_ordinary
        for texts in batches:
            yield pd.Series([len(encode(t)) if t else 0 for t in texts], dtype="int32")

    return df.withColumn(out, count(F.col(text)))


def word_count(text: Column) -> Column:
    """Number of word-rule tokens, on the JVM; null texts give 0."""
    return F.coalesce(F.regexp_count(text, F.lit("(?U)" + WORD_TOKEN)), F.lit(0))
