"""Problem 10: cut oversized texts by recursive bisection at natural boundaries."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.tokens import WORD_TOKEN, encoding, word_count

_WORD = regex.compile(WORD_TOKEN)
#: Kinds of boundary, strongest first: paragraph, line, sentence, clause. Between words is the least.
_BOUNDARIES = (
    (5, re.compile(r"\n[ \t]*\n\s*")),
    (4, re.compile(r"\n\s*")),
    (3, re.compile(r"[.!?।…][\"'”»)\]]*\s+")),
    (2, re.compile(r"[;:,–—]\s+")),
    (1, re.compile(r"\s+")),
)


#: A run without blanks of more tokens than this may be cut at any of its characters.
LONG_RUN = 16


@lru_cache(maxsize=2)
def _facts(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every token of a vocabulary: its bytes, and whether its first, last and all bytes are blanks."""
    encode = encoding(path)
    tokens = [encode.decode_single_token_bytes(k) for k in range(encode.n_vocab)]
    blank = frozenset(b" \t\n\r\x0b\x0c")
    return np.array([len(t) for t in tokens]), np.array([t[0] in blank for t in tokens]), np.array([t[-1] in blank for t in tokens]), np.array([all(x in blank for x in t) for t in tokens])


def units(text: str, path: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start offsets of the units that may begin a piece, the tokens before each (one entry more, the total), and which of them begin inside a run without blanks.

    Under a public tokenizer a unit begins at a token that stands at a blank, where its own rule for words cuts as well, so that a piece has the tokens that it has within the text; longer runs may be cut at any token that begins a character.
    """
    if path is None:
        starts = np.fromiter((m.start() for m in _WORD.finditer(text)), dtype=np.int64)
        return starts, np.arange(len(starts) + 1), np.zeros(len(starts), dtype=bool)
    ids = np.array(encoding(path).encode_ordinary(text), dtype=np.int64)
    if not len(ids):
        return ids, np.zeros(1, dtype=np.int64), np.zeros(0, dtype=bool)
    size, first, last, blank = (f[ids] for f in _facts(path))
    at = np.concatenate(([0], np.cumsum(size)[:-1]))
    whole = np.ones(len(ids), dtype=bool)
    if not text.isascii():
        head = (np.frombuffer(text.encode(), dtype=np.uint8) & 0xC0) != 0x80
        whole = head[at]
        at = (np.cumsum(head) - 1)[at]
    free = np.ones(len(ids), dtype=bool)
    free[1:] = (first[1:] | last[:-1]) & ~(blank[1:] & blank[:-1]) & whole[1:]
    begins = np.flatnonzero(free)
    run = np.repeat(np.diff(np.append(begins, len(ids))), np.diff(np.append(begins, len(ids))))
    inside = ~free & whole & (run > LONG_RUN)
    begins = np.flatnonzero(free | inside)
    return at[begins], np.append(begins, len(ids)), inside[begins]


def strengths(text: str, starts: np.ndarray) -> np.ndarray:
    """The strongest boundary right before each unit."""
    out = np.zeros(len(starts), dtype=np.int8)
    for weight, pattern in reversed(_BOUNDARIES):
        ends = np.fromiter((m.end() for m in pattern.finditer(text)), dtype=np.int64)
        hit = np.searchsorted(starts, ends)
        # a unit may begin with the blank before its word
        exact = (hit < len(starts)) & (starts[np.minimum(hit, len(starts) - 1)] == ends)
        hit = np.where(exact, hit, np.searchsorted(starts, ends - 1))
        out[hit[hit < len(starts)]] = weight
    return out


def bisect(text: str, limit: int, overlap: int, path: str | None = None, made: tuple | None = None) -> list[tuple[int, int, int, int]]:
    """(start, end, tokens, tokens shared with the piece before) of the pieces of text; one if it holds at most limit tokens. made are its units and strengths, if they are there already.

    A range that holds more than limit - overlap tokens is cut at its strongest boundary in the middle half, the nearest to the midpoint among equals, and both halves go on in the same way. Then each piece but the first
    is begun overlap tokens earlier, at the first unit that lies within them: it shares overlap tokens with the piece before, or less by part of a unit.
    """
    starts, before, inside, strength = made or (*(u := units(text, path)), strengths(text, u[0]))
    n = len(starts)
    if n == 0 or before[-1] <= limit:
        return [(0, len(text), int(before[-1]), 0)]
    room = max(1, limit - overlap)
    pieces, todo = [], [(0, n)]
    while todo:
        a, b = todo.pop()
        if before[b] - before[a] <= room or b - a < 2:
            pieces.append((a, b))
            continue
        low, high = before[a], before[b]
        quarter = (high - low) / 4
        first = int(np.clip(np.searchsorted(before, low + quarter), a + 1, b - 1))
        last = int(np.clip(np.searchsorted(before, high - quarter), first, b - 1))
        window = strength[first : last + 1]
        best = np.flatnonzero(window == window.max()) + first
        cut = int(best[np.argmin(np.abs(before[best] - (low + high) / 2))])
        todo += [(cut, b), (a, cut)]
    spans = []
    for k, (a, b) in enumerate(pieces):
        own = a
        if k and overlap:
            a = max(int(np.searchsorted(before, before[a] - overlap, side="left")), pieces[k - 1][0])
        size = int(before[b] - before[a])
        end = int(starts[b]) if b < n else len(text)
        if path is not None and b < n and text[end - 1].isspace():
            # blanks at the end are tokenized as a whole there
            u = max(a, int(np.searchsorted(starts, len(text[int(starts[a]) : end].rstrip()) + int(starts[a]) - 1, side="right")) - 1)
            size += len(encoding(path).encode_ordinary(text[int(starts[u]) : end])) - int(before[b] - before[u])
        if inside[a] or (b < n and inside[b]):
            # a cut inside a run may change its tokens: count again, and share less where that makes too many
            count = lambda a: len(encoding(path).encode_ordinary(text[int(starts[a]) : end]))  # noqa: B023, E731
            size = count(a)
            while size > limit and a < own:
                a += 1
                size = count(a)
        spans.append((int(starts[a]) if a or k else 0, end, size, int(before[own] - before[a])))
    return spans


def split_oversized(docs: DataFrame, limits: list[tuple[int, int, int]], text: str = "text", key: str = "doc_id", tokenizer: str | None = None) -> DataFrame:
    """Pieces (budget_id, key, piece_no, n_pieces, char_start, char_end, n_tokens, shared_tokens, piece_text) of the texts with more than limit tokens, for each (budget_id, limit, overlap) of limits.

    Every text is read and tokenized once, whatever the number of limits. A text of at most limit characters has at most limit word tokens, and a public token holds a byte at least, so short texts are decided
    by their length and never reach Python. tokenizer is the path of a public vocabulary, or None for the word rule, under which pieces share exactly overlap tokens unless the piece before is shorter; public tokens are shared in whole words, shared_tokens of them. Texts within the limit have none. Null and empty texts have no pieces. Equal rows give equal pieces. Other columns of docs, whatever their names, are left out.
    """
    least = min(limit for _, limit, _ in limits)
    base = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text")).where(F.length("__text") > 0)
    size = word_count(F.col("__text")) if tokenizer is None else F.octet_length("__text")
    big = base.where((F.length("__text") > least) if tokenizer is None else (F.octet_length("__text") > least)).where(size > least)
    kind = docs.schema[key].dataType.simpleString()
    schema = f"budget_id int, __key {kind}, piece_no int, n_pieces int, char_start int, char_end int, n_tokens int, shared_tokens int, piece_text string"

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for k, t in zip(frame["__key"], frame["__text"]):
                u = units(t, tokenizer)
                if u[1][-1] <= least:
                    continue
                made = (*u, strengths(t, u[0]))
                for budget, limit, overlap in limits:
                    spans = bisect(t, limit, overlap, tokenizer, made)
                    if len(spans) > 1:
                        rows += [(budget, k, no, len(spans), a, b, n, shared, t[a:b]) for no, (a, b, n, shared) in enumerate(spans)]
            yield pd.DataFrame(rows, columns=["budget_id", "__key", "piece_no", "n_pieces", "char_start", "char_end", "n_tokens", "shared_tokens", "piece_text"])

    return big.mapInPandas(work, schema).withColumnRenamed("__key", key)


def found(docs: DataFrame, limit: int, overlap: int) -> DataFrame:
    """Keys of the documents that the operator cuts under the word rule, each once."""
    return split_oversized(docs, [(0, limit, overlap)]).where(F.col("piece_no") == 1).select("doc_id").distinct()
