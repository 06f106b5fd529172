"""Pipe tables, repeated tails and audio headers as columns."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_RULE = r"^\s*\|?[\s:|-]*-[\s:|-]*\|?\s*$"


def without_trailing_rules(table: Column) -> Column:
    """The table without blank and separator lines at its end; the first two lines always stay."""
    lines = F.split(F.coalesce(table, F.lit("")), "\n")
    kept = F.transform(lines, lambda s, i: F.when((i < 2) | ((F.trim(s) != "") & ~s.rlike(_RULE)), i))
    return F.when(F.size(lines) >= 3, F.array_join(F.slice(lines, 1, F.array_max(kept) + 1), "\n")).otherwise(F.coalesce(table, F.lit("")))


def row_and_column_count(table: Column) -> Column:
    """(rows, cols): pipe lines that are no separators, and the cells of the first."""
    lines = F.filter(F.split(F.coalesce(table, F.lit("")), "\n"), lambda s: F.trim(s).startswith("|"))
    rows = F.size(F.filter(lines, lambda s: ~s.rlike(_RULE)))
    return F.struct(rows.alias("rows"), F.when(F.size(lines) > 0, F.regexp_count(F.get(lines, 0), F.lit(r"\|")) - 1).otherwise(0).alias("cols"))


def modal_width(rows: Column) -> Column:
    """The most frequent number of cells of a row; of equals the first seen. Null for no rows."""
    sizes = F.transform(rows, F.size)
    ranked = F.transform(F.array_distinct(sizes), lambda n: F.struct(F.size(F.filter(sizes, lambda m: m == n)).alias("count"), (-F.array_position(sizes, n)).alias("first"), n.alias("n")))
    return F.array_max(ranked)["n"]


def has_header(rows: Column) -> Column:
    """Whether the first row looks like a heading: its cells are short, at most 20 characters and under 0.6 of the others in the mean."""
    mean = lambda cells: F.aggregate(cells, F.lit(0.0), lambda s, c: s + F.length(F.coalesce(c, F.lit("")))) / F.size(cells)
    head, rest = F.get(rows, 0), F.flatten(F.slice(rows, 2, F.greatest(F.size(rows), F.lit(1))))
    return F.coalesce((F.size(rows) > 1) & (F.size(head) > 0) & (F.size(rest) > 0) & (mean(head) <= 20) & (mean(head) < 0.6 * mean(rest)), F.lit(False))


def _strip_tail(text: str | None, least: int = 3) -> str | None:
    if not text:
        return text
    lines = text.rstrip().split("\n")
    n = len(lines)
    while n > 1 and lines[n - 1] == lines[-1]:
        n -= 1
    if len(lines) - n >= least:
        lines = lines[: n + 1]
    out = "\n".join(lines)
    head, tail = out[:-600] if len(out) > 600 else "", out[-600:]
    for size in range(6, 1, -1):
        m = re.search(rf"((?:\S+\s+){{{size - 1}}}\S+)(?:\s+\1){{{least - 1},}}\s*$", tail)
        if m:
            tail = tail[: m.start()] + m[1]
            break
    return head + tail


def without_repeated_tail(text: Column, least: int = 3) -> Column:
    """The text with a last line, or a last run of two to six words, that comes least times on end kept once. Null stays null."""

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([_strip_tail(t, least) for t in texts], dtype=object)

    return F.pandas_udf(run, "string")(text)


def wav_base64(pcm: Column, rate: int = 16000, channels: int = 1) -> Column:
    """16-bit samples with the 44 bytes of a wave header before them, in base 64."""
    little = lambda n, size: F.unhex(F.array_join(F.reverse(F.regexp_extract_all(F.lpad(F.hex(n), size * 2, "0"), F.lit("(..)"), F.lit(1))), ""))
    n = F.coalesce(F.octet_length(pcm), F.lit(0)).cast("long")
    head = F.concat(
        F.encode(F.lit("RIFF"), "UTF-8"), little(n + 36, 4), F.encode(F.lit("WAVEfmt "), "UTF-8"), little(F.lit(16), 4), little(F.lit(1), 2), little(F.lit(channels), 2), little(F.lit(rate), 4),
        little(F.lit(rate * channels * 2), 4), little(F.lit(channels * 2), 2), little(F.lit(16), 2), F.encode(F.lit("data"), "UTF-8"), little(n, 4),
    )
    return F.base64(F.concat(head, F.coalesce(pcm, F.lit(b""))))


def box_downsampled(samples: Column, rate_in: int, rate_out: int) -> Column:
    """Means over windows whose bounds are rounded; the rate may only fall."""
    if rate_out > rate_in:
        raise ValueError("the rate may only fall")
    ratio = rate_in / rate_out
    n = F.round(F.size(samples) / ratio).cast("int")
    at = lambda i: F.round(i * ratio).cast("int")
    mean = lambda part: F.aggregate(part.cast("array<double>"), F.lit(0.0), lambda s, x: s + x) / F.size(part)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: mean(F.slice(samples, at(i) + 1, F.greatest(F.least(at(i + 1), F.size(samples)) - at(i), F.lit(1)))))).otherwise(F.array().cast("array<double>"))
