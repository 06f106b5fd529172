"""Text functions as columns; all run on the JVM except text_similarity."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The keyword index's tokens.
KEYWORD_TOKEN = r"[A-Za-z]+(?:[-_/][A-Za-z0-9]+)*|\d{4}-\d{2}-\d{2}|\d+(?:\.\d+)?|[A-Z]{2,}\d+[A-Z0-9-]*"
#: Words or single other signs; Unicode letters count.
SIZE_TOKEN = r"(?U)\w+|[^\w\s]"
# Words that an echo of speech may add or lose.
ECHO_FILLERS = ("um", "uh", "er", "ah", "like", "okay", "ok")
# What reference sections look like.
REFERENCE_HEADING = r"(?i)\b(?:references?|bibliograph(?:y|ies)|works cited|citations?)\b"
AUTHOR_YEAR = r"\b[A-Z][a-z]+(?:,\s*[A-Z]\.)+\s*\(\d{4}\)"
YEAR = r"\b(?:19|20)\d{2}\b"
DOI = r"(?i)\bdoi:\s*10\.\S+"
JOURNAL = r"(?i)\b(?:neurology|radiology|neuroimage|brain|plos one|frontiers|ann\.?|j\.|vol\.?|pp\.?)\b"
REFERENCE_PENALTY = 0.45


def _text(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def keyword_tokens(text: Column) -> Column:
    """Tokens of the keyword index in lower case and order; null gives none."""
    return F.transform(F.regexp_extract_all(_text(text), F.lit(KEYWORD_TOKEN), F.lit(0)), F.lower)


def size_estimate(text: Column) -> Column:
    """Tokens of the text by the plain rule; null gives 0."""
    return F.regexp_count(_text(text), F.lit(SIZE_TOKEN))


def normalized(text: Column) -> Column:
    """Non-breaking blanks to blanks, runs of blanks to one, three or more line ends to two, outer white space off."""
    out = F.replace(_text(text), F.lit(" "), F.lit(" "))
    out = F.regexp_replace(out, r"[ \t]+", " ")
    return F.regexp_replace(F.regexp_replace(out, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def content_signature(text: Column) -> Column:
    """The first 400 characters of the words in lower case; equal for texts that differ in signs and case alone."""
    return F.substring(F.trim(F.regexp_replace(F.lower(_text(text)), r"(?U)\W+", " ")), 1, 400)


def excerpt(text: Column, most: int = 520) -> Column:
    """The text, or what stands before the last blank of its first characters, with dots."""
    whole = normalized(text)
    head = F.regexp_replace(F.substring(whole, 1, most), r"(?s) [^ ]*$", "")
    return F.when(F.length(whole) <= most, whole).otherwise(F.concat(F.regexp_replace(head, r"^\s+|\s+$", ""), F.lit("...")))


def section_label(path: Column) -> Column:
    return F.coalesce(F.nullif(F.array_join(F.filter(path, lambda p: p.isNotNull() & (p != "")), " > "), F.lit("")), F.lit("Unknown"))


def sentences(text: Column) -> Column:
    """Parts between sentence marks followed by white space, blanks collapsed, empty ones left out."""
    flat = F.trim(F.regexp_replace(_text(text), r"\s+", " "))
    return F.filter(F.split(flat, r"(?<=[.!?])\s+"), lambda s: s != "")


def refine_sentences(text: Column) -> Column:
    """Sentences line by line; headings and bullets stay whole."""
    whole = r"^(?:#|[-*•]\s|\d+[.)]\s)"
    lines = F.filter(F.transform(F.split(_text(text), "\n"), lambda s: F.trim(s)), lambda s: s != "")
    return F.filter(F.flatten(F.transform(lines, lambda s: F.when(s.rlike(whole), F.array(s)).otherwise(F.split(s, r"(?<=[.!?])\s+")))), lambda s: s != "")


def echo_words(text: Column) -> Column:
    """Lower-case ASCII words without fillers, joined by blanks."""
    words = F.split(F.regexp_replace(F.lower(_text(text)), r"[^a-z0-9\s]", " "), r"\s+")
    return F.array_join(F.filter(words, lambda w: (w != "") & ~w.isin(*ECHO_FILLERS)), " ")


def _ratios(left: pd.Series, right: pd.Series) -> pd.Series:
    from difflib import SequenceMatcher

    return pd.Series([SequenceMatcher(None, a, b).ratio() if a is not None and b is not None else None for a, b in zip(left, right)], dtype=float)


def text_similarity(left: Column, right: Column) -> Column:
    """Share of the longer text where one holds the other, else the matching ratio of their echo words; 0 where one has none. Python sees only pairs that neither rule decides."""
    a, b = echo_words(left), echo_words(right)
    undecided = (a != "") & (b != "") & ~F.contains(a, b) & ~F.contains(b, a)
    ratio = F.pandas_udf(_ratios, "double")(F.when(undecided, a), F.when(undecided, b))
    return F.when((a == "") | (b == ""), 0.0).when(~undecided, F.least(F.length(a), F.length(b)) / F.greatest(F.length(a), F.length(b))).otherwise(ratio)


def reference_like(section: Column, content: Column) -> Column:
    """Whether the heading names references, or at least two of five marks of citations show in heading and text."""
    head, body = _text(section), _text(content)
    both = F.concat_ws("\n", head, body)
    count = lambda p: F.regexp_count(both, F.lit(p))
    cited = F.size(F.filter(F.split(body, "\n"), lambda s: s.rlike(YEAR) & (s.rlike(DOI) | s.contains(","))))
    marks = [count(YEAR) >= 4, count(DOI) >= 1, count(AUTHOR_YEAR) >= 2, count(JOURNAL) >= 3, cited >= 3]
    return head.rlike(REFERENCE_HEADING) | (sum((F.when(m, 1).otherwise(0) for m in marks[1:]), F.when(marks[0], 1).otherwise(0)) >= 2)


def penalized(score: Column, is_reference: Column) -> Column:
    return F.when(is_reference, score * REFERENCE_PENALTY).otherwise(score)


def caption_anchor(text: Column) -> Column:
    """(kind, n) of a caption that begins with a keyword and a number; null for other texts."""
    shape = r"(?i)^\s*(figure|fig\.?|table|tab\.?|equation|eq\.?)\s*(\d+)[a-z]?(?![A-Za-z0-9])"
    word = F.lower(F.regexp_extract(_text(text), shape, 1))
    kind = F.when(word.startswith("fig"), "figure").when(word.startswith("tab"), "table").when(word.startswith("eq"), "equation")
    return F.when(kind.isNotNull(), F.struct(kind.alias("kind"), F.regexp_extract(_text(text), shape, 2).try_cast("int").alias("n")))


def compact(text: Column, most: int = 300) -> Column:
    flat = F.trim(F.regexp_replace(_text(text), r"\s+", " "))
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most), F.lit("..."))).otherwise(flat)


def safe_id(text: Column) -> Column:
    return F.substring(F.regexp_replace(_text(text), r"[^A-Za-z0-9_.-]+", "_"), 1, 120)


def slug(text: Column, most: int = 48) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(_text(text)), "[^a-z0-9]+", "_"), "^_+|_+$", ""), 1, most)


def stable_uuid(name: Column) -> Column:
    """The version 5 UUID of name in the URL namespace."""
    digest = F.substring(F.sha1(F.concat(F.unhex(F.lit("6ba7b8119dad11d180b400c04fd430c8")), F.encode(name, "UTF-8"))), 1, 32)
    variant = F.lower(F.hex(F.conv(F.substring(digest, 17, 2), 16, 10).cast("int").bitwiseAND(F.lit(0x3F)).bitwiseOR(F.lit(0x80))))
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 19, 2)), F.substring(digest, 21, 12))


def json_object(text: Column) -> Column:
    """What stands between the first and the last brace; empty where there is none."""
    return F.regexp_extract(_text(text), r"(?s)\{.*\}", 0)


def prefix_template(filename: Column, section: Column) -> Column:
    return F.when(F.coalesce(filename, F.lit("")) != "", F.concat(F.lit("This chunk is from "), filename, F.lit("'s section '"), section, F.lit("'."))).otherwise(F.concat(F.lit("From section '"), section, F.lit("'.")))


def head_and_tail(text: Column, most: int = 12000) -> Column:
    half = most // 2
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, half), F.lit("\n[...]\n"), F.right(text, F.lit(half)))).otherwise(text)
