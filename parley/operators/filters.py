"""Predicates of retrieval and of the stream."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_UUID = r"^[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$"


def document_filter(value: str | None) -> dict[str, str]:
    """A document named by id, by file or by file stem, as a filter; nothing for blank names."""
    import re

    name = (value or "").strip()
    if not name:
        return {}
    if re.match(_UUID, name):
        return {"doc_id": name}
    return {"source_filename": name if name.lower().endswith(".pdf") else f"{name}.pdf"}


def retrieval_predicate(filters: dict[str, object]) -> Column:
    """All given conditions: doc_id, source_filename, user_id, chunking_strategy equal, page_start and page_end overlapping. Empty values are no conditions; rows of a null column do not pass one."""
    out = F.lit(True)
    for name in ("doc_id", "source_filename", "user_id", "chunking_strategy"):
        if filters.get(name) not in (None, ""):
            out = out & F.coalesce(F.col(name) == filters[name], F.lit(False))
    if filters.get("page_start") is not None:
        out = out & F.coalesce(F.col("page_end") >= filters["page_start"], F.lit(False))
    if filters.get("page_end") is not None:
        out = out & F.coalesce(F.col("page_start") <= filters["page_end"], F.lit(False))
    return out


def candidate_limit(query: Column) -> Column:
    """How many results a query of so many words is worth: 8 up to three, 10 up to eight, else 12."""
    n = F.size(F.filter(F.split(F.trim(F.coalesce(query, F.lit(""))), r"\s+"), lambda w: w != ""))
    return F.when(n <= 3, 8).when(n <= 8, 10).otherwise(12)


def sends_audio(level: Column, has_audio: Column, floor: Column | float) -> Column:
    """Whether a packet of a channel goes on to recognition."""
    return F.coalesce(has_audio & ((F.lit(floor) <= 0) | (level > floor)), F.lit(False))


def sends_worker_audio(both_run: Column, has_audio: Column, most: int = 3) -> Column:
    """Not while both sides have spoken for most packets on end."""
    return F.coalesce(has_audio & (both_run < most), F.lit(False))


def possible_bleed(left: Column, right: Column, threshold: float = 100.0) -> Column:
    return F.coalesce(left >= F.greatest(F.lit(2 * threshold), right * 2.5), F.lit(False))
