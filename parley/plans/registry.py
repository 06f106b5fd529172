"""All queries over the given tables for the operators of the core, with their SQL."""

from __future__ import annotations

from parley.plans import pages, records, retrieval, talk

QUERIES = retrieval.QUERIES | records.QUERIES | talk.QUERIES | pages.QUERIES
SQL: dict[str, str] = retrieval.SQL | records.SQL | talk.SQL | pages.SQL
