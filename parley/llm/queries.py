"""Queries over the given tables for the ten problems of training data, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm import conversations, duplicates, languages, mixing, packing, pairs, personal, scanned, splitting, tokens, transcripts
from parley.session import cut, table

#: Domains of the project's sources.
DOMAINS = {"dialogue": ("call_transcript", "chat_log", "email_thread", "complaint_letter"), "reference": ("kb_article", "faq", "sop", "product_note", "rate_card")}
Query = Callable[[SparkSession, str], DataFrame]


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token sizes of all documents, counted once and written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    return cut(tokens.with_token_count(docs.select("doc_id", "source", "lang", "text")).select("doc_id", "source", "lang", "n_tokens"))


def _budget(spark: SparkSession, sf_dir: str, budget_id: int) -> tuple[int, int]:
    row = table(spark, sf_dir, "token_budgets").where(F.col("budget_id") == budget_id).first()
    return row["max_tokens"], row["overlap_tokens"]


def _personal(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, personal.SemiMarkov]:
    turns = table(spark, sf_dir, "transcript_turns")
    return turns, personal.fit_model(personal.gazetteer(table(spark, sf_dir, "known_names")), personal.common_words(turns))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.found(*_personal(spark, sf_dir))


def p1_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.redacted(*_personal(spark, sf_dir))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "transcript_turns")
    return transcripts.found(turns, transcripts.fit_models(turns))


def p2_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "transcript_turns")
    segments = transcripts.segments_in_order(turns, transcripts.fit_models(turns))
    return transcripts.clean_turns(segments, transcripts.fit_boundaries(segments))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.found(table(spark, sf_dir, "bm25_docs"))


def p3_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.versions(table(spark, sf_dir, "bm25_docs"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "transcript_turns")
    return languages.found(turns, languages.fit_model(turns))


def p4_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "transcript_turns")
    found = languages.with_languages(turns, languages.fit_model(turns))
    return found.select("id", "field", F.posexplode("segments").alias("segment_no", "s")).select("id", "field", "segment_no", "s.lang", "s.confidence", "s.sentences")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "transcript_turns")
    return conversations.found(turns, transcripts.fit_models(turns))


def p5_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "transcript_turns")
    return conversations.conversations(turns, transcripts.fit_models(turns))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.found(table(spark, sf_dir, "live_assist_state"))


def p6_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = pairs.with_defects(table(spark, sf_dir, "live_assist_state"))
    return marked.select("state_id", F.posexplode("defects").alias("rule_no", "defect"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned.found(scanned.repair(table(spark, sf_dir, "chunks"), cut))


def p7_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned.repaired_text(scanned.repair(table(spark, sf_dir, "chunks"), cut))


def p8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_sizes(spark, sf_dir), table(spark, sf_dir, "token_budgets").where("purpose = 'container'"), targets=table(spark, sf_dir, "mix_targets"))


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.containers(p8_packing(spark, sf_dir), table(spark, sf_dir, "token_budgets").where("purpose = 'container'"))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = table(spark, sf_dir, "token_budgets").where("purpose = 'mix_total'").first()["max_tokens"]
    return mixing.mix(_sizes(spark, sf_dir), table(spark, sf_dir, "mix_targets"), total, DOMAINS)


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(p9_mix(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    limit, overlap = _budget(spark, sf_dir, 3)
    return splitting.found(table(spark, sf_dir, "documents"), limit, overlap)


def p10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every piece budget, in tokens of the public tokenizer."""
    budgets = table(spark, sf_dir, "token_budgets").where("purpose = 'piece'").orderBy("budget_id").collect()
    return splitting.split_oversized(table(spark, sf_dir, "documents"), [(b["budget_id"], b["max_tokens"], b["overlap_tokens"]) for b in budgets], tokenizer=tokens.default_path())


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        p1_found, p1_redacted, p2_found, p2_turns, p3_found, p3_versions, p4_found, p4_segments, p5_found, p5_conversations, p6_found, p6_defects, p7_found, p7_text,
        p8_packing, p8_containers, p9_mix, p9_shares, p10_found, p10_pieces,
    )
}

SQL: dict[str, str] = {
    "p3_found": r"""
        WITH w AS (SELECT chunk_id, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS ws FROM bm25_docs WHERE text IS NOT NULL),
        p AS (SELECT a.chunk_id AS x, b.chunk_id AS y, len(list_intersect(a.ws, b.ws)) AS k, len(a.ws) AS m, len(b.ws) AS n
              FROM w a JOIN w b ON a.chunk_id < b.chunk_id AND len(a.ws) * 100 > 82 * len(b.ws) AND len(b.ws) * 100 > 82 * len(a.ws))
        SELECT x AS chunk_id_a, y AS chunk_id_b FROM p WHERE k * 100 > 82 * (m + n - k)
    """,
    "p10_found": r"""
        SELECT DISTINCT doc_id FROM documents
        WHERE len(regexp_extract_all(text, '[\p{L}\p{M}\p{Nd}_]+|[^\s\p{Z}\p{L}\p{M}\p{Nd}_]')) > (SELECT max_tokens FROM token_budgets WHERE budget_id = 3)
    """,
}
