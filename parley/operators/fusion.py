"""Rank fusion, re-ranking and budgeted context of retrieved records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.functions.text import keyword_tokens, normalized, penalized, section_label, size_estimate
from parley.operators.ordered import made_once

# Fixed values of fusion and of the context.
RRF_K = 60
TOKEN_BUDGET, MAX_CHUNKS, MAX_PER_DOC = 2800, 6, 6
NEAR_DUPLICATE = 0.82


def reciprocal_rank_fusion(lists: dict[str, DataFrame], key: str, query_key: str = "query_id", k: int = RRF_K) -> DataFrame:
    """(query_key, key, score, <name>_rank...): sum of 1 / (k + rank) over the ranked lists, which have columns query_key, key and rank. One shuffle, no join."""
    names = list(lists)
    union = None
    for name in names:
        part = lists[name].select(query_key, key, "rank", F.lit(name).alias("__list"))
        union = part if union is None else union.unionByName(part)
    ranks = [F.min(F.when(F.col("__list") == n, F.col("rank"))).alias(f"{n}_rank") for n in names]
    return union.groupBy(query_key, key).agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"), *ranks)


def fused_order(fused: DataFrame, names: list[str], key: str, limit: int, query_key: str = "query_id", score: Column | None = None, digits: int = 6) -> DataFrame:
    """The limit best by adjusted score; ties keep the order of the lists, then that of keys."""
    value = score if score is not None else F.col("score")
    order = [F.round(value, digits).desc(), *[F.col(f"{n}_rank").asc_nulls_last() for n in names], F.col(key)]
    return fused.withColumn("score", F.round(value, digits)).withColumn("final_rank", F.row_number().over(Window.partitionBy(query_key).orderBy(*order))).where(F.col("final_rank") <= limit)


def with_reference_penalty(fused: DataFrame, is_reference: Column) -> DataFrame:
    return fused.withColumn("score", penalized(F.col("score"), is_reference))


def coverage_score(query: Column, text: Column) -> Column:
    """Share of the query's distinct tokens that the text holds: the offline stand-in for a cross-encoder."""
    q = F.array_distinct(keyword_tokens(query))
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, keyword_tokens(text))) / F.size(q)).otherwise(0.0)


def effective_score(*scores: Column) -> Column:
    """The first score that is neither null nor zero."""
    return F.coalesce(*[F.nullif(s, F.lit(0.0)) for s in scores], F.lit(0.0))


def _words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)\w+"), F.lit(0)))


def budgeted_context(ranked: DataFrame, query_key: str = "query_id", budget: int = TOKEN_BUDGET, most: int = MAX_CHUNKS, per_doc: int = MAX_PER_DOC, ordering: str = "ranked") -> DataFrame:
    """(query_key, position, chunk_id, context_tokens, score): the chunks that fit the context of each query, picked in order.

    ranked has query_key, chunk_id, doc_id, source_filename, section_path, page_start, page_end, text and score, at most a candidate pool for each query. A chunk is passed over where its
    signature was seen or its words overlap by more than NEAR_DUPLICATE with a kept chunk of the same document at most a page away; where its document has per_doc
    chunks; and where it does not fit, unless it is the first, which is then cut to the budget. The pool of one query is small, so the fold runs over an array.
    """
    score = F.coalesce("score", F.lit(0.0))
    doc = F.coalesce(F.nullif(F.col("doc_id"), F.lit("")), F.col("source_filename"), F.lit(""))
    order = (
        F.struct((-score).alias("o1"), F.coalesce("source_filename", F.lit("")).alias("o2"), F.coalesce("page_start", F.lit(0)).cast("double").alias("o3"))
        if ordering == "ranked"
        else F.struct(F.lit(0.0).alias("o1"), F.coalesce("source_filename", F.lit("")).alias("o2"), (F.coalesce("page_start", F.lit(0)) - score / 1e6).alias("o3"))
    )
    head = F.format_string(
        "[Chunk %d | prose score=%.3f] file=%s pages=%s-%s section=%s\n", F.lit(1), score.cast("double"), F.coalesce("source_filename", "doc_id", F.lit("")), F.coalesce(F.col("page_start").cast("string"), F.lit("None")), F.coalesce(F.col("page_end").cast("string"), F.lit("None")), section_label(F.col("section_path"))
    )
    tokens = size_estimate(F.concat(head, normalized(F.col("text"))))
    item = F.struct(
        order.alias("o"), F.col("chunk_id"), doc.alias("doc"), F.coalesce("page_start", F.lit(0)).alias("page"), score.alias("score"), tokens.alias("tokens"), _words(F.col("text")).alias("words"), F.substring(F.trim(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), r"(?U)\W+", " ")), 1, 400).alias("sig")
    )
    pool = ranked.groupBy(query_key).agg(F.array_sort(F.collect_list(item)).alias("pool"))
    kept_type = "array<struct<chunk_id:string,doc:string,page:int,score:double,tokens:int,words:array<string>,sig:string>>"

    def unlike(kept: Column, c: Column) -> Column:
        near = lambda x: (x["sig"] == c["sig"]) | (x["chunk_id"] == c["chunk_id"]) | (
            (x["doc"] == c["doc"]) & (F.abs(x["page"] - c["page"]) <= 1) & (F.size(F.array_intersect(x["words"], c["words"])) > NEAR_DUPLICATE * (F.size(x["words"]) + F.size(c["words"]) - F.size(F.array_intersect(x["words"], c["words"]))))
        )
        return ~F.exists(kept, near)

    short = lambda c: F.struct(c["chunk_id"].alias("chunk_id"), c["doc"].alias("doc"), c["page"].cast("int").alias("page"), c["score"].cast("double").alias("score"), c["tokens"].cast("int").alias("tokens"), c["words"].alias("words"), c["sig"].alias("sig"))
    unique = F.aggregate("pool", F.array().cast(kept_type), lambda acc, c: F.when(unlike(acc, c), F.concat(acc, F.array(short(c)))).otherwise(acc))
    used = lambda acc: F.aggregate(acc, F.lit(0), lambda s, x: s + x["tokens"])

    def pick(acc: Column, c: Column) -> Column:
        same_doc = F.size(F.filter(acc, lambda x: x["doc"] == c["doc"]))
        fits = (F.size(acc) == 0) | (used(acc) + c["tokens"] <= budget)
        capped = c.withField("tokens", F.when(F.size(acc) == 0, F.least(c["tokens"], F.lit(budget))).otherwise(c["tokens"]))
        return F.when((F.size(acc) < most) & (same_doc < per_doc) & fits, F.concat(acc, F.array(capped))).otherwise(acc)

    chosen = F.aggregate("unique", F.array().cast(kept_type), pick)
    return made_once(made_once(pool, unique=unique), chosen=chosen).select(query_key, F.posexplode("chosen").alias("position", "c")).select(query_key, (F.col("position") + 1).alias("position"), "c.chunk_id", F.col("c.tokens").alias("context_tokens"), "c.score")
