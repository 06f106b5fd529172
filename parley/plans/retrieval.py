"""Queries of keyword and vector retrieval over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parley.functions.text import KEYWORD_TOKEN, reference_like
from parley.functions.vector import cosine, distance_score
from parley.operators import fusion, lexical, nearest
from parley.operators.ordered import blocked_lag
from parley.session import cut, table


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set: the question of every state whose id is divisible by 50."""
    return table(spark, sf_dir, "live_assist_state").where("state_id % 50 = 0").select(F.col("state_id").alias("query_id"), F.col("question").alias("query"))


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "bm25_docs")


def bm25_corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = lexical.tokenized(_chunks(spark, sf_dir), "chunk_id", "text")
    terms = lexical.postings(tokens, "chunk_id").agg(F.count_distinct("term").alias("n_terms"), F.sum("tf").alias("n_tokens"))
    return lexical.corpus_statistics(tokens).crossJoin(terms).select("n_docs", F.round("avg_len", 6).alias("avg_len"), "n_terms", "n_tokens")


def bm25_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _chunks(spark, sf_dir)
    n = docs.count()
    df = lexical.document_frequency(lexical.postings(lexical.tokenized(docs, "chunk_id", "text"), "chunk_id"))
    return df.select("term", "df", F.round(lexical.idf(F.lit(n), F.col("df")), 6).alias("idf"))


def _chunk_index(spark: SparkSession, sf_dir: str) -> lexical.Index:
    return lexical.index(_chunks(spark, sf_dir), "chunk_id", "text")


def bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.bm25_best(_chunk_index(spark, sf_dir), _questions(spark, sf_dir), 10, key="chunk_id").select("query_id", "chunk_id", "score", "rank")


def bm25_search_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As bm25_search, over pages 2 to 10 of chunks with an owner; statistics stay those of all chunks."""
    allowed = _chunks(spark, sf_dir).where("page_end >= 2 and page_start <= 10 and coalesce(user_id, '') <> ''")
    return lexical.bm25_best(_chunk_index(spark, sf_dir), _questions(spark, sf_dir), 10, key="chunk_id", among=allowed).select("query_id", "chunk_id", "score", "rank")


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    v = table(spark, sf_dir, "embeddings")
    return v, v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding", "label")


def knn_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, q = _vectors(spark, sf_dir)
    return nearest.nearest(v, q, 10).select("query_id", "vec_id", "similarity", "rank")


def knn_prefiltered_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, q = _vectors(spark, sf_dir)
    return nearest.nearest(v, q, 5, same="label").select("query_id", "vec_id", "similarity", "rank")


def distance_to_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, q = _vectors(spark, sf_dir)
    return nearest.nearest(v, q, 3).select("query_id", "vec_id", F.round(distance_score(1 - F.col("similarity")), 5).alias("score"))


def redundancy_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every vector whose id is divisible by 50: the most similar other one, and whether they are near duplicates."""
    v, q = _vectors(spark, sf_dir)
    other = nearest.nearest(v, q, 2).where("query_id <> vec_id")
    best = other.groupBy("query_id").agg(F.min_by(F.struct("vec_id", "similarity"), "rank").alias("b"))
    return best.select("query_id", F.col("b.vec_id").alias("most_similar"), F.col("b.similarity").alias("redundancy_max"), (F.col("b.similarity") > 0.85).alias("near_duplicate"))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", "source")


def _document_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.col("text").alias("query"))


def _ranked_lists(spark: SparkSession, sf_dir: str, pool: int = 20) -> dict[str, DataFrame]:
    """Vector and keyword rankings of the documents whose vector has the same id, for every id divisible by 50."""
    v, q = _vectors(spark, sf_dir)
    semantic = nearest.nearest(v, q, pool).select("query_id", F.col("vec_id").alias("doc_id"), F.col("similarity").alias("score"), "rank")
    return {"semantic": semantic, "keyword": lexical.bm25_best(lexical.index(_documents(spark, sf_dir), "doc_id", "text"), _document_questions(spark, sf_dir), pool)}


def rrf_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    fused = fusion.reciprocal_rank_fusion(_ranked_lists(spark, sf_dir), "doc_id")
    return fused.select("query_id", "doc_id", F.round("score", 6).alias("score"), "semantic_rank", "keyword_rank")


def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword and vector rankings fused, records like reference lists put down, the ten best."""
    fused = fusion.reciprocal_rank_fusion(_ranked_lists(spark, sf_dir), "doc_id")
    docs = _documents(spark, sf_dir).select("doc_id", reference_like(F.lit(""), F.col("text")).alias("is_reference"))
    marked = fused.join(docs, "doc_id", "left").withColumn("is_reference", F.coalesce("is_reference", F.lit(False)))
    ordered = fusion.fused_order(fusion.with_reference_penalty(marked, F.col("is_reference")), ["semantic", "keyword"], "doc_id", 10)
    return ordered.select("query_id", "doc_id", "score", "is_reference", "final_rank")


def legacy_alpha_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """0.7 x vector similarity + 0.3 x keyword score over the best of the 20 vector candidates of each query, the five best."""
    v, q = _vectors(spark, sf_dir)
    near = cut(nearest.nearest(v, q, 20).select("query_id", F.col("vec_id").alias("doc_id"), "similarity"))
    made = lexical.index(_documents(spark, sf_dir), "doc_id", "text")
    scores = lexical.bm25_of_pairs(made, _document_questions(spark, sf_dir), near).withColumnRenamed("score", "keyword")
    both = near.join(scores, ["query_id", "doc_id"], "left").withColumn("keyword", F.coalesce("keyword", F.lit(0.0)))
    best = F.max("keyword").over(Window.partitionBy("query_id"))
    blended = both.withColumn("score", F.round(0.7 * F.col("similarity") + 0.3 * F.when(best > 0, F.col("keyword") / best).otherwise(0.0), 5))
    return lexical.top_k(blended, 5, digits=5).select("query_id", "doc_id", "score", "rank")


def rerank_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 keyword candidates of each question re-scored by the share of its tokens that they hold, the five best; ties keep their order."""
    questions = _questions(spark, sf_dir)
    docs = _chunks(spark, sf_dir)
    candidates = lexical.bm25_best(_chunk_index(spark, sf_dir), questions, 20, key="chunk_id")
    scored = candidates.join(questions, "query_id").join(docs.select("chunk_id", "text"), "chunk_id").withColumn("rerank_score", F.round(fusion.coverage_score(F.col("query"), F.col("text")), 6))
    w = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "rank")
    return scored.withColumn("rerank_rank", F.row_number().over(w)).where("rerank_rank <= 5").select("query_id", "chunk_id", "rerank_score", "rerank_rank")


def context_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context of each question: the keyword candidates, near duplicates left out, as far as they fit the budget."""
    docs = _chunks(spark, sf_dir)
    candidates = lexical.bm25_best(_chunk_index(spark, sf_dir), _questions(spark, sf_dir), 20, key="chunk_id").select("query_id", "chunk_id", "score")
    return fusion.budgeted_context(candidates.join(docs, "chunk_id"))


def reference_like_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", reference_like(F.lit(""), F.col("text")).alias("is_reference"))


def adjacent_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity of each vector to the next of its label, by id."""
    v = table(spark, sf_dir, "embeddings").select("label", "vec_id", "embedding", F.floor(F.col("vec_id") / 4096).alias("stretch"))
    seen = blocked_lag(v, ["label"], "stretch", ["vec_id"], F.col("embedding"), "next", ahead=True).where("next is not null")
    return seen.select("label", "vec_id", F.round(cosine(F.col("embedding"), F.col("next")), 5).alias("similarity"))


def _tokens(text: str) -> str:
    return f"list_transform(regexp_extract_all(coalesce({text}, ''), '{KEYWORD_TOKEN}'), lambda t: lower(t))"


def _bm25_sql(docs: str, key: str, queries: str, where: str = "") -> str:
    """Scores of all query and record pairs as a common table expression named scored."""
    return f"""
        d AS (SELECT {key} AS k, {_tokens('text')} AS ts FROM {docs}),
        st AS (SELECT count(*) AS n, avg(len(ts)) AS avg_len FROM d),
        po AS (SELECT k, len(ts) AS dl, t, count(*) AS tf FROM (SELECT k, ts, unnest(ts) AS t FROM d) GROUP BY ALL),
        fr AS (SELECT t, count(*) AS df FROM (SELECT k, t FROM po) GROUP BY t),
        q AS (SELECT query_id, t, count(*) AS times FROM (SELECT query_id, unnest({_tokens('query')}) AS t FROM ({queries})) GROUP BY ALL),
        scored AS (SELECT query_id, k, sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg_len))) AS score
                   FROM q JOIN po USING (t) JOIN fr USING (t) CROSS JOIN st {where} GROUP BY ALL)
    """


_Q = "SELECT state_id AS query_id, question AS query FROM live_assist_state WHERE state_id % 50 = 0"
_DQ = "SELECT doc_id AS query_id, text AS query FROM documents WHERE doc_id % 50 = 0"
_SIM = "round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6)"


def _knn_sql(k: int, where: str = "") -> str:
    return f"""
        nn AS (SELECT * FROM (SELECT a.vec_id AS query_id, b.vec_id, {_SIM} AS similarity,
               row_number() OVER (PARTITION BY a.vec_id ORDER BY {_SIM} DESC, b.vec_id) AS rank
               FROM embeddings a JOIN embeddings b ON true {where} WHERE a.vec_id % 50 = 0) WHERE rank <= {k})
    """


_NORMAL = r"regexp_replace(regexp_replace(regexp_replace(replace(coalesce(text, ''), chr(160), ' '), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"
_TOP = "row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, k)"
_REFERENCE = r"""
    ((CASE WHEN len(list_filter(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}_]+'), lambda w: regexp_full_match(w, '(?:19|20)\d{2}'))) >= 4 THEN 1 ELSE 0 END)
     + (CASE WHEN regexp_matches(coalesce(text, ''), '(?i)\bdoi:\s*10\.\S+') THEN 1 ELSE 0 END)
     + (CASE WHEN len(regexp_extract_all(coalesce(text, ''), '\b[A-Z][a-z]+(?:,\s*[A-Z]\.)+\s*\(\d{4}\)')) >= 2 THEN 1 ELSE 0 END)
     + (CASE WHEN len(list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+'), lambda w: w IN ('neurology', 'radiology', 'neuroimage', 'brain', 'frontiers', 'ann', 'vol', 'pp')))
               + len(regexp_extract_all(lower(coalesce(text, '')), '\b(?:plos one\b|j\.[\p{L}\p{N}_])')) >= 3 THEN 1 ELSE 0 END)
     + (CASE WHEN len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda s: len(list_filter(regexp_extract_all(s, '[\p{L}\p{N}_]+'), lambda w: regexp_full_match(w, '(?:19|20)\d{2}'))) > 0 AND (contains(s, ',') OR regexp_matches(s, '(?i)\bdoi:\s*10\.\S+')))) >= 3 THEN 1 ELSE 0 END)) >= 2
"""
_LISTS = f"""{_knn_sql(20)}, {_bm25_sql('documents', 'doc_id', _DQ)},
    kw AS (SELECT query_id, k AS doc_id, rank FROM (SELECT query_id, k, {_TOP} AS rank FROM scored) WHERE rank <= 20)"""
_FUSED = f"""{_LISTS},
    fused AS (SELECT query_id, doc_id, sum(1.0 / (60 + rank)) AS score, min(CASE WHEN l = 's' THEN rank END) AS semantic_rank, min(CASE WHEN l = 'k' THEN rank END) AS keyword_rank
              FROM (SELECT query_id, vec_id AS doc_id, rank, 's' AS l FROM nn UNION ALL SELECT query_id, doc_id, rank, 'k' AS l FROM kw) GROUP BY ALL)"""

QUERIES = {
    f.__name__: f
    for f in (
        bm25_corpus_stats, bm25_idf, bm25_search, bm25_search_filtered, knn_cosine, knn_prefiltered_label, distance_to_similarity, redundancy_metrics, rrf_fuse, hybrid_search, legacy_alpha_blend,
        rerank_overlap, context_budget, reference_like_docs, adjacent_similarity,
    )
}

SQL = {
    "bm25_corpus_stats": f"""
        WITH d AS (SELECT {_tokens('text')} AS ts FROM bm25_docs)
        SELECT count(*) AS n_docs, round(avg(len(ts)), 6) AS avg_len, (SELECT count(DISTINCT t) FROM (SELECT unnest(ts) AS t FROM d)) AS n_terms, sum(len(ts))::BIGINT AS n_tokens FROM d""",
    "bm25_idf": f"""
        WITH d AS (SELECT chunk_id, {_tokens('text')} AS ts FROM bm25_docs), n AS (SELECT count(*) AS n FROM d),
        f AS (SELECT t AS term, count(*) AS df FROM (SELECT DISTINCT chunk_id, unnest(ts) AS t FROM d) GROUP BY t)
        SELECT term, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM f CROSS JOIN n""",
    "bm25_search": f"WITH {_bm25_sql('bm25_docs', 'chunk_id', _Q)} SELECT query_id, k AS chunk_id, round(score, 6) AS score, rank::INT AS rank FROM (SELECT *, {_TOP} AS rank FROM scored) WHERE rank <= 10",
    "bm25_search_filtered": f"""WITH {_bm25_sql('bm25_docs', 'chunk_id', _Q)},
        ok AS (SELECT chunk_id FROM bm25_docs WHERE page_end >= 2 AND page_start <= 10 AND coalesce(user_id, '') <> '')
        SELECT query_id, k AS chunk_id, round(score, 6) AS score, rank::INT AS rank FROM (SELECT *, {_TOP} AS rank FROM scored WHERE k IN (SELECT chunk_id FROM ok)) WHERE rank <= 10""",
    "knn_cosine": f"WITH {_knn_sql(10)} SELECT query_id, vec_id, similarity, rank::INT AS rank FROM nn",
    "knn_prefiltered_label": f"WITH {_knn_sql(5, 'AND a.label = b.label')} SELECT query_id, vec_id, similarity, rank::INT AS rank FROM nn",
    "distance_to_similarity": f"WITH {_knn_sql(3)} SELECT query_id, vec_id, round(1 / (1 + (1 - similarity)), 5) AS score FROM nn",
    "redundancy_metrics": f"""WITH {_knn_sql(2)}, b AS (SELECT query_id, arg_min(vec_id, rank) AS most_similar, arg_min(similarity, rank) AS s FROM nn WHERE query_id <> vec_id GROUP BY query_id)
        SELECT query_id, most_similar, s AS redundancy_max, s > 0.85 AS near_duplicate FROM b""",
    "rrf_fuse": f"WITH {_FUSED} SELECT query_id, doc_id, round(score, 6) AS score, semantic_rank::INT AS semantic_rank, keyword_rank::INT AS keyword_rank FROM fused",
    "hybrid_search": f"""WITH {_FUSED}, r AS (SELECT doc_id, {_REFERENCE} AS is_reference FROM documents),
        p AS (SELECT f.*, coalesce(is_reference, false) AS is_reference, round(CASE WHEN is_reference THEN score * 0.45 ELSE score END, 6) AS adjusted FROM fused f LEFT JOIN r USING (doc_id))
        SELECT query_id, doc_id, adjusted AS score, is_reference, final_rank::INT AS final_rank
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY adjusted DESC, semantic_rank ASC NULLS LAST, keyword_rank ASC NULLS LAST, doc_id) AS final_rank FROM p) WHERE final_rank <= 10""",
    "legacy_alpha_blend": f"""WITH {_LISTS},
        j AS (SELECT nn.query_id, nn.vec_id AS k, similarity, coalesce(score, 0) AS keyword FROM nn LEFT JOIN scored ON nn.query_id = scored.query_id AND nn.vec_id = scored.k),
        b AS (SELECT query_id, k, round(0.7 * similarity + 0.3 * CASE WHEN max(keyword) OVER (PARTITION BY query_id) > 0 THEN keyword / max(keyword) OVER (PARTITION BY query_id) ELSE 0 END, 5) AS score FROM j)
        SELECT query_id, k AS doc_id, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, k) AS rank FROM b) WHERE rank <= 5""",
    "rerank_overlap": f"""WITH {_bm25_sql('bm25_docs', 'chunk_id', _Q)},
        c AS (SELECT * FROM (SELECT query_id, k, {_TOP} AS rank FROM scored) WHERE rank <= 20),
        q2 AS (SELECT query_id, list_distinct({_tokens('query')}) AS qs FROM ({_Q})),
        s AS (SELECT query_id, k, rank, round(len(list_intersect(qs, ts)) / len(qs), 6) AS rerank_score FROM c JOIN q2 USING (query_id) JOIN d USING (k))
        SELECT query_id, k AS chunk_id, rerank_score, rerank_rank::INT AS rerank_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rank) AS rerank_rank FROM s) WHERE rerank_rank <= 5""",
    "reference_like_docs": f"SELECT doc_id, {_REFERENCE} AS is_reference FROM documents",
    "adjacent_similarity": """
        WITH n AS (SELECT label, vec_id, embedding, lead(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS nx FROM embeddings)
        SELECT label, vec_id, round(list_cosine_similarity(embedding::DOUBLE[], nx::DOUBLE[]), 5) AS similarity FROM n WHERE nx IS NOT NULL""",
    "context_budget": rf"""WITH RECURSIVE {_bm25_sql('bm25_docs', 'chunk_id', _Q)},
        c AS (SELECT * FROM (SELECT query_id, k, round(score, 6) AS score, {_TOP} AS rank FROM scored) WHERE rank <= 20),
        x AS (SELECT c.query_id, c.score, b.*, coalesce(nullif(doc_id, ''), source_filename, '') AS doc, coalesce(page_start, 0) AS page,
                     '[Chunk 1 | prose score=0.000] file=' || coalesce(source_filename, doc_id, '') || ' pages=' || coalesce(page_start::VARCHAR, 'None') || '-' || coalesce(page_end::VARCHAR, 'None') || ' section='
                     || coalesce(nullif(array_to_string(list_filter(section_path, lambda p: p IS NOT NULL AND p <> ''), ' > '), ''), 'Unknown') || chr(10) || {_NORMAL} AS block,
                     list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}\p{{M}}_]+')) AS ws, left(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}\p{{M}}_]+', ' ', 'g')), 400) AS sig
              FROM c JOIN bm25_docs b ON b.chunk_id = c.k),
        i AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY -score, coalesce(source_filename, ''), page, chunk_id) AS r, len(regexp_extract_all(block, '[\p{{L}}\p{{N}}\p{{M}}_]+|[^\s\p{{L}}\p{{N}}\p{{M}}_]')) AS tokens FROM x),
        e AS (SELECT b.query_id, b.r, list(a.r) AS near FROM i a JOIN i b ON a.query_id = b.query_id AND a.r < b.r AND (a.sig = b.sig OR (a.doc = b.doc AND abs(a.page - b.page) <= 1 AND len(list_intersect(a.ws, b.ws)) > 0.82 * len(list_distinct(list_concat(a.ws, b.ws))))) GROUP BY 1, 2),
        j AS (SELECT i.query_id, i.r, coalesce(near, []) AS near FROM i LEFT JOIN e ON e.query_id = i.query_id AND e.r = i.r),
        u AS (SELECT query_id, r, [r] AS kept FROM j WHERE r = 1 UNION ALL SELECT j.query_id, j.r, CASE WHEN len(list_intersect(kept, near)) = 0 THEN list_append(kept, j.r) ELSE kept END FROM u JOIN j ON j.query_id = u.query_id AND j.r = u.r + 1),
        o AS (SELECT query_id, unnest(kept) AS r, generate_subscripts(kept, 1) AS pos FROM (SELECT query_id, arg_max(kept, r) AS kept FROM u GROUP BY 1)),
        t AS (SELECT o.query_id, pos, chunk_id, tokens, score FROM o JOIN i ON i.query_id = o.query_id AND i.r = o.r),
        p AS (SELECT query_id, pos, 1 AS n, true AS taken, least(tokens, 2800) AS own, least(tokens, 2800) AS used FROM t WHERE pos = 1 UNION ALL
              SELECT t.query_id, t.pos, CASE WHEN n < 6 AND used + tokens <= 2800 THEN n + 1 ELSE n END, n < 6 AND used + tokens <= 2800, tokens, CASE WHEN n < 6 AND used + tokens <= 2800 THEN used + tokens ELSE used END FROM p JOIN t ON t.query_id = p.query_id AND t.pos = p.pos + 1)
        SELECT p.query_id, n::INT AS position, chunk_id, own::INT AS context_tokens, score FROM p JOIN t ON t.query_id = p.query_id AND t.pos = p.pos WHERE taken""",
}
