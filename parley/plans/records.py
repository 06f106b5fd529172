"""Queries of chunks, texts and stored records over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions import text as T
from parley.operators import chunking, storage
from parley.operators.ordered import blocked_running_sum, made_once
from parley.session import table

#: The moment at which ages are counted, so that results do not depend on the clock.
NOW = 1_750_000_000.0


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunk table with every chunk once; a re-sent row is equal to the first."""
    rows = table(spark, sf_dir, "chunks").select("chunk_id", "doc_id", "document_id", "user_id", "source_filename", "section_path", "ord", "text", "page_start", "page_end", "token_count", "chunk_type")
    return storage.last_by_key(rows, ["chunk_id"], F.struct("ord", "text"))


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of all chunks as layout blocks; those that begin with ## are headings."""
    parts = _chunks(spark, sf_dir).select("doc_id", "chunk_id", "ord", F.col("page_start").alias("page"), F.posexplode(F.split("text", "\n\n")).alias("p", "t"))
    return parts.where(F.trim("t") != "").select(
        "doc_id", F.concat_ws("#", "chunk_id", F.col("p").cast("string")).alias("block_id"), (F.col("ord").cast("long") * 4096 + F.col("p")).alias("ord"), "page",
        F.when(F.col("t").startswith("## "), "section_heading").otherwise("paragraph").alias("type"), F.regexp_replace("t", "^## ", "").alias("text"),
    )


#: Blocks are numbered by chunk and paragraph; the blocks of 512 chunks make a stretch.
_BLOCK_STRETCH = 512 * 4096


def section_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = chunking.section_chunks(chunking.sections(_blocks(spark, sf_dir), _BLOCK_STRETCH), _BLOCK_STRETCH)
    return made.select("doc_id", "section_no", "part_no", "page_start", "page_end", "block_count", F.md5("text").alias("text_md5"), F.coalesce(F.col("block_types")["section_heading"], F.lit(0)).alias("headings"))


def floor_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = chunking.merged_groups(chunking.floor_groups(_chunks(spark, sf_dir)))
    return merged.select("doc_id", "group_no", "chunk_id", "page_start", "page_end", "token_count", F.size("merged_from").alias("n_merged"), F.md5("text").alias("text_md5"))


def prev_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.linked(_chunks(spark, sf_dir)).select("chunk_id", "prev_id", "next_id")


def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.when(F.col("chunk_type") == "prose", 0).when(F.col("chunk_type") == "table", 1).otherwise(2)
    chunks = _chunks(spark, sf_dir).withColumn("rank", rank).withColumn("stretch", F.floor(F.col("page_start") / 16))
    placed = blocked_running_sum(chunks, ["doc_id"], "stretch", ["page_start", "rank", "ord", "chunk_id"], F.lit(1), "position")
    return placed.select("doc_id", "chunk_id", F.col("position").cast("int").alias("position"))


def token_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.size_distribution(_chunks(spark, sf_dir), "token_count")


def document_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks, tokens and pages of each document, with its entry in the registry."""
    per = _chunks(spark, sf_dir).groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum("token_count").alias("tokens"), F.min("page_start").alias("first_page"), F.max("page_end").alias("last_page"))
    registry = table(spark, sf_dir, "documents_registry").select(F.col("document_id").alias("doc_id"), "filename", F.lower(F.trim("status")).alias("status"))
    return per.join(registry, "doc_id", "left").select("doc_id", "filename", "status", "chunks", "tokens", "first_page", "last_page")


def unindexed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "chunks").select(F.col("doc_id").alias("document_id"))
    return table(spark, sf_dir, "documents_registry").join(chunks, "document_id", "left_anti").select("document_id", F.lower("status").alias("status"))


def type_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks by type, added up over the maps of all chunks."""
    maps = table(spark, sf_dir, "chunks").select("chunk_id", "block_types").groupBy("chunk_id").agg(F.any_value("block_types").alias("block_types"))
    return maps.select(F.explode("block_types").alias("type", "n")).groupBy("type").agg(F.sum("n").alias("n"))


def dedupe_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first chunk of each signature within its document. Copies are combined before the shuffle."""
    docs = table(spark, sf_dir, "bm25_docs").select(F.coalesce("doc_id", F.lit("")).alias("doc_id"), "chunk_id", F.md5(T.content_signature(F.col("text"))).alias("signature"))
    return docs.groupBy("doc_id", "signature").agg(F.min("chunk_id").alias("chunk_id"), F.count(F.lit(1)).alias("copies")).select("doc_id", "chunk_id", "copies")


def normalized_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "bm25_docs")
    return docs.select("chunk_id", F.md5(T.normalized(F.col("text"))).alias("normalized_md5"), F.md5(T.excerpt(F.col("text"))).alias("excerpt_md5"), T.section_label(F.col("section_path")).alias("section"))


def size_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.size_estimate(F.col("text")).alias("tokens"), F.size(T.keyword_tokens(F.col("text"))).alias("keyword_tokens"))


def sentence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.sentences(F.col("text"))).alias("sentences"), F.size(T.refine_sentences(F.col("text"))).alias("line_sentences"))


def name_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slug, safe id and stable id of every file name of the registry."""
    f = F.col("filename")
    return table(spark, sf_dir, "documents_registry").select("document_id", T.slug(f).alias("slug"), T.safe_id(f).alias("safe_id"), T.stable_uuid(F.col("document_id")).alias("stable_id"), T.compact(f, 12).alias("short"))


def contextual_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks joined with the text of their section: template prefix, the section cut to head and tail, and the chunk with its prefix."""
    chunks = _chunks(spark, sf_dir).withColumn("section", T.section_label(F.col("section_path")))
    joined = chunks.join(chunking.section_extracts(chunks), ["doc_id", "section"], "left")
    prefix = T.prefix_template(F.col("source_filename"), F.col("section"))
    return joined.select("chunk_id", prefix.alias("prefix"), F.md5(F.coalesce("extract", "text")).alias("section_md5"), F.md5(F.concat(prefix, F.lit("\n\n"), F.coalesce("text", F.lit("")))).alias("context_md5"))


def registry_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry after a later load in which every document with chunks is ready; its upload time is kept."""
    old = table(spark, sf_dir, "documents_registry").select("document_id", "filename", "status", "uploaded_at")
    new = table(spark, sf_dir, "chunks").groupBy(F.col("doc_id").alias("document_id")).agg(F.min("source_filename").alias("filename")).withColumns({"status": F.lit("ready"), "uploaded_at": F.lit(NOW)})
    return storage.upsert(old, new.select(*old.columns), ["document_id"], keep=("uploaded_at",))


def missing_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Call rows that the sessions of all turns lack."""
    turns = table(spark, sf_dir, "transcript_turns").groupBy("session_id").agg(F.min("ts").alias("created_at")).withColumnRenamed("session_id", "call_id")
    return storage.insert_or_ignore(table(spark, sf_dir, "calls"), turns, ["call_id"])


def unexpired_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return storage.unexpired(table(spark, sf_dir, "calls"), F.col("created_at"), F.lit(NOW), 90).select("call_id")


def after_deletion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword chunks without those of owners whose documents failed."""
    failed = table(spark, sf_dir, "documents_registry").where("lower(status) = 'failed'").select("user_id").where("user_id is not null")
    return storage.without_document(table(spark, sf_dir, "bm25_docs"), failed, "user_id").select("chunk_id")


def page_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of each owner that touch pages 3 to 5."""
    return table(spark, sf_dir, "bm25_docs").where("page_end >= 3 and page_start <= 5").groupBy(F.coalesce("user_id", F.lit("")).alias("user_id")).agg(F.count(F.lit(1)).alias("chunks"))


def _sentence_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of each chunk with their sizes and the similarity of each to the next, the cosine of their sets of tokens, as arrays; a chunk is small."""
    parts = _chunks(spark, sf_dir).select("chunk_id", "doc_id", "ord", T.sentences(F.col("text")).alias("sentences")).where(F.size("sentences") > 0)
    sets = made_once(parts, sizes=F.transform("sentences", T.size_estimate), sets=F.transform("sentences", lambda x: F.array_distinct(T.keyword_tokens(x))))
    here, after = lambda i: F.get("sets", i), lambda i: F.get("sets", i + 1)
    cosine = lambda i: F.when((F.size(here(i)) > 0) & (F.size(after(i)) > 0), F.size(F.array_intersect(here(i), after(i))) / F.sqrt((F.size(here(i)) * F.size(after(i))).cast("double"))).otherwise(0.0)
    pairs = F.when(F.size("sets") > 1, F.transform(F.sequence(F.lit(0), F.size("sets") - 2), lambda i: F.round(cosine(i), 6))).otherwise(F.array().cast("array<double>"))
    return made_once(sets.select("chunk_id", "doc_id", "ord", "sentences", "sizes", "sets"), sims=pairs).drop("sets")


def semantic_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of each chunk grouped by similarity and size: number of groups and their sizes after merging small ones."""
    folds = made_once(_sentence_folds(spark, sf_dir), groups=chunking.greedy_groups(F.col("sims"), F.col("sizes"), least=30, most=120))
    numbers = F.transform(F.sequence(F.lit(0), F.array_max("groups")), lambda g: F.aggregate(F.filter(F.arrays_zip("groups", "sizes"), lambda x: x["groups"] == g), F.lit(0), lambda s, x: s + x["sizes"]))
    return folds.select("chunk_id", F.size("sizes").alias("sentences"), (F.array_max("groups") + 1).alias("n_groups"), F.to_json(chunking.semantic_floor_merge(numbers, 30)).alias("sizes"))


def _refined(spark: SparkSession, sf_dir: str) -> DataFrame:
    folds = _sentence_folds(spark, sf_dir)
    large = F.aggregate("sizes", F.lit(0), lambda s, x: s + x) > 120
    points = made_once(folds, points=F.when(large, chunking.split_points(F.col("sims"))).otherwise(F.array().cast("array<int>")))
    return made_once(points, cuts=chunking.accepted_splits(F.col("points"), F.col("sizes"), 30)).drop("points")


def refine_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cuts of the chunks above 120 tokens at the deepest valleys of similarity, and how many sentences each cut repeats."""
    cuts = _refined(spark, sf_dir)
    return cuts.select("chunk_id", "sizes", F.posexplode("cuts").alias("cut_no", "cut")).select("chunk_id", "cut_no", "cut", chunking.trailing_overlap(F.col("sizes"), F.col("cut"), 20).alias("overlap"))


def refined_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks after refinement as rows: the sentences of each piece with those that it repeats of the one before, and the pieces linked anew in the order of their document."""
    pieces = chunking.refined_pieces(_refined(spark, sf_dir), 20)
    linked = chunking.linked(pieces.withColumn("ord", F.col("ord").cast("long") * 4096 + F.col("part")), stretch=512 * 4096)
    return linked.select("chunk_id", "source_chunk_id", "part", F.md5("text").alias("text_md5"), "overlap_sentences", "prev_id", "next_id")


QUERIES = {
    f.__name__: f
    for f in (
        section_grouping, floor_merge, prev_next, reading_order, token_distribution, document_sizes, unindexed_documents, type_histogram, dedupe_signature, normalized_excerpts, size_estimates, sentence_counts,
        name_forms, contextual_prefix, registry_upsert, missing_calls, unexpired_calls, after_deletion, page_overlap, semantic_groups, refine_splits, refined_chunks,
    )
}

_ONCE = "c AS (SELECT * FROM chunks QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY ord DESC, text DESC) = 1)"
_TOKENS = r"len(regexp_extract_all({t}, '[\p{L}\p{N}\p{M}_]+|[^\s\p{L}\p{N}\p{M}_]'))"
_NORMAL = r"regexp_replace(regexp_replace(regexp_replace(replace(coalesce(text, ''), chr(160), ' '), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"

_SPLIT = r"string_split(regexp_replace({t}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))"
_KEYWORDS = f"list_distinct(list_transform(regexp_extract_all(x, '{T.KEYWORD_TOKEN}'), lambda t: lower(t)))"
#: f: sentences, sizes and token sets of each chunk; u: one row a sentence with its similarity to the one before.
_FOLDS = rf"""{_ONCE},
        y AS (SELECT chunk_id, doc_id, ord, list_filter({_SPLIT.replace('{t}', "trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))")}, lambda s: s <> '') AS ss FROM c),
        f AS (SELECT chunk_id, doc_id, ord, ss, list_transform(ss, lambda x: {_TOKENS.replace('{t}', 'x')}::INT) AS ns, list_transform(ss, lambda x: {_KEYWORDS}) AS ks FROM y WHERE len(ss) > 0),
        v AS (SELECT chunk_id, unnest(range(1, len(ns) + 1)) AS i, ns, ks FROM f),
        u AS (SELECT chunk_id, i, ns[i] AS n, CASE WHEN i > 1 THEN CASE WHEN len(ks[i]) > 0 AND len(ks[i - 1]) > 0 THEN round(len(list_intersect(ks[i - 1], ks[i])) / sqrt((len(ks[i - 1]) * len(ks[i]))::DOUBLE), 6) ELSE 0 END END AS sim FROM v)"""
#: e: the accepted cuts of each chunk above 120 tokens, numbered.
_CUTS = """
        q AS (SELECT chunk_id, list(sim ORDER BY i) FILTER (i > 1) AS sims FROM u GROUP BY 1),
        a1 AS (SELECT q.chunk_id, list_transform(range(1, len(sims) + 1), lambda i: (CASE WHEN i > 1 THEN sims[i - 1] ELSE 0 END + sims[i] + coalesce(sims[i + 1], 0)) / 3) AS sm, ns FROM q JOIN f USING (chunk_id) WHERE len(sims) >= 3 AND list_sum(ns) > 120),
        a2 AS (SELECT chunk_id, ns, sm, unnest(range(2, len(sm))) AS i FROM a1),
        a3 AS (SELECT chunk_id, ns, i, row_number() OVER (PARTITION BY chunk_id ORDER BY sm[i], i) AS rk FROM a2 WHERE sm[i] < sm[i - 1] AND sm[i] < sm[i + 1]),
        a4 AS (SELECT DISTINCT chunk_id, ns, 0::BIGINT AS rk, []::BIGINT[] AS acc FROM a3 UNION ALL
               SELECT a3.chunk_id, a3.ns, a3.rk, CASE WHEN list_sum(a3.ns[coalesce(list_max(list_filter(acc, lambda x: x < a3.i)), 0) + 1:a3.i]) >= 30 AND list_sum(a3.ns[a3.i + 1:coalesce(list_min(list_filter(acc, lambda x: x > a3.i)), len(a3.ns))]) >= 30 THEN list_append(acc, a3.i) ELSE acc END
               FROM a4 JOIN a3 ON a3.chunk_id = a4.chunk_id AND a3.rk = a4.rk + 1),
        a5 AS (SELECT chunk_id, any_value(ns) AS ns, list_sort(arg_max(acc, rk)) AS acc FROM a4 GROUP BY 1),
        e AS (SELECT chunk_id, ns, unnest(acc) AS cut, generate_subscripts(acc, 1) AS k FROM a5)"""

SQL = {
    "section_grouping": f"""
        WITH {_ONCE}, b AS (SELECT doc_id, ord, page_start, unnest(string_split(text, chr(10) || chr(10))) AS t, generate_subscripts(string_split(text, chr(10) || chr(10)), 1) AS p FROM c),
        k AS (SELECT * FROM b WHERE trim(t) <> ''), s AS (SELECT *, sum(CASE WHEN starts_with(t, '## ') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ord, p) AS section_no FROM k)
        SELECT doc_id, section_no::BIGINT AS section_no, 0 AS part_no, min(page_start) AS page_start, max(page_start) AS page_end, count(*) AS block_count, md5(string_agg(t, chr(10) || chr(10) ORDER BY ord, p)) AS text_md5,
               count(*) FILTER (starts_with(t, '## '))::INT AS headings FROM s GROUP BY doc_id, section_no""",
    "floor_merge": f"""
        WITH {_ONCE}, g AS (SELECT *, sum(CASE WHEN coalesce(token_count, 0) >= 100 OR rn = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ord) AS group_no FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS rn FROM c)),
        m AS (SELECT doc_id, group_no, arg_min(chunk_id, ord) AS chunk_id, arg_min(page_start, ord) AS page_start, max(page_end) AS page_end, string_agg(text, chr(10) || chr(10) ORDER BY ord) AS t, count(*) AS n FROM g GROUP BY ALL)
        SELECT doc_id, group_no::BIGINT AS group_no, chunk_id, page_start, page_end, {_TOKENS.replace('{t}', 't')}::INT AS token_count, n::INT AS n_merged, md5(t) AS text_md5 FROM m""",
    "prev_next": f"WITH {_ONCE} SELECT chunk_id, lag(chunk_id) OVER w AS prev_id, lead(chunk_id) OVER w AS next_id FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY ord, chunk_id)",
    "reading_order": f"WITH {_ONCE} SELECT doc_id, chunk_id, (row_number() OVER (PARTITION BY doc_id ORDER BY page_start, CASE chunk_type WHEN 'prose' THEN 0 WHEN 'table' THEN 1 ELSE 2 END, ord, chunk_id))::INT AS position FROM c",
    "token_distribution": f"""
        WITH {_ONCE}, s AS (SELECT token_count AS v, row_number() OVER (ORDER BY token_count) AS r, count(*) OVER () AS n FROM c WHERE token_count IS NOT NULL)
        SELECT max(n) AS n, sum(v)::BIGINT AS total, min(v) AS min, min(v) FILTER (r = n // 2 + 1) AS upper_median, (sum(v) // count(*))::BIGINT AS mean, max(v) AS max, count(*) FILTER (v < 100) AS below_100, count(*) FILTER (v > 1000) AS above_1000 FROM s""",
    "document_sizes": f"""
        WITH {_ONCE}, p AS (SELECT doc_id, count(*) AS chunks, sum(token_count)::BIGINT AS tokens, min(page_start) AS first_page, max(page_end) AS last_page FROM c GROUP BY doc_id)
        SELECT doc_id, filename, lower(trim(status)) AS status, chunks, tokens, first_page, last_page FROM p LEFT JOIN documents_registry r ON r.document_id = p.doc_id""",
    "unindexed_documents": "SELECT document_id, lower(status) AS status FROM documents_registry r WHERE NOT EXISTS (SELECT 1 FROM chunks c WHERE c.doc_id = r.document_id)",
    "type_histogram": "WITH m AS (SELECT chunk_id, any_value(block_types) AS b FROM chunks GROUP BY chunk_id), e AS (SELECT unnest(map_entries(b)) AS x FROM m) SELECT x.key AS type, sum(x.value)::BIGINT AS n FROM e GROUP BY 1",
    "dedupe_signature": r"""
        WITH s AS (SELECT coalesce(doc_id, '') AS doc_id, chunk_id, left(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}\p{M}_]+', ' ', 'g')), 400) AS g FROM bm25_docs)
        SELECT doc_id, min(chunk_id) AS chunk_id, count(*) AS copies FROM s GROUP BY doc_id, g""",
    "normalized_excerpts": rf"""
        WITH n AS (SELECT chunk_id, section_path, {_NORMAL} AS t FROM bm25_docs)
        SELECT chunk_id, md5(t) AS normalized_md5, md5(CASE WHEN length(t) <= 520 THEN t ELSE regexp_replace(regexp_replace(left(t, 520), ' [^ ]*$', ''), '^\s+|\s+$', '', 'g') || '...' END) AS excerpt_md5,
               coalesce(nullif(array_to_string(list_filter(section_path, lambda p: p IS NOT NULL AND p <> ''), ' > '), ''), 'Unknown') AS section FROM n""",
    "size_estimates": rf"""
        SELECT doc_id, {_TOKENS.replace('{t}', "coalesce(text, '')")}::INT AS tokens, len(regexp_extract_all(coalesce(text, ''), '{T.KEYWORD_TOKEN}'))::INT AS keyword_tokens FROM documents""",
    "name_forms": r"""
        SELECT document_id, left(regexp_replace(regexp_replace(lower(coalesce(filename, '')), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 48) AS slug, left(regexp_replace(coalesce(filename, ''), '[^A-Za-z0-9_.-]+', '_', 'g'), 120) AS safe_id,
               substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (('0x' || substr(h, 17, 1))::INT % 4) + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS stable_id,
               CASE WHEN length(trim(coalesce(filename, ''))) > 12 THEN left(trim(filename), 12) || '...' ELSE trim(coalesce(filename, '')) END AS short
        FROM (SELECT *, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(document_id)) AS h FROM documents_registry)""",
    "contextual_prefix": f"""
        WITH {_ONCE}, s AS (SELECT *, coalesce(nullif(array_to_string(list_filter(section_path, lambda p: p IS NOT NULL AND p <> ''), ' > '), ''), 'Unknown') AS section FROM c),
        w AS (SELECT doc_id, section, string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY ord, chunk_id) AS t FROM s GROUP BY ALL),
        x AS (SELECT chunk_id, text, t, CASE WHEN coalesce(source_filename, '') <> '' THEN 'This chunk is from ' || source_filename || '''s section ''' || section || '''.' ELSE 'From section ''' || section || '''.' END AS prefix FROM s JOIN w USING (doc_id, section))
        SELECT chunk_id, prefix, md5(CASE WHEN length(t) > 12000 THEN left(t, 6000) || chr(10) || '[...]' || chr(10) || right(t, 6000) ELSE t END) AS section_md5, md5(prefix || chr(10) || chr(10) || coalesce(text, '')) AS context_md5 FROM x""",
    "registry_upsert": f"""
        WITH n AS (SELECT doc_id AS document_id, min(source_filename) AS filename FROM chunks GROUP BY 1)
        SELECT coalesce(n.document_id, o.document_id) AS document_id, CASE WHEN n.document_id IS NULL THEN o.filename ELSE n.filename END AS filename, CASE WHEN n.document_id IS NULL THEN o.status ELSE 'ready' END AS status, coalesce(o.uploaded_at, {NOW}::DOUBLE) AS uploaded_at
        FROM documents_registry o FULL JOIN n ON o.document_id = n.document_id""",
    "missing_calls": "SELECT session_id AS call_id, min(ts) AS created_at FROM transcript_turns WHERE session_id NOT IN (SELECT call_id FROM calls) GROUP BY 1",
    "unexpired_calls": f"SELECT call_id FROM calls WHERE {NOW}::DOUBLE - created_at <= 90 * 86400",
    "after_deletion": "SELECT chunk_id FROM bm25_docs WHERE user_id IS NULL OR user_id NOT IN (SELECT user_id FROM documents_registry WHERE lower(status) = 'failed' AND user_id IS NOT NULL)",
    "page_overlap": "SELECT coalesce(user_id, '') AS user_id, count(*) AS chunks FROM bm25_docs WHERE page_end >= 3 AND page_start <= 5 GROUP BY 1",
    "sentence_counts": rf"""
        WITH d AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS flat, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda s: trim(s)), lambda s: s <> '') AS ls FROM documents)
        SELECT doc_id, len(list_filter({_SPLIT.replace('{t}', 'flat')}, lambda s: s <> ''))::INT AS sentences,
               coalesce(list_sum(list_transform(ls, lambda s: CASE WHEN regexp_matches(s, '^(?:#|[-*•]\s|\d+[.)]\s)') THEN 1 ELSE len(list_filter({_SPLIT.replace('{t}', 's')}, lambda x: x <> '')) END)), 0)::INT AS line_sentences FROM d""",
    "semantic_groups": f"""
        WITH RECURSIVE {_FOLDS},
        g AS (SELECT chunk_id, i, 0 AS no, n AS size FROM u WHERE i = 1 UNION ALL
              SELECT u.chunk_id, u.i, CASE WHEN size + n > 120 OR (size >= 30 AND sim < 0.58) OR (size >= 50 AND sim < 0.42) THEN no + 1 ELSE no END, CASE WHEN size + n > 120 OR (size >= 30 AND sim < 0.58) OR (size >= 50 AND sim < 0.42) THEN n ELSE size + n END FROM g JOIN u ON u.chunk_id = g.chunk_id AND u.i = g.i + 1),
        z AS (SELECT chunk_id, no, sum(n)::INT AS sz FROM g JOIN u USING (chunk_id, i) GROUP BY 1, 2),
        m AS (SELECT chunk_id, no, [sz] AS acc FROM z WHERE no = 0 UNION ALL
              SELECT z.chunk_id, z.no, CASE WHEN sz < 30 OR acc[len(acc)] < 30 THEN list_append(acc[1:len(acc) - 1], acc[len(acc)] + sz) ELSE list_append(acc, sz) END FROM m JOIN z ON z.chunk_id = m.chunk_id AND z.no = m.no + 1),
        l AS (SELECT chunk_id, arg_max(acc, no) AS acc, max(no) AS no FROM m GROUP BY 1)
        SELECT chunk_id, len(ns)::INT AS sentences, (no + 1)::INT AS n_groups, to_json(acc)::VARCHAR AS sizes FROM l JOIN f USING (chunk_id)""",
    "refine_splits": f"""
        WITH RECURSIVE {_FOLDS}, {_CUTS}
        SELECT chunk_id, (k - 1)::INT AS cut_no, cut::INT AS cut, greatest(1, len(list_filter(range(1, cut + 1), lambda j: list_sum(ns[cut - j + 1:cut]) <= 20)))::INT AS overlap FROM e""",
    "refined_chunks": f"""
        WITH RECURSIVE {_FOLDS}, {_CUTS},
        h AS (SELECT chunk_id, k, cut, greatest(1, len(list_filter(range(1, cut + 1), lambda j: list_sum(ns[cut - j + 1:cut]) <= 20))) AS ov FROM e),
        w AS (SELECT f.chunk_id, doc_id, ord, ss, list_concat([0], coalesce(list(cut ORDER BY k) FILTER (cut IS NOT NULL), [])) AS b, list_concat([0], coalesce(list(ov ORDER BY k) FILTER (cut IS NOT NULL), [])) AS o FROM f LEFT JOIN h USING (chunk_id) GROUP BY ALL),
        r AS (SELECT *, unnest(range(len(b))) AS part FROM w),
        t AS (SELECT CASE WHEN len(b) = 1 THEN chunk_id ELSE chunk_id || '#' || part END AS id, chunk_id AS source_chunk_id, doc_id, ord, part, o[part + 1] AS ov, array_to_string(ss[b[part + 1] - o[part + 1] + 1:coalesce(b[part + 2], len(ss))], ' ') AS text FROM r)
        SELECT id AS chunk_id, source_chunk_id, part::INT AS part, md5(text) AS text_md5, ov::INT AS overlap_sentences, lag(id) OVER v AS prev_id, lead(id) OVER v AS next_id FROM t WINDOW v AS (PARTITION BY doc_id ORDER BY ord, part, id)""",
}
