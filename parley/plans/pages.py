"""Queries of layout, tables, samples, sources and caches over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parley.functions import tables, vector
from parley.functions import text as T
from parley.functions.speakers import session_key
from parley.operators import chunking, conversation, filters, layout, lexical, signals, storage
from parley.operators.ordered import blocked_lag
from parley.plans.records import _ONCE, _chunks
from parley.session import scratch, table, table_stream
from parley.sources import readers, sinks

#: Pages hold so many paragraphs of so many points, one below the other; the tables have no boxes.
PAGE_LINES, LINE_POINTS = 32, 24.0


def _boxed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of the documents as layout blocks: headings, tables, equations and paragraphs by what they hold, captions behind tables, boxes by their place. Blocks of a document are numbered from 0."""
    parts = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n+")).alias("ord", "text")).where(F.trim("text") != "")
    kind = (
        F.when(F.col("text").startswith("|"), "table").when(F.col("text").rlike(r"^#|^[A-Z][a-z]+( [A-Za-z-]+){0,4}:?$"), "section_heading").when(F.col("text").rlike(r"^[-*] "), "list_item").when(F.col("text").rlike(r"^[^%]*\d%[^%]*$"), "equation").when(F.col("text").rlike(r"^[^:]{3,20}: "), "caption").otherwise("paragraph")
    )
    place = F.pmod("ord", F.lit(PAGE_LINES)) * LINE_POINTS
    box = F.array(F.lit(0.0), 790.0 - place, F.lit(500.0) - F.pmod(F.length("text"), F.lit(50)), 778.0 - place)
    return parts.withColumns({"type": kind, "page": (F.floor(F.col("ord") / PAGE_LINES) + 1).cast("int"), "bbox": box, "block_id": F.concat_ws("#", F.col("doc_id").cast("string"), F.col("ord").cast("string"))})


def block_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks, pages and marginal strips of each document by type; figures in the margin change their type."""
    blocks = layout.retype_margins(_boxed(spark, sf_dir).withColumn("type", F.when(F.col("type") == "list_item", "figure").otherwise(F.col("type"))))
    return blocks.groupBy("doc_id", "type").agg(F.count(F.lit(1)).alias("blocks"), F.count_if(layout.in_margin(F.col("bbox"))).alias("marginal"), F.max("page").alias("last_page"))


def block_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _boxed(spark, sf_dir).select("block_id", "type", F.md5(chunking.formatted_block(F.col("type"), F.col("text"))).alias("text_md5"))


def caption_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The caption that each table or equation takes, and the captions without one."""
    attached, orphans = layout.attach_captions(_boxed(spark, sf_dir))
    return attached.select("doc_id", "asset_id", F.md5("caption").alias("caption_md5")).unionByName(orphans.select("doc_id", F.lit(None).cast("string").alias("asset_id"), F.md5("caption").alias("caption_md5")))


def equation_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = layout.equation_neighbours(_boxed(spark, sf_dir), 40)
    return found.select("doc_id", "ord", "before", "after")


def equation_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks, quality and label of every equation, and whether its reading without signs of currency is better."""
    e = _boxed(spark, sf_dir).where("type = 'equation'").withColumn("m", layout.equation_marks(F.col("text")))
    plain = F.regexp_replace("text", r"[*+/=<>-]", " ")
    better = layout.repaired_equation(plain, F.col("text"))
    return e.select("block_id", "m.*", layout.equation_quality(F.col("text")).alias("quality"), layout.equation_label(F.col("text")).alias("label"), better["source"].alias("source"))


def section_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The headings in force at each block; a heading with a colon is of the second level."""
    blocks = _boxed(spark, sf_dir).withColumn("level", F.when(F.col("type") == "section_heading", F.when(F.col("text").endswith(":"), 2).otherwise(1)))
    return layout.section_paths(blocks).select("block_id", F.md5(F.array_join("section_path", " > ")).alias("path_md5"), F.size("section_path").alias("depth"))


def section_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.section_tree(_chunks(spark, sf_dir)).select("doc_id", F.array_join("path", " > ").alias("path"), "page_start", "page_end", "chunks")


def figure_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The section path of each chunk read as classes given to it: the first, and whether one names a logo or icon."""
    notes = F.transform("section_path", lambda p: F.struct(F.lit("classification").alias("kind"), p.alias("class")))
    return _chunks(spark, sf_dir).select("chunk_id", layout.figure_class(notes).alias("class"), layout.is_logo(notes).alias("is_logo"))


def _grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first pipe table of each document that has one, and its cells."""
    found = table(spark, sf_dir, "documents").select("doc_id", layout.markdown_table(F.col("text")).alias("table")).where("table is not null")
    cells = F.transform(F.split("table", "\n"), lambda line: F.transform(F.split(F.regexp_replace(F.trim(line), r"^\||\|$", ""), r"\|"), lambda s: F.trim(s)))
    return found.withColumn("rows", cells)


def table_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    shape = tables.row_and_column_count(F.col("table"))
    return _grids(spark, sf_dir).select("doc_id", shape["rows"].alias("n_rows"), shape["cols"].alias("n_cols"), tables.modal_width(F.col("rows")).alias("modal_width"), tables.has_header(F.col("rows")).alias("has_header"), F.md5(tables.without_trailing_rules(F.col("table"))).alias("table_md5"))


def tables_rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grids(spark, sf_dir).select("doc_id", F.md5(layout.table_markdown(F.col("rows"))).alias("markdown_md5"))


def vector_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels of each vector read as samples, and which of two halves dominates."""
    e = F.col("embedding")
    half = lambda start: vector.root_mean_square(F.slice(e, start, 32))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(vector.root_mean_square(e), 6).alias("rms"), F.round(vector.peak(e), 6).alias("peak"), signals.dominance(half(1), half(33), 1.05).alias("dominance"), F.round(vector.norm(vector.unit(e)), 6).alias("unit_norm"))


def vectors_resampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector as 64 samples at 16 kHz: interpolated to 12 kHz and averaged to 8 kHz, summed with weights."""
    e = F.col("embedding").cast("array<double>")
    weigh = lambda v: F.round(F.aggregate(F.transform(v, lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x), 6)
    return table(spark, sf_dir, "embeddings").select("vec_id", weigh(vector.resampled(e, F.lit(16000), F.lit(12000))).alias("linear"), weigh(tables.box_downsampled(e, 16000, 8000)).alias("boxed"))


def neighbour_coherence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and deviation of the similarity of neighbouring vectors of each label; 1 for a single vector."""
    v = table(spark, sf_dir, "embeddings").select("label", "vec_id", "embedding", F.floor(F.col("vec_id") / 4096).alias("stretch"))
    seen = blocked_lag(v, ["label"], "stretch", ["vec_id"], F.col("embedding"), "next", ahead=True)
    sim = F.when(F.col("next").isNotNull(), F.round(vector.cosine(F.col("embedding"), F.col("next")), 6))
    return seen.withColumn("sim", sim).groupBy("label").agg(F.round(F.coalesce(F.avg("sim"), F.lit(1.0)), 4).alias("coherence"), F.round(F.stddev_samp("sim"), 4).alias("deviation"), F.count(F.lit(1)).alias("n"))


def vectors_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their vector, in the order of the documents; those without are marked, as an index must not be built then."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.size("embedding").alias("dim"))
    return table(spark, sf_dir, "documents").select("doc_id").join(v, "doc_id", "left").select("doc_id", "dim", F.col("dim").isNull().alias("missing"))


def first_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three chunks of each document by order, 300 characters of each. Partial ranks are made before the shuffle."""
    w = Window.partitionBy("doc_id").orderBy("ord", "chunk_id")
    return _chunks(spark, sf_dir).withColumn("n", F.row_number().over(w)).where("n <= 3").select("doc_id", "n", "chunk_id", F.md5(F.substring("text", 1, 300)).alias("head_md5"))


def candidate_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "live_assist_state").select("state_id", filters.candidate_limit(F.col("question")).alias("candidates"))


def filtered_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of one file that touch pages 2 to 4."""
    wanted = filters.document_filter("procedures") | {"page_start": 2, "page_end": 4}
    return table(spark, sf_dir, "bm25_docs").withColumn("source_filename", F.when(F.col("source_filename").rlike("[0-4]"), "procedures.pdf").otherwise(F.col("source_filename"))).where(filters.retrieval_predicate(wanted)).select("chunk_id")


def call_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The id of each call out of the address and the message with which a client would name it."""
    calls = table(spark, sf_dir, "calls")
    odd = F.pmod(F.xxhash64("call_id"), F.lit(2)) == 1
    url = F.concat(F.lit("ws://host/audio?lang=en&"), F.when(F.col("created_at").isNull(), F.lit("call_id=")).otherwise(F.lit("session_id=")), F.col("call_id"), F.lit("#x"))
    message = F.when(odd, F.to_json(F.struct(F.col("call_id").alias("conversation_id")))).otherwise(F.to_json(F.struct("call_id")))
    return calls.select("call_id", readers.call_id_of_url(url).alias("of_url"), readers.call_id_of_message(message).alias("of_message"))


def turn_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns sent as JSON lines, one in three without body, and read again; every seventh line is broken."""
    turns = table(spark, sf_dir, "transcript_turns")
    body = F.struct(F.col("raw_text").alias("transcript"), "speaker", F.col("ts").cast("string").alias("timestamp"), F.col("session_id").alias("call_id"))
    line = F.when(F.col("id") % 7 == 0, F.concat(F.lit("{"), F.col("id").cast("string"))).when(F.col("id") % 3 == 0, F.to_json(body)).otherwise(F.to_json(F.struct(body.alias("body"))))
    read = readers.turn_envelopes(turns.select(line.alias("value")))
    return read.groupBy("call_id", "speaker").agg(F.count(F.lit(1)).alias("turns"), F.count_if("ok").alias("read"), F.count("ts").alias("timed"), F.sum(F.length("transcript")).alias("characters"))


def audio_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels of events written as records and as log lines, and read again."""
    e = table(spark, sf_dir, "events").select("event_id", "value", F.when(F.col("event_type") == "error", "OTHER").otherwise("AUDIO_CHUNK_META").alias("type"))
    record = F.to_json(F.struct("type", F.col("event_id").cast("int").alias("chunk_index"), F.round(F.col("value") / 1000, 6).alias("system_rms")))
    line = F.concat(F.lit("level system_rms="), F.format_number(F.col("value") / 10000, 4), F.lit(" mic_rms=0.0040"))
    return e.select("event_id", readers.audio_meta(record)["system_rms"].alias("level"), readers.energy_of_log(line)["system_active"].alias("active"))


def chunk_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks written as tables by document and read again in the form that later steps share."""
    folder = scratch(spark, "chunks")
    sinks.write_partitioned(_chunks(spark, sf_dir).select("chunk_id", F.coalesce("doc_id", F.lit("(none)")).alias("doc"), "doc_id", "document_id", "text", "section_path", "page_start", "page_end", "ord"), folder, ["doc"], 4)
    read = readers.normalize_chunks(spark.read.parquet(folder))
    return read.select("chunk_id", "doc_id", F.md5("text").alias("text_md5"), F.md5("indexed_text").alias("indexed_md5"), F.size("section_path").alias("depth"), "page_start", "page_end")


def index_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keyword index written as tables and read again: postings and occurrences of each term."""
    folder = scratch(spark, "index")
    sinks.write_index(table(spark, sf_dir, "bm25_docs"), folder, "chunk_id", "text", 8)
    return spark.read.parquet(f"{folder}/postings").groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("occurrences"))


def keyword_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many different tokens each chunk has and how long it is, from the hashed index."""
    made = lexical.index(table(spark, sf_dir, "bm25_docs"), "chunk_id", "text")
    return made.terms.select("chunk_id", F.size("terms").alias("tokens"), F.size(F.array_distinct("terms")).alias("different"))


def paired_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The n-th click of each user with their n-th view."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.floor(F.col("event_id") / 1024).alias("stretch"))
    pairs = signals.paired_in_order(e.where("event_type = 'click'"), e.where("event_type = 'view'"), "user_id", ["event_id"], "stretch")
    return pairs.select("user_id", "n", F.col("l.event_id").alias("click_id"), F.col("r.event_id").alias("view_id"))


def mixed_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Value of clicks and of views of each user by hour; where one side has none it is zero."""
    e = table(spark, sf_dir, "events").withColumn("hour", F.date_trunc("hour", "ts"))
    side = lambda kind: e.where(F.col("event_type") == kind).groupBy("user_id", "hour").agg(F.round(F.sum("value"), 4).alias("v"))
    return signals.mixed(side("click"), side("view"), ["user_id", "hour"], "v")


def merged_partials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn heard in growing parts, then anew, and merged."""
    turns = table(spark, sf_dir, "transcript_turns").where("length(trim(raw_text)) > 0").withColumn("t", F.trim("raw_text"))
    parts = F.array(F.substring("t", 1, 9), F.substring("t", 1, 25), F.substring("t", 1, 9), F.col("t"), F.lit(" "), F.lit("~ok"), F.lit("~ok then"))
    return turns.select("id", F.md5(F.array_join(conversation.merge_partials(parts), " ")).alias("text_md5"))


def similar_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every question whose id is divisible by 50 the most similar one that its session stored before, in the last 500 runs. Vectors are counts of letters, of length one."""
    letters = [chr(97 + k) for k in range(26)]
    states = table(spark, sf_dir, "live_assist_state").where("question is not null").select("state_id", session_key(F.col("session_id")).alias("session"), F.col("state_id").cast("double").alias("at"), "route", F.lower("question").alias("q"))
    counts = F.array(*[F.length("q") - F.length(F.replace("q", F.lit(c), F.lit(""))) for c in letters])
    known = states.withColumn("vector", vector.unit(counts))
    return storage.similar_cached(known.where("state_id % 50 = 0").withColumnRenamed("state_id", "query_id"), known.where("route = 'rag_answer'").withColumnRenamed("state_id", "entry_id"), max_age=500.0)


def streamed_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of all turns, found by a stream that reads the table once and forgets nothing; late copies are dropped."""
    folder = scratch(spark, "stream")
    source = table_stream(spark, sf_dir, "transcript_turns")
    sessions = source.select(session_key(F.col("session_id")).alias("session")).dropDuplicates(["session"])
    sessions.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(sessions.schema).parquet(f"{folder}/out")


QUERIES = {
    f.__name__: f
    for f in (
        block_types, block_formats, caption_assets, equation_neighbours, equation_quality, section_paths, section_tree, figure_classes, table_shapes, tables_rendered, vector_levels, vectors_resampled, neighbour_coherence, vectors_complete,
        first_chunks, candidate_limits, filtered_chunks, call_ids, turn_envelopes, audio_records, chunk_files, index_tables, keyword_positions, paired_records, mixed_channels, merged_partials, similar_cache, streamed_sessions,
    )
}

_B = r"""
    p AS (SELECT doc_id, unnest(string_split_regex(coalesce(text, ''), '\n+')) AS text, generate_subscripts(string_split_regex(coalesce(text, ''), '\n+'), 1) - 1 AS ord FROM documents),
    b AS (SELECT doc_id, ord, text, doc_id || '#' || ord AS block_id, ord // 32 + 1 AS page, [0.0, 790.0 - (ord % 32) * 24.0, 500.0 - length(text) % 50, 778.0 - (ord % 32) * 24.0] AS bbox,
          CASE WHEN starts_with(text, '|') THEN 'table' WHEN regexp_matches(text, '^#|^[A-Z][a-z]+( [A-Za-z-]+){0,4}:?$') THEN 'section_heading' WHEN regexp_matches(text, '^[-*] ') THEN 'list_item' WHEN regexp_matches(text, '^[^%]*\d%[^%]*$') THEN 'equation' WHEN regexp_matches(text, '^[^:]{3,20}: ') THEN 'caption' ELSE 'paragraph' END AS type
          FROM p WHERE trim(text) <> '')"""
_MARGIN = "(bbox[2] - bbox[4] < 25.0 AND (bbox[4] >= 752.0 OR bbox[2] <= 40.0))"
_QUALITY = r"(CASE WHEN trim({t}) = '' THEN -100 ELSE (CASE WHEN regexp_matches({t}, '/[A-Z][a-z]+') THEN -50 ELSE 0 END) + (CASE WHEN contains({t}, chr(65533)) THEN -30 ELSE 0 END) + (CASE WHEN regexp_matches({t}, '[=+\-/*<>]') THEN 10 ELSE 0 END) + (CASE WHEN regexp_matches({t}, '[\x{0370}-\x{03FF}∑∫√∞≤≥≠±×÷∂∇]') THEN 5 ELSE 0 END) + (CASE WHEN length({t}) > 500 THEN -10 ELSE 0 END) END)"
_PIPES = r"""
    l AS (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda s: trim(s)), lambda s: NOT starts_with(s, '```')) AS ls FROM documents),
    f AS (SELECT doc_id, regexp_extract(chr(10) || array_to_string(ls, chr(10)) || chr(10), '\n((?:\|[^\n]*\n){2,})', 1) AS t FROM l),
    g AS (SELECT doc_id, left(t, length(t) - 1) AS tab FROM f WHERE t <> ''),
    r AS (SELECT doc_id, tab, list_transform(string_split(tab, chr(10)), lambda x: list_transform(string_split(regexp_replace(trim(x), '^\||\|$', '', 'g'), '|'), lambda c: trim(c))) AS cells FROM g)"""
_RULE = r"'^\s*\|?[\s:|-]*-[\s:|-]*\|?\s*$'"
_E = "e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)"
_TOKENS = f"list_transform(regexp_extract_all(coalesce(text, ''), '{T.KEYWORD_TOKEN}'), lambda t: lower(t))"
_SESSION = r"coalesce(lower(regexp_replace(session_id, '^\s+|\s+$', '', 'g')), '')"

SQL = {
    "block_types": f"""WITH {_B}, k AS (SELECT *, {_MARGIN} AS m, CASE WHEN type = 'list_item' THEN CASE WHEN {_MARGIN} THEN 'page_marginal' ELSE 'figure' END ELSE type END AS kind FROM b)
        SELECT doc_id, kind AS type, count(*) AS blocks, count(*) FILTER (m) AS marginal, max(page)::INT AS last_page FROM k GROUP BY 1, 2""",
    "block_formats": f"""WITH {_B} SELECT block_id, type, md5(CASE type WHEN 'section_heading' THEN '## ' || text WHEN 'list_item' THEN '- ' || text WHEN 'equation' THEN '$$ ' || text || ' $$' WHEN 'caption' THEN '_Caption: ' || text || '_' WHEN 'table' THEN '' ELSE text END) AS text_md5 FROM b""",
    "caption_assets": rf"""WITH {_B},
        c AS (SELECT doc_id, page, ord, text, bbox, CASE WHEN regexp_matches(text, '(?i)^\s*(figure|fig\.?)\s*\d+[a-z]?([^A-Za-z0-9]|$)') THEN 'figure' WHEN regexp_matches(text, '(?i)^\s*(table|tab\.?)\s*\d+[a-z]?([^A-Za-z0-9]|$)') THEN 'table' WHEN regexp_matches(text, '(?i)^\s*(equation|eq\.?)\s*\d+[a-z]?([^A-Za-z0-9]|$)') THEN 'equation' END AS kind FROM b WHERE type = 'caption'),
        a AS (SELECT * FROM b WHERE type IN ('figure', 'table', 'equation')),
        n AS (SELECT c.doc_id, c.ord, c.text, a.block_id, row_number() OVER (PARTITION BY c.doc_id, c.ord ORDER BY sqrt(power((c.bbox[1] + c.bbox[3]) / 2 - (a.bbox[1] + a.bbox[3]) / 2, 2) + power((c.bbox[2] + c.bbox[4]) / 2 - (a.bbox[2] + a.bbox[4]) / 2, 2)), CASE a.type WHEN 'figure' THEN 1 WHEN 'table' THEN 2 ELSE 3 END, a.ord) AS r
              FROM c JOIN a ON c.doc_id = a.doc_id AND c.page = a.page AND (c.kind IS NULL OR c.kind = a.type)),
        x AS (SELECT * FROM n WHERE r = 1)
        SELECT doc_id, block_id AS asset_id, md5(arg_max(text, ord)) AS caption_md5 FROM x GROUP BY 1, 2
        UNION ALL SELECT doc_id, NULL, md5(text) FROM c WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.doc_id = c.doc_id AND x.ord = c.ord)""",
    "equation_neighbours": f"""WITH {_B}, s AS (SELECT *, CASE WHEN type IN ('paragraph', 'list_item') THEN text END AS t FROM b),
        w AS (SELECT *, last_value(t IGNORE NULLS) OVER (PARTITION BY doc_id, page ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS be, first_value(t IGNORE NULLS) OVER (PARTITION BY doc_id, page ORDER BY ord ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS af FROM s)
        SELECT doc_id, ord::INT AS ord, left(be, 40) AS before, left(af, 40) AS after FROM w WHERE type = 'equation'""",
    "equation_quality": rf"""WITH {_B}, q AS (SELECT *, regexp_replace(text, '[*+/=<>-]', ' ', 'g') AS plain FROM b WHERE type = 'equation')
        SELECT block_id, regexp_matches(text, '/[A-Z][a-z]+') AS glyph_names, contains(text, chr(65533)) AS replaced, regexp_matches(text, '[=+\-/*<>]') AS operators, regexp_matches(text, '[\x{{0370}}-\x{{03FF}}∑∫√∞≤≥≠±×÷∂∇]') AS mathematical,
               {_QUALITY.replace('{t}', 'text')}::INT AS quality, nullif(regexp_extract(text, '\((\d+[a-z]?)\)\s*$', 1), '') AS label, CASE WHEN {_QUALITY.replace('{t}', 'text')} > {_QUALITY.replace('{t}', 'plain')} + 5 THEN 'second' ELSE 'first' END AS source FROM q""",
    "section_paths": f"""WITH {_B}, h AS (SELECT *, CASE WHEN type = 'section_heading' AND NOT ends_with(text, ':') THEN {{'o': ord, 't': text}} END AS a, CASE WHEN type = 'section_heading' AND ends_with(text, ':') THEN {{'o': ord, 't': text}} END AS z FROM b),
        w AS (SELECT block_id, last_value(a IGNORE NULLS) OVER o AS a, last_value(z IGNORE NULLS) OVER o AS z FROM h WINDOW o AS (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
        s AS (SELECT block_id, list_filter([a.t, CASE WHEN z IS NOT NULL AND NOT coalesce(a.o > z.o, false) THEN z.t END], lambda x: x IS NOT NULL) AS path FROM w)
        SELECT block_id, md5(coalesce(array_to_string(path, ' > '), '')) AS path_md5, len(path)::INT AS depth FROM s""",
    "section_tree": f"""WITH {_ONCE}, n AS (SELECT doc_id, page_start, page_end, array_to_string(section_path[1:k], ' > ') AS path FROM (SELECT *, unnest(range(1, len(section_path) + 1)) AS k FROM c WHERE len(section_path) > 0))
        SELECT doc_id, path, min(page_start) AS page_start, max(page_end) AS page_end, count(*) AS chunks FROM n GROUP BY 1, 2""",
    "figure_classes": f"WITH {_ONCE} SELECT chunk_id, section_path[1] AS class, coalesce(len(list_filter(section_path, lambda p: lower(p) IN ('logo', 'icon'))) > 0, false) AS is_logo FROM c",
    "table_shapes": rf"""WITH {_PIPES},
        m AS (SELECT doc_id, tab, cells, list_transform(cells, lambda x: len(x)) AS w, string_split(tab, chr(10)) AS lines FROM r),
        t AS (SELECT doc_id, w FROM m), u AS (SELECT doc_id, n, count(*) AS c, min(i) AS i FROM (SELECT doc_id, unnest(w) AS n, generate_subscripts(w, 1) AS i FROM t) GROUP BY 1, 2),
        mode AS (SELECT doc_id, arg_max(n, (c, -i)) AS modal_width FROM u GROUP BY 1),
        hd AS (SELECT doc_id, list_avg(list_transform(cells[1], lambda x: length(x))) AS a, list_avg(list_transform(flatten(cells[2:]), lambda x: length(x))) AS b FROM m)
        SELECT m.doc_id, len(list_filter(lines, lambda s: starts_with(trim(s), '|') AND NOT regexp_matches(s, {_RULE})))::INT AS n_rows, (length(lines[1]) - length(replace(lines[1], '|', '')) - 1)::INT AS n_cols, modal_width::INT AS modal_width,
               coalesce(a <= 20 AND a < 0.6 * b, false) AS has_header,
               md5(CASE WHEN len(lines) >= 3 THEN array_to_string(lines[1:list_max(list_transform(range(1, len(lines) + 1), lambda i: CASE WHEN i <= 2 OR (trim(lines[i]) <> '' AND NOT regexp_matches(lines[i], {_RULE})) THEN i END))], chr(10)) ELSE tab END) AS table_md5
        FROM m JOIN mode USING (doc_id) JOIN hd USING (doc_id)""",
    "tables_rendered": rf"""WITH {_PIPES}, w AS (SELECT doc_id, cells, list_max(list_transform(cells, lambda x: len(x))) AS n FROM r),
        k AS (SELECT doc_id, n, list_transform(cells, lambda x: '| ' || array_to_string(list_transform(range(1, n + 1), lambda i: replace(trim(regexp_replace(coalesce(x[i], ''), '\s+', ' ', 'g')), '|', '\|')), ' | ') || ' |') AS ls FROM w)
        SELECT doc_id, md5(array_to_string(list_concat(list_concat(ls[1:1], ['| ' || array_to_string(list_transform(range(n), lambda i: '---'), ' | ') || ' |']), ls[2:]), chr(10))) AS markdown_md5 FROM k""",
    "vector_levels": f"""WITH {_E}, s AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v[1:32], lambda x: x * x)) / 32) AS a, sqrt(list_sum(list_transform(v[33:64], lambda x: x * x)) / 32) AS b, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM e)
        SELECT vec_id, round(sqrt(n * n / len(v)), 6) AS rms, round(list_max(list_transform(v, lambda x: abs(x))), 6) AS peak, CASE WHEN a > b * 1.05 THEN 'system' WHEN b > a * 1.05 THEN 'mic' ELSE 'mixed' END AS dominance, round(sqrt(list_sum(list_transform(v, lambda x: (x / n) * (x / n)))), 6) AS unit_norm FROM s""",
    "vectors_resampled": f"""WITH {_E}
        SELECT vec_id, round(list_sum(list_transform(range(48), lambda i: (i + 1) * (v[floor(i * (16000 / 12000))::INT + 1] * (1 - (i * (16000 / 12000) - floor(i * (16000 / 12000)))) + v[least(floor(i * (16000 / 12000))::INT + 2, 64)] * (i * (16000 / 12000) - floor(i * (16000 / 12000)))))), 6) AS linear,
               round(list_sum(list_transform(range(32), lambda i: (i + 1) * (v[2 * i + 1] + v[2 * i + 2]) / 2)), 6) AS boxed FROM e""",
    "neighbour_coherence": f"""WITH {_E}, n AS (SELECT label, v, lead(v) OVER (PARTITION BY label ORDER BY vec_id) AS nx FROM e), s AS (SELECT label, round(list_cosine_similarity(v, nx), 6) AS sim FROM n)
        SELECT label, round(coalesce(avg(sim), 1), 4) AS coherence, round(stddev_samp(sim), 4) AS deviation, count(*) AS n FROM s GROUP BY label""",
    "vectors_complete": "SELECT d.doc_id, len(embedding)::INT AS dim, embedding IS NULL AS missing FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id",
    "first_chunks": f"WITH {_ONCE}, n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord, chunk_id) AS n FROM c) SELECT doc_id, n::INT AS n, chunk_id, md5(left(text, 300)) AS head_md5 FROM n WHERE n <= 3",
    "candidate_limits": r"SELECT state_id, CASE WHEN w <= 3 THEN 8 WHEN w <= 8 THEN 10 ELSE 12 END AS candidates FROM (SELECT state_id, len(list_filter(string_split_regex(trim(coalesce(question, '')), '\s+'), lambda x: x <> '')) AS w FROM live_assist_state)",
    "filtered_chunks": "SELECT chunk_id FROM bm25_docs WHERE CASE WHEN regexp_matches(source_filename, '[0-4]') THEN 'procedures.pdf' ELSE source_filename END = 'procedures.pdf' AND page_end >= 2 AND page_start <= 4",
    "call_ids": "SELECT call_id, call_id AS of_url, call_id AS of_message FROM calls",
    "turn_envelopes": """WITH t AS (SELECT CASE WHEN id % 7 <> 0 THEN session_id END AS call_id, CASE WHEN id % 7 <> 0 THEN speaker END AS speaker, id % 7 <> 0 AND (session_id IS NOT NULL OR raw_text IS NOT NULL) AS ok, CASE WHEN id % 7 <> 0 THEN ts END AS ts, CASE WHEN id % 7 <> 0 THEN raw_text END AS tx FROM transcript_turns)
        SELECT call_id, speaker, count(*) AS turns, count(*) FILTER (ok) AS read, count(ts) AS timed, sum(length(tx))::BIGINT AS characters FROM t GROUP BY 1, 2""",
    "audio_records": "SELECT event_id, CASE WHEN event_type <> 'error' THEN round(value / 1000, 6) END AS level, round(value / 10000, 4) > 0.003 AS active FROM events",
    "chunk_files": f"""WITH {_ONCE} SELECT chunk_id, coalesce(nullif(document_id, ''), nullif(doc_id, ''), '') AS doc_id, md5(coalesce(nullif(text, ''), '')) AS text_md5, md5(nullif(text, '')) AS indexed_md5, len(coalesce(section_path, []))::INT AS depth, coalesce(page_start, 0) AS page_start, coalesce(page_end, page_start, 0) AS page_end FROM c""",
    "index_tables": f"WITH d AS (SELECT chunk_id, unnest({_TOKENS}) AS term FROM bm25_docs) SELECT term, count(DISTINCT chunk_id) AS df, count(*) AS occurrences FROM d GROUP BY term",
    "keyword_positions": f"SELECT chunk_id, len({_TOKENS})::INT AS tokens, len(list_distinct({_TOKENS}))::INT AS different FROM bm25_docs",
    "paired_records": """WITH n AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM events WHERE event_type IN ('click', 'view'))
        SELECT a.user_id, a.n, a.event_id AS click_id, b.event_id AS view_id FROM n a JOIN n b ON a.user_id = b.user_id AND a.n = b.n AND a.event_type = 'click' AND b.event_type = 'view'""",
    "mixed_channels": """WITH s AS (SELECT user_id, date_trunc('hour', ts) AS hour, event_type, round(sum(value), 4) AS v FROM events WHERE event_type IN ('click', 'view') GROUP BY 1, 2, 3)
        SELECT user_id, hour, coalesce(max(v) FILTER (event_type = 'click'), 0) AS left, coalesce(max(v) FILTER (event_type = 'view'), 0) AS right FROM s GROUP BY 1, 2""",
    "merged_partials": "SELECT id, md5(trim(raw_text) || ' ~ok then') AS text_md5 FROM transcript_turns WHERE length(trim(raw_text)) > 0",
    "similar_cache": f"""WITH s AS (SELECT state_id, {_SESSION} AS session, route, list_transform(range(26), lambda k: (length(lower(question)) - length(replace(lower(question), chr(97 + k::INT), '')))::DOUBLE) AS v FROM live_assist_state WHERE question IS NOT NULL),
        n AS (SELECT a.state_id AS query_id, b.state_id AS entry_id, round(list_cosine_similarity(a.v, b.v), 6) AS similarity FROM s a JOIN s b ON a.session = b.session AND a.state_id % 50 = 0 AND b.route = 'rag_answer' AND b.state_id < a.state_id AND a.state_id - b.state_id <= 500),
        k AS (SELECT * FROM n WHERE similarity >= 0.97)
        SELECT s.state_id AS query_id, arg_max(entry_id, (similarity, entry_id)) AS entry_id, max(similarity) AS similarity FROM s LEFT JOIN k ON k.query_id = s.state_id WHERE s.state_id % 50 = 0 GROUP BY 1""",
    "streamed_sessions": f"SELECT DISTINCT {_SESSION} AS session FROM transcript_turns",
}
