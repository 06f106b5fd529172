"""Scans of chunk files, parsed documents, turn envelopes, vectors and logs into typed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = "chunk_id string, doc_id string, document_id string, user_id string, text string, content string, section_path array<string>, page_start int, page_end int, token_count int, chunk_type string, text_with_context string"
BLOCK = "block_id string, type string, page int, bbox array<double>, text string, section_path array<string>, tree_level int"
ENVELOPE = "transcript string, speaker string, timestamp string, call_id string, hasInterruptions boolean, raw_text string, translated_text string, source string, metadata map<string,string>"


def chunk_files(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of all *.chunks.json files of a folder with the name of the document they come from; files are read whole, each by one task."""
    raw = spark.read.schema(f"chunks array<struct<{_fields(CHUNK)}>>").option("multiLine", True).option("pathGlobFilter", "*.chunks.json").json(folder)
    named = raw.select(F.regexp_replace(F.element_at(F.split(F.input_file_name(), "/"), -1), r"\.chunks\.json$", "").alias("stem"), F.posexplode("chunks").alias("ord", "c"))
    return normalize_chunks(named.select("c.*", "ord", F.concat(F.col("stem"), F.lit(".pdf")).alias("source_filename")))


def _fields(ddl: str) -> str:
    return ", ".join(f"{p.strip().split(' ', 1)[0]}: {p.strip().split(' ', 1)[1]}" for p in ddl.split(", "))


def normalize_chunks(rows: DataFrame) -> DataFrame:
    """One form for all later steps: document id before doc id, text before content, pages and path never null. Absent columns count as null."""
    have = set(rows.columns)
    col = lambda c, t="string": F.col(c) if c in have else F.lit(None).cast(t)
    blank = lambda c: F.nullif(c, F.lit(""))
    return rows.select(
        col("chunk_id").alias("chunk_id"), F.coalesce(blank(col("document_id")), blank(col("doc_id")), F.lit("")).alias("doc_id"), col("user_id").alias("user_id"), col("source_filename").alias("source_filename"),
        F.coalesce(blank(col("text")), col("content"), F.lit("")).alias("text"), F.coalesce(col("section_path", "array<string>"), F.array().cast("array<string>")).alias("section_path"),
        F.coalesce(col("page_start", "int"), F.lit(0)).alias("page_start"), F.coalesce(col("page_end", "int"), col("page_start", "int"), F.lit(0)).alias("page_end"), col("ord", "int").alias("ord"),
        F.coalesce(blank(col("text_with_context")), blank(col("text")), col("content")).alias("indexed_text"),
    )


def parsed_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Layout blocks of all *.parsed.json files of a folder in reading order."""
    raw = spark.read.schema(f"doc_id string, source_file string, blocks array<struct<{_fields(BLOCK)}>>").option("multiLine", True).option("pathGlobFilter", "*.parsed.json").json(folder)
    return raw.select("doc_id", "source_file", F.posexplode("blocks").alias("ord", "b")).select("doc_id", "source_file", "ord", "b.*")


def turn_envelopes(lines: DataFrame, value: str = "value") -> DataFrame:
    """Turns of JSON envelopes, one a line, with body or without; lines that are no JSON come out with all null and are told by ok."""
    parsed = lines.select(F.from_json(F.col(value).cast("string"), f"body struct<{_fields(ENVELOPE)}>, {ENVELOPE}").alias("e"))
    body = lambda c: F.coalesce(F.col(f"e.body.{c}"), F.col(f"e.{c}")).alias(c)
    names = [p.strip().split(" ")[0] for p in ENVELOPE.split(", ")]
    return parsed.select(*[body(c) for c in names]).withColumn("ok", F.col("call_id").isNotNull() | F.col("transcript").isNotNull()).withColumn("ts", F.col("timestamp").try_cast("double"))


def call_id_of_url(url: Column) -> Column:
    """The first of call_id, session_id and conversation_id in the query of a URL; null where there is none."""
    get = lambda k: F.nullif(F.regexp_extract(F.coalesce(url, F.lit("")), rf"[?&]{k}=([^&#]+)", 1), F.lit(""))
    return F.coalesce(get("call_id"), get("session_id"), get("conversation_id"))


def call_id_of_message(message: Column) -> Column:
    get = lambda k: F.nullif(F.get_json_object(message, f"$.{k}"), F.lit(""))
    return F.coalesce(get("call_id"), get("session_id"), get("conversation_id"))


def audio_meta(message: Column) -> Column:
    """The record that goes with the next audio frame; null for messages of other types."""
    parsed = F.from_json(message, "type string, chunk_index int, bytes int, sent_at_ms bigint, system_rms double, mic_rms double")
    return F.when(parsed["type"] == "AUDIO_CHUNK_META", parsed)


def energy_of_log(line: Column) -> Column:
    """Levels of a log line of the recorder and whether each is above the floor of 0.003; null for other lines."""
    get = lambda k: F.regexp_extract(F.coalesce(line, F.lit("")), rf"{k}=([0-9.]+)", 1).try_cast("double")
    system, mic = get("system_rms"), get("mic_rms")
    return F.when(system.isNotNull() & mic.isNotNull(), F.struct(system.alias("system_rms"), mic.alias("mic_rms"), (system > 0.003).alias("system_active"), (mic > 0.003).alias("mic_active")))
