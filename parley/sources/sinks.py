"""Writing tables so that a repeated write of the same input leaves the same content."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.operators import lexical, storage


def write_partitioned(df: DataFrame, path: str, by: list[str], files: int = 64) -> None:
    """Overwrites the partitions that df has; keys with many rows are spread over up to files files by salt."""
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(*[c for c in df.columns if c not in by][:1] or by), F.lit(files)))
    salted.repartition(*by, "__salt").drop("__salt").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def write_index(docs: DataFrame, path: str, key: str, text: str, buckets: int = 64) -> None:
    """The keyword index as tables: postings sorted by term, document lengths, document frequencies and totals."""
    tokens = lexical.tokenized(docs, key, text)
    posted = lexical.postings(tokens, key)
    posted.repartition(buckets, "term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings")
    tokens.select(key, F.size("tokens").alias("doc_len")).write.mode("overwrite").parquet(f"{path}/lengths")
    lexical.document_frequency(posted).write.mode("overwrite").parquet(f"{path}/frequencies")
    lexical.corpus_statistics(tokens).write.mode("overwrite").parquet(f"{path}/totals")


def append_turns(turns: DataFrame, calls: DataFrame, turns_path: str, calls_path: str) -> None:
    """Appends turns, and the call rows that their sessions lack."""
    turns.write.mode("append").parquet(turns_path)
    new = turns.groupBy(F.col("session_id").alias("call_id")).agg(F.min("ts").alias("created_at"))
    storage.insert_or_ignore(calls, new, ["call_id"]).write.mode("append").parquet(calls_path)


def write_diagnostics(events: DataFrame, path: str) -> None:
    """Events as JSON lines by day, null fields left out."""
    events.withColumn("day", F.to_date(F.timestamp_millis("ts_ms"))).select("day", F.to_json(F.struct(*events.columns), {"ignoreNullFields": "true"}).alias("value")).write.mode("append").partitionBy("day").text(path)
