"""A stated set of queries against all rows: by one broadcast where the queries are measured to be few, else in blocks of both."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a chunk that meets a block of queries.
CHUNK_ROWS = 100_000


def against(rows: DataFrame, key: str, queries: DataFrame, query_key: str, n_blocks: int, prepare: Callable[[pd.DataFrame], object], score: Callable[[object, Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """score(prepare(queries), frames of rows) for all pairs of a block of queries and a chunk of rows, with the columns of schema. score sees the frames of a whole task, so that it can keep what is best of all of them.

    Rows of one query belong to one block. A single block is broadcast and the rows stay where they are; n_blocks must follow from the measured size of the queries. Several blocks meet chunks of rows by a shuffle: each row is sent
    once for every block and each query once for every chunk, nothing passes through the driver, and the plan does not grow with their number.
    """
    if n_blocks == 1:
        shared = rows.sparkSession.sparkContext.broadcast(prepare(queries.toArrow().to_pandas()))
        return rows.mapInPandas(lambda frames: score(shared.value, frames), schema)
    n_chunks = max(1, -(-rows.count() // chunk_rows))
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.withColumn("__chunk", F.pmod(F.xxhash64(key), F.lit(n_chunks)).cast("int")).withColumn("__block", numbers(n_blocks))
    right = queries.withColumn("__block", F.pmod(F.xxhash64(query_key), F.lit(n_blocks)).cast("int")).withColumn("__chunk", numbers(n_chunks))

    def both(chunk: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({c.split()[0]: [] for c in schema.split(", ")})
        if not len(chunk) or not len(block):
            return none
        found = list(score(prepare(block.reset_index(drop=True)), iter([chunk.reset_index(drop=True)])))
        return pd.concat(found, ignore_index=True) if found else none

    return left.groupBy("__chunk", "__block").cogroup(right.groupBy("__chunk", "__block")).applyInPandas(both, schema)
