"""Exact nearest neighbours: a stated set of queries against all rows, in blocks of bounded size."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parley.operators.blocks import against

#: Queries of one block; 64 floats each make two megabytes.
BLOCK = 4096


def _matrix(vectors: pd.Series, dim: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors, and which of the given ones they are: those of the length dim (else the most frequent one) that are neither null nor zero."""
    size = vectors.map(lambda v: -1 if v is None else len(v))
    if not (size > 0).any():
        return np.zeros((0, dim or 1)), np.zeros(0, dtype=np.int64)
    dim = dim or int(size[size > 0].mode()[0])
    where = np.flatnonzero(size == dim)
    if not len(where):
        return np.zeros((0, dim)), where
    x = np.stack(vectors.iloc[where].to_numpy()).astype(np.float64)
    norm = np.linalg.norm(x, axis=1)
    return x[norm > 0] / norm[norm > 0, None], where[norm > 0]


def nearest(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", query_key: str = "query_id", same: str | None = None, digits: int = 6) -> DataFrame:
    """(query_key, key, similarity, rank): the k rows of the highest cosine similarity for each query, rounded once to digits places, ties by key.

    Up to BLOCK queries are broadcast; more of them meet the rows in blocks. Every batch of rows keeps k of them for each query before the shuffle. With same, only rows of an equal column same are compared.
    Null vectors, and those of another length than most queries of the block or of norm zero, are left out.
    """
    kind, qkind = vectors.schema[key].dataType.simpleString(), queries.schema[query_key].dataType.simpleString()
    extra = [same] if same else []
    n_blocks = max(1, -(-queries.count() // BLOCK))

    def prepare(rows: pd.DataFrame) -> tuple:
        q, where = _matrix(rows[vector])
        rows = rows.iloc[where]
        return rows[query_key].to_numpy(), q, rows[same].to_numpy() if same else None

    def best(block: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        ids, q, groups = block
        x, where = _matrix(frame[vector], q.shape[1])
        if not len(x) or not len(q):
            return pd.DataFrame({query_key: [], key: [], "similarity": []})
        frame = frame.iloc[where]
        keys = frame[key].to_numpy()
        sims = np.round(q @ x.T, digits)
        if groups is not None:
            sims = np.where(groups[:, None] == frame[same].to_numpy()[None, :], sims, -2.0)
        order = np.argsort(keys, kind="stable")
        top = order[np.argsort(-sims[:, order], axis=1, kind="stable")[:, :k]]
        value = np.take_along_axis(sims, top, axis=1)
        keep = (value > -2.0).ravel()
        return pd.DataFrame({query_key: np.repeat(ids, top.shape[1])[keep], key: keys[top].ravel()[keep], "similarity": value.ravel()[keep]})

    found = against(vectors.select(key, vector, *extra), key, queries.select(query_key, vector, *extra), query_key, n_blocks, prepare, lambda block, frames: (best(block, frame) for frame in frames), f"{query_key} {qkind}, {key} {kind}, similarity double")
    w = Window.partitionBy(query_key).orderBy(F.col("similarity").desc(), F.col(key))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
