"""Keyword search: corpus statistics, postings and BM25 scores."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.functions.text import keyword_tokens
from parley.operators.blocks import against
from parley.session import cut

# Fixed values of the scoring formula.
K1, B = 1.5, 0.75
#: Terms of all queries together that one block holds, some 32 MB; tokens of a chunk of records that meets one of several blocks.
QUERY_TERMS, CHUNK_TOKENS = 2_000_000, 4_000_000
#: What one step holds: tokens of records, cells of a tile of queries and records, pairs of postings and queries, and cells of the matrix of queries and common terms. An executor's Python workers hold this beside a full heap,
#: some ten arrays of each at a time; results do not depend on it.
TOKENS_AT_ONCE, CELLS_AT_ONCE, PAIRS_AT_ONCE, COMMON_CELLS = 250_000, 1_000_000, 250_000, 6_000_000
#: Terms are common from this share of all pairs of queries and records: adding up single pairs costs so much more than a product of matrices.
COMMON = 0.005


def tokenized(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, tokens); documents without tokens stay."""
    return docs.select(key, keyword_tokens(F.col(text)).alias("tokens"))


def corpus_statistics(tokens: DataFrame) -> DataFrame:
    """One row: n_docs, avg_len; documents without tokens count in both."""
    return tokens.agg(F.count(F.lit(1)).alias("n_docs"), F.avg(F.size("tokens")).alias("avg_len"))


def postings(tokens: DataFrame, key: str) -> DataFrame:
    """(term, key, tf, doc_len)."""
    return tokens.select(key, F.size("tokens").alias("doc_len"), F.explode("tokens").alias("term")).groupBy(key, "doc_len", "term").agg(F.count(F.lit(1)).alias("tf"))


def document_frequency(posted: DataFrame) -> DataFrame:
    return posted.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def idf(n_docs: Column, df: Column) -> Column:
    return F.log(1 + (n_docs - df + 0.5) / (df + 0.5))


@dataclass
class Index:
    """What the scoring of one corpus needs: the hashed tokens of its records, written once, and the two numbers of the corpus."""

    terms: DataFrame  # key, terms array<bigint>
    n_docs: int
    avg_len: float


def index(docs: DataFrame, key: str, text: str) -> Index:
    """Tokenizes all records once; tokens are 64-bit hashes from here on. Records without tokens count in both numbers."""
    terms = cut(docs.select(key, F.transform(keyword_tokens(F.col(text)), lambda t: F.xxhash64(t)).alias("terms")))
    stats = terms.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("terms")).alias("avg_len")).first()
    return Index(terms, stats["n"], stats["avg_len"] or 1.0)


def weighted_terms(made: Index, queries: DataFrame, query_key: str, query: str) -> DataFrame:
    """(query_key, term, times, idf) of the query terms that the corpus holds. Frequencies are counted in each task first, so that a frequent term is no single task."""
    wanted = queries.select(query_key, F.explode(F.transform(keyword_tokens(F.col(query)), lambda t: F.xxhash64(t))).alias("term")).groupBy(query_key, "term").agg(F.count(F.lit(1)).alias("times"))
    # counts first: a join before them would send every token of every record to the task of its term; where the wanted terms are broadcast, the planner filters below the counts by itself
    df = made.terms.select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).join(wanted.select("term").distinct(), "term", "left_semi")
    return wanted.join(df, "term").select(query_key, "term", "times", idf(F.lit(made.n_docs), F.col("df")).alias("idf"))


def _common(queried: np.ndarray, weight: np.ndarray, q: np.ndarray, times: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each term its column in the matrix of n queries and common terms, or -1, and that matrix with the times that queries hold terms. The share of records that hold a term follows from its weight."""
    share = np.exp(-weight) * queried / n
    chosen = np.argsort(-share, kind="stable")[: COMMON_CELLS // n]
    chosen = chosen[share[chosen] >= COMMON]
    column = np.full(len(weight), -1, dtype=np.int64)
    column[chosen] = np.arange(len(chosen))
    matrix = np.zeros((n, len(chosen)))
    for c, t in enumerate(chosen):
        matrix[q[at[t] : at[t + 1]], c] = times[at[t] : at[t + 1]]
    return column, matrix


class _Best:
    """The k best records of each of n queries so far: by rounded score, then key."""

    def __init__(self, n: int, k: int) -> None:
        self.k, self.floor = k, np.zeros(n)  # the score that a further record must reach
        self.q, self.keys, self.score = np.empty(0, np.int64), None, np.empty(0)
        self.waiting: list[tuple] = []
        self.n_waiting = 0

    def tile(self, score: np.ndarray, keys: np.ndarray, digits: int) -> None:
        """Scores of all queries and of records in the order of keys; 0 where they share no term."""
        may = (score >= (self.floor - 10.0**-digits)[:, None]) & (score > 0)
        i, j = np.nonzero(may)
        if len(i) > 4 * self.k * len(score):
            # most are among the first that are seen, so that k of each query are picked at once
            top = np.argsort(-np.where(may, score.round(digits), -1.0), axis=1, kind="stable")[:, : self.k]
            i, j = np.repeat(np.arange(len(score)), top.shape[1]), top.ravel()
            i, j = i[may[i, j]], j[may[i, j]]
        value = score[i, j].round(digits)
        enough = value >= self.floor[i]
        if enough.any():
            self.waiting.append((i[enough], keys[j[enough]], value[enough]))
            self.n_waiting += int(enough.sum())
        if self.n_waiting > self.k * len(score):
            self.settle()

    def settle(self) -> None:
        if not self.waiting:
            return
        parts = self.waiting + ([] if self.keys is None else [(self.q, self.keys, self.score)])
        q, keys, score = (np.concatenate([p[c] for p in parts]) for c in range(3))
        order = np.lexsort((np.unique(keys, return_inverse=True)[1] if keys.dtype == object else keys, -score, q))
        q = q[order]
        begins = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1])))
        place = np.arange(len(q)) - np.repeat(begins, np.diff(np.append(begins, len(q))))
        order, self.q, place = order[place < self.k], q[place < self.k], place[place < self.k]
        self.keys, self.score = keys[order], score[order]
        full = place == self.k - 1
        self.floor[self.q[full]] = self.score[full]
        self.waiting, self.n_waiting = [], 0


def bm25_best(made: Index, queries: DataFrame, k: int, key: str = "doc_id", query_key: str = "query_id", query: str = "query", among: DataFrame | None = None, digits: int = 6) -> DataFrame:
    """(query_key, key, score, rank): the k best records of each query by score, then key. A token that a query holds twice counts twice. Statistics are those of all records; with among, only records of its keys are scored. Null and empty queries match nothing.

    The terms of the queries go to the records, not the postings to the terms: each task adds up the scores of its records for all queries in tiles of bounded size and keeps the k best of each query over all its records, so that no
    frequent term is a key of any shuffle and no row is made for a pair. Terms that many queries and many records hold are a product of matrices; the pairs of the others are added up one by one.
    Up to QUERY_TERMS terms are broadcast; more meet the records in blocks.
    """
    kind, qkind = made.terms.schema[key].dataType.simpleString(), queries.schema[query_key].dataType.simpleString()
    terms = cut(weighted_terms(made, queries, query_key, query))
    n_blocks = max(1, -(-terms.count() // QUERY_TERMS))
    avg_len = made.avg_len
    most = max(k, 1)

    def prepare(rows: pd.DataFrame) -> tuple:
        ids, q = np.unique(rows[query_key].to_numpy(), return_inverse=True)
        order = np.argsort(rows["term"].to_numpy(), kind="stable")
        term, first = np.unique(rows["term"].to_numpy()[order], return_index=True)
        # every worker has its own copy of what is broadcast; times are whole numbers, exact in single precision
        return ids, term, rows["idf"].to_numpy()[order][first], np.append(first, len(order)), q[order].astype(np.int32), rows["times"].to_numpy()[order].astype(np.float32)

    def best(block: tuple, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, term, weight, at, q, times = block
        if not len(ids):
            return
        queried = np.diff(at)
        column, common = _common(queried, weight, q, times, at, len(ids))
        kept = _Best(len(ids), most)
        for frame in frames:
            order = np.argsort(frame[key].to_numpy(), kind="stable")
            keys, lists = frame[key].to_numpy()[order], frame["terms"].to_numpy()[order]
            length = np.array([0 if x is None else len(x) for x in lists], dtype=np.int64)
            # so many records at a time that their tokens fit
            for at_token in np.split(np.arange(len(lists)), np.flatnonzero(np.diff(np.cumsum(length) // TOKENS_AT_ONCE)) + 1):
                some = [x for x in lists[at_token] if x is not None and len(x)]
                if not some:
                    continue
                flat, doc = np.concatenate(some), np.repeat(at_token, length[at_token])
                place = np.minimum(np.searchsorted(term, flat), len(term) - 1)
                hit = term[place] == flat
                code, tf = np.unique(doc[hit] * len(term) + place[hit], return_counts=True)
                doc, t = np.divmod(code, len(term))
                value = weight[t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[doc] / avg_len))
                width = max(1, CELLS_AT_ONCE // len(ids))
                for low in range(at_token[0], at_token[-1] + 1, width):
                    size = min(width, at_token[-1] + 1 - low)
                    a, b = np.searchsorted(doc, (low, low + size))
                    dense = column[t[a:b]] >= 0
                    wide = np.zeros((common.shape[1], size))
                    wide[column[t[a:b][dense]], doc[a:b][dense] - low] = value[a:b][dense]
                    score = (common @ wide).ravel()
                    rare = np.arange(a, b)[~dense]
                    n = queried[t[rare]]
                    for part in np.split(np.arange(len(rare)), np.flatnonzero(np.diff(np.cumsum(n) // PAIRS_AT_ONCE)) + 1):
                        rep, many = np.repeat(rare[part], n[part]), n[part]
                        pair = at[t[rep]] + np.arange(len(rep)) - np.repeat(np.cumsum(many) - many, many)
                        score += np.bincount(q[pair] * size + (doc[rep] - low), value[rep] * times[pair], len(score))
                    kept.tile(score.reshape(len(ids), size), keys[low : low + size], digits)
            kept.settle()
        if len(kept.q):
            yield pd.DataFrame({query_key: ids[kept.q], key: kept.keys, "score": kept.score})

    scored = made.terms if among is None else made.terms.join(among.select(key).distinct(), key, "left_semi")
    found = against(scored, key, terms, query_key, n_blocks, prepare, best, f"{query_key} {qkind}, {key} {kind}, score double", chunk_rows=max(1, int(CHUNK_TOKENS / max(avg_len, 1.0))))
    w = Window.partitionBy(query_key).orderBy(F.desc("score"), F.col(key))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max(k, 1))


def bm25_of_pairs(made: Index, queries: DataFrame, pairs: DataFrame, key: str = "doc_id", query_key: str = "query_id", query: str = "query") -> DataFrame:
    """(query_key, key, score) of the given pairs that share a token; only their records' tokens are looked at."""
    terms = weighted_terms(made, queries, query_key, query)
    held = pairs.select(query_key, key).distinct().join(made.terms, key).select(query_key, key, F.size("terms").alias("len"), F.explode("terms").alias("term"))
    tf = F.col("tf")
    weight = F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.lit(made.avg_len)))
    return held.join(terms, [query_key, "term"]).groupBy(query_key, key, "term", "len", "times", "idf").agg(F.count(F.lit(1)).alias("tf")).groupBy(query_key, key).agg(F.sum(F.col("times") * weight).alias("score")).where("score > 0")


def top_k(scored: DataFrame, k: int, query_key: str = "query_id", key: str = "doc_id", score: str = "score", digits: int = 6) -> DataFrame:
    """The k best of each query with their rank; scores equal at digits places go by key, so that the order is total. Partial top-k runs before the shuffle by query."""
    w = Window.partitionBy(query_key).orderBy(F.round(score, digits).desc(), F.col(key))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max(k, 1)).withColumn(score, F.round(score, digits))
