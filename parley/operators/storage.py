"""Keyed upserts and deletions over immutable tables, as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions.vector import dot


def last_by_key(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The row of the highest order for each key; the order has to be total within a key. Partial results are combined before the shuffle, so that a hot key is no single task."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in rest]), order).alias("__row")).select(*keys, *[F.col(f"__row.`{c}`").alias(c) for c in rest])


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows of new replace those of old with equal keys; the columns keep stay as they were in replaced rows. Null keys match one another."""
    o, n = old.alias("o"), new.alias("n")
    match = [F.col(f"o.`{k}`").eqNullSafe(F.col(f"n.`{k}`")) for k in keys]
    both = o.withColumn("__old", F.lit(True)).alias("o").join(n.withColumn("__new", F.lit(True)).alias("n"), match, "full_outer")
    is_new, is_old = F.col("n.__new").isNotNull(), F.col("o.__old").isNotNull()
    pick = lambda c: F.when(is_new & ~(is_old & F.lit(c in keep)), F.col(f"n.`{c}`")).otherwise(F.col(f"o.`{c}`")).alias(c)
    return both.select(*[pick(c) for c in old.columns])


def insert_or_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new whose keys old does not have; equal new keys come once, by the least row."""
    rest = [c for c in new.columns if c not in keys]
    once = new.groupBy(*keys).agg(*([F.min(F.struct(*rest)).alias("__row")] if rest else []))
    once = once.select(*keys, *[F.col(f"__row.`{c}`").alias(c) for c in rest])
    return once.join(old.select(*keys).distinct(), keys, "left_anti")


def unexpired(rows: DataFrame, at: Column, now: Column, days: float) -> DataFrame:
    """Rows not older than so many days at now; rows without time count as expired."""
    return rows.where(F.coalesce(now - at <= days * 86400, F.lit(False)))


def without_document(rows: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among the deleted ones; rows of a null key stay."""
    return rows.join(deleted.select(key).distinct(), key, "left_anti")


def similar_cached(asked: DataFrame, entries: DataFrame, vector: str = "vector", session: str = "session", at: str = "at", least: float = 0.97, max_age: float = 7 * 86400.0) -> DataFrame:
    """(query_id, entry_id, similarity): for each question the most similar entry of its session that was stored before it, no longer ago than max_age, with a vector of equal length and a similarity of at least least; none where there is none. Of equal ones the latest counts, then the lowest id.

    asked has query_id, entries entry_id; both have session, at and a unit vector. They meet by session and stretch of max_age, so that a busy session is spread over time.
    """
    stretch = lambda c: F.floor(F.col(c) / max_age)
    q = asked.select("query_id", F.col(session).alias("s"), F.col(at).alias("q_at"), F.col(vector).alias("q_v"), F.explode(F.array(stretch(at), stretch(at) - 1)).alias("t"))
    e = entries.select("entry_id", F.col(session).alias("s"), F.col(at).alias("e_at"), F.col(vector).alias("e_v"), stretch(at).alias("t"))
    near = q.join(e, ["s", "t"]).where((F.col("e_at") < F.col("q_at")) & (F.col("q_at") - F.col("e_at") <= max_age) & (F.size("q_v") == F.size("e_v")))
    scored = near.withColumn("similarity", F.round(dot(F.col("q_v"), F.col("e_v")), 6)).where(F.col("similarity") >= least)
    best = scored.groupBy("query_id").agg(F.max_by(F.struct("entry_id", "similarity"), F.struct("similarity", "e_at", -F.col("entry_id"))).alias("b"))
    return asked.select("query_id").join(best, "query_id", "left").select("query_id", "b.entry_id", "b.similarity")
