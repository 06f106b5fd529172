"""Order-dependent operators whose work is split inside a key, so that a key with a third of all rows is no single task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def blocked_lag(df: DataFrame, keys: list[str], block: str, order: list[str], value: Column, out: str, ahead: bool = False) -> DataFrame:
    """Adds out: value of the row before, in the order of block and then order, among the rows of equal keys; null at the first. With ahead, of the row after; null at the last.

    block must not decrease along the order. Rows are sorted within (keys, block) only; one row for each block carries its last value across.
    The order has to be total, otherwise which of two equal rows comes first is open. value must not be null where it is to be seen.
    """
    inner = Window.partitionBy(*keys, block).orderBy(*[F.col(c).desc() for c in order] if ahead else order)
    outer = Window.partitionBy(*keys).orderBy(F.col(block).desc() if ahead else F.col(block))
    edge = (F.min_by if ahead else F.max_by)(F.struct(value.alias("v")), F.struct(*order))
    edges = df.groupBy(*keys, block).agg(edge.alias("__lag_last")).withColumn("__lag_edge", F.lag("__lag_last").over(outer)).select(*keys, block, "__lag_edge")
    return (
        df.withColumn("__lag_here", F.lag(F.struct(value.alias("v"))).over(inner))
        .join(edges, [*keys, block])
        .withColumn(out, F.coalesce("__lag_here", "__lag_edge").getField("v"))
        .drop("__lag_here", "__lag_edge")
    )


def blocked_last(df: DataFrame, keys: list[str], block: str, order: list[str], values: dict[str, Column]) -> DataFrame:
    """Adds for each name the last value that is not null up to and with the row, in the order of block and then order, among the rows of equal keys."""
    inner = Window.partitionBy(*keys, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    outer = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    last = [F.max_by(v, F.when(v.isNotNull(), F.struct(*order))).alias(f"__of_{n}") for n, v in values.items()]
    edges = df.groupBy(*keys, block).agg(*last).select(*keys, block, *[F.last(f"__of_{n}", ignorenulls=True).over(outer).alias(f"__before_{n}") for n in values])
    seen = df.withColumns({f"__in_{n}": F.last(v, ignorenulls=True).over(inner) for n, v in values.items()}).join(edges, [*keys, block])
    return seen.withColumns({n: F.coalesce(f"__in_{n}", f"__before_{n}") for n in values}).drop(*[f"__in_{n}" for n in values], *[f"__before_{n}" for n in values])


def blocked_running_sum(df: DataFrame, keys: list[str], block: str, order: list[str], amount: Column, out: str) -> DataFrame:
    """Adds out: the sum of amount up to and with the row, in the order of block and then order, among the rows of equal keys."""
    inner = Window.partitionBy(*keys, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edges = (
        df.groupBy(*keys, block)
        .agg(F.sum(amount).alias("__block_sum"))
        .withColumn("__carried", F.sum("__block_sum").over(Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)))
        .select(*keys, block, "__carried")
    )
    return df.withColumn("__inner_sum", F.sum(amount).over(inner)).join(edges, [*keys, block]).withColumn(out, F.col("__inner_sum") + F.coalesce("__carried", F.lit(0))).drop("__inner_sum", "__carried")


def made_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that later steps may read, or filter by, any number of times: a generated row is made before them, where a mere projection would be written into every use."""
    return df.select("*", F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("__made")).select("*", *[F.col(f"__made.{n}") for n in columns]).drop("__made")
