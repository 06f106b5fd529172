"""Packets, activity and echo over event rows (key, time in seconds, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.functions.text import text_similarity
from parley.operators.ordered import blocked_lag, blocked_running_sum

# Fixed values of the stream.
PACKET_BYTES = 12288
LOOK_BACK = 2.5
ECHO_STRONG, ECHO_WEAK, ECHO_MIN_CHARS = 0.78, 0.60, 4


def channel_activity(left: Column, right: Column, threshold: Column | float) -> Column:
    """Which of two levels exceeds the threshold; null levels count as silence."""
    a, b = F.coalesce(left > threshold, F.lit(False)), F.coalesce(right > threshold, F.lit(False))
    return F.when(a & b, "both_active").when(a, "customer_only").when(b, "worker_only").otherwise("silence")


def dominance(left: Column, right: Column, ratio: float = 2.5) -> Column:
    return F.when(left > right * ratio, "system").when(right > left * ratio, "mic").otherwise("mixed")


def look_back(events: DataFrame, key: str, time: str, value: str, seconds: float) -> DataFrame:
    """Adds recent_n, recent_max and recent_sum of the rows of the key up to so many seconds before, the row itself included.

    Time is cut into blocks of the window's length; each row is also sent to the next block, so that one key's rows are spread over as many tasks as it has blocks.
    """
    marked = events.withColumn("__block", F.floor(F.col(time) / seconds)).withColumn("__micros", F.round(F.col(time) * 1e6).cast("long"))
    twice = marked.withColumn("__own", F.lit(True)).unionByName(marked.withColumn("__block", F.col("__block") + 1).withColumn("__own", F.lit(False)))
    w = Window.partitionBy(key, "__block").orderBy("__micros").rangeBetween(-round(seconds * 1e6), 0)
    out = twice.withColumns({"recent_n": F.count(F.lit(1)).over(w), "recent_max": F.max(value).over(w), "recent_sum": F.sum(value).over(w)})
    return out.where("__own").drop("__own", "__block", "__micros")


def run_lengths(events: DataFrame, key: str, order: list[str], block: Column, flag: Column) -> DataFrame:
    """(key, run_no, n, first, last): lengths of the runs of rows for which flag holds."""
    marked = events.select(key, *order, block.alias("__block"), F.coalesce(flag, F.lit(False)).alias("__flag"))
    seen = blocked_lag(marked, [key], "__block", order, F.col("__flag"), "__before")
    starts = F.when(F.col("__flag") & ~F.coalesce("__before", F.lit(False)), 1).otherwise(0)
    numbered = blocked_running_sum(seen, [key], "__block", order, starts, "run_no").where("__flag")
    return numbered.groupBy(key, "run_no").agg(F.count(F.lit(1)).alias("n"), F.min(order[0]).alias("first"), F.max(order[0]).alias("last"))


def sequence_gaps(packets: DataFrame, key: str, seq: str, arrival: str, block: Column) -> DataFrame:
    """Rows whose sequence number is not that of the packet before plus one: missing (numbers skipped) or out_of_order."""
    seen = blocked_lag(packets.select(key, seq, arrival, block.alias("__block")), [key], "__block", [arrival], F.col(seq), "before")
    gap = F.col(seq) - (F.col("before") + 1)
    return seen.where(F.col("before").isNotNull() & (gap != 0)).select(key, seq, arrival, "before", gap.alias("gap"), F.when(gap > 0, "missing").otherwise("out_of_order").alias("kind"))


def rebatched(frames: DataFrame, key: str, order: list[str], block: Column, size: Column, packet: int = PACKET_BYTES) -> DataFrame:
    """(key, packet_no, bytes, first): how frames of any size fall into packets of fixed size; a frame that spans packets counts in each with its share."""
    marked = frames.select(key, *order, block.alias("__block"), F.coalesce(size, F.lit(0)).cast("long").alias("__size"))
    summed = blocked_running_sum(marked, [key], "__block", order, F.col("__size"), "__end").withColumn("__start", F.col("__end") - F.col("__size")).where("__size > 0")
    spread = summed.select(key, order[0], "__start", "__end", F.explode(F.sequence(F.floor(F.col("__start") / packet), F.floor((F.col("__end") - 1) / packet))).alias("packet_no"))
    share = F.least(F.col("__end"), (F.col("packet_no") + 1) * packet) - F.greatest(F.col("__start"), F.col("packet_no") * packet)
    return spread.groupBy(key, "packet_no").agg(F.sum(share).alias("bytes"), F.min(order[0]).alias("first"))


def interval_pairs(left: DataFrame, right: DataFrame, key: str, time: str, seconds: float) -> DataFrame:
    """Pairs (l, r) of equal key with 0 <= l.time - r.time <= seconds, as an equality join on blocks of time: each right row stands in its own block and the next."""
    l = left.select(F.struct("*").alias("l"), F.col(key).alias("__key"), F.floor(F.col(time) / seconds).alias("__block"))  # noqa: E741
    r = right.select(F.struct("*").alias("r"), F.col(key).alias("__key"), F.explode(F.array(F.floor(F.col(time) / seconds), F.floor(F.col(time) / seconds) + 1)).alias("__block"))
    age = F.col(f"l.{time}") - F.col(f"r.{time}")
    return l.join(r, ["__key", "__block"]).where((age >= 0) & (age <= seconds)).select("l", "r")


def echoes(worker: DataFrame, customer: DataFrame, key: str = "session", time: str = "time", text: str = "text", seconds: float = LOOK_BACK) -> DataFrame:
    """Best match of each worker text among the customer texts of the seconds before: (id, similarity, matched_id, kind strong, weak or none). Texts of fewer than ECHO_MIN_CHARS are not compared."""
    pairs = interval_pairs(worker.where(F.length(text) >= ECHO_MIN_CHARS), customer.where(F.length(text) >= ECHO_MIN_CHARS), key, time, seconds)
    scored = pairs.select(F.col("l.id").alias("id"), F.col("r.id").alias("other"), F.round(text_similarity(F.col(f"l.{text}"), F.col(f"r.{text}")), 6).alias("similarity"))
    best = scored.groupBy("id").agg(F.max_by(F.struct("other", "similarity"), F.struct("similarity", (-F.col("other")).alias("o"))).alias("b"))
    s = F.col("b.similarity")
    return best.select("id", s.alias("similarity"), F.col("b.other").alias("matched_id"), F.when(s >= ECHO_STRONG, "strong").when(s >= ECHO_WEAK, "weak").otherwise("none").alias("kind"))


def paired_in_order(left: DataFrame, right: DataFrame, key: str, order: list[str], block: str) -> DataFrame:
    """(key, n, l, r): the n-th row of left of each key with the n-th of right, as structs; rows without a partner stay out. Both are numbered in blocks of block, which must not decrease along the order."""
    number = lambda df, name: blocked_running_sum(df, [key], block, order, F.lit(1), "n").select(key, "n", F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name))
    return number(left, "l").join(number(right, "r"), [key, "n"])


def mixed(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, left, right): both channels by packet; where one has no packet it counts as zero."""
    a, b = left.select(*keys, F.col(value).alias("left")), right.select(*keys, F.col(value).alias("right"))
    return a.join(b, keys, "full_outer").fillna(0, ["left", "right"])


def packet_bytes(chunk_size: Column | int, buffers: Column | int) -> Column:
    """Bytes of a packet of so many buffers of 16-bit samples."""
    return F.lit(chunk_size) * F.lit(buffers) * 2
