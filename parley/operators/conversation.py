"""Turns, speaker runs, summaries and lookups of conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.functions.speakers import epoch_seconds, session_key, speaker_role
from parley.operators.ordered import blocked_lag, blocked_running_sum

#: Turns of one session are ordered in blocks of so many seconds.
BLOCK_SECONDS = 6 * 3600
SUMMARY_EVERY = 5


def ordered_turns(turns: DataFrame) -> DataFrame:
    """id, session, role, text, time, block of the turns that say something; blank texts are ignored, null times sort first."""
    text = F.coalesce("raw_text", F.lit(""))
    time = F.coalesce(epoch_seconds(F.col("ts")), F.lit(0.0))
    return turns.where(F.trim(text) != "").select("id", session_key(F.col("session_id")).alias("session"), speaker_role(F.col("speaker")).alias("role"), F.trim(text).alias("text"), time.alias("time"), F.floor(time / BLOCK_SECONDS).alias("block"))


def recent_turns(turns: DataFrame, n: int) -> DataFrame:
    """The last n turns of each session by time, then id. Of each block only its last n are ranked again, so that a hot session is not sorted in one task."""
    last = Window.partitionBy("session", "block").orderBy(F.desc("time"), F.desc("id"))
    near = turns.withColumn("__r", F.row_number().over(last)).where(F.col("__r") <= n).drop("__r")
    return near.withColumn("recency", F.row_number().over(Window.partitionBy("session").orderBy(F.desc("time"), F.desc("id")))).where(F.col("recency") <= n)


def speaker_runs(turns: DataFrame) -> DataFrame:
    """(session, run_no, part_no, role, text, n_turns, first_id): consecutive turns of one role make one, their texts joined by blanks. A run that goes on through several blocks of time comes out as so many ordered parts (part_no from 0), so that no row holds more than a block."""
    seen = blocked_lag(turns, ["session"], "block", ["time", "id"], F.col("role"), "before")
    starts = seen.withColumn("start", F.when(F.col("before").isNull() | (F.col("before") != F.col("role")), 1).otherwise(0))
    numbered = blocked_running_sum(starts, ["session"], "block", ["time", "id"], F.col("start"), "run_no")
    items = F.array_sort(F.collect_list(F.struct("time", "id", "text")))
    parts = numbered.groupBy("session", "block", "run_no", "role").agg(F.array_join(F.transform(items, lambda x: x["text"]), " ").alias("text"), F.count(F.lit(1)).alias("n_turns"), F.min_by("id", F.struct("time", "id")).alias("first_id"))
    return _in_parts(parts, numbered, "run_no").select("session", "run_no", "part_no", "role", "text", "n_turns", "first_id")


def _in_parts(parts: DataFrame, rows: DataFrame, number: str) -> DataFrame:
    """Adds part_no: the place of each part's block among those of its run. Blocks of runs with several are small rows; most runs have one."""
    several = rows.groupBy("session", number).agg(F.min("block").alias("__low"), F.max("block").alias("__high")).where("__low < __high").select("session", number)
    blocks = parts.select("session", number, "block").join(several, ["session", number], "left_semi")
    placed = blocks.withColumn("__part", F.row_number().over(Window.partitionBy("session", number).orderBy("block")) - 1)
    return parts.join(placed, ["session", number, "block"], "left").withColumn("part_no", F.coalesce("__part", F.lit(0)))


def question_turns(turns: DataFrame) -> DataFrame:
    """(session, turn_no, part_no, customer, assistant, worker): a customer's turn opens one; of the assistant's texts the last counts, those of workers are joined by lines. What comes before the first customer turn is turn 0.

    A turn that goes on through several blocks of time comes out as so many ordered parts, each with what is said in its block.
    """
    opened = F.when(F.col("role") == "Customer", 1).otherwise(0)
    numbered = blocked_running_sum(turns, ["session"], "block", ["time", "id"], opened, "turn_no")
    place = F.struct("time", "id")
    workers = F.array_sort(F.collect_list(F.when(F.col("role") == "Worker", F.struct("time", "id", "text"))))
    parts = numbered.groupBy("session", "block", "turn_no").agg(
        F.coalesce(F.max(F.when(F.col("role") == "Customer", F.col("text"))), F.lit("")).alias("customer"),
        F.coalesce(F.max_by("text", F.when(F.col("role") == "Assistant", place)), F.lit("")).alias("assistant"),
        F.array_join(F.transform(workers, lambda x: x["text"]), "\n").alias("worker"),
    )
    return _in_parts(parts, numbered, "turn_no").select("session", "turn_no", "part_no", "customer", "assistant", "worker")


def summary_points(turns: DataFrame, every: int = SUMMARY_EVERY) -> DataFrame:
    """(session, id, customer_turns): the customer turns at which a summary is due, each count once."""
    counted = blocked_running_sum(turns.where("role = 'Customer'"), ["session"], "block", ["time", "id"], F.lit(1), "customer_turns")
    return counted.where((F.col("customer_turns") >= every) & (F.col("customer_turns") % every == 0)).select("session", "id", "customer_turns")


def previous_sessions(summaries: DataFrame, user: str = "user_id", session: str = "session", at: str = "created_at", stretch: float = 4096.0) -> DataFrame:
    """Adds previous_session: of the same user, the latest other session that began before. summaries has a row for each user and session. Null users have none. A busy user's sessions are ordered in stretches of at."""
    known = summaries.where(F.col(user).isNotNull()).withColumn("__stretch", F.floor(F.col(at) / stretch))
    seen = blocked_lag(known, [user], "__stretch", [at, session], F.col(session), "previous_session").drop("__stretch")
    return seen.unionByName(summaries.where(F.col(user).isNull()).withColumn("previous_session", F.lit(None).cast("string")))


def merge_partials(partials: Column) -> Column:
    """Buffer of partial transcripts: an equal or shorter prefix is ignored, a continuation replaces the last, anything else is appended."""

    def fold(acc: Column, new: Column) -> Column:
        last = F.element_at(acc, -1)
        return (
            F.when(F.trim(new) == "", acc).when(F.size(acc) == 0, F.array(F.trim(new))).when(last.startswith(F.trim(new)), acc)
            .when(F.trim(new).startswith(last), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.trim(new)))).otherwise(F.concat(acc, F.array(F.trim(new))))
        )

    return F.aggregate(F.filter(partials, lambda x: x.isNotNull()), F.array().cast("array<string>"), lambda acc, x: F.when(F.size(acc) == 0, F.when(F.trim(x) == "", acc).otherwise(F.array(F.trim(x)))).otherwise(fold(acc, x)))
