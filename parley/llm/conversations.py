"""Problem 5: whole conversations from message rows, treated as an event log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.functions.speakers import clean_speaker_role, epoch_seconds, session_key
from parley.llm.transcripts import BLOCK_SECONDS, Models, with_bits
from parley.operators.ordered import blocked_running_sum

SPOKEN_BIT = 16


def final_turns(turns: DataFrame) -> DataFrame:
    """Folds the rows of one record (session, trace_id) by arrival into its final turn: session, id, speaker, raw_text, ts, turn_id, event.

    The lowest id creates the turn. Later rows that all have its text are retries and change nothing; with another text among them the record is edited, and the last text counts, be it the first one again; one whose text
    is blank after a spoken one is a delete, which leaves the record's turn number but no text. Rows without trace_id stand for themselves. The turn keeps the time
    of its creation. Records are small; rows of one session are spread over all tasks by their trace.
    """
    meta = F.col("metadata")
    trace = F.coalesce(F.nullif(F.trim(meta["trace_id"]), F.lit("")), F.concat(F.lit("id:"), F.col("id").cast("string")))
    rows = turns.select(session_key(F.col("session_id")).alias("session"), trace.alias("trace"), "id", "speaker", "raw_text", "ts", meta["turn_id"].alias("turn_id"))
    folded = rows.groupBy("session", "trace").agg(
        F.min_by(F.struct("id", "speaker", "ts", "turn_id", F.col("raw_text").alias("first_text")), "id").alias("created"),
        F.max_by(F.struct(F.col("raw_text").alias("text")), "id").alias("last"),
        F.count(F.lit(1)).alias("versions"),
        F.min(F.coalesce("raw_text", F.lit(""))).alias("low"),
        F.max(F.coalesce("raw_text", F.lit(""))).alias("high"),
    )
    text, first = F.col("last.text"), F.col("created.first_text")
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    event = F.when(F.col("versions") == 1, "create").when(F.col("low") == F.col("high"), "retry").when(blank(text) & ~blank(first), "delete").otherwise("edit")
    return folded.select("session", "created.id", "created.speaker", "created.ts", "created.turn_id", text.alias("raw_text"), event.alias("event"))


def _judged(turns: DataFrame, model: Models) -> DataFrame:
    spoken = F.col("bits").bitwiseAND(F.lit(SPOKEN_BIT)) != 0
    return with_bits(final_turns(turns), model).withColumn("spoken", spoken).withColumn("role", clean_speaker_role(F.col("speaker"))).drop("bits")


def _by_session(judged: DataFrame) -> DataFrame:
    """Per session: what is spoken and by whom, and whether the turn numbers run 1, 2, ... without a gap."""
    number = F.expr("try_cast(trim(turn_id) as bigint)")
    spoken = F.col("spoken")
    # one row for each number first, so that a session with most of the rows is summed up everywhere
    numbers = judged.groupBy("session", number.alias("number")).agg(
        F.bool_or(spoken).alias("any"), F.bool_or(spoken & F.col("role").isin("Worker", "Assistant")).alias("reply"), F.bool_or(spoken & (F.col("role") == "Customer")).alias("customer")
    )
    return numbers.groupBy("session").agg(
        F.bool_or("any").alias("any"), F.bool_or("reply").alias("reply"), F.bool_or("customer").alias("customer"), F.count("number").alias("n"), F.min("number").alias("low"), F.max("number").alias("high")
    )


def found(turns: DataFrame, model: Models) -> DataFrame:
    """(session_id, defect) of every session: empty; else no_reply, no_customer; and broken. Null ids form the session of the empty string; sessions without turn numbers are not broken."""
    broken = (F.col("n") > 0) & ((F.col("low") != 1) | (F.col("high") != F.col("n")))
    defects = F.array_compact(
        F.array(
            F.when(~F.col("any"), F.lit("empty")),
            F.when(F.col("any") & ~F.col("reply"), F.lit("no_reply")),
            F.when(F.col("any") & ~F.col("customer"), F.lit("no_customer")),
            F.when(broken, F.lit("broken")),
        )
    )
    return _by_session(_judged(turns, model)).select(F.col("session").alias("session_id"), F.explode(defects).alias("defect"))


def conversations(turns: DataFrame, model: Models) -> DataFrame:
    """The turns of the sessions without defect, in order of time, then id: (session_id, seq, role, id, ts, text, event). Turns without a spoken word are left out."""
    judged = _judged(turns, model).withColumn("time", F.coalesce(epoch_seconds(F.col("ts")), F.lit(0.0)))
    good = _by_session(judged).where("any and reply and customer and (n = 0 or (low = 1 and high = n))").select("session")
    kept = judged.where("spoken").join(good, "session", "left_semi").withColumn("block", F.floor(F.col("time") / BLOCK_SECONDS))
    numbered = blocked_running_sum(kept, ["session"], "block", ["time", "id"], F.lit(1), "seq")
    return numbered.select(F.col("session").alias("session_id"), "seq", "role", "id", F.col("time").alias("ts"), F.col("raw_text").alias("text"), "event")
