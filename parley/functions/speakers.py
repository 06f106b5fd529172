"""Speaker names and session ids as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names under which the two sides of a call are known.
CUSTOMER_NAMES = ("customer", "client", "caller", "prospect")
WORKER_NAMES = ("worker", "manager", "agent", "advisor", "rm", "relationship manager", "salesperson")
ASSISTANT_NAMES = ("assistant",)
#: Further spellings that occur in recorded labels.
CUSTOMER_ALSO = ("cust", "kunde", "cliente", "kundin")
WORKER_ALSO = ("advisor desk", "berater", "operator", "agente")
FOUR_NAMES = ("Customer", "Worker", "Assistant", "Unknown")


def speaker_role(speaker: Column) -> Column:
    """One of the four names by the fixed synonyms, after trimming and lower-casing; Unknown for all else, null included."""
    name = F.lower(F.trim(speaker))
    return (
        F.when(name.isin(*CUSTOMER_NAMES), "Customer").when(name.isin(*WORKER_NAMES), "Worker").when(name.isin(*ASSISTANT_NAMES), "Assistant").otherwise("Unknown")
    )


def clean_speaker_role(speaker: Column) -> Column:
    """As speaker_role, and also through punctuation around the name and further spellings."""
    name = F.regexp_replace(F.lower(speaker), r"^[^\p{L}]+|[^\p{L}]+$", "")
    return (
        F.when(name.isin(*CUSTOMER_NAMES, *CUSTOMER_ALSO), "Customer")
        .when(name.isin(*WORKER_NAMES, *WORKER_ALSO), "Worker")
        .when(name.isin(*ASSISTANT_NAMES), "Assistant")
        .otherwise("Unknown")
    )


def workflow_target(role: Column) -> Column:
    return (
        F.when(role == "Customer", "live_assist_customer_turn")
        .when(role == "Worker", "context_update_only")
        .when(role == "Assistant", "assistant_answer")
        .otherwise("generic_live_feedback")
    )


def session_key(session_id: Column) -> Column:
    """Lower case without outer blanks; null and blank ids become the empty string."""
    return F.coalesce(F.lower(F.regexp_replace(session_id, r"^\s+|\s+$", "")), F.lit(""))


def epoch_seconds(ts: Column) -> Column:
    """Seconds, whether ts was recorded in seconds, milliseconds or microseconds."""
    return F.when(F.abs(ts) > 1e14, ts / 1e6).when(F.abs(ts) > 1e11, ts / 1e3).otherwise(ts)
