"""Queries of turns, sessions and events over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parley.functions.speakers import ASSISTANT_NAMES, CUSTOMER_NAMES, WORKER_NAMES, epoch_seconds, session_key, speaker_role, workflow_target
from parley.functions.text import echo_words
from parley.operators import conversation, signals, storage
from parley.operators.ordered import blocked_lag, blocked_running_sum
from parley.session import table

DAY = 86400.0


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.ordered_turns(table(spark, sf_dir, "transcript_turns"))


def speaker_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    role = speaker_role(F.col("speaker"))
    return table(spark, sf_dir, "transcript_turns").select("id", role.alias("role"), workflow_target(role).alias("target"))


def role_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _turns(spark, sf_dir)
    return turns.groupBy("session").agg(*[F.count_if(F.col("role") == r).alias(r.lower()) for r in ("Customer", "Worker", "Assistant", "Unknown")])


def recent_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.recent_turns(_turns(spark, sf_dir), 5).select("session", "id", "role", "recency")


def speaker_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.speaker_runs(_turns(spark, sf_dir)).select("session", "run_no", "part_no", "role", "n_turns", "first_id", F.md5("text").alias("text_md5"))


def qa_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = conversation.question_turns(_turns(spark, sf_dir))
    return made.select("session", "turn_no", "part_no", F.md5("customer").alias("customer_md5"), F.md5("assistant").alias("assistant_md5"), F.md5("worker").alias("worker_md5"))


def summary_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.summary_points(_turns(spark, sf_dir))


def running_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products of each session in the order in which they were first named."""
    turns = table(spark, sf_dir, "transcript_turns").where("product is not null and trim(product) <> ''")
    first = turns.select(session_key(F.col("session_id")).alias("session"), "product", epoch_seconds(F.col("ts")).alias("time"), "id").groupBy("session", "product").agg(F.min(F.struct("time", "id")).alias("at"))
    return first.groupBy("session").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "product"))), lambda x: x["product"]), ", ").alias("products"))


def echo_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "transcript_turns").select("id", F.md5(echo_words(F.col("raw_text"))).alias("echo_md5"))


def echo_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best match of each worker turn among the customer turns of its session in the 2.5 seconds before."""
    turns = _turns(spark, sf_dir).select("id", "session", "role", "time", "text")
    return signals.echoes(turns.where("role = 'Worker'"), turns.where("role = 'Customer'"))


def echo_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _turns(spark, sf_dir).select("id", "session", "role", "time")
    pairs = signals.interval_pairs(turns.where("role = 'Worker'"), turns.where("role = 'Customer'"), "session", "time", signals.LOOK_BACK)
    return pairs.select(F.col("l.id").alias("worker_id"), F.col("r.id").alias("customer_id"))


def previous_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each user and session of the answer workflow, the user's session before it by its first run."""
    states = table(spark, sf_dir, "live_assist_state").where("user_id is not null").groupBy("user_id", session_key(F.col("session_id")).alias("session")).agg(F.min("state_id").alias("created_at"))
    return conversation.previous_sessions(states).select("user_id", "session", "previous_session")


def current_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest summary and product context of each user and session."""
    states = table(spark, sf_dir, "live_assist_state").select("user_id", session_key(F.col("session_id")).alias("session"), "state_id", F.coalesce("running_summary", F.lit("")).alias("summary"), F.coalesce("product_context", F.lit("")).alias("products"))
    return storage.last_by_key(states, ["user_id", "session"], F.col("state_id")).select("user_id", "session", "state_id", F.md5("summary").alias("summary_md5"), "products")


def cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every question whose id is divisible by 50, the latest earlier run of any user with the very same question; similar ones of a session are found by similar_cache."""
    states = table(spark, sf_dir, "live_assist_state").select("state_id", F.lower(F.trim("question")).alias("q"), "route").where("q is not null")
    asked = states.where("state_id % 50 = 0").select(F.col("state_id").alias("query_id"), "q")
    stored = states.where("route = 'rag_answer'").select(F.col("state_id").alias("entry_id"), "q")
    hits = asked.join(stored, "q").where("entry_id < query_id").groupBy("query_id").agg(F.max("entry_id").alias("entry_id"))
    return asked.select("query_id").join(hits, "query_id", "left").withColumn("hit", F.col("entry_id").isNotNull())


def route_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = table(spark, sf_dir, "live_assist_state")
    return states.groupBy("route", "retrieval_mode").agg(F.count(F.lit(1)).alias("runs"), F.count_if("cache_hit").alias("hits"), F.round(F.avg(F.size("rag_top_chunks")), 6).alias("avg_chunks"))


def latest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One state per trace, the last of re-sent runs."""
    rows = table(spark, sf_dir, "live_assist_state").select("trace_id", "state_id", "route")
    return storage.last_by_key(rows, ["trace_id"], F.col("state_id"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.withColumn("time", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)


def activity_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the same user in the hour before each event, itself included."""
    out = signals.look_back(_events(spark, sf_dir).select("event_id", "user_id", "time", "value"), "user_id", "time", "value", 3600.0)
    return out.select("event_id", "recent_n", F.round("recent_max", 6).alias("recent_max"))


def channel_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root mean square of each user's clicks and views by hour, and which of them exceed 100."""
    e = _events(spark, sf_dir).where("event_type in ('click', 'view')").groupBy("user_id", F.date_trunc("hour", "ts").alias("hour"))
    level = lambda k: F.sqrt(F.avg(F.when(F.col("event_type") == k, F.col("value") * F.col("value"))))
    sums = e.agg(level("click").alias("left"), level("view").alias("right"))
    return sums.select("user_id", "hour", F.round("left", 6).alias("left"), F.round("right", 6).alias("right"), signals.channel_activity(F.col("left"), F.col("right"), 100.0).alias("activity"))


def run_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of consecutive events of a user with a value below 50."""
    e = _events(spark, sf_dir)
    return signals.run_lengths(e, "user_id", ["time", "event_id"], F.floor(F.col("time") / DAY), F.col("value") < 50).select("user_id", "run_no", "n")


def sequence_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jumps of the number in props between consecutive events of a user."""
    e = _events(spark, sf_dir).select("user_id", "event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("seq"), F.floor(F.col("time") / DAY).alias("day")).where("seq is not null")
    return signals.sequence_gaps(e, "user_id", "seq", "event_id", F.col("day")).select("user_id", "event_id", "gap", "kind")


def byte_rebatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as frames of value x 100 bytes, cut into packets of 12288 bytes by user."""
    e = _events(spark, sf_dir).withColumn("bytes", F.floor(F.col("value") * 100))
    return signals.rebatched(e, "user_id", ["time", "event_id"], F.floor(F.col("time") / DAY), F.col("bytes")).select("user_id", "packet_no", "bytes")


def event_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    return e.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("day"), "event_type", "n", "total")


def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of each user: events less than six hours apart. A busy user's events are ordered by day."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", F.to_date("ts").alias("day"))
    seen = blocked_lag(e, ["user_id"], "day", ["ts", "event_id"], F.col("ts"), "before")
    apart = F.when(F.col("before").isNull() | (F.col("ts") >= F.col("before") + F.expr("INTERVAL 6 HOURS")), 1).otherwise(0)
    numbered = blocked_running_sum(seen, ["user_id"], "day", ["ts", "event_id"], apart, "no")
    return numbered.groupBy("user_id", "no").agg(F.min("ts").alias("started_at"), F.count(F.lit(1)).alias("n")).select("user_id", "started_at", "n")


def event_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Milliseconds between consecutive events of a user, by day: mean and greatest."""
    e = _events(spark, sf_dir).select("user_id", "event_id", F.to_date("ts").alias("day"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    seen = blocked_lag(e, ["user_id"], "day", ["at", "event_id"], F.col("at"), "before").withColumn("ms", (F.col("at") - F.col("before")) / 1000).where("ms is not null")
    return seen.groupBy("day").agg(F.round(F.avg("ms"), 3).alias("avg_ms"), F.round(F.max("ms"), 3).alias("max_ms"))


def active_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open requests after each day if every event opens one that lasts value minutes."""
    e = _events(spark, sf_dir).select(F.to_date("ts").alias("start"), F.to_date(F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + (F.floor(F.col("value") * 60) * 1000000))).alias("end"))
    steps = e.select(F.col("start").alias("day"), F.lit(1).alias("d")).unionByName(e.select(F.col("end").alias("day"), F.lit(-1).alias("d"))).groupBy("day").agg(F.sum("d").alias("d"))
    # one row a day
    return steps.select("day", F.sum("d").over(Window.partitionBy(F.lit(0)).orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("open"))


def props_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))


QUERIES = {
    f.__name__: f
    for f in (
        speaker_normalise, role_counts, recent_turns, speaker_runs, qa_turns, summary_points, running_products, echo_forms, echo_matches, echo_candidates, previous_session, current_summary, cache_lookup,
        route_counts, latest_runs, activity_window, channel_activity, run_lengths, sequence_gaps, byte_rebatch, event_tumbling, event_sessions, event_latency, active_requests, props_extract,
    )
}

_in = lambda names: ", ".join(f"'{n}'" for n in names)
_ROLE = f"CASE WHEN lower(trim(speaker)) IN ({_in(CUSTOMER_NAMES)}) THEN 'Customer' WHEN lower(trim(speaker)) IN ({_in(WORKER_NAMES)}) THEN 'Worker' WHEN lower(trim(speaker)) IN ({_in(ASSISTANT_NAMES)}) THEN 'Assistant' ELSE 'Unknown' END"
_TIME = "(CASE WHEN abs(ts) > 1e14 THEN ts / 1e6 WHEN abs(ts) > 1e11 THEN ts / 1e3 ELSE ts END)"
_SESSION = r"coalesce(lower(regexp_replace(session_id, '^\s+|\s+$', '', 'g')), '')"
_T = f"t AS (SELECT id, {_SESSION} AS session, {_ROLE} AS role, trim(raw_text) AS text, coalesce({_TIME}, 0) AS time FROM transcript_turns WHERE trim(coalesce(raw_text, '')) <> '')"
_E = "e AS (SELECT *, epoch_us(ts) / 1e6 AS time FROM events)"

SQL = {
    "speaker_normalise": f"""WITH r AS (SELECT id, {_ROLE} AS role FROM transcript_turns)
        SELECT id, role, CASE role WHEN 'Customer' THEN 'live_assist_customer_turn' WHEN 'Worker' THEN 'context_update_only' WHEN 'Assistant' THEN 'assistant_answer' ELSE 'generic_live_feedback' END AS target FROM r""",
    "role_counts": f"WITH {_T} SELECT session, " + ", ".join(f"count(*) FILTER (role = '{r}') AS {r.lower()}" for r in ("Customer", "Worker", "Assistant", "Unknown")) + " FROM t GROUP BY session",
    "recent_turns": f"WITH {_T} SELECT session, id, role, recency::INT AS recency FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY time DESC, id DESC) AS recency FROM t) WHERE recency <= 5",
    "speaker_runs": f"""WITH {_T}, l AS (SELECT *, lag(role) OVER w AS before FROM t WINDOW w AS (PARTITION BY session ORDER BY time, id)),
        n AS (SELECT *, sum(CASE WHEN before IS NULL OR before <> role THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY time, id) AS run_no FROM l)
        SELECT session, run_no::BIGINT AS run_no, (row_number() OVER (PARTITION BY session, run_no ORDER BY block) - 1)::INT AS part_no, role, n_turns, first_id, text_md5
        FROM (SELECT session, run_no, floor(time / 21600) AS block, role, count(*) AS n_turns, arg_min(id, (time, id)) AS first_id, md5(string_agg(text, ' ' ORDER BY time, id)) AS text_md5 FROM n GROUP BY 1, 2, 3, 4)""",
    "qa_turns": f"""WITH {_T}, n AS (SELECT *, sum(CASE WHEN role = 'Customer' THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY time, id) AS turn_no FROM t)
        SELECT session, turn_no::BIGINT AS turn_no, (row_number() OVER (PARTITION BY session, turn_no ORDER BY block) - 1)::INT AS part_no, customer_md5, assistant_md5, worker_md5
        FROM (SELECT session, turn_no, floor(time / 21600) AS block, md5(coalesce(max(text) FILTER (role = 'Customer'), '')) AS customer_md5, md5(coalesce(arg_max(text, (time, id)) FILTER (role = 'Assistant'), '')) AS assistant_md5,
               md5(coalesce(string_agg(text, chr(10) ORDER BY time, id) FILTER (role = 'Worker'), '')) AS worker_md5 FROM n GROUP BY 1, 2, 3)""",
    "summary_points": f"""WITH {_T}, c AS (SELECT session, id, row_number() OVER (PARTITION BY session ORDER BY time, id) AS customer_turns FROM t WHERE role = 'Customer')
        SELECT * FROM c WHERE customer_turns >= 5 AND customer_turns % 5 = 0""",
    "running_products": f"""WITH f AS (SELECT {_SESSION} AS session, product, min(({_TIME}, id)) AS first_at FROM transcript_turns WHERE product IS NOT NULL AND trim(product) <> '' GROUP BY 1, 2)
        SELECT session, string_agg(product, ', ' ORDER BY first_at, product) AS products FROM f GROUP BY session""",
    "echo_forms": r"""SELECT id, md5(array_to_string(list_filter(string_split_regex(regexp_replace(lower(coalesce(raw_text, '')), '[^a-z0-9\s]', ' ', 'g'), '\s+'), lambda w: w <> '' AND w NOT IN ('um', 'uh', 'er', 'ah', 'like', 'okay', 'ok')), ' ')) AS echo_md5 FROM transcript_turns""",
    "echo_candidates": f"WITH {_T} SELECT a.id AS worker_id, b.id AS customer_id FROM t a JOIN t b ON a.session = b.session AND a.role = 'Worker' AND b.role = 'Customer' AND a.time - b.time BETWEEN 0 AND 2.5",
    "previous_session": f"""WITH s AS (SELECT user_id, {_SESSION} AS session, min(state_id) AS first_id FROM live_assist_state WHERE user_id IS NOT NULL GROUP BY 1, 2)
        SELECT user_id, session, lag(session) OVER (PARTITION BY user_id ORDER BY first_id, session) AS previous_session FROM s""",
    "current_summary": f"""SELECT user_id, {_SESSION} AS session, max(state_id) AS state_id, md5(arg_max(coalesce(running_summary, ''), state_id)) AS summary_md5, arg_max(coalesce(product_context, ''), state_id) AS products FROM live_assist_state GROUP BY 1, 2""",
    "cache_lookup": """WITH s AS (SELECT state_id, lower(trim(question)) AS q, route FROM live_assist_state WHERE question IS NOT NULL)
        SELECT a.state_id AS query_id, max(b.state_id) AS entry_id, max(b.state_id) IS NOT NULL AS hit FROM s a LEFT JOIN s b ON a.q = b.q AND b.route = 'rag_answer' AND b.state_id < a.state_id WHERE a.state_id % 50 = 0 GROUP BY 1""",
    "route_counts": "SELECT route, retrieval_mode, count(*) AS runs, count(*) FILTER (cache_hit) AS hits, round(avg(len(rag_top_chunks)), 6) AS avg_chunks FROM live_assist_state GROUP BY 1, 2",
    "latest_runs": "SELECT trace_id, max(state_id) AS state_id, arg_max(route, state_id) AS route FROM live_assist_state GROUP BY 1",
    "activity_window": f"""WITH {_E} SELECT event_id, count(*) OVER w AS recent_n, round(max(value) OVER w, 6) AS recent_max FROM e WINDOW w AS (PARTITION BY user_id ORDER BY time RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW)""",
    "channel_activity": """WITH s AS (SELECT user_id, date_trunc('hour', ts) AS hour, sqrt(avg(value * value) FILTER (event_type = 'click')) AS l, sqrt(avg(value * value) FILTER (event_type = 'view')) AS r FROM events WHERE event_type IN ('click', 'view') GROUP BY 1, 2)
        SELECT user_id, hour, round(l, 6) AS left, round(r, 6) AS right, CASE WHEN l > 100 AND r > 100 THEN 'both_active' WHEN l > 100 THEN 'customer_only' WHEN r > 100 THEN 'worker_only' ELSE 'silence' END AS activity FROM s""",
    "run_lengths": f"""WITH {_E}, f AS (SELECT *, value < 50 AS f, lag(value < 50) OVER w AS b FROM e WINDOW w AS (PARTITION BY user_id ORDER BY time, event_id)),
        n AS (SELECT *, sum(CASE WHEN f AND NOT coalesce(b, false) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY time, event_id) AS run_no FROM f)
        SELECT user_id, run_no::BIGINT AS run_no, count(*) AS n FROM n WHERE f GROUP BY 1, 2""",
    "sequence_gaps": """WITH p AS (SELECT user_id, event_id, try_cast(props->>'$.k' AS BIGINT) AS seq, floor(epoch_us(ts) / 1e6 / 86400) AS day FROM events WHERE try_cast(props->>'$.k' AS BIGINT) IS NOT NULL),
        l AS (SELECT *, seq - (lag(seq) OVER (PARTITION BY user_id ORDER BY day, event_id) + 1) AS gap FROM p)
        SELECT user_id, event_id, gap, CASE WHEN gap > 0 THEN 'missing' ELSE 'out_of_order' END AS kind FROM l WHERE gap <> 0""",
    "byte_rebatch": f"""WITH {_E}, b AS (SELECT user_id, floor(value * 100)::BIGINT AS s, sum(floor(value * 100)::BIGINT) OVER (PARTITION BY user_id ORDER BY time, event_id)::BIGINT AS e2 FROM e),
        x AS (SELECT user_id, e2 - s AS st, e2 AS en, unnest(range((e2 - s) // 12288, (e2 - 1) // 12288 + 1)) AS packet_no FROM b WHERE s > 0)
        SELECT user_id, packet_no, sum(least(en, (packet_no + 1) * 12288) - greatest(st, packet_no * 12288))::BIGINT AS bytes FROM x GROUP BY 1, 2""",
    "event_tumbling": "SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "event_sessions": """WITH l AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS f FROM events),
        n AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM l) SELECT user_id, min(ts) AS started_at, count(*) AS n FROM n GROUP BY user_id, s""",
    "event_latency": """WITH l AS (SELECT ts, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 1000.0 AS ms FROM events) SELECT ts::DATE AS day, round(avg(ms), 3) AS avg_ms, round(max(ms), 3) AS max_ms FROM l WHERE ms IS NOT NULL GROUP BY 1""",
    "active_requests": """WITH s AS (SELECT ts::DATE AS day, 1 AS d FROM events UNION ALL SELECT (ts + to_seconds(floor(value * 60)::BIGINT))::DATE, -1 FROM events), g AS (SELECT day, sum(d) AS d FROM s GROUP BY day)
        SELECT day, (sum(d) OVER (ORDER BY day))::BIGINT AS open FROM g""",
    "props_extract": "SELECT event_id, try_cast(props->>'$.k' AS BIGINT) AS k FROM events",
}
