"""Queries of window and sequence operators (W, J6, J7, T4-T6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.operators import sequence as s
from tracewright.sources.driver_tables import conversation_events, responses, sql, trace_events


def sliding_max(spark, d):
    return s.sliding_max(trace_events(spark, d), F.col("kind") == "tool_call", 20).select("session_id", F.col("most").cast("long").alias("most"))


def first_window_reaching(spark, d):
    return s.first_window(trace_events(spark, d), F.col("error").isNotNull(), 10, 4)


def request_scope_rollup(spark, d):
    scoped = s.request_scope(trace_events(spark, d))
    return scoped.groupBy("session_id", "scope").agg(F.count("*").alias("n"), F.sum("size").alias("total_size"))


def failure_chains(spark, d):
    return s.failure_chains(trace_events(spark, d), 3).drop("island")


def retry_groups(spark, d):
    return s.retry_groups(trace_events(spark, d).filter("kind in ('tool_result', 'user_msg')"), "call_id")


def poll_runs(spark, d):
    return s.poll_runs(trace_events(spark, d), F.coalesce(F.col("category") == "read", F.lit(False)), "tool", 2).drop("island")


def decumulate_usage(spark, d):
    rows = s.decumulate(trace_events(spark, d), "session_id", "idx", "size")
    return rows.select("session_id", "idx", "size", "delta")


def turn_builder(spark, d):
    return s.turns(conversation_events(spark, d).filter("kind <> 'meta'")).withColumn("turn", F.col("turn").cast("long"))


def event_turns(spark, d):
    return s.turns(trace_events(spark, d)).withColumn("turn", F.col("turn").cast("long"))


def context_rot_thirds(spark, d):
    return s.thirds(trace_events(spark, d), F.col("error").isNotNull())


def asof_prior_next(spark, d):
    rows = s.ordered_prior_next(trace_events(spark, d), F.col("kind") == "tool_call", F.col("kind") == "user_msg")
    return rows.select("session_id", "idx", "prior_idx", "next_idx")


def asof_previous_answer(spark, d):
    rows = s.ordered_prior_next(conversation_events(spark, d), F.col("kind") == "assistant_msg", F.col("kind") == "assistant_msg")
    return rows.filter("kind = 'user_msg'").select("session_id", "idx", "prior_idx", "next_idx")


def terminal_messages(spark, d):
    return s.terminal_messages(conversation_events(spark, d)).select("session_id", "idx", F.length("text").cast("long").alias("chars"))


def adjacent_gaps(spark, d):
    return s.adjacent_gaps(trace_events(spark, d)).select("session_id", "idx", F.round("gap", 6).alias("gap"))


def no_adapt_retry(spark, d):
    calls = trace_events(spark, d).filter("kind = 'tool_call' and command is not null")
    return s.no_adapt_clusters(calls, "command").select("session_id", "attempts", "first_idx", "last_idx")


def logical_position(spark, d):
    return s.logical(conversation_events(spark, d)).select("session_id", "idx", F.col("pos").cast("long").alias("pos"))


QUERIES = {
    f.__name__: f
    for f in (
        sliding_max, first_window_reaching, request_scope_rollup, failure_chains, retry_groups, poll_runs, decumulate_usage, turn_builder,
        event_turns, context_rot_thirds, asof_prior_next, asof_previous_answer, terminal_messages, adjacent_gaps, no_adapt_retry, logical_position,
    )
}

_UPTO = "OVER (PARTITION BY session_id ORDER BY idx ROWS UNBOUNDED PRECEDING)"
_BEFORE = "OVER (PARTITION BY session_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_AFTER = "OVER (PARTITION BY session_id ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)"
_TURNS = f"""SELECT session_id, CAST(turn AS BIGINT) AS turn, min(idx) AS first_idx, max(idx) AS last_idx, count(*) AS n_events,
    count(*) FILTER (kind = 'tool_call') AS n_calls
FROM (SELECT *, sum(CASE WHEN kind = 'user_msg' THEN 1 ELSE 0 END) {_UPTO} AS turn FROM %s) GROUP BY session_id, turn"""

ORACLE_SQL = {
    "sliding_max": sql(
        """SELECT session_id, CAST(max(n) AS BIGINT) AS most FROM (SELECT session_id, sum(CASE WHEN kind = 'tool_call' THEN 1 ELSE 0 END)
        OVER (PARTITION BY session_id ORDER BY idx ROWS 19 PRECEDING) AS n FROM ev) GROUP BY session_id""",
        "ev",
    ),
    "first_window_reaching": sql(
        """SELECT session_id, arg_min(start_idx, idx) AS start_idx, min(idx) AS end_idx FROM (
        SELECT session_id, idx, count(error) OVER w AS n, min(CASE WHEN error IS NOT NULL THEN idx END) OVER w AS start_idx FROM ev
        WINDOW w AS (PARTITION BY session_id ORDER BY idx ROWS 9 PRECEDING)) WHERE n >= 4 GROUP BY session_id""",
        "ev",
    ),
    "request_scope_rollup": sql(
        f"""SELECT session_id, scope, count(*) AS n, CAST(sum(size) AS BIGINT) AS total_size FROM (
        SELECT *, coalesce(max(CASE WHEN kind = 'user_msg' THEN idx END) {_UPTO}, -1) AS scope FROM ev) GROUP BY session_id, scope""",
        "ev",
    ),
    "failure_chains": sql(
        f"""SELECT session_id, count(*) AS failures, min(idx) AS first_idx, max(idx) AS last_idx FROM (
        SELECT *, sum(CASE WHEN kind = 'user_msg' OR ok THEN 1 ELSE 0 END) {_UPTO} AS island FROM ev) WHERE ok = false
        GROUP BY session_id, island HAVING count(*) >= 3""",
        "ev",
    ),
    "retry_groups": sql(
        f"""AND_WITH scoped AS (SELECT *, coalesce(max(CASE WHEN kind = 'user_msg' THEN idx END) {_UPTO}, -1) AS scope FROM ev),
        numbered AS (SELECT *, coalesce(sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY session_id, call_id, scope ORDER BY idx
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS closed FROM scoped WHERE kind = 'tool_result')
        SELECT session_id, call_id, scope, count(*) AS attempts, count(*) FILTER (NOT ok) AS failed, min(idx) AS first_idx, max(idx) AS last_idx
        FROM numbered GROUP BY session_id, call_id, scope, closed HAVING count(*) >= 2 AND count(*) FILTER (NOT ok) >= 2""",
        "ev",
    ),
    "poll_runs": sql(
        f"""SELECT session_id, tool, count(*) AS polls, min(idx) AS first_idx, max(idx) AS last_idx FROM (
        SELECT *, sum(CASE WHEN kind = 'user_msg' OR (kind = 'tool_call' AND category <> 'read') THEN 1 ELSE 0 END) {_UPTO} AS island FROM ev)
        WHERE category = 'read' GROUP BY session_id, island, tool HAVING count(*) >= 2""",
        "ev",
    ),
    "decumulate_usage": sql(
        """SELECT session_id, idx, size, CASE WHEN size < before THEN size ELSE size - before END AS delta FROM (
        SELECT *, coalesce(lag(size) OVER (PARTITION BY session_id ORDER BY idx), 0) AS before FROM ev)""",
        "ev",
    ),
    "turn_builder": sql(_TURNS % "(SELECT * FROM conv WHERE kind <> 'meta')", "conv"),
    "event_turns": sql(_TURNS % "ev", "ev"),
    "context_rot_thirds": sql(
        """SELECT session_id, n, count(*) FILTER (error IS NOT NULL AND pos < n // 3) AS first_hits,
        count(*) FILTER (error IS NOT NULL AND pos >= n - n // 3) AS last_hits FROM (
        SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY idx) - 1 AS pos, count(*) OVER (PARTITION BY session_id) AS n FROM ev)
        WHERE n >= 9 GROUP BY session_id, n""",
        "ev",
    ),
    "asof_prior_next": sql(
        f"""SELECT session_id, idx, max(CASE WHEN kind = 'tool_call' THEN idx END) {_BEFORE} AS prior_idx,
        min(CASE WHEN kind = 'user_msg' THEN idx END) {_AFTER} AS next_idx FROM ev""",
        "ev",
    ),
    "asof_previous_answer": sql(
        f"""SELECT session_id, idx, prior_idx, next_idx FROM (SELECT *, max(CASE WHEN kind = 'assistant_msg' THEN idx END) {_BEFORE} AS prior_idx,
        min(CASE WHEN kind = 'assistant_msg' THEN idx END) {_AFTER} AS next_idx FROM conv) WHERE kind = 'user_msg'""",
        "conv",
    ),
    "terminal_messages": sql(
        """SELECT session_id, idx, length(text) AS chars FROM (SELECT *, lead(kind) OVER (PARTITION BY session_id ORDER BY idx) AS nxt
        FROM conv WHERE kind <> 'meta') WHERE kind = 'assistant_msg' AND (nxt IS NULL OR nxt = 'user_msg')""",
        "conv",
    ),
    "adjacent_gaps": sql(
        """SELECT session_id, idx, round((epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY session_id ORDER BY idx)) / 1e6, 6) AS gap FROM ev""", "ev"
    ),
    "no_adapt_retry": sql(
        f"""AND_WITH calls AS (SELECT *, lag(command) OVER w AS before, lag(tool) OVER w AS tool_before FROM ev WHERE kind = 'tool_call' AND command IS NOT NULL
            WINDOW w AS (PARTITION BY session_id ORDER BY idx)),
        marked AS (SELECT *, coalesce(tool_before = tool AND levenshtein(command, before) < 5
            AND levenshtein(command, before) <= greatest(1, least(length(command), length(before)) // 4), false) AS near FROM calls)
        SELECT session_id, count(*) AS attempts, min(idx) AS first_idx, max(idx) AS last_idx FROM (
            SELECT *, sum(CASE WHEN near THEN 0 ELSE 1 END) {_UPTO} AS island FROM marked) GROUP BY session_id, island HAVING count(*) >= 2""",
        "ev",
    ),
    "logical_position": sql("SELECT session_id, idx, row_number() OVER (PARTITION BY session_id ORDER BY idx) - 1 AS pos FROM conv WHERE kind <> 'meta'", "conv"),
}
