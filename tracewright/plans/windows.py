"""Queries of the streaming twins over tables (V)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.functions import text as tx
from tracewright.operators import detectors, memory, metrics
from tracewright.sources import sinks
from tracewright.sources.driver_tables import conversation_events, sql, trace_events, work_events
from tracewright.streaming import twins

from .evidence import redact_sql
from .findings import KNOBS, bodies

TRACE_FINDINGS = sorted(bodies())


def session_window_idle(spark, d):
    return twins.idle_sessions(trace_events(spark, d), "6 hours").select("session_id", F.col("start").cast("timestamp_ntz").alias("start"), "n", "size")


def monthly_counts(spark, d):
    return twins.monthly_counts(trace_events(spark, d))


def evidence_projection(spark, d):
    rows = memory.evidence(conversation_events(spark, d), tx.redact)
    return rows.select("session_id", "idx", "role", "antecedent", F.length("text").cast("long").alias("chars"))


def trace_table(spark, d):
    events = work_events(spark, d)
    found = detectors.run(events, KNOBS, enabled=set(TRACE_FINDINGS))
    return sinks.trace_table(metrics.session_metrics(events).select("session_id", "n_events", "errors"), found, TRACE_FINDINGS)


QUERIES = {f.__name__: f for f in (session_window_idle, monthly_counts, evidence_projection, trace_table)}

ORACLE_SQL = {
    "session_window_idle": sql(
        """SELECT session_id, min(ts) AS start, count(*) AS n, CAST(sum(size) AS BIGINT) AS size FROM (
        SELECT *, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS island FROM (
            SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY session_id ORDER BY ts) > INTERVAL 6 HOUR, true) AS fresh FROM ev)) GROUP BY session_id, island""",
        "ev",
    ),
    "evidence_projection": sql(
        f"""SELECT session_id, idx, CASE kind WHEN 'user_msg' THEN 'user' ELSE 'assistant' END AS role,
        last_value(CASE WHEN kind = 'assistant_msg' THEN idx END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS antecedent,
        length({redact_sql("text")}) AS chars FROM conv WHERE kind <> 'meta'""",
        "conv",
    ),
    "trace_table": sql(
        f"""AND_WITH found AS ({" UNION ALL ".join(f"SELECT '{n}' AS detector, session_id FROM ({b.replace('FROM conv', 'FROM f')})" for n, b in bodies().items())}),
        counts AS (SELECT session_id, {", ".join(f"count(*) FILTER (detector = '{n}') AS {n}" for n in TRACE_FINDINGS)} FROM found GROUP BY session_id)
        SELECT e.session_id, count(*) AS n_events, count(*) FILTER (ok = false) AS errors, {", ".join(f"coalesce(any_value({n}), 0) AS {n}" for n in TRACE_FINDINGS)}
        FROM work e LEFT JOIN counts c ON e.session_id = c.session_id GROUP BY e.session_id""",
        "made", "work", "f",
    ),
    "monthly_counts": sql("SELECT strftime(ts, '%Y-%m') AS month, model, count(*) AS n, CAST(sum(size) AS BIGINT) AS size FROM ev GROUP BY 1, 2", "ev"),
}
