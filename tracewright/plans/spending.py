"""Queries of costs and rankings (M, O, A15-A18)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracewright.operators import costs as c
from tracewright.operators import rankings as r
from tracewright.sources.driver_tables import responses, sql, trace_events

#: Dollars per million tokens.
RATES = {"input": 3.0, "cache_read": 0.3, "cache_write": 3.75, "output": 15.0}
_EDGES = [86_400.0 * d for d in (10, 30, 60, 90)]


def _charged(spark, d):
    status = F.when(F.col("effort") == "A", "exact").when(F.col("effort") == "N", "estimated").otherwise("unknown")
    return c.charge(responses(spark, d), RATES).withColumn("status", status)


def invoice_by_model(spark, d):
    return c.money(_charged(spark, d), "model", "effort")


def origin_attributed(spark, d):
    rows = c.origin_attributed(responses(spark, d), 0.3)
    return rows.groupBy("thread_id").agg(F.round(F.sum("attributed"), 11).alias("attributed"), F.round(F.max("attributed"), 11).alias("largest"))


def wait_bands(spark, d):
    rows = responses(spark, d)
    seconds = (F.unix_micros(F.col("ts_end").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 1e6
    return rows.withColumn("band", c.band(seconds, _EDGES)).groupBy("band", "model").agg(F.count("*").alias("waits"), F.sum("cache_write").alias("written"))


def monthly_rollup(spark, d):
    return c.monthly(_charged(spark, d))


def spend_overview(spark, d):
    return c.spend_overview(_charged(spark, d))


def expense_tail_5pct(spark, d):
    per = _charged(spark, d).groupBy("thread_id").agg(F.round(F.sum("cost"), 8).alias("cost"))
    return c.expense_tail(per)


def model_activity(spark, d):
    rows = responses(spark, d)
    return rows.groupBy("model", "effort").agg(
        F.count("*").alias("calls"), *(F.sum(F.coalesce(k, F.lit(0))).alias(k) for k in RATES), F.round(F.sum("input") / F.sum(F.sum("input")).over(Window.partitionBy()), 6).alias("input_share")
    )


def prevalence_rankings(spark, d):
    return r.prevalence(trace_events(spark, d), "error")


QUERIES = {f.__name__: f for f in (invoice_by_model, origin_attributed, wait_bands, monthly_rollup, spend_overview, expense_tail_5pct, model_activity, prevalence_rankings)}

_COST = "(" + " + ".join(f"coalesce({k}, 0) / 1e6 * {v}" for k, v in RATES.items()) + ")"
_CHARGED = f"charged AS (SELECT *, {_COST} AS cost, CASE effort WHEN 'A' THEN 'exact' WHEN 'N' THEN 'estimated' ELSE 'unknown' END AS status FROM resp)"
_WORST = "(['exact', 'estimated', 'unknown'])[max(CASE status WHEN 'exact' THEN 0 WHEN 'estimated' THEN 1 ELSE 2 END) + 1]"
_OVERVIEW = """count(*) AS responses, count(*) FILTER (status = 'exact') AS exact, count(*) FILTER (status = 'estimated') AS estimated,
    count(*) FILTER (status = 'unknown') AS unknown, round(sum(cost), 8) AS cost, count(*) FILTER (response_id IS NULL) AS anonymous FROM charged"""

ORACLE_SQL = {
    "invoice_by_model": sql(f"AND_WITH {_CHARGED} SELECT model, effort, round(sum(cost), 8) AS amount, {_WORST} AS status, count(*) AS n FROM charged GROUP BY model, effort", "resp"),
    "origin_attributed": sql(
        """AND_WITH known AS (SELECT *, coalesce(sum(input + output) OVER (PARTITION BY thread_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS known,
            cache_read / 1e6 * 0.3 AS cost FROM resp),
        spread AS (SELECT a.thread_id, a.seq, CASE WHEN a.known > 0 THEN 0.0 ELSE any_value(a.cost) END
            + any_value(a.input + a.output) * coalesce(sum(CASE WHEN b.known > 0 THEN b.cost / b.known ELSE 0 END), 0) AS attributed
            FROM known a LEFT JOIN known b ON a.thread_id = b.thread_id AND b.seq > a.seq GROUP BY a.thread_id, a.seq, a.known)
        SELECT thread_id, round(sum(attributed), 11) AS attributed, round(max(attributed), 11) AS largest FROM spread GROUP BY thread_id""",
        "resp",
    ),
    "wait_bands": sql(
        "SELECT CAST(CASE " + " ".join(f"WHEN s >= {e} THEN {e}" for e in reversed(_EDGES)) + " ELSE 0.0 END AS DOUBLE) AS band, model, count(*) AS waits, CAST(sum(cache_write) AS BIGINT) AS written "
        "FROM (SELECT *, (epoch_us(ts_end) - epoch_us(ts)) / 1e6 AS s FROM resp) GROUP BY 1, 2",
        "resp",
    ),
    "monthly_rollup": sql(
        f"""AND_WITH {_CHARGED} SELECT strftime(ts, '%Y-%m') AS month, model, effort, count(*) AS responses, count(DISTINCT thread_id) AS threads,
        round(sum(cost), 8) AS cost, {_WORST} AS status, round(sum(cache_read) / nullif(sum(cache_read + input), 0), 6) AS cache_share FROM charged GROUP BY 1, 2, 3""",
        "resp",
    ),
    "spend_overview": sql(
        f"""AND_WITH {_CHARGED} SELECT NULL AS model, NULL AS effort, 3 AS level, {_OVERVIEW} UNION ALL SELECT model, NULL, 1, {_OVERVIEW} GROUP BY model
        UNION ALL SELECT NULL, effort, 2, {_OVERVIEW} GROUP BY effort UNION ALL SELECT model, effort, 0, {_OVERVIEW} GROUP BY model, effort""",
        "resp",
    ),
    "expense_tail_5pct": sql(
        f"""AND_WITH {_CHARGED}, per AS (SELECT thread_id, round(sum(cost), 8) AS cost FROM charged GROUP BY thread_id)
        SELECT thread_id, cost FROM (SELECT *, rank() OVER (ORDER BY cost DESC) AS r, count(*) OVER () AS n FROM per) WHERE r <= ceil(n * 0.05)""",
        "resp",
    ),
    "model_activity": sql(
        """SELECT model, effort, count(*) AS calls, CAST(sum(input) AS BIGINT) AS input, CAST(sum(cache_read) AS BIGINT) AS cache_read, CAST(sum(cache_write) AS BIGINT) AS cache_write,
        CAST(sum(output) AS BIGINT) AS output, round(sum(input) / sum(sum(input)) OVER (), 6) AS input_share FROM resp GROUP BY model, effort""",
        "resp",
    ),
    "prevalence_rankings": sql(
        """AND_WITH per AS (SELECT error AS item, count(*) AS n, count(DISTINCT session_id) AS sessions, round(count(*) / count(DISTINCT session_id), 6) AS per_session FROM ev
            WHERE error IS NOT NULL GROUP BY error)
        SELECT *, row_number() OVER (ORDER BY n DESC, item) AS by_n, row_number() OVER (ORDER BY sessions DESC, item) AS by_sessions,
        row_number() OVER (ORDER BY per_session DESC, item) AS by_rate FROM per""",
        "ev",
    ),
}
