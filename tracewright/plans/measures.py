"""Queries of measures and joins (A, J, U)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.operators import joins as j
from tracewright.operators import metrics as m
from tracewright.operators import sequence as s
from tracewright.sources.driver_tables import ERRORS, responses, sql, table, trace_events

HOUR = 3600.0
ERROR_NAMES = sorted(ERRORS)


def session_metrics(spark, d):
    return m.session_metrics(trace_events(spark, d))


def calls_by_tool(spark, d):
    return m.counts_by(trace_events(spark, d).filter("kind = 'tool_call'"), "session_id", "tool")


def errors_by_category(spark, d):
    return m.counts_by(trace_events(spark, d), "session_id", "error")


def error_streaks(spark, d):
    return m.error_streaks(trace_events(spark, d))


def active_idle(spark, d):
    return m.active_idle(trace_events(spark, d), 6 * HOUR)


def test_run_metrics(spark, d):
    return m.test_runs(trace_events(spark, d), F.coalesce(F.col("command").contains("pytest"), F.lit(False)))


def group_stats_grouping_sets(spark, d):
    return m.group_stats(trace_events(spark, d), ["category", "model"], "seconds")


def document_group_stats(spark, d):
    return m.group_stats(table(spark, d, "documents"), ["lang", "source"], "n_chars")


def top_tools(spark, d):
    return m.top_counts(trace_events(spark, d), "session_id", "path", 3)


def majority_model(spark, d):
    return m.strict_majority(trace_events(spark, d), "session_id", "model")


def file_state(spark, d):
    return m.file_state(trace_events(spark, d))


def file_read_analytics(spark, d):
    return m.file_read_analytics(trace_events(spark, d), F.col("session_id") % 7)


def token_totals(spark, d):
    rows = responses(spark, d).withColumn("cache_write", F.nullif("cache_write", F.lit(0)))
    return m.null_safe_total(rows, "thread_id", ["input", "cache_read", "cache_write", "output"])


def finding_histogram_pivot(spark, d):
    return m.pivot_counts(trace_events(spark, d).filter("error is not null"), "session_id", "error", ERROR_NAMES)


def call_result_last_wins(spark, d):
    return j.pair_last(trace_events(spark, d))


def call_result_unique(spark, d):
    return j.pair_unique(trace_events(spark, d)).select("session_id", "call_id", "idx", "result_idx", "tool", "ok")


def turn_ownership(spark, d):
    events = trace_events(spark, d)
    rows = events.filter("kind = 'tool_result'").select("session_id", "idx")
    return j.within_turn(rows, s.turns(events)).select("session_id", "idx", F.col("turn").cast("long").alias("turn"))


def price_lookup_prefix(spark, d):
    part = table(spark, d, "part")
    rates = part.groupBy("p_brand").agg(F.round(F.avg("p_retailprice"), 6).alias("price"))
    part = part.withColumn("p_brand", F.concat("p_brand", F.when(F.col("p_size") % 3 == 0, "").when(F.col("p_size") % 3 == 1, "-mini").otherwise("[1m]")))
    prices = rates.select(F.col("p_brand").alias("prefix"), "price").unionByName(spark.createDataFrame([("default", 1.5)], "prefix string, price double"))
    return j.longest_prefix(part, "p_brand", prices)


def dedup_responses(spark, d):
    return j.first_of(responses(spark, d), ["thread_id", "response_id"], ["seq"]).select("thread_id", "response_id", "seq", "input")


def orphans_anti(spark, d):
    return j.orphans(table(spark, d, "orders"), table(spark, d, "lineitem"), "o_orderkey", "l_orderkey").select("o_orderkey", "o_custkey")


def label_pairs(spark, d):
    lab = table(spark, d, "labels")
    rows = lab.select("doc_id", F.lit("a").alias("annotator"), F.col("quality").alias("value")).unionByName(
        lab.select("doc_id", F.lit("b").alias("annotator"), F.col("toxic").alias("value"))
    )
    return j.double_labels(rows, ["doc_id"])


QUERIES = {
    f.__name__: f
    for f in (
        session_metrics, calls_by_tool, errors_by_category, error_streaks, active_idle, test_run_metrics, group_stats_grouping_sets, document_group_stats,
        top_tools, majority_model, file_state, file_read_analytics, token_totals, finding_histogram_pivot, call_result_last_wins, call_result_unique,
        turn_ownership, price_lookup_prefix, dedup_responses, orphans_anti, label_pairs,
    )
}


def _stats_sql(source: str, keys: list[str], value: str) -> str:
    columns = f"count(*) AS n, count({value}) AS n_value, round(avg({value}), 6) AS mean, round(quantile_cont({value}, 0.5), 6) AS p50, round(quantile_cont({value}, 0.95), 6) AS p95"
    parts = [f"SELECT 'all' AS scope, 'all' AS grp, {columns} FROM {source}"]
    parts += [f"SELECT '{k}', CAST({k} AS VARCHAR), {columns} FROM {source} WHERE {k} IS NOT NULL GROUP BY {k}" for k in keys]
    return " UNION ALL ".join(parts)


_BEFORE = "OVER (PARTITION BY session_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_UPTO = "OVER (PARTITION BY session_id ORDER BY idx ROWS UNBOUNDED PRECEDING)"
ORACLE_SQL = {
    "session_metrics": sql(
        """SELECT session_id, count(*) AS n_events, count(*) FILTER (kind = 'user_msg') AS user_messages, count(*) FILTER (kind = 'tool_call') AS calls,
        count(*) FILTER (category = 'read') AS reads, count(*) FILTER (category = 'write') AS writes, count(*) FILTER (category = 'execute') AS executes,
        min(idx) FILTER (kind = 'tool_call') AS first_call_idx, count(*) FILTER (category = 'read' AND idx < first_write) AS reads_before_write,
        count(DISTINCT tool) FILTER (kind = 'tool_call') AS tools, count(DISTINCT path) AS paths, count(*) FILTER (ok = false) AS errors,
        count(*) FILTER (ok = false AND idx < last_call) AS retried_errors,
        round(count(*) FILTER (ok = false) / nullif(count(*) FILTER (kind = 'tool_result'), 0), 6) AS error_rate,
        CAST(sum(size) FILTER (kind = 'tool_result') AS BIGINT) AS output_size
        FROM (SELECT *, max(CASE WHEN kind = 'tool_call' THEN idx END) OVER w AS last_call, min(CASE WHEN category = 'write' THEN idx END) OVER w AS first_write
              FROM ev WINDOW w AS (PARTITION BY session_id)) GROUP BY session_id""",
        "ev",
    ),
    "calls_by_tool": sql("SELECT session_id, tool, count(*) AS n FROM ev WHERE kind = 'tool_call' AND tool IS NOT NULL GROUP BY session_id, tool", "ev"),
    "errors_by_category": sql("SELECT session_id, error, count(*) AS n FROM ev WHERE error IS NOT NULL GROUP BY session_id, error", "ev"),
    "error_streaks": sql(
        f"""SELECT session_id, max(n) AS longest FROM (SELECT session_id, streak, count(*) AS n FROM (
        SELECT *, sum(CASE WHEN ok THEN 1 ELSE 0 END) {_UPTO} AS streak FROM ev WHERE kind = 'tool_result') WHERE NOT ok GROUP BY session_id, streak)
        GROUP BY session_id""",
        "ev",
    ),
    "active_idle": sql(
        """SELECT session_id, round(sum(gap) FILTER (gap <= 21600), 6) AS active_seconds, round(sum(gap) FILTER (gap > 21600), 6) AS idle_seconds,
        count(*) FILTER (gap > 21600) AS idle_gaps FROM (
        SELECT session_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY session_id ORDER BY ts, idx)) / 1e6 AS gap FROM ev) GROUP BY session_id""",
        "ev",
    ),
    "test_run_metrics": sql(
        f"""AND_WITH marked AS (SELECT *, coalesce(contains(command, 'pytest'), false) AS is_test FROM ev),
        placed AS (SELECT *, max(CASE WHEN category = 'write' THEN idx END) {_UPTO} AS last_edit, max(CASE WHEN is_test THEN idx END) {_BEFORE} AS last_test FROM marked)
        SELECT session_id, count(*) FILTER (is_test) AS tests, count(DISTINCT trim(command)) FILTER (is_test) AS commands,
        count(*) FILTER (is_test AND last_edit > coalesce(last_test, -1)) AS cycles FROM placed GROUP BY session_id HAVING count(*) FILTER (is_test) > 0""",
        "ev",
    ),
    "group_stats_grouping_sets": sql(_stats_sql("ev", ["category", "model"], "seconds"), "ev"),
    "document_group_stats": _stats_sql("documents", ["lang", "source"], "n_chars"),
    "top_tools": sql(
        """SELECT session_id, path, n, place FROM (SELECT session_id, path, count(*) AS n,
        row_number() OVER (PARTITION BY session_id ORDER BY count(*) DESC, path) AS place FROM ev WHERE path IS NOT NULL GROUP BY session_id, path) WHERE place <= 3""",
        "ev",
    ),
    "majority_model": sql(
        """SELECT session_id, CASE WHEN count(*) = 1 THEN min(model) END AS winner, max(n) AS n FROM (
        SELECT session_id, model, count(*) AS n, max(count(*)) OVER (PARTITION BY session_id) AS most FROM ev GROUP BY session_id, model)
        WHERE n = most GROUP BY session_id""",
        "ev",
    ),
    "file_state": sql(
        """SELECT session_id, path, count(*) FILTER (category = 'read') AS reads, count(*) FILTER (category = 'write') AS edits, arg_max(category, idx) AS last_op,
        min(idx) FILTER (category = 'read') AS first_read, min(idx) FILTER (category = 'write') AS first_edit,
        coalesce(min(idx) FILTER (category = 'read') < min(idx) FILTER (category = 'write'), min(idx) FILTER (category = 'write') IS NULL) AS read_first
        FROM ev WHERE kind = 'tool_call' AND path IS NOT NULL GROUP BY session_id, path""",
        "ev",
    ),
    "file_read_analytics": sql(
        """SELECT path, count(*) AS reads, count(DISTINCT session_id) AS sessions, count(DISTINCT session_id % 7) AS groups,
        count(*) - count(DISTINCT session_id) AS repeats FROM ev WHERE category = 'read' GROUP BY path""",
        "ev",
    ),
    "token_totals": sql(
        """SELECT thread_id, CAST(input AS BIGINT) AS input, CAST(cache_read AS BIGINT) AS cache_read, CAST(cache_write AS BIGINT) AS cache_write,
        CAST(output AS BIGINT) AS output, CAST(input + cache_read + coalesce(cache_write, 0) + output AS BIGINT) AS total FROM (
        SELECT thread_id, sum(input) AS input, sum(cache_read) AS cache_read, sum(nullif(cache_write, 0)) AS cache_write, sum(output) AS output
        FROM resp GROUP BY thread_id)""",
        "resp",
    ),
    "finding_histogram_pivot": sql(
        "SELECT session_id, " + ", ".join(f"count(*) FILTER (error = '{e}') AS n_{e}" for e in ERROR_NAMES) + " FROM ev WHERE error IS NOT NULL GROUP BY session_id", "ev"
    ),
    "call_result_last_wins": sql(
        """SELECT c.session_id, c.idx, c.call_id, c.tool, r.idx AS result_idx, r.ok AS result_ok FROM (SELECT * FROM ev WHERE kind = 'tool_call') c
        LEFT JOIN (SELECT session_id, call_id, max(idx) AS idx, arg_max(ok, idx) AS ok FROM ev WHERE kind = 'tool_result' GROUP BY session_id, call_id) r
        ON c.session_id = r.session_id AND c.call_id = r.call_id""",
        "ev",
    ),
    "call_result_unique": sql(
        """AND_WITH n AS (SELECT *, count(*) OVER (PARTITION BY session_id, call_id, kind) AS same FROM ev WHERE call_id IS NOT NULL)
        SELECT c.session_id, c.call_id, c.idx, r.idx AS result_idx, c.tool, r.ok FROM n c JOIN n r ON c.session_id = r.session_id AND c.call_id = r.call_id
        WHERE c.kind = 'tool_call' AND r.kind = 'tool_result' AND c.same = 1 AND r.same = 1 AND r.idx > c.idx""",
        "ev",
    ),
    "turn_ownership": sql(
        f"""SELECT session_id, idx, CAST(turn AS BIGINT) AS turn FROM (SELECT *, sum(CASE WHEN kind = 'user_msg' THEN 1 ELSE 0 END) {_UPTO} AS turn FROM ev)
        WHERE kind = 'tool_result'""",
        "ev",
    ),
    "price_lookup_prefix": """
        WITH prices AS (SELECT p_brand AS prefix, round(avg(p_retailprice), 6) AS price FROM part GROUP BY p_brand
            UNION ALL SELECT 'default', 1.5),
        found AS (SELECT k.p_brand AS key, p.price, length(p.prefix) AS n, row_number() OVER (PARTITION BY k.p_brand ORDER BY length(p.prefix) DESC) AS r
            FROM (SELECT DISTINCT p_brand || CASE p_size % 3 WHEN 0 THEN '' WHEN 1 THEN '-mini' ELSE '[1m]' END AS p_brand FROM part) k LEFT JOIN prices p ON starts_with(k.p_brand, p.prefix))
        SELECT key, coalesce(price, 1.5) AS price, CASE WHEN n = length(key) THEN 'exact' ELSE 'estimated' END AS status FROM found WHERE r = 1""",
    "dedup_responses": sql(
        """SELECT thread_id, response_id, seq, input FROM (SELECT *, row_number() OVER (PARTITION BY thread_id, response_id ORDER BY seq) AS r FROM resp) WHERE r = 1""", "resp"
    ),
    "orphans_anti": "SELECT o_orderkey, o_custkey FROM orders ANTI JOIN lineitem ON o_orderkey = l_orderkey",
    "label_pairs": "SELECT doc_id, quality AS value_1, toxic AS value_2 FROM labels",
}
