"""Queries of tail measurements and what is ranked by them (T, A14, A23, B1, B2, D41-D59, W14)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.operators import briefs, detectors
from tracewright.operators import rankings as r
from tracewright.operators import tails as t
from tracewright.operators.facts import facts
from tracewright.operators.graph import cut_lineage, kept
from tracewright.sources.driver_tables import sql, work_events

from .findings import KNOBS
from .findings import ORACLE_SQL as _FOUND


def _facts(spark, d):
    return cut_lineage(facts(work_events(spark, d)))


def _measured(rows):
    """The incidents of _facts(), gathered in as many tasks as those have."""
    return t.incidents(rows, rows.rdd.getNumPartitions())


def _incidents(spark, d):
    return _measured(_facts(spark, d))


def tail_incidents(spark, d):
    return _incidents(spark, d).withColumn("value", F.round("value", 6))


def tail_distributions(spark, d):
    return t.distributions(_incidents(spark, d))


def tail_retained(spark, d):
    return t.retained(cut_lineage(_incidents(spark, d)), 10, 0.02)


def tail_observations(spark, d):
    return t.observations(_incidents(spark, d), 0.02)


def tail_coverage(spark, d):
    return t.coverage(facts(work_events(spark, d)))


def round_activity(spark, d):
    return t.model_activity(facts(work_events(spark, d)))


def cache_rebuilds(spark, d):
    return t.cache_rebuilds(facts(work_events(spark, d)), 2000).select("session_id", "idx", "value")


def theme_scores(spark, d):
    return r.themes(_incidents(spark, d))


def priority_rank(spark, d):
    return r.priorities(t.observations(_incidents(spark, d), 0.02))


#: Fixed value: measures or rules that a task takes one after the other. Each holds its first pages of memory until the
#: task ends.
AT_ONCE = 4


def _few(items):
    return [items[i : i + AT_ONCE] for i in range(0, len(items), AT_ONCE)]


def run_brief(spark, d):
    """Findings of the rules and of the tails in one report. Both read the same facts, which are made once and kept while
    they are counted, in the tasks they were made in; only counts by kind and by detector leave those."""
    apart = [x.id for x in detectors.REGISTRY.values() if x.stage == "table"]
    shared = set(detectors.REGISTRY) - set(apart)
    with kept(facts(work_events(spark, d))) as rows:
        number = cut_lineage(rows.groupBy("session_id").agg(F.lit(1)).agg(F.count("*").alias("sessions")))
        tails = reduce(DataFrame.unionByName, [cut_lineage(t.tallies(t.incidents(rows, measures=few), 0.02)) for few in _few(t.MEASURES)])
        rules = reduce(DataFrame.unionByName, [cut_lineage(detectors.tallies(detectors.run(rows, KNOBS, known=True, enabled=few))) for few in (shared, *map(set, _few(apart)))])
    seen = tails.filter("observed > 0").select("detector", "severity", F.col("observed").alias("n"), F.col("observed_sessions").alias("sessions"))
    return briefs.of_counts(number, rules.unionByName(seen), r.scored(tails), r.routed(seen.withColumnRenamed("n", "incidents")))


QUERIES = {
    f.__name__: f
    for f in (tail_incidents, tail_distributions, tail_retained, tail_observations, tail_coverage, round_activity, cache_rebuilds, theme_scores, priority_rank, run_brief)
}

_UPTO = "OVER (PARTITION BY session_id ORDER BY idx ROWS UNBOUNDED PRECEDING)"
_KEY = "coalesce(signature, tool, '')"
_POLL = "(is_call AND lower(tool) IN ('wait_agent', 'get_subagent_result', 'wait', 'write_stdin', 'list_agents'))"
_LOOK = "(is_read OR (is_call AND coalesce(intent = 'inspect', false)))"
_CHECK = "(intent = 'build_test' AND NOT regexp_matches(command, '^ruff format'))"
_TRIED = f"""tried AS (SELECT *, {_KEY} AS key, stops AS stop, CASE WHEN stops THEN false ELSE r_failed END AS failed, sum(CASE WHEN stops THEN 1 ELSE 0 END) {_UPTO} AS barrier
    FROM (SELECT *, kind = 'user_msg' OR NOT paired AS stops FROM f WHERE (is_call AND NOT {_POLL}) OR kind = 'user_msg'))"""
_ROUNDS = f"""rounds AS (SELECT session_id, response_id, min(idx) AS idx, count(*) FILTER (is_call) AS calls, max(scope) FILTER (kind = 'usage') AS scope, max(model) AS model, max(input) AS input,
    max(output) AS output, max(cache_read) AS cache_read, max(cache_write) AS cache_write, CASE WHEN count(*) FILTER (is_call) = 0 THEN 'no_tools'
    WHEN count(*) FILTER (is_call AND NOT {_LOOK}) = 0 THEN 'inspection' WHEN count(*) FILTER (is_call AND NOT (category = 'subagent' OR lower(tool) IN ('wait_agent', 'list_agents'))) = 0 THEN 'coordination'
    WHEN count(*) FILTER (is_call AND category NOT IN ('execute', 'write')) = 0 THEN 'execution' ELSE 'mixed' END AS category
    FROM f WHERE kind = 'usage' OR is_call GROUP BY session_id, response_id HAVING count(*) FILTER (kind = 'usage') = 1)"""
_LAUNCHED = """launched AS (SELECT session_id, idx, scope, text AS files, paired, r_ok, r_idx, (r_ts - ts) / 1e6 AS seconds, (max(ts) OVER (PARTITION BY session_id) - ts) / 1e6 AS open_seconds, is_call, tool FROM f),
launches AS (SELECT * FROM launched WHERE is_call AND tool = 'Task')"""


def _inc(kind: str, select: str, cohort: str | None = None) -> str:
    name = f"'{kind}'" if cohort is None else f"'{kind}:' || coalesce({cohort}, 'unknown')"
    return f"SELECT '{kind}' AS kind, {name} AS cohort, session_id, CAST(idx AS BIGINT) AS idx, CAST(value AS DOUBLE) AS value FROM ({select})"


def _request(hit: str, value: str, least: int) -> str:
    return f"SELECT session_id, min(idx) AS idx, {value} AS value FROM f WHERE {hit} AND scope >= 0 GROUP BY session_id, scope HAVING count(*) >= {least}"


def _rebuilds(tokens: int) -> str:
    return f"""SELECT session_id, min(before) AS idx, count(*) AS value FROM (SELECT *, lag(cache_read) OVER w AS was, lag(model) OVER w AS of, lag(scope) OVER w AS within, lag(idx) OVER w AS before
        FROM f WHERE kind = 'usage' WINDOW w AS (PARTITION BY session_id ORDER BY idx)) WHERE was > 0 AND cache_read = 0 AND cache_write >= {tokens} AND of = model AND within = scope AND scope >= 0
        AND coalesce(compacted, -1) < before GROUP BY session_id, scope"""


_TRIP = "SELECT *, (r_ts - ts) / 1e6 AS value FROM f WHERE paired AND r_ts >= ts AND lower(tool) {} IN ('wait_agent', 'get_subagent_result', 'wait')"
_INCIDENTS = (
    f"{_TRIED},\n{_ROUNDS},\n{_LAUNCHED},\nincidents AS ("
    + " UNION ALL ".join(
        [
            _inc("model_input", "SELECT *, input AS value FROM f WHERE kind = 'usage' AND input >= 0", "model"),
            _inc("model_output", "SELECT *, output AS value FROM f WHERE kind = 'usage' AND output >= 0", "model"),
            _inc("tool_latency", _TRIP.format("NOT"), "tool"),
            _inc("parent_wait", _TRIP.format(""), "tool"),
            _inc("output_volume", "SELECT *, r_size AS value FROM f WHERE paired AND r_size >= 0", "tool"),
            _inc("retry_attempts", """SELECT session_id, min(idx) AS idx, count(*) AS value FROM (SELECT *, coalesce(sum(CASE WHEN failed THEN 0 ELSE 1 END)
                OVER (PARTITION BY session_id, key, barrier ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS closed FROM tried WHERE NOT stop)
                GROUP BY session_id, key, barrier, closed HAVING count(*) >= 2 AND count(*) FILTER (failed) >= 2"""),
            _inc("failure_chain", f"SELECT session_id, min(idx) AS idx, count(*) AS value FROM (SELECT *, sum(CASE WHEN failed THEN 0 ELSE 1 END) {_UPTO} AS island FROM tried) WHERE failed GROUP BY session_id, island HAVING count(*) >= 3"),
            _inc("poll_amplification", f"SELECT session_id, min(idx) AS idx, count(*) AS value FROM (SELECT *, {_KEY} AS key, {_POLL} AS poll, sum(CASE WHEN {_POLL} THEN 0 ELSE 1 END) {_UPTO} AS island FROM f WHERE is_call OR kind = 'user_msg') WHERE poll GROUP BY session_id, island, key HAVING count(*) >= 3"),
            _inc("delegation_fanout", _request("is_call AND tool = 'Task'", "count(*)", 2)),
            _inc("context_replay", _request("kind = 'usage' AND cache_read > 0", "sum(cache_read)", 5)),
            _inc("cache_creation", _request("kind = 'usage' AND cache_write > 0", "sum(cache_write)", 5)),
            _inc("inspection_rounds", "SELECT session_id, min(idx) AS idx, count(*) AS value FROM rounds WHERE category = 'inspection' GROUP BY session_id, scope HAVING count(*) >= 3"),
            _inc("status_probes", "SELECT session_id, min(idx) AS idx, count(*) AS value FROM f WHERE paired AND tool = 'list_agents' GROUP BY session_id, scope HAVING count(*) >= 3"),
            _inc("output_repetition", f"""SELECT session_id, min(idx) AS idx, max(r_size) * (count(*) - 1) AS value FROM f WHERE paired AND r_ok AND {_LOOK} AND r_text IS NOT NULL GROUP BY session_id, scope, {_KEY}, r_text
                HAVING count(*) >= 2 AND min(r_size) = max(r_size) AND max(r_size) * (count(*) - 1) >= 1000"""),
            _inc("verification_repetition", f"""SELECT session_id, min(idx) AS idx, count(*) - 1 AS value FROM f WHERE paired AND r_ok AND coalesce(r_exit, 0) = 0 AND {_CHECK} AND (next_user IS NULL OR next_user > r_idx)
                GROUP BY session_id, scope, {_KEY} HAVING count(*) >= 2"""),
            _inc("cache_rebuilds", _rebuilds(10_000)),
            _inc("delegation_lifetime", "SELECT *, seconds AS value FROM launches WHERE paired AND r_ok AND seconds >= 0"),
            _inc("delegation_open", "SELECT *, open_seconds AS value FROM launches WHERE NOT paired AND open_seconds >= 0"),
            _inc("delegation_repetition", """SELECT a.session_id, a.idx, count(*) AS value FROM launches a JOIN launches b ON a.session_id = b.session_id AND a.scope = b.scope AND a.files = b.files
                WHERE NOT (a.paired AND NOT a.r_ok) AND b.paired AND b.r_ok AND b.idx < b.r_idx AND b.r_idx < a.idx GROUP BY a.session_id, a.idx"""),
        ]
    )
    + ")"
)
_LIMIT = "CASE kind " + " ".join(f"WHEN '{k}' THEN {float(v)}" for k, (v, _) in t.THRESHOLDS.items()) + " END"
_SEVERITY = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, (_, v) in t.THRESHOLDS.items()) + " END"
_PLACED = "placed AS (SELECT *, row_number() OVER (PARTITION BY cohort ORDER BY value DESC, session_id, idx) AS place, count(*) OVER (PARTITION BY cohort) AS n, median(value) OVER (PARTITION BY cohort) AS median FROM incidents)"
_OBSERVED = f"observed AS (SELECT 'TAIL_' || upper(kind) AS detector, 'observation' AS obs, {_SEVERITY} AS severity, session_id, idx, round(value, 6) AS value FROM incidents WHERE value >= {_LIMIT} * 0.02)"


def _sql(body: str) -> str:
    return sql(body, "made", "work", "f")


ORACLE_SQL = {
    "tail_incidents": _sql(f"AND_WITH {_INCIDENTS} SELECT kind, cohort, session_id, idx, round(value, 6) AS value FROM incidents"),
    "tail_distributions": _sql(
        f"""AND_WITH {_INCIDENTS}, {_PLACED} SELECT kind, cohort, count(*) AS n, round(median(value), 6) AS p50, round(quantile_disc(value, 0.95), 6) AS p95,
        round(quantile_disc(value, 0.99), 6) AS p99, round(max(value), 6) AS largest,
        round(sum(value) FILTER (place <= greatest(1, ceil(n * 0.01))) / nullif(sum(value), 0), 6) AS top_share FROM placed GROUP BY kind, cohort"""
    ),
    "tail_retained": _sql(
        f"""AND_WITH {_INCIDENTS}, {_PLACED} SELECT kind, cohort, session_id, idx, round(value, 6) AS value, CASE WHEN place <= 10 THEN place END AS place, value >= {_LIMIT} * 0.02 AS exceeds,
        CASE WHEN n >= 5 AND median > 0 THEN round(value / round(median, 6), 6) END AS median_ratio FROM placed WHERE place <= 10 OR value >= {_LIMIT} * 0.02"""
    ),
    "tail_observations": _sql(f"AND_WITH {_INCIDENTS}, {_OBSERVED} SELECT detector, obs AS kind, severity, session_id, idx, value FROM observed"),
    "tail_coverage": _sql(
        """SELECT count(*) AS calls, count(*) FILTER (paired) AS paired, count(*) FILTER (NOT paired) AS unpaired, count(*) FILTER (paired AND ts IS NOT NULL AND r_ts IS NOT NULL) AS timed,
        count(*) FILTER (paired AND r_size IS NOT NULL) AS sized FROM f WHERE is_call"""
    ),
    "round_activity": _sql(
        f"""AND_WITH {_ROUNDS} SELECT category, model, input IS NULL OR output IS NULL OR cache_read IS NULL OR cache_write IS NULL AS incomplete, count(*) AS rounds, CAST(sum(calls) AS BIGINT) AS calls,
        CAST(sum(coalesce(input, 0)) AS BIGINT) AS input, CAST(sum(coalesce(output, 0)) AS BIGINT) AS output, CAST(sum(coalesce(cache_read, 0)) AS BIGINT) AS cache_read,
        CAST(sum(coalesce(cache_write, 0)) AS BIGINT) AS cache_write FROM rounds GROUP BY ALL"""
    ),
    "cache_rebuilds": _sql(f"SELECT session_id, idx, CAST(value AS DOUBLE) AS value FROM ({_rebuilds(2000)})"),
    "theme_scores": _sql(
        f"""AND_WITH {_INCIDENTS}, per AS (SELECT kind, count(*) AS n, count(DISTINCT session_id) AS sessions, sum(value) AS total FROM incidents GROUP BY kind)
        SELECT kind, n, sessions, round(30 * n / max(n) OVER () + 15 * total / max(total) OVER () + 35 * sessions / max(sessions) OVER () + 20 * (1 - n / sum(n) OVER ()), 6) AS score FROM per"""
    ),
    "priority_rank": _sql(
        f"""AND_WITH {_INCIDENTS}, {_OBSERVED}, routed AS (SELECT detector, severity, count(*) AS incidents, count(DISTINCT session_id) AS sessions FROM observed GROUP BY detector, severity)
        SELECT detector, severity, incidents, sessions, CASE WHEN sessions >= 20 THEN 'supported' WHEN sessions >= 5 THEN 'investigate' ELSE 'measure' END AS route,
        row_number() OVER (ORDER BY CASE WHEN sessions >= 20 THEN 0 WHEN sessions >= 5 THEN 1 ELSE 2 END, incidents DESC, detector) AS place FROM routed"""
    ),
}
_SEVERE = "list_position(['info', 'low', 'medium', 'high'], severity)"
ORACLE_SQL["run_brief"] = f"""WITH th AS ({ORACLE_SQL["theme_scores"]}), pr AS ({ORACLE_SQL["priority_rank"]}), fu AS ({_FOUND["findings_union"]}),
per AS (SELECT detector, severity, CAST(findings AS BIGINT) AS n, sessions FROM fu UNION ALL SELECT detector, severity, incidents, sessions FROM pr)
SELECT 'overview' AS section, 1::BIGINT AS place, 'sessions' AS name, NULL::VARCHAR AS label, count(DISTINCT user_id) AS n, NULL::BIGINT AS sessions, NULL::DOUBLE AS score FROM events
UNION ALL SELECT 'overview', 2, 'findings', NULL, CAST(coalesce(sum(n), 0) AS BIGINT), NULL, NULL FROM per UNION ALL SELECT 'overview', 3, 'signals', NULL, count(DISTINCT detector), NULL, NULL FROM per
UNION ALL SELECT 'overview', 4, 'severity', arg_max(severity, {_SEVERE}), NULL, NULL, NULL FROM per
UNION ALL SELECT 'finding', row_number() OVER (ORDER BY {_SEVERE} DESC, n DESC, detector), detector, severity, n, sessions, NULL FROM per
UNION ALL SELECT 'theme', row_number() OVER (ORDER BY score DESC, kind), kind, of, n, sessions, score FROM th LEFT JOIN (SELECT DISTINCT detector AS of FROM per) ON of = 'TAIL_' || upper(kind)
UNION ALL SELECT 'priority', place, detector, route, incidents, sessions, NULL FROM pr"""
