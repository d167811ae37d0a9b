"""Queries of tasks, episodes, delegations and waste (E, H, J12, J14, M7, M9, A21, A22, A30, O8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.functions import text as tx
from tracewright.operators import sequence as s
from tracewright.operators import handovers as h
from tracewright.operators import structure as t
from tracewright.operators.facts import facts
from tracewright.sources.driver_tables import conversation_events, responses, sql, table, trace_events, work_events

_EDGES = [86_400.0 * d for d in (1, 7, 30)]


def episodes(spark, d):
    return t.episodes(trace_events(spark, d), 6 * 3600.0, 6)


def task_ledger(spark, d):
    opens = (F.col("kind") == "user_msg") & (tx.word_count(F.col("text")) >= 20)
    return t.tasks(conversation_events(spark, d), opens).withColumn("task", F.col("task").cast("long"))


def handovers(spark, d):
    found = h.handovers(facts(work_events(spark, d)))
    return found.select("session_id", "idx", "scope", F.array_join("files", ",").alias("files"), "review", "status", "returned", F.round("seconds", 6).alias("seconds"))


def repeated_delegations(spark, d):
    return h.repeated(h.handovers(facts(work_events(spark, d))))


def delegation_use(spark, d):
    return h.consumption(facts(work_events(spark, d)))


def cache_wait_cohorts(spark, d):
    return t.wait_cohorts(responses(spark, d), _EDGES)


def _candidates(spark, d):
    """Duplicate work is a repeated read."""
    rows = s.request_scope(trace_events(spark, d)).withColumn("unit", F.col("scope"))
    total = lambda r: r.groupBy("session_id", "unit").agg(F.sum("size").alias("amount"))
    per = lambda c: total(rows.filter(c))
    return [
        ("EXTERNAL_BLOCK", per(F.col("error").isin("rate_limit", "sandbox_egress"))),
        ("DUPLICATE_WORK", total(t.repeated_reads(rows))),
        ("INEFFECTIVE_ITERATION", per(F.col("error") == "build_test_fail")),
    ]


def waste_partition(spark, d):
    return t.claim(_candidates(spark, d)).groupBy("claim").agg(F.count("*").alias("units"), F.sum("amount").alias("amount"))


def vetoed_diagnoses(spark, d):
    blocked, duplicates, _ = _candidates(spark, d)
    return t.veto(duplicates[1], blocked[1], ["session_id", "unit"])


def classifier_coverage(spark, d):
    lab = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    each = F.array(*(F.struct(F.lit(n).alias("feature_id"), c.alias("confidence")) for n, c in (("quality", F.col("n_chars") % 10 / 10), ("toxic", F.nullif(F.col("toxic").cast("double"), F.lit(0.0))))))
    rows = lab.select("lang", F.col("doc_id").alias("object_id"), F.inline(each)).withColumns({"status": t.answer_status(F.col("confidence")), "at": F.lit(1)})
    return t.coverage(rows, ["lang"], 2)


def capability_lattice(spark, d):
    return t.lattice(trace_events(spark, d).filter("category is not null"), "session_id", "category", F.col("k") % 3)


def largest_sessions(spark, d):
    """A top-k report."""
    rows = trace_events(spark, d).groupBy("session_id").agg(F.sum("size").alias("size"))
    return rows.orderBy(F.col("size").desc(), "session_id").limit(10)


QUERIES = {
    f.__name__: f
    for f in (
        episodes, task_ledger, handovers, repeated_delegations, delegation_use, cache_wait_cohorts, waste_partition, vetoed_diagnoses, classifier_coverage, capability_lattice, largest_sessions,
    )
}

_UPTO = "OVER (PARTITION BY session_id ORDER BY idx ROWS UNBOUNDED PRECEDING)"
_BEFORE = "OVER (PARTITION BY session_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_LAUNCHED = f"""launched AS (SELECT session_id, idx, scope, 'src/m' || regexp_extract(text, 'm([0-9]+)', 1) || '.py' AS files, true AS review,
    CASE WHEN NOT paired THEN 'unknown' WHEN r_ok THEN 'completed' ELSE 'refused' END AS status, CASE WHEN paired AND r_ok THEN r_idx END AS returned,
    CASE WHEN paired AND r_ok THEN round((r_ts - ts) / 1e6, 6) END AS seconds FROM f WHERE is_call AND tool = 'Task')"""
_SCOPED = f"scoped AS (SELECT *, row_number() OVER (PARTITION BY session_id, category, path ORDER BY idx) AS nth, coalesce(max(CASE WHEN kind = 'user_msg' THEN idx END) {_UPTO}, -1) AS unit FROM ev)"


def _per(condition: str) -> str:
    return f"SELECT session_id, unit, CAST(sum(size) AS BIGINT) AS amount FROM scoped WHERE {condition} GROUP BY session_id, unit"


_BLOCK, _DUPLICATE, _ITERATE = _per("error IN ('rate_limit', 'sandbox_egress')"), _per("category = 'read' AND nth > 1"), _per("error = 'build_test_fail'")
ORACLE_SQL = {
    "episodes": sql(
        f"""AND_WITH gaps AS (SELECT *, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY session_id ORDER BY idx)) / 1e6 AS gap,
            last_value(category IGNORE NULLS) {_BEFORE} AS was FROM ev),
        reasons AS (SELECT *, CASE WHEN kind = 'user_msg' THEN 'user_turn' WHEN gap > 21600 THEN 'idle_gap' WHEN was = 'write' AND category = 'execute' THEN 'phase_shift' END AS reason FROM gaps),
        parts AS (SELECT *, sum(CASE WHEN reason IS NULL THEN 0 ELSE 1 END) {_UPTO} AS part FROM reasons),
        splits AS (SELECT *, greatest(sum(CASE WHEN kind = 'tool_call' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id, part ORDER BY idx ROWS UNBOUNDED PRECEDING) - 1, 0) // 6 AS split FROM parts)
        SELECT session_id, min(idx) AS first_idx, max(idx) AS last_idx, count(*) FILTER (kind = 'tool_call') AS calls,
        CASE WHEN split > 0 THEN 'cap_split' ELSE coalesce(max(reason), 'start') END AS reason FROM splits GROUP BY session_id, part, split""",
        "ev",
    ),
    "task_ledger": sql(
        f"""AND_WITH opened AS (SELECT *, kind = 'user_msg' AND len(regexp_extract_all(text, '\\S+')) >= 20 AS opens FROM conv WHERE kind <> 'meta'),
        numbered AS (SELECT *, CAST(sum(CASE WHEN opens THEN 1 ELSE 0 END) {_UPTO} AS BIGINT) AS task FROM opened)
        SELECT session_id, task, min(idx) AS first_idx, count(*) AS n_events, count(*) FILTER (kind = 'user_msg' AND NOT opens) AS amendments,
        max(idx) FILTER (kind = 'assistant_msg') AS last_answer FROM numbered WHERE task > 0 GROUP BY session_id, task""",
        "conv",
    ),
    "handovers": sql(f"AND_WITH {_LAUNCHED} SELECT * FROM launched", "made", "work", "f"),
    "repeated_delegations": sql(
        f"""AND_WITH {_LAUNCHED} SELECT a.session_id, a.idx, count(*) AS earlier FROM launched a JOIN launched b ON a.session_id = b.session_id AND a.scope = b.scope AND a.files = b.files
        WHERE a.status <> 'refused' AND b.idx < b.returned AND b.returned < a.idx GROUP BY a.session_id, a.idx""",
        "made", "work", "f",
    ),
    "delegation_use": sql(
        f"""AND_WITH {_LAUNCHED}, later AS (SELECT l.session_id, l.idx, returned, c.idx AS place, c.category, min(CASE WHEN c.category = 'write' THEN c.idx END) OVER (PARTITION BY l.session_id, l.idx) AS next_write
            FROM launched l JOIN f c ON c.session_id = l.session_id AND c.is_call AND c.idx > returned)
        SELECT session_id, idx, returned, min(place) AS next_call, any_value(next_write) AS next_write, count(*) FILTER (category = 'read' AND (next_write IS NULL OR place < next_write)) AS reads_before_write
        FROM later GROUP BY session_id, idx, returned""",
        "made", "work", "f",
    ),
    "cache_wait_cohorts": sql(
        "SELECT model, CAST(CASE " + " ".join(f"WHEN wait >= {e} THEN {e}" for e in reversed(_EDGES)) + """ ELSE 0.0 END AS DOUBLE) AS band, count(*) AS waits, CAST(sum(cache_write) AS BIGINT) AS written,
        count(*) FILTER (cache_read < before) AS rewrites FROM (SELECT *, (epoch_us(ts_end) - lag(epoch_us(ts_end)) OVER w) / 1e6 AS wait, lag(cache_read) OVER w AS before FROM resp
        WINDOW w AS (PARTITION BY thread_id ORDER BY ts_end, seq)) WHERE wait IS NOT NULL GROUP BY 1, 2""",
        "resp",
    ),
    "waste_partition": sql(
        f"""AND_WITH {_SCOPED}, claims AS (SELECT 'EXTERNAL_BLOCK' AS claim, 0 AS p, * FROM ({_BLOCK}) UNION ALL SELECT 'DUPLICATE_WORK', 1, * FROM ({_DUPLICATE})
            UNION ALL SELECT 'INEFFECTIVE_ITERATION', 2, * FROM ({_ITERATE}))
        SELECT claim, count(*) AS units, CAST(sum(amount) AS BIGINT) AS amount FROM (SELECT *, row_number() OVER (PARTITION BY session_id, unit ORDER BY p) AS r FROM claims)
        WHERE r = 1 GROUP BY claim""",
        "ev",
    ),
    "vetoed_diagnoses": sql(f"AND_WITH {_SCOPED} SELECT d.* FROM ({_DUPLICATE}) d ANTI JOIN ({_BLOCK}) b ON d.session_id = b.session_id AND d.unit = b.unit", "ev"),
    "classifier_coverage": """SELECT lang, count(*) AS objects, count(*) FILTER (answered = 2) AS complete, CAST(sum(answered) AS BIGINT) AS answered, CAST(sum(uncertain) AS BIGINT) AS uncertain
        FROM (SELECT lang, doc_id, CASE WHEN q BETWEEN 0.3 AND 0.7 THEN 0 ELSE 1 END + CASE WHEN toxic = 1 THEN 1 ELSE 0 END AS answered, CASE WHEN q BETWEEN 0.3 AND 0.7 THEN 1 ELSE 0 END AS uncertain
            FROM (SELECT lang, doc_id, toxic, CAST(n_chars % 10 AS DOUBLE) / 10 AS q FROM labels JOIN documents USING (doc_id))) GROUP BY lang""",
    "capability_lattice": sql("SELECT session_id, category, min(k % 3) AS declared, max(k % 3) AS observed FROM ev WHERE category IS NOT NULL GROUP BY session_id, category", "ev"),
    "largest_sessions": sql("SELECT session_id, CAST(sum(size) AS BIGINT) AS size FROM ev GROUP BY session_id ORDER BY size DESC, session_id LIMIT 10", "ev"),
}
