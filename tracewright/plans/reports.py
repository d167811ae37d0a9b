"""Queries of folds, pages, excerpts, cached answers and retained evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.functions import text as tx
from tracewright.operators import detectors, graph, memory, reports, structure, work
from tracewright.operators.facts import facts
from tracewright.sources.driver_tables import sql, table, work_events

from .evidence import redact_sql, root_walk
from .findings import KNOBS, _finding_sql, bodies
from .spending import RATES
from .work import _EPISODES, _SPENT, ORACLE_SQL as WORK_SQL

_SHOWN = ("RATE_LIMIT_LOOP", "MCP_TRANSPORT_ERR", "TEST_GAMING")


def trace_fold(spark, d):
    rows = table(spark, d, "customer").select(
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("session_id"), F.round("c_acctbal", 2).alias("cost"), F.when(F.col("c_nationkey") % 2 == 0, "exact").otherwise("estimated").alias("status"),
        F.when(F.col("c_acctbal") < 0, "negative").when(F.col("c_custkey") % 50 == 0, "round").alias("note"),
    )
    found = reports.trace_fold(rows, root_walk(spark, d), ["cost"])
    return found.withColumns({"cost": F.round("cost", 2), "notes": F.array_join("notes", ",")})


def month_cells(spark, d):
    """An order is a diagnosis and its own task; those without line items lead to no cell."""
    cells = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("task_id"), F.date_format("l_shipdate", "yyyy-MM").alias("month"), F.col("l_returnflag").alias("model"))
    diagnoses = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.array("o_orderkey").alias("task_ids"))
    return reports.month_cells(diagnoses, cells)


def guidance_pairs(spark, d):
    claims = table(spark, d, "nation").select(F.col("n_nationkey").alias("candidate_id"), F.substring(F.lower("n_name"), 1, 3).alias("claim"))
    chunks = memory.chunks(table(spark, d, "benchmark"), "item_id", "text", 200, 20)
    pairs = reports.comparisons(claims, chunks, 1 << 20)
    return pairs.groupBy("candidate_id").agg(F.count("*").alias("chunks"), F.count_if(F.contains("part", "claim")).alias("told"))


def annotated_evidence(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text"))
    marks = docs.join(table(spark, d, "labels"), "doc_id").select(F.col("doc_id").alias("mark"), "source", "text", "quality")
    return reports.annotated(marks, docs).select("mark", "doc_id", "quality")


def paged_sessions(spark, d):
    return reports.paged(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", 100)


def call_excerpts(spark, d):
    return reports.excerpts(facts(work_events(spark, d)), 8)


def task_edges(spark, d):
    rows = table(spark, d, "documents").select("doc_id", *((F.col("n_chars") % k / float(k)).alias(n) for k, n in ((7, "a"), (5, "b"), (11, "c"), (4, "d"))))
    return rows.groupBy(reports.edge_of(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("edge")).agg(F.count("*").alias("n"))


def lexical_baseline(spark, d):
    found = reports.lexical_baseline(table(spark, d, "conversations"))
    return found.groupBy("role").agg(F.count("*").alias("n"), *(F.count_if(n).alias(n) for n in reports.LEXICAL))


def cached_answers(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.lit("m").alias("model"), F.coalesce("text", F.lit("")).alias("state"), F.coalesce("lang", F.lit("")).alias("question"))
    cache = table(spark, d, "labels").join(docs, "doc_id").select("model", F.sha2("state", 256).alias("state_hash"), F.sha2("question", 256).alias("question_hash"), F.col("quality").alias("value"), F.col("doc_id").alias("at"))
    return reports.cached_answers(docs, cache).select("doc_id", "value", "missing")


def retained_evidence(spark, d):
    each = F.array(*(F.struct(F.lit(q).alias("question"), (F.col("n_chars") % k / float(k)).alias("score")) for q, k in (("correction", 7), ("discovery", 13))))
    return reports.retained_evidence(table(spark, d, "documents").select(F.col("doc_id").alias("record_id"), F.inline(each)), 0.75).withColumn("score", F.round("score", 6))


def episode_composites(spark, d):
    events = work_events(spark, d)
    return reports.composites(work.episode_facts(work.with_episode(facts(events), structure.episodes(events, 6 * 3600.0, 6))))


def response_charges(spark, d):
    events = work_events(spark, d)
    cost = sum((F.coalesce(F.col(k), F.lit(0)) / 1e6 * v for k, v in RATES.items()), F.lit(0.0))
    found = reports.response_charges(facts(events), structure.episodes(events, 6 * 3600.0, 6), cost)
    return found.groupBy("session_id", "episode").agg(F.count("*").alias("responses"), F.round(F.sum("cost"), 8).alias("cost"))


def behaviour_tallies(spark, d):
    events = work_events(spark, d)
    sessions = events.groupBy("session_id").agg(F.max("model").alias("agent"))
    return reports.behaviour(detectors.run(events, KNOBS, enabled=set(_SHOWN)), sessions, "agent")


def call_outcomes(spark, d):
    return reports.worst_results(work_events(spark, d))


def session_links(spark, d):
    """Components of a forest of sessions with their size and depth."""
    return graph.walk(graph.ranked_edges(_forest(spark, d))).groupBy("root").agg(F.count("*").alias("sessions"), F.max("depth").alias("depth"))


def _forest(spark, d):
    o = table(spark, d, "orders")
    return o.filter("o_orderkey > 1").select(F.col("o_orderkey").cast("string").alias("child"), F.floor(F.col("o_orderkey") / 2).cast("string").alias("parent"), F.lit("spawn").alias("kind"))


def redacted_messages(spark, d):
    rows = table(spark, d, "conversations").filter("text is not null")
    return rows.select("conv_id", "turn", F.md5(tx.redact(F.col("text"))).alias("digest"))


QUERIES = {
    f.__name__: f
    for f in (
        trace_fold, month_cells, guidance_pairs, annotated_evidence, paged_sessions, call_excerpts, task_edges, lexical_baseline, cached_answers, retained_evidence, episode_composites,
        response_charges, behaviour_tallies, call_outcomes, session_links, redacted_messages,
    )
}


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _work(body: str) -> str:
    return sql(body, "made", "work", "f")


_ASKED, _SAID = redact_sql("coalesce(command, path, text, '')"), redact_sql("coalesce(r_text, '')")
ORACLE_SQL = {
    "trace_fold": """WITH RECURSIVE edges AS (SELECT 'c' || c_custkey AS child, 'n' || c_nationkey AS parent FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation),
        walk AS (SELECT DISTINCT parent AS node, parent AS root FROM edges WHERE parent NOT IN (SELECT child FROM edges) UNION ALL SELECT e.child, w.root FROM walk w JOIN edges e ON e.parent = w.node)
        SELECT root AS trace_id, count(*) AS sessions, round(sum(round(c_acctbal, 2)), 2) AS cost, coalesce(array_to_string(list_sort(list(DISTINCT CASE WHEN c_acctbal < 0 THEN 'negative' WHEN c_custkey % 50 = 0 THEN 'round' END)
            FILTER (c_acctbal < 0 OR c_custkey % 50 = 0)), ','), '') AS notes, CASE WHEN max(c_nationkey % 2) = 0 THEN 'exact' ELSE 'estimated' END AS status
        FROM customer JOIN walk ON node = 'c' || c_custkey GROUP BY root""",
    "month_cells": """SELECT DISTINCT o_orderkey AS id, coalesce(strftime(l_shipdate, '%Y-%m'), 'unknown') AS month, l_returnflag AS model FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey""",
    "guidance_pairs": """WITH c AS (SELECT item_id, substr(text, u.c * 180 + 1, 200) AS part FROM benchmark, unnest(range(0, greatest(1, CAST(ceil((length(text) - 20) / 180) AS BIGINT)))) AS u(c)),
        k AS (SELECT n_nationkey AS candidate_id, substr(lower(n_name), 1, 3) AS claim FROM nation)
        SELECT candidate_id, count(*) AS chunks, count(*) FILTER (contains(part, claim)) AS told FROM k, c GROUP BY candidate_id""",
    "annotated_evidence": """WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents) SELECT a.doc_id AS mark, b.doc_id, quality FROM d a JOIN labels l ON l.doc_id = a.doc_id JOIN d b ON a.source = b.source AND a.text = b.text""",
    "paged_sessions": "SELECT o_orderkey, o_custkey, (rank() OVER (ORDER BY o_custkey) - 1) // 100 AS page FROM orders",
    "call_excerpts": _work(f"SELECT session_id, idx, left({_ASKED}, 8) AS asked, length({_ASKED}) > 8 AS asked_cut, left({_SAID}, 8) AS said, length({_SAID}) > 8 AS said_cut FROM f WHERE paired"),
    "task_edges": """SELECT CASE WHEN b >= 0.7 THEN 'corrects' WHEN a >= 0.7 THEN 'same' WHEN c >= 0.7 THEN 'follows' WHEN d >= 0.7 THEN 'sibling' ELSE 'new' END AS edge, count(*) AS n FROM (
        SELECT (n_chars % 7) / 7.0::DOUBLE AS a, (n_chars % 5) / 5.0::DOUBLE AS b, (n_chars % 11) / 11.0::DOUBLE AS c, (n_chars % 4) / 4.0::DOUBLE AS d FROM documents) GROUP BY 1""",
    "lexical_baseline": "SELECT role, count(*) AS n, " + ", ".join(f"count(*) FILTER (role = '{r}' AND coalesce(regexp_matches(text, {_q(p)}), false)) AS {n}" for n, (r, p) in reports.LEXICAL.items()) + " FROM conversations GROUP BY role",
    "cached_answers": """WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS lang FROM documents), c AS (SELECT text, lang, arg_max(quality, d.doc_id) AS value FROM labels l JOIN d ON l.doc_id = d.doc_id GROUP BY text, lang)
        SELECT doc_id, value, value IS NULL AS missing FROM d LEFT JOIN c ON d.text = c.text AND d.lang = c.lang""",
    "retained_evidence": """SELECT record_id, round(max(score), 6) AS score, arg_max(question, (score, question)) AS question FROM (SELECT doc_id AS record_id, 'correction' AS question, (n_chars % 7) / 7.0::DOUBLE AS score FROM documents
        UNION ALL SELECT doc_id, 'discovery', (n_chars % 13) / 13.0::DOUBLE FROM documents) GROUP BY record_id HAVING max(score) >= 0.75""",
    "episode_composites": f"""SELECT session_id, episode, tests_failed > 0 AND NOT outstanding AS recovered, declares AND NOT proved AS unproved,
        coalesce(lag(paths_read) OVER w > 0 AND lag(edits) OVER w = 0 AND edits > 0, false) AS investigated FROM ({WORK_SQL["episode_facts"]}) WINDOW w AS (PARTITION BY session_id ORDER BY episode)""",
    "response_charges": _work(
        f"""AND_WITH {_EPISODES}, billed AS (SELECT * FROM tested WHERE kind = 'usage' QUALIFY row_number() OVER (PARTITION BY session_id, response_id ORDER BY idx) = 1)
        SELECT session_id, CAST(episode AS INTEGER) AS episode, count(*) AS responses, round(sum({_SPENT}), 8) AS cost FROM billed GROUP BY ALL"""
    ),
    "behaviour_tallies": _work(
        f"""AND_WITH found AS ({" UNION ALL ".join(f"SELECT DISTINCT detector, session_id FROM ({_finding_sql(n, bodies()[n])})" for n in _SHOWN)}),
        s AS (SELECT session_id, max(model) AS agent FROM work GROUP BY session_id), n AS (SELECT agent, count(*) AS sessions FROM s GROUP BY agent)
        SELECT agent, detector, count(*) AS shown, any_value(n.sessions) AS sessions, round(count(*) / any_value(n.sessions), 6) AS share FROM found JOIN s USING (session_id) JOIN n USING (agent) GROUP BY agent, detector"""
    ),
    "call_outcomes": _work("SELECT session_id, call_id, count(*) AS results, CASE WHEN bool_or(ok = false) THEN 'failed' WHEN count(*) FILTER (ok IS NULL) > 0 THEN 'unknown' ELSE 'ok' END AS outcome FROM work WHERE kind = 'tool_result' AND call_id IS NOT NULL GROUP BY ALL"),
    "session_links": """WITH RECURSIVE e AS (SELECT o_orderkey AS child, o_orderkey // 2 AS parent FROM orders WHERE o_orderkey > 1),
        w AS (SELECT DISTINCT parent AS node, parent AS root, 0 AS depth FROM e WHERE parent NOT IN (SELECT child FROM e) UNION ALL SELECT e.child, w.root, w.depth + 1 FROM w JOIN e ON e.parent = w.node)
        SELECT CAST(root AS VARCHAR) AS root, count(*) AS sessions, CAST(max(depth) AS BIGINT) AS depth FROM w GROUP BY root""",
    "redacted_messages": f"SELECT conv_id, turn, md5({redact_sql('text')}) AS digest FROM conversations WHERE text IS NOT NULL",
}
