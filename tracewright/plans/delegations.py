"""Queries of delegations: binding, follow-ups, children, interventions and levels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewright.operators import delegations as g
from tracewright.operators.graph import scratch, stored
from tracewright.sources.driver_tables import table

_UUID = "00000000-0000-4000-8000-"


def _thread(key: F.Column) -> F.Column:
    return F.concat(F.lit(_UUID), F.lpad(key.cast("string"), 12, "0"))


def tree(spark: SparkSession, d: str) -> DataFrame:
    """`orders` as sessions: those of a customer are one trace, in order of their keys; session k > 0 has number
    (k - 1) div 2 as its parent. With the key of the other child of that parent, and the parent's key and date."""
    k = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("trace_id"), F.col("o_orderkey").alias("key"), k.cast("long").alias("ord"), "o_orderdate")
    up = o.select("trace_id", F.col("ord").alias("p_ord"), F.col("key").alias("p_key"), F.col("o_orderdate").alias("p_date"))
    twin = o.select("trace_id", F.col("ord").alias("t_ord"), F.col("key").alias("t_key"))
    rows = o.withColumns({"p_ord": F.floor((F.col("ord") - 1) / 2).cast("long"), "t_ord": F.when(F.col("ord") % 2 == 1, F.col("ord") + 1).otherwise(F.col("ord") - 1)})
    return rows.join(up, ["trace_id", "p_ord"], "left").join(twin, ["trace_id", "t_ord"], "left")


def delegation_tables(spark: SparkSession, d: str, keep: Callable[[DataFrame], DataFrame] = stored) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(events, sessions, links). Line items are a session's calls with their usage; a session ends with an answer, but
    for some; each session but the first is launched by its parent, in ways that depend on its key: see the SQL twin. The
    trees and the events are made once and kept by `keep`, as every operator reads them several times."""
    t = keep(tree(spark, d))
    sessions = t.select("trace_id", _thread(F.col("key")).alias("session_id"), "ord")
    nested = t.filter("p_key is not null")
    links = nested.filter("key % 9 <> 0").select(
        "trace_id", _thread(F.col("p_key")).alias("parent_id"), _thread(F.col("key")).alias("child_id"), F.when(F.col("key") % 11 == 0, "fork").otherwise("spawn").alias("kind"), "ord", F.lit("high").alias("confidence")
    )
    li = table(spark, d, "lineitem").join(t.select("trace_id", "key", "ord"), F.col("l_orderkey") == F.col("key"))
    first = Window.partitionBy("key").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    li = li.withColumn("at", 10 * F.row_number().over(first))
    own = ["trace_id", _thread(F.col("key")).alias("session_id"), "ord"]
    reads = F.col("l_partkey") % 3 != 0
    line = lambda **c: F.struct(*(c.get(n, F.lit(None)).cast(k).alias(n) for n, k in {"idx": "long", **g.COLUMNS}.items()))
    call = line(
        idx=F.col("at"), kind=F.lit("tool_call"), tool=F.when(reads, "Read").otherwise("Edit"), category=F.when(reads, "read").otherwise("write"),
        path=F.concat(F.lit("src/p"), F.col("l_partkey") % 20, F.lit(".py")),
    )
    usage = line(
        idx=F.col("at") + 1, kind=F.lit("usage"), model=F.concat(F.lit("m"), F.col("l_suppkey") % 3), input=F.col("l_quantity"), output=F.col("l_linenumber"),
        cache_read=F.when(F.col("key") % 4 != 0, F.col("l_partkey") % 100),
    )
    items = li.select(*own, F.inline(F.array(call, usage)))
    final = t.filter("key % 3 <> 2").select(*own, F.lit(900).cast("long").alias("idx"), F.lit("assistant_msg").alias("kind"), F.concat(F.lit("done with "), "key").alias("text"), F.lit(True).alias("final"))
    key, base = F.col("key"), 1000 + 20 * F.col("ord")
    me, v = _thread(key), F.col("key") % 7
    target = F.when(v == 6, F.concat(F.lit("a"), key)).when(key % 10 == 1, F.lit("nobody")).otherwise(me)
    result = (
        F.when(v == 0, F.concat(F.lit("Agent ID: "), me)).when((v == 1) & (key % 2 == 0), F.concat_ws(" and ", F.concat(F.lit("threads "), me), _thread(F.col("t_key")))).when(v == 1, "started")
        .when(v == 2, "refused").when(v == 3, "ok").when(v == 4, F.concat(F.lit("Agent: "), me, F.lit(" in the background"))).when(v == 5, F.concat(F.lit("Agent ID: "), me)).otherwise(F.concat(F.lit("Agent ID: a"), key))
    )
    text = F.concat(F.lit("do src/p"), key % 20, F.lit(".py, report"))
    said = [
        # more, holds, kind, tool, call, agent, text, ok, raw_type, status
        (0, F.lit(True), "tool_call", F.when((v == 1) & (key % 2 == 0), "create_thread").otherwise("spawn_agent"), "l", F.when(v == 3, me), text, None, None, None),
        (1, F.lit(True), "tool_result", None, "l", None, result, v != 2, None, None),
        (2, v == 5, "tool_call", F.lit("spawn_agent"), "x", None, text, None, None, None),
        (3, v == 5, "tool_result", None, "x", None, F.concat(F.lit("Agent ID: "), me), F.lit(True), None, None),
        (4, key % 2 == 0, "tool_call", F.lit("steer_subagent"), "s", target, F.lit("go on"), None, None, None),
        (5, key % 3 == 0, "tool_call", F.lit("get_subagent_result"), "w", target, None, None, None, None),
        (6, key % 3 == 0, "tool_result", None, "w", None, F.when(key % 6 == 0, "Status: completed. fine").otherwise("Status: running"), F.lit(True), None, None),
        (7, key % 5 == 0, "tool_call", F.lit("agent"), "r", target, F.lit("again"), None, None, None),
        (8, key % 4 == 0, "notification", None, "n", target, F.when(key % 8 == 0, "result"), None, F.lit("subagent-notification"), F.element_at(F.array(*map(F.lit, ("completed", "failed", "terminated", "error"))), (F.floor(key / 4) % 4 + 1).cast("int"))),
    ]
    none = F.lit(None)
    each = [
        F.when(
            holds,
            F.struct(
                (base + more).cast("long").alias("idx"), F.lit(kind).alias("kind"), (none if tool is None else tool).cast("string").alias("tool"), F.concat(F.lit(call), key).alias("call_id"),
                (none if agent is None else agent).cast("string").alias("agent"), (none if words is None else words).cast("string").alias("text"), (none if ok is None else ok).cast("boolean").alias("ok"),
                (none if raw is None else raw).cast("string").alias("raw_type"), (none if status is None else status).cast("string").alias("status"),
            ),
        )
        for more, holds, kind, tool, call, agent, words, ok, raw, status in said
    ]
    launched = nested.select("trace_id", _thread(F.col("p_key")).alias("session_id"), F.col("p_ord").alias("ord"), F.inline(F.filter(F.array(*each), lambda x: x.isNotNull())))
    parts = (items, final, launched)
    whole = [p.select("trace_id", "session_id", "ord", "idx", *((F.col(c) if c in p.columns else none).cast(k).alias(c) for c, k in g.COLUMNS.items())) for p in parts]
    events = whole[0].unionByName(whole[1]).unionByName(whole[2])
    return keep(events), sessions, links


def _ledger(spark, d, keep=stored):
    events, sessions, links = delegation_tables(spark, d, keep)
    return events, sessions, links, *g.ledger(events, sessions, links)


def delegation_binding(spark, d):
    *_, launched, _ = _ledger(spark, d)
    return launched.select("trace_id", "session_id", "idx", "agent", "child", "names", "confidence", "evidence", "steers", "resumes", "waits", "notices", F.array_join("request_files", ",").alias("files"), "status")


def delegation_followups(spark, d):
    *_, said = _ledger(spark, d)
    return said.select("trace_id", "session_id", "idx", "action", "target", "l_session", "l_idx")


def delegation_children(spark, d):
    with scratch(spark) as keep:
        events, _, links, launched, _ = _ledger(spark, d, keep)
        found = g.children(launched, events, links)
    lists = {c: F.array_join(c, ",") for c in ("models", "files_read", "files_written")}
    columns = ("input", "output", "cache_read", "cache_write", "calls", "models", "files_read", "files_written", "answer", "tree_sessions", "tree_input", "tree_output", "tree_calls", "tree_files")
    return found.withColumns(lists).select("trace_id", "session_id", "idx", "child", *columns)


def delegation_levels(spark, d):
    _, sessions, links, launched, _ = _ledger(spark, d)
    return g.parents_first(sessions, links, launched).select("trace_id", "session_id", "root", "depth", "path", F.col("spawned_at.session_id").alias("spawn_session"), F.col("spawned_at.idx").alias("spawn_idx"))


def delegation_interventions(spark, d):
    """Answers stand in for a classifier's: a number from the line items of the launched order, one a question."""
    *_, launched, _ = _ledger(spark, d)
    questions = (*g.CHANGES, *g.CONTRACT, *g.RETURN)
    k = F.substring("child", 25, 12).cast("long")
    each = F.array(*(F.struct(F.lit(q).alias("question"), (((k * (n + 3) + 7 * n) % 41) / 40.0).alias("value"), F.lit(None if n % 2 else 0.03).cast("double").alias("low"), F.lit(None if n % 3 else 0.97).cast("double").alias("high"), (k % (n + 5) == 0).alias("abstains")) for n, q in enumerate(questions)))
    answers = launched.filter("child is not null").select(*g.PLACE, F.inline(each))
    failed = launched.filter(k % 29 == 0)
    return g.interventions(launched, answers, failed).select("trace_id", "session_id", "idx", "status", "intervention")


QUERIES = {f.__name__: f for f in (delegation_binding, delegation_followups, delegation_children, delegation_levels, delegation_interventions)}

_T = f"""tree AS (SELECT o.trace_id, o.key, o.ord, p.key AS p_key, p.ord AS p_ord, t.key AS t_key, printf('{_UUID}%012d', o.key) AS me, printf('{_UUID}%012d', p.key) AS up, printf('{_UUID}%012d', t.key) AS twin FROM base o
    LEFT JOIN base p ON o.trace_id = p.trace_id AND o.ord > 0 AND p.ord = (o.ord - 1) // 2
    LEFT JOIN base t ON o.trace_id = t.trace_id AND t.ord = CASE WHEN o.ord % 2 = 1 THEN o.ord + 1 ELSE o.ord - 1 END)"""
_WITH = f"""WITH RECURSIVE base AS (SELECT o_custkey AS trace_id, o_orderkey AS key, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS ord FROM orders), {_T},
links AS (SELECT trace_id, up AS parent_id, me AS child_id, CASE WHEN key % 11 = 0 THEN 'fork' ELSE 'spawn' END AS kind, ord FROM tree WHERE p_key IS NOT NULL AND key % 9 <> 0),
child AS (SELECT *, 1000 + 20 * ord AS pos, CASE WHEN key % 7 = 6 THEN 'a' || key WHEN key % 10 = 1 THEN 'nobody' ELSE me END AS target FROM tree WHERE p_key IS NOT NULL),
launch AS (SELECT trace_id, up AS session_id, p_ord AS ord, pos AS idx, key, me, CASE WHEN key % 7 IN (0, 3, 4, 5) THEN me WHEN key % 7 = 6 THEN 'a' || key END AS agent,
        CASE WHEN key % 7 = 1 AND key % 2 = 0 THEN [me] || CASE WHEN t_key IS NULL THEN [] ELSE [twin] END ELSE [] END AS mentions, key % 7 = 2 AS refused, key % 7 = 4 AS background FROM child
    UNION ALL SELECT trace_id, up, p_ord, pos + 2, key, me, me, [], false, false FROM child WHERE key % 7 = 5),
pairs AS (SELECT trace_id, session_id, ord, idx, agent AS child, 1 AS rank, -ord AS o1, -idx AS o2, 0 AS place FROM launch WHERE agent LIKE '0000%'
    UNION ALL SELECT trace_id, session_id, ord, idx, x.m, 2, ord, idx, x.n FROM (SELECT *, unnest(list_zip(mentions, range(len(mentions)))) AS z FROM launch), LATERAL (SELECT z[1] AS m, z[2] AS n) x),
best1 AS (SELECT *, row_number() OVER (PARTITION BY trace_id, session_id, idx ORDER BY rank, o1, o2, place, child) AS l, row_number() OVER (PARTITION BY trace_id, child ORDER BY rank, o1, o2, place, session_id, idx) AS r FROM pairs),
won1 AS (SELECT * FROM best1 WHERE l = 1 AND r = 1),
pairs2 AS (SELECT * EXCLUDE (l, r) FROM best1 b WHERE NOT EXISTS (FROM won1 w WHERE w.trace_id = b.trace_id AND (w.child = b.child OR (w.session_id = b.session_id AND w.idx = b.idx)))),
best2 AS (SELECT *, row_number() OVER (PARTITION BY trace_id, session_id, idx ORDER BY rank, o1, o2, place, child) AS l, row_number() OVER (PARTITION BY trace_id, child ORDER BY rank, o1, o2, place, session_id, idx) AS r FROM pairs2),
won AS (SELECT * FROM won1 UNION ALL SELECT * FROM best2 WHERE l = 1 AND r = 1),
every AS (SELECT l.*, w.child AS got, w.rank, CASE WHEN l.agent LIKE '0000%' THEN l.agent END AS names FROM launch l LEFT JOIN won w ON l.trace_id = w.trace_id AND l.session_id = w.session_id AND l.idx = w.idx),
spare AS (SELECT trace_id, session_id, min(idx) AS idx FROM every WHERE got IS NULL AND names IS NULL GROUP BY 1, 2 HAVING count(*) = 1),
free AS (SELECT trace_id, parent_id AS session_id, arg_min(child_id, ord) AS child FROM links k WHERE kind = 'spawn' AND NOT EXISTS (FROM won w WHERE w.trace_id = k.trace_id AND w.child = k.child_id) GROUP BY 1, 2),
bound AS (SELECT e.*, coalesce(e.got, f.child) AS child, CASE WHEN f.child IS NOT NULL THEN 'unique_unmatched_spawn' WHEN rank = 1 THEN 'exact_id' WHEN rank = 2 THEN 'mentioned_thread' END AS evidence,
    CASE WHEN f.child IS NOT NULL OR rank = 2 THEN 'medium' WHEN e.got IS NULL THEN 'unknown' WHEN k.child_id IS NULL THEN 'unknown' ELSE 'high' END AS confidence
    FROM every e LEFT JOIN spare s ON e.trace_id = s.trace_id AND e.session_id = s.session_id AND e.idx = s.idx LEFT JOIN free f ON s.trace_id = f.trace_id AND s.session_id = f.session_id
    LEFT JOIN links k ON k.trace_id = e.trace_id AND k.child_id = e.got),
asked AS (SELECT trace_id, up AS session_id, p_ord AS ord, pos + 4 AS idx, 'steer' AS action, target, false AS done FROM child WHERE key % 2 = 0
    UNION ALL SELECT trace_id, up, p_ord, pos + 5, 'wait', target, key % 6 = 0 FROM child WHERE key % 3 = 0 UNION ALL SELECT trace_id, up, p_ord, pos + 7, 'resume', target, false FROM child WHERE key % 5 = 0),
keys AS (SELECT DISTINCT trace_id, ord, idx, session_id, unnest([agent, child]) AS name FROM bound),
said AS (SELECT a.trace_id, a.session_id, a.idx, a.action, a.target, a.done, arg_max(k.session_id, [k.ord, k.idx]) AS l_session, arg_max(k.idx, [k.ord, k.idx]) AS l_idx FROM asked a
    LEFT JOIN keys k ON k.trace_id = a.trace_id AND k.name = a.target AND (k.ord < a.ord OR (k.ord = a.ord AND k.idx < a.idx)) GROUP BY ALL),
spoken AS (SELECT trace_id, l_session, l_idx, count(*) FILTER (action = 'steer') AS steers, count(*) FILTER (action = 'resume') AS resumes, count(*) FILTER (action = 'wait') AS waits, bool_or(done) AS wait_done FROM said GROUP BY 1, 2, 3),
told AS (SELECT c.trace_id, c.p_ord AS ord, c.pos + 8 AS idx, c.target, (['completed', 'failed', 'terminated', 'error'])[c.key // 4 % 4 + 1] AS status, c.key % 8 = 0 AS reply FROM child c WHERE key % 4 = 0),
lasts AS (SELECT trace_id, agent, arg_max(session_id, [ord, idx]) AS session_id, arg_max(idx, [ord, idx]) AS idx FROM bound WHERE agent IS NOT NULL GROUP BY 1, 2),
noted AS (SELECT l.trace_id, l.session_id, l.idx, count(*) AS notices, arg_max(status, [t.ord, t.idx]) AS notice, bool_or(status = 'completed' AND reply) AS notice_done FROM told t JOIN lasts l ON t.trace_id = l.trace_id AND t.target = l.agent GROUP BY 1, 2, 3),
launched AS (SELECT b.trace_id, b.session_id, b.idx, b.agent, b.child, b.names, b.confidence, b.evidence, coalesce(steers, 0) AS steers, coalesce(resumes, 0) AS resumes, coalesce(waits, 0) AS waits, coalesce(notices, 0) AS notices,
    'src/p' || (b.key % 20) || '.py' AS files, b.refused,
    CASE WHEN (NOT b.refused AND NOT b.background) OR coalesce(wait_done, false) OR coalesce(notice_done, false) OR coalesce(t.key % 3 <> 2, false) THEN 'completed' WHEN notice = 'completed' THEN 'result-unavailable'
        WHEN notice = 'terminated' THEN 'terminated' WHEN notice IS NOT NULL THEN 'failed' WHEN b.refused THEN 'spawn-rejected' WHEN b.background THEN 'running-at-capture' ELSE 'unknown' END AS status
    FROM bound b LEFT JOIN spoken s ON s.trace_id = b.trace_id AND s.l_session = b.session_id AND s.l_idx = b.idx LEFT JOIN noted n ON n.trace_id = b.trace_id AND n.session_id = b.session_id AND n.idx = b.idx
    LEFT JOIN tree t ON t.trace_id = b.trace_id AND t.me = b.child),
down AS (SELECT trace_id, parent_id AS top, child_id AS under FROM links UNION ALL SELECT d.trace_id, d.top, k.child_id FROM down d JOIN links k ON d.trace_id = k.trace_id AND d.under = k.parent_id),
within AS (SELECT * FROM down UNION ALL SELECT trace_id, me, me FROM tree)
"""
ORACLE_SQL = {
    "delegation_binding": _WITH + "SELECT * EXCLUDE (refused) FROM launched",
    "delegation_followups": _WITH + "SELECT trace_id, session_id, idx, action, target, l_session, l_idx FROM said",
    "delegation_children": _WITH + """, li AS (SELECT trace_id, me, l_partkey AS part, l_suppkey AS supp, l_linenumber AS n, CAST(l_quantity AS BIGINT) AS quantity, key, row_number() OVER (PARTITION BY key ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS nth FROM lineitem JOIN tree ON l_orderkey = key),
    own AS (SELECT trace_id, me, CAST(sum(quantity) AS BIGINT) AS input, CAST(sum(n) AS BIGINT) AS output, CAST(sum(CASE WHEN key % 4 <> 0 THEN part % 100 END) AS BIGINT) AS cache_read, count(*) AS calls FROM li GROUP BY 1, 2),
    started AS (SELECT trace_id, session_id AS me, count(*) AS more FROM (SELECT trace_id, session_id FROM launch UNION ALL SELECT trace_id, session_id FROM asked) GROUP BY 1, 2),
    counted AS (SELECT t.trace_id, t.me, o.input, o.output, o.cache_read, coalesce(o.calls, 0) + coalesce(s.more, 0) AS calls, t.key FROM tree t LEFT JOIN own o ON t.trace_id = o.trace_id AND t.me = o.me LEFT JOIN started s ON t.trace_id = s.trace_id AND t.me = s.me),
    models AS (SELECT trace_id, me, string_agg(model, ',' ORDER BY first) AS models FROM (SELECT trace_id, me, 'm' || (supp % 3) AS model, min(nth) AS first FROM li GROUP BY ALL) GROUP BY 1, 2),
    files AS (SELECT trace_id, me, coalesce(string_agg(DISTINCT path, ',' ORDER BY path) FILTER (part % 3 <> 0), '') AS files_read, coalesce(string_agg(DISTINCT path, ',' ORDER BY path) FILTER (part % 3 = 0), '') AS files_written FROM (SELECT *, 'src/p' || (part % 20) || '.py' AS path FROM li) GROUP BY 1, 2),
    trees AS (SELECT w.trace_id, w.top, count(*) AS tree_sessions, CAST(sum(input) AS BIGINT) AS tree_input, CAST(sum(output) AS BIGINT) AS tree_output, CAST(sum(calls) AS BIGINT) AS tree_calls FROM within w JOIN counted c ON c.trace_id = w.trace_id AND c.me = w.under GROUP BY 1, 2),
    paths AS (SELECT w.trace_id, w.top, count(DISTINCT part % 20) AS tree_files FROM within w JOIN li ON li.trace_id = w.trace_id AND li.me = w.under GROUP BY 1, 2)
    SELECT l.trace_id, l.session_id, l.idx, l.child, input, output, cache_read, NULL::BIGINT AS cache_write, calls, coalesce(models, '') AS models, coalesce(files_read, '') AS files_read, coalesce(files_written, '') AS files_written,
        CASE WHEN c.key % 3 <> 2 THEN 'done with ' || c.key END AS answer, tree_sessions, tree_input, tree_output, tree_calls, coalesce(tree_files, 0) AS tree_files
    FROM launched l JOIN counted c ON c.trace_id = l.trace_id AND c.me = l.child LEFT JOIN models m ON m.trace_id = c.trace_id AND m.me = c.me LEFT JOIN files f ON f.trace_id = c.trace_id AND f.me = c.me
    LEFT JOIN trees t ON t.trace_id = c.trace_id AND t.top = c.me LEFT JOIN paths p ON p.trace_id = c.trace_id AND p.top = c.me""",
    "delegation_levels": _WITH + """, spawned AS (SELECT trace_id, child, session_id AS spawn_session, idx AS spawn_idx FROM launched WHERE child IS NOT NULL),
    placed AS (SELECT t.trace_id, t.me AS session_id, t.me AS root, 0::BIGINT AS depth, '' AS path FROM tree t WHERE NOT EXISTS (FROM links k WHERE k.trace_id = t.trace_id AND k.child_id = t.me)
        UNION ALL SELECT p.trace_id, k.child_id, p.root, p.depth + 1, p.path || '/' || coalesce(CAST(s.spawn_idx AS VARCHAR), '?') FROM placed p JOIN links k ON k.trace_id = p.trace_id AND k.parent_id = p.session_id
            LEFT JOIN spawned s ON s.trace_id = k.trace_id AND s.child = k.child_id)
    SELECT p.*, spawn_session, spawn_idx FROM placed p LEFT JOIN spawned s ON s.trace_id = p.trace_id AND s.child = p.session_id""",
    "delegation_interventions": _WITH
    + ", keyed AS (SELECT *, CAST(substr(child, 25, 12) AS BIGINT) AS k FROM launched), answers AS (SELECT trace_id, session_id, idx, k, unnest(range(9)) AS n FROM keyed WHERE child IS NOT NULL), "
    + """usable AS (SELECT trace_id, session_id, idx, n, (k * (n + 3) + 7 * n) % 41 / 40.0 AS value, CASE WHEN n % 2 = 0 THEN 0.03 ELSE 0.2 END AS low, CASE WHEN n % 3 = 0 THEN 0.97 ELSE 0.8 END AS high FROM answers WHERE k % (n + 5) <> 0),
    flags AS (SELECT trace_id, session_id, idx, bool_or(n < 2 AND value >= high) AS change, bool_or(n BETWEEN 2 AND 4 AND value <= low) AS contract, bool_or(n > 4 AND value <= low) AS reply FROM usable GROUP BY 1, 2, 3)
    SELECT l.trace_id, l.session_id, l.idx, status, CASE WHEN refused OR coalesce(k % 29 = 0, false) THEN 'repair_child_execution' WHEN coalesce(change, false) THEN 'manage_requirement_change' WHEN coalesce(contract, false) THEN 'improve_initial_contract'
        WHEN coalesce(reply, false) THEN 'improve_child_return' ELSE 'investigate_visibility' END AS intervention FROM keyed l LEFT JOIN flags f ON f.trace_id = l.trace_id AND f.session_id = l.session_id AND f.idx = l.idx""",
}
