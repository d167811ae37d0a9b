"""A query for each detector, and their union with its histogram (D, A20)."""

from __future__ import annotations

from pyspark.sql import functions as F


from tracewright.functions import text as tx
from tracewright.operators import detectors
from tracewright.sources.driver_tables import conversation_events, sql, work_events

#: Values that suit the shared tables, whose sessions last weeks and hold few long texts. The defaults of the rules are
#: for logs. The SQL twins read these.
KNOBS = {
    "bloated_opener": {"tokens": 60}, "cold_start_reads": {"most": 2}, "slow_to_action": {"most": 0}, "overlong_trace": {"events": 150, "tokens": 9_000_000, "minutes": 41_000},
    "context_bloat_no_clear": {"window": 5_000_000}, "tool_monoculture": {"share": 0.25}, "linear_scan_search": {"most": 8}, "idle_gap": {"minutes": 2000}, "EDIT_THRASH": {"rows": 400},
    "RETRY_STORM": {"least": 3, "rows": 300}, "CONTEXT_ROT": {"ratio": 1.0}, "CORRECTION_LOOP": {"rows": 200, "least": 2}, "GOAL_DRIFT": {"recall": 0.6},
    "NO_ADAPT_RETRY": {"distance": 12}, "COMPACTION_AMNESIA": {"rows": 60}, "PERFECTIONISM_LOOP": {"least": 1}, "OVER_ENGINEERING": {"files": 2}, "RUNAWAY_SESSION": {"events": 180},
    "no_plan_dive": {"before": 12}, "PANIC_REVERT": {"rows": 200}, "FULL_FILE_REWRITE": {"lines": 30}, "EDIT_WITHOUT_READ": {"rows": 12},
}
ON_MESSAGES = ("bloated_opener", "thin_prompt")


def _query(name: str):
    def query(spark, sf_dir):
        events = (conversation_events if name in ON_MESSAGES else work_events)(spark, sf_dir)
        return detectors.run(events, KNOBS, enabled={name}).drop("kind")

    query.__name__ = f"finding_{name.lower()}"
    return query


def findings_union(spark, sf_dir):
    found = detectors.run(work_events(spark, sf_dir), KNOBS)
    return found.groupBy("detector", "kind", "severity").agg(F.count("*").alias("findings"), F.countDistinct("session_id").alias("sessions"))


QUERIES = {f"finding_{d.lower()}": _query(d) for d in detectors.REGISTRY} | {"findings_union": findings_union}


def _k(name: str) -> dict:
    return detectors.REGISTRY[name].knobs | KNOBS.get(name, {})


def _quote(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _has(column: str, pattern: str) -> str:
    return f"coalesce(regexp_matches({column}, {_quote(pattern)}), false)"


def _words(name: str, column: str = "text") -> str:
    return _has(column, tx.words_pattern(_k(name)["words"]))


_WHOLE = "NULL AS span_start, NULL AS span_end"
_UPTO = "OVER (PARTITION BY session_id ORDER BY idx ROWS UNBOUNDED PRECEDING)"
_LINEAR = "SELECT session_id, min(idx) FILTER (r) AS span_start, max(idx) FILTER (r) AS span_end, count(*) FILTER (r) AS value FROM (SELECT *, is_read AND NOT is_search AS r FROM f) GROUP BY session_id HAVING value > %d AND count(*) FILTER (is_search) = 0"
_ERRORS = "SELECT session_id, min(idx) AS span_start, max(idx) AS span_end, count(*) AS value FROM f WHERE kind = 'tool_result' AND ok = false AND error = '%s' GROUP BY session_id HAVING count(*) >= %d"
_OPENER = "arg_min(text, idx) FILTER (kind = 'user_msg')"
_TOKENS = "sum(coalesce(input, 0) + coalesce(output, 0))"
_SPACED = "len(regexp_extract_all({0}, '\\S+'))"
_IS_EDIT, _IS_NEW = "(is_write AND lower(tool) = 'edit')", "(is_write AND lower(tool) = 'write')"
_NAME = "regexp_extract({0}, '([^/]*)$', 1)"
_STEM = "lower(regexp_replace(regexp_replace(" + _NAME + ", '\\.[^.]*$', ''), '^test_|(?:_test|\\.test|\\.spec)$', ''))"
_EDITS = (  # of commands of one line: sed -i, patch, or > to a project file from echo or to a source file
    "len(list_filter(list_transform(string_split_regex(command, '[;|&]+'), lambda x: trim(x)), lambda x: regexp_matches(x, '^sed\\s(?:.*\\s)?-i(?:[^n]|$)') OR regexp_matches(x, '^patch(?:\\s|$)')"
    f" OR (regexp_extract(x, '>{{1,2}}\\s*([^\\s&|>]+)', 1) <> '' AND NOT regexp_matches(regexp_extract(x, '>{{1,2}}\\s*([^\\s&|>]+)', 1), {_quote(tx.SCRATCH)})"
    f" AND (regexp_matches(x, '^(?:echo|printf|cat)(?:\\s|$)') OR regexp_matches(regexp_extract(x, '>{{1,2}}\\s*([^\\s&|>]+)', 1), {_quote(tx.SOURCE)}))))) > 0"
)
_CLAIM = f"""SELECT session_id, max(last_edit) AS edit, max(CASE WHEN said_row AND idx > last_edit AND {_words("UNVERIFIED_COMPLETION")} THEN idx END) AS claim,
    coalesce(list(DISTINCT command) FILTER (is_exec AND intent = 'build_test' AND idx > last_edit), []) AS tests,
    coalesce(list(DISTINCT path) FILTER (is_write AND {_has("path", tx.CODE)}), []) AS paths FROM f GROUP BY session_id"""
_FILES = f"list_filter(regexp_extract_all(t, '(?:^|\\s)((?:[\\w.-]+/)*[\\w.-]+\\.[A-Za-z0-9]{{1,6}})', 1), lambda n: regexp_matches(n, {_quote(tx.CODE)}))"
_RAN = f"""len(list_filter(tests, lambda t: len({_FILES}) = 0 OR len(list_filter({_FILES}, lambda n: len(list_filter(paths, lambda p:
    {_NAME.format("n")} = {_NAME.format("p")} OR (length({_STEM.format("p")}) >= 3 AND contains({_STEM.format("n")}, {_STEM.format("p")})))) > 0)) > 0)) > 0"""


def _key(side: str = "") -> str:
    return f"trim(regexp_replace(coalesce({side}command, {side}signature), '\\s+', ' ', 'g'))"


def bodies() -> dict[str, str]:
    k = _k
    asked = f"list_distinct(list_transform(list_filter(regexp_extract_all(text, {_quote(tx.PATHS)}), lambda p: regexp_matches(p, {_quote(tx.SOURCE)}) AND NOT regexp_matches(p, {_quote(tx.DOCUMENTS)})), lambda p: {_NAME.format('p')}))"
    secrets = "|".join(f"(?:{p})" for p in k("CREDENTIAL_LEAK")["secrets"])
    runaway = k("RUNAWAY_SESSION")
    return {
        "bloated_opener": f"SELECT session_id, {_WHOLE}, greatest(1, length(text) // 4) AS value FROM (SELECT session_id, {_OPENER} AS text FROM conv GROUP BY session_id) WHERE greatest(1, length(text) // 4) > {k('bloated_opener')['tokens']}",
        "thin_prompt": f"SELECT session_id, {_WHOLE}, {_SPACED.format('text')} AS value FROM (SELECT session_id, {_OPENER} AS text FROM conv GROUP BY session_id) WHERE {_SPACED.format('text')} < 8",
        "cold_start_reads": f"SELECT session_id, {_WHOLE}, count(DISTINCT path) AS value FROM f WHERE is_read AND idx < first_write GROUP BY session_id HAVING value > {k('cold_start_reads')['most']}",
        "slow_to_action": f"SELECT session_id, {_WHOLE}, coalesce(min(pos) FILTER (is_call), count(*) FILTER (logical)) AS value FROM f GROUP BY session_id HAVING value > {k('slow_to_action')['most']}",
        "overlong_trace": f"""SELECT session_id, {_WHOLE}, count(*) FILTER (logical) AS value FROM f GROUP BY session_id HAVING value > {k("overlong_trace")["events"]}
            OR {_TOKENS} > {k("overlong_trace")["tokens"]} OR (max(stamp) - min(stamp)) / 6e7 > {k("overlong_trace")["minutes"]}""",
        "context_bloat_no_clear": f"""SELECT session_id, idx AS span_start, idx AS span_end, n AS value FROM (SELECT *, coalesce(input, 0) + coalesce(cache_read, 0) AS n, bool_or(kind = 'compaction') OVER (PARTITION BY session_id) AS cleared FROM f)
            WHERE NOT cleared AND n > {k("context_bloat_no_clear")["share"] * k("context_bloat_no_clear")["window"]} QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY n DESC, idx) = 1""",
        "tool_monoculture": f"""SELECT session_id, min(a) AS span_start, max(b) AS span_end, max(n) / sum(n) AS value FROM (SELECT session_id, tool, count(*) AS n, min(idx) AS a, max(idx) AS b FROM f WHERE is_call GROUP BY session_id, tool)
            GROUP BY session_id HAVING sum(n) >= 10 AND max(n) / sum(n) > {k("tool_monoculture")["share"]}""",
        "linear_scan_search": _LINEAR % k("linear_scan_search")["most"],
        "LINEAR_SCAN": _LINEAR % k("LINEAR_SCAN")["most"],
        "bash_as_editor": f"SELECT session_id, {_WHOLE}, count(*) AS value FROM f WHERE is_exec AND {_EDITS} GROUP BY session_id",
        "no_plan_dive": f"SELECT session_id, min(idx) AS span_start, min(idx) AS span_end, 1 AS value FROM f WHERE is_write AND idx < {k('no_plan_dive')['before']} AND NOT planned GROUP BY session_id",
        "runaway_todo": """SELECT session_id, min(idx) AS span_start, max(idx) AS span_end, max(todos) AS value FROM f WHERE todos IS NOT NULL GROUP BY session_id
            HAVING count(*) >= 2 AND arg_max(todos, idx) > arg_min(todos, idx) AND max(todos) >= 3 AND sum(todos_done) = 0""",
        "idle_gap": f"""SELECT session_id, idx AS span_start, idx AS span_end, gap / 60 AS value FROM f WHERE gap IS NOT NULL QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY gap DESC, idx) = 1 AND gap / 60 > {k("idle_gap")["minutes"]}""",
        "CONTEXT_ROT": f"""SELECT session_id, min(idx) FILTER (late) AS span_start, max(idx) FILTER (late) AS span_end, count(*) FILTER (hit AND late) AS value FROM (
            SELECT *, logical AND pos >= n_logical - n_logical // 3 AS late, logical AND ((kind = 'tool_result' AND ok = false) OR (kind = 'user_msg' AND {_words("CONTEXT_ROT")}) OR is_write) AS hit FROM f)
            GROUP BY session_id HAVING max(n_logical) >= 9 AND count(*) FILTER (hit AND pos < n_logical // 3) >= 1 AND count(*) FILTER (hit AND late) >= 2
            AND count(*) FILTER (hit AND late) >= {k("CONTEXT_ROT")["ratio"]} * count(*) FILTER (hit AND pos < n_logical // 3) AND coalesce(max(input + coalesce(cache_read, 0)) > 0.6 * 200000, true)""",
        "KITCHEN_SINK": f"""SELECT o.session_id, span_start, span_end, value FROM (SELECT session_id, min(idx) AS span_start, max(idx) AS span_end, count(*) AS value FROM f
            WHERE kind = 'user_msg' AND {_words("KITCHEN_SINK")} GROUP BY session_id HAVING count(*) >= 2) o
            WHERE NOT EXISTS (SELECT 1 FROM f c WHERE c.session_id = o.session_id AND c.kind = 'compaction' AND c.idx > span_start AND c.idx < span_end)""",
        "CORRECTION_LOOP": f"""SELECT session_id, arg_min(a, idx) AS span_start, min(idx) AS span_end, {k("CORRECTION_LOOP")["least"]} AS value FROM (
            SELECT session_id, idx, count(*) OVER w AS n, min(idx) OVER w AS a FROM f WHERE kind = 'user_msg' AND {_words("CORRECTION_LOOP")}
            WINDOW w AS (PARTITION BY session_id ORDER BY pos RANGE BETWEEN {k("CORRECTION_LOOP")["rows"] - 1} PRECEDING AND CURRENT ROW)) WHERE n >= {k("CORRECTION_LOOP")["least"]} GROUP BY session_id""",
        "EDIT_THRASH": f"""SELECT session_id, min(idx) AS span_start, arg_min(third, idx) AS span_end, 3 AS value FROM (
            SELECT *, lead(idx, 2) OVER w AS third, lead(reads, 2) OVER w AS third_reads FROM (
                SELECT *, sum(CASE WHEN is_read THEN 1 ELSE 0 END) OVER (PARTITION BY session_id, path ORDER BY idx) AS reads FROM f WHERE touch IS NOT NULL)
            WHERE is_write WINDOW w AS (PARTITION BY session_id, path ORDER BY idx)) WHERE third - idx <= {k("EDIT_THRASH")["rows"]} AND third_reads = reads GROUP BY session_id, path""",
        "EDIT_WITHOUT_READ": f"""SELECT session_id, idx AS span_start, idx AS span_end, 1 AS value FROM f e WHERE {_IS_EDIT} AND touch = 1
            AND EXISTS (SELECT 1 FROM f l WHERE l.session_id = e.session_id AND (l.is_read OR l.is_search OR (l.is_exec AND l.intent = 'inspect')))
            AND NOT EXISTS (SELECT 1 FROM f l WHERE l.session_id = e.session_id AND (l.is_read OR l.is_search OR (l.is_exec AND l.intent = 'inspect')) AND l.pos < e.pos AND l.pos >= e.pos - {k("EDIT_WITHOUT_READ")["rows"]}
                AND (contains(concat_ws(' ', l.command, l.path), {_NAME.format("e.path")}) OR coalesce(starts_with(e.path, l.path || '/'), false)))""",
        "FULL_FILE_REWRITE": f"SELECT session_id, idx AS span_start, idx AS span_end, lines AS value FROM f WHERE {_IS_NEW} AND touch > 1 AND lines >= {k('FULL_FILE_REWRITE')['lines']}",
        "RETRY_STORM": f"""SELECT session_id, min(idx) AS span_start, arg_min(last, idx) AS span_end, arg_min(n, idx) AS value FROM (
            SELECT *, count(*) OVER w AS n, max(idx) OVER w AS last, sum(CASE WHEN r_failed AND NOT r_benign THEN 1 ELSE 0 END) OVER w AS real FROM (
                SELECT *, writes - sum(CASE WHEN is_write THEN 1 ELSE 0 END) OVER (PARTITION BY session_id, tool, signature ORDER BY idx ROWS UNBOUNDED PRECEDING) AS others FROM f
                WHERE is_call AND category <> 'subagent' AND tool <> 'mcp.fs.list')
            WINDOW w AS (PARTITION BY session_id, tool, signature, others ORDER BY pos RANGE BETWEEN CURRENT ROW AND {k("RETRY_STORM")["rows"]} FOLLOWING))
            WHERE n >= {k("RETRY_STORM")["least"]} AND real > 0 GROUP BY session_id, tool, signature""",
        "NO_ADAPT_RETRY": f"""SELECT session_id, min(idx) AS span_start, max(idx) AS span_end, count(*) AS value FROM (SELECT *, sum(CASE WHEN near THEN 0 ELSE 1 END) {_UPTO} AS island FROM (
            SELECT *, coalesce(failed AND lag(failed) OVER w AND lag(tool) OVER w = tool AND levenshtein(key, lag(key) OVER w) < {k("NO_ADAPT_RETRY")["distance"]}
                AND levenshtein(key, lag(key) OVER w) <= greatest(1, least(length(key), length(lag(key) OVER w)) // 4), false) AS near
            FROM (SELECT *, {_key()} AS key, is_call AND r_failed AND NOT r_killed AS failed FROM f WHERE is_call OR kind = 'user_msg') WINDOW w AS (PARTITION BY session_id ORDER BY idx)))
            WHERE failed GROUP BY session_id, island HAVING count(*) >= 2""",
        "ASSUMING_NOT_OBSERVING": f"SELECT session_id, min(idx) AS span_start, min(idx) AS span_end, 1 AS value FROM f WHERE said_row AND {_has('text', k('ASSUMING_NOT_OBSERVING')['claim'])} AND NOT observed GROUP BY session_id",
        "TEST_GAMING": f"""SELECT session_id, idx AS span_start, idx AS span_end, 1 AS value FROM f WHERE is_write AND test_failed IS NOT NULL AND {_has("path", k("TEST_GAMING")["path"])}
            AND ((regexp_matches(coalesce(new_text, ''), '(?i)\\bskip\\b|\\bxfail\\b') AND NOT regexp_matches(coalesce(old_text, ''), '(?i)\\bskip\\b|\\bxfail\\b'))
            OR len(regexp_extract_all(coalesce(old_text, ''), '\\bassert\\b')) > len(regexp_extract_all(coalesce(new_text, ''), '\\bassert\\b')))""",
        "PANIC_REVERT": f"""SELECT session_id, arg_min(test_failed, idx) AS span_start, min(idx) AS span_end, 1 AS value FROM f WHERE is_exec AND {_has("command", k("PANIC_REVERT")["revert"])}
            AND idx - test_failed <= {k("PANIC_REVERT")["rows"]} GROUP BY session_id""",
        "ACTING_ON_QUESTION": f"""SELECT session_id, idx AS span_start, next_write AS span_end, 1 AS value FROM f WHERE kind = 'user_msg' AND next_write < coalesce(next_user, 1e15)
            AND (regexp_matches(text, '\\?\\s*$') OR {_has("text", "^\\s*" + tx.words_pattern(k("ACTING_ON_QUESTION")["words"]))})""",
        "PERMISSION_FRICTION": """SELECT session_id, min(idx) AS span_start, max(idx) AS span_end, count(*) AS value FROM f WHERE kind = 'tool_result' AND ok = false AND error = 'permission'
            GROUP BY session_id, coalesce(c_command, '?') HAVING count(*) >= 2""",
        "SANDBOX_EGRESS_FAIL": _ERRORS % ("sandbox_egress", 1),
        "TOOL_ARG_MALFORMED": _ERRORS % ("agent_syntax_error", 1),
        "MCP_TRANSPORT_ERR": _ERRORS % ("mcp_transport", 1),
        "RATE_LIMIT_LOOP": _ERRORS % ("rate_limit", 2),
        "PERFECTIONISM_LOOP": f"""SELECT session_id, min(idx) AS span_start, max(idx) AS span_end, count(*) AS value FROM f WHERE is_write AND idx > last_pass AND coalesce(last_user, -1) < last_pass
            GROUP BY session_id HAVING count(*) >= {k("PERFECTIONISM_LOOP")["least"]}""",
        "OVER_ENGINEERING": f"""SELECT session_id, CASE WHEN many THEN asked ELSE creep END AS span_start, CASE WHEN many THEN asked ELSE creep END AS span_end, CASE WHEN many THEN files ELSE 1 END AS value FROM (
            SELECT *, coalesce({_has("text", k("OVER_ENGINEERING")["fix"])} AND files >= {k("OVER_ENGINEERING")["files"]}, false) AS many FROM (
            SELECT session_id, {_OPENER} AS text, min(idx) FILTER (kind = 'user_msg') AS asked, count(*) FILTER ({_IS_NEW} AND touch = 1) AS files,
                min(idx) FILTER (said_row AND {_has("text", k("OVER_ENGINEERING")["creep"])}) AS creep FROM f GROUP BY session_id)) WHERE many OR creep IS NOT NULL""",
        "GOAL_DRIFT": f"""SELECT session_id, idx AS span_start, idx AS span_end, len(list_intersect(asked, edited)) / len(asked) AS value FROM (SELECT *, {asked} AS asked FROM (
            SELECT session_id, {_OPENER} AS text, min(idx) FILTER (kind = 'user_msg') AS idx, list(DISTINCT {_NAME.format("path")}) FILTER (is_write AND {_has("path", tx.SOURCE)}) AS edited FROM f GROUP BY session_id))
            WHERE len(asked) > 0 AND len(edited) > 0 AND len(list_intersect(asked, edited)) / len(asked) < {k("GOAL_DRIFT")["recall"]}""",
        "LOOKS_RIGHT_RUNS_WRONG": f"SELECT session_id, edit AS span_start, edit AS span_end, len(paths) AS value FROM ({_CLAIM}) WHERE edit IS NOT NULL AND claim IS NOT NULL AND NOT {_RAN}",
        "UNVERIFIED_COMPLETION": f"SELECT session_id, edit AS span_start, edit AS span_end, 1 AS value FROM ({_CLAIM}) WHERE edit IS NOT NULL AND claim IS NOT NULL AND len(tests) = 0",
        "SILENT_ERROR_SWALLOW": """SELECT session_id, idx AS span_start, next_terminal AS span_end, 1 AS value FROM f WHERE kind = 'tool_result' AND ok = false AND NOT benign
            AND next_terminal < coalesce(next_user, 1e15) AND next_terminal < coalesce(next_call, 1e15) AND next_terminal < coalesce(next_ack, 1e15)""",
        "COMPACTION_AMNESIA": f"""SELECT session_id, compacted AS span_start, max(idx) AS span_end, count(*) AS value FROM (SELECT f.session_id, f.compacted, f.path, min(f.idx) AS idx FROM f JOIN f c ON c.session_id = f.session_id AND c.idx = f.compacted
            WHERE f.is_read AND f.read_first < f.compacted AND f.pos - c.pos <= {k("COMPACTION_AMNESIA")["rows"]} AND f.scope < f.compacted GROUP BY f.session_id, f.compacted, f.path) GROUP BY session_id, compacted""",
        "STYLE_IMPOSITION": """SELECT session_id, min(idx) AS span_start, min(idx) AS span_end, 1 AS value FROM (SELECT session_id, idx, regexp_extract(new_text, '(?:import|from) (\\w+)', 1) AS module FROM f WHERE is_write) i
            WHERE module <> '' AND EXISTS (SELECT 1 FROM f o WHERE o.session_id = i.session_id AND o.kind = 'tool_result' AND trim(o.text) <> '')
            AND NOT EXISTS (SELECT 1 FROM f o WHERE o.session_id = i.session_id AND o.kind = 'tool_result' AND contains(o.text, module)) GROUP BY session_id""",
        "CREDENTIAL_LEAK": f"""SELECT session_id, idx AS span_start, idx AS span_end, length(regexp_extract(concat_ws(chr(10), text, command, path, old_text, new_text), {_quote(secrets)})) AS value FROM f
            WHERE (said_row OR is_call) AND regexp_matches(concat_ws(chr(10), text, command, path, old_text, new_text), {_quote(secrets)})""",
        "RUNAWAY_SESSION": f"""SELECT session_id, min(idx) AS span_start, max(idx) AS span_end, count(*) FILTER (logical) AS value FROM f GROUP BY session_id
            HAVING (value > {runaway["events"]} OR {_TOKENS} > {runaway["tokens"]} OR coalesce(sum(gap) FILTER (gap BETWEEN 0 AND {60 * runaway["idle"]}), 0) / 60 > {runaway["minutes"]})
            AND NOT (coalesce(bool_or(kind = 'user_msg' AND idx = last_user AND {_words("RUNAWAY_SESSION")}), false) AND coalesce(bool_or(said_row AND idx < last_user), false))
            AND NOT (max(last_pass) IS NOT NULL AND coalesce(bool_or(is_exec AND contains(lower(command), 'git commit')), false))""",
    }


def _finding_sql(name: str, body: str) -> str:
    d = detectors.REGISTRY[name]
    return f"""SELECT '{name}' AS detector, '{d.severity}' AS severity, session_id, CAST(span_start AS BIGINT) AS span_start,
        CAST(span_end AS BIGINT) AS span_end, round(CAST(value AS DOUBLE), 6) AS value FROM ({body})"""


def _oracles() -> dict[str, str]:
    made = {f"finding_{n.lower()}": sql(_finding_sql(n, b), *(("conv",) if n in ON_MESSAGES else ("made", "work", "f"))) for n, b in bodies().items()}
    every = {n: b.replace("FROM conv", "FROM f") for n, b in bodies().items()}
    union = " UNION ALL ".join(f"SELECT *, '{detectors.REGISTRY[n].kind}' AS kind FROM ({_finding_sql(n, b)})" for n, b in every.items())
    made["findings_union"] = sql(f"SELECT detector, kind, severity, count(*) AS findings, count(DISTINCT session_id) AS sessions FROM ({union}) GROUP BY detector, kind, severity", "made", "work", "f")
    return made


ORACLE_SQL = _oracles()
