"""Queries of failures, waits, episodes' facts, spending by phase and text functions (C5, C6, E4, F, J, M, P, T18, W)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.functions import text as tx
from tracewright.operators import costs, failures, structure, waits, work
from tracewright.operators.errors import IMPEDIMENTS, intent_sql
from tracewright.operators.facts import facts
from tracewright.operators.graph import cut_lineage
from tracewright.sources.driver_tables import conversation_events, responses, sql, table, work_events

from .spending import RATES

_EDGES = [30.0, 90.0]
TIERS = {"alpha:*": 2, "beta:high": 4, "beta:*": 1, "gam*": 3, "default": 0}


def _facts(spark, d):
    return facts(work_events(spark, d))


def _features(rows):
    """Answers that a classifier would give, made from what is known of a failed call."""
    each = F.array(
        F.struct(F.lit("intent.project_check").alias("feature"), F.when(tx.command_intent(F.col("c_command")) == "build_test", 0.9).otherwise(0.1).alias("value")),
        F.struct(F.lit("intent.presence_probe").alias("feature"), F.when(F.col("c_command").startswith("grep"), 0.8).otherwise(0.5).alias("value")),
        F.struct(F.lit("intent.absence_acceptable").alias("feature"), F.lit(0.75).alias("value")),
    )
    return rows.filter("kind = 'tool_result' and not ok").select("session_id", "idx", F.inline(each)).withColumn("reason", F.lit(None).cast("string"))


def failure_leaves(spark, d):
    rows = cut_lineage(_facts(spark, d))
    found = failures.leaves(failures.records(rows), failures.answers(_features(rows)))
    return found.groupBy("leaf", "disposition", "owner").agg(F.count("*").alias("n"), F.countDistinct("session_id").alias("sessions"))


#: What failed commands say in failure_leaf_cases().
CASES = (
    "refresh needs an interactive tty", "refresh: interactive; missing permission 'a.b'", "storage.objects.get access denied", "unknown flag --x", "offset 10 is beyond the end of the file", "No such file or directory: 'jq'",
    "bash: foo: command not found", "check_prompts: 2 findings", "would reformat a.py", "a.py:1:1 E501 line too long", "mypy: 3 findings", "AssertionError: 1 == 2", "compilation failed in a.c", "panic: index out of range", "deadline exceeded",
    "KeyError: 'x'", "no such column: y", "no such file: src/a.py", "validation error: argument 'path' is missing", "old_string was not found in src/a.py", "", "Script completed", "the build failed, see lint", "Traceback (most recent call last)",
)
#: The questions whose answers decide leaves.
ASKED = (
    "intent.user_named_identifier", "intent.identifier_matches", "intent.stop_if_missing", "intent.presence_probe", "intent.absence_acceptable", "intent.post_action_verifier", "intent.main_action_completed", "intent.agent_validator",
    "intent.project_check", "check.invocation_rejected", "check.prompt_finding", "check.product_runtime", "context.agent_data_assumption", "context.agent_sql_assumption",
)


_VALUES = (0.1, 0.9, 0.5, 0.9, 0.1, 0.1, 0.5, 0.1, 0.9, 0.5, 0.1)


def failure_leaf_cases(spark, d):
    """Failed results of work_events() that say CASES in turn, with answers by their place: every leaf occurs."""
    at = F.col("session_id") * 31 + F.floor(F.col("idx") / 4)
    failed = (F.col("kind") == "tool_result") & ~F.col("ok")
    said = F.element_at(F.array(*map(F.lit, CASES)), (at % len(CASES) + 1).cast("int"))
    rows = _facts(spark, d).withColumns({"text": F.when(failed, said).otherwise(F.col("text")), "size": F.when(failed, F.length(said) + F.when(at % 9 == 0, 5).otherwise(0)).otherwise(F.col("size"))})
    rows = rows.withColumns({"c_command": F.when(failed & (at % 5 == 4), None).when(failed & (at % len(CASES)).isin(20, 21), "grep -rn foo src").when(failed & (at % 7 == 3), "cd src; make lint").otherwise(F.col("c_command")), "exit_code": F.when(failed & (at % 23 == 7), 143).otherwise(F.col("exit_code"))})
    rows = cut_lineage(rows.filter(failed))
    value = lambda n: F.element_at(F.array(*map(F.lit, _VALUES)), ((F.col("session_id") * (n + 3) + F.floor(F.col("idx") / 4) * (n * n + 1) + 3 * n) % len(_VALUES) + 1).cast("int"))
    each = F.array(*(F.struct(F.lit(q).alias("feature"), value(n).alias("value")) for n, q in enumerate(ASKED)))
    features = rows.select("session_id", "idx", F.inline(each)).withColumn("reason", F.lit(None).cast("string"))
    return failures.leaves(failures.records(rows), failures.answers(features)).select("session_id", "idx", "leaf", "disposition", "owner")


def failure_signals(spark, d):
    rows = failures.records(_facts(spark, d))
    each = F.array(*(F.struct(F.lit(n).alias("signal"), F.col(n).alias("value")) for n in failures.SIGNALS))
    long = rows.select("session_id", F.inline(each))
    return long.groupBy("signal").agg(F.count_if("value").alias("yes"), F.count_if(~F.col("value")).alias("no"), F.count_if(F.col("value").isNull()).alias("unknown"))


def cache_waits(spark, d):
    found = waits.cache_waits(_facts(spark, d), 2000)
    return found.select("session_id", "idx", "mode", F.round("seconds", 6).alias("seconds"), F.col("prior.response_id").alias("prior"), F.col("next.response_id").alias("next"), "comparable", "rewrite")


def cache_wait_groups(spark, d):
    return waits.cohorts(waits.cache_waits(_facts(spark, d), 2000), _EDGES)


def episode_facts(spark, d):
    events = work_events(spark, d)
    return work.episode_facts(work.with_episode(facts(events), structure.episodes(events, 6 * 3600.0, 6)))


def display_runs(spark, d):
    return work.display_runs(_facts(spark, d))


def stuck_stretches(spark, d):
    return work.stuck(_facts(spark, d), 2)


def thrashing_paths(spark, d):
    return work.thrashing(_facts(spark, d), 2)


def tokens_by_model(spark, d):
    return work.tokens_by_model(_facts(spark, d))


def phase_spend(spark, d):
    cost = sum((F.coalesce(F.col(k), F.lit(0)) / 1e6 * v for k, v in RATES.items()), F.lit(0.0))
    return work.phase_spend(_facts(spark, d), cost)


def expense_context(spark, d):
    return work.expense_context(_facts(spark, d), 3)


def tier_ranks(spark, d):
    rows = responses(spark, d).select(F.when(F.col("part_id") % 4 == 0, "alpha").when(F.col("part_id") % 4 == 1, "beta").when(F.col("part_id") % 4 == 2, "gamma").otherwise("other").alias("model"), F.when(F.col("effort") == "A", "high").otherwise("low").alias("effort"))
    return rows.groupBy("model", "effort", work.tier(F.col("model"), F.col("effort"), TIERS).alias("tier")).agg(F.count("*").alias("n"))


def continuation_range(spark, d):
    rows = _facts(spark, d)
    used = work.billed(rows).groupBy("session_id", "scope").agg(F.max(F.coalesce("input", F.lit(0)) + F.coalesce("cache_read", F.lit(0))).alias("occupancy"))
    asked = rows.filter("kind = 'user_msg'").select("session_id", F.col("idx").alias("scope"), "text")
    return asked.join(used, ["session_id", "scope"]).select("session_id", "scope", *(F.round(c, 8).alias(n) for n, c in zip(("low", "high"), work.baseline(F.col("text"), F.col("occupancy"), 3.0), strict=True)))


def monetary_amounts(spark, d):
    """Only exact amounts count as money; others are shown as what they are."""
    rows = costs.charge(responses(spark, d), RATES).withColumn("status", F.when(F.col("effort") == "A", "exact").when(F.col("effort") == "N", "estimated").otherwise("unknown"))
    per = rows.groupBy("thread_id", "status").agg(F.round(F.sum("cost"), 8).alias("cost"))
    return per.select("thread_id", "status", tx.amount(F.col("cost"), F.col("status")).alias("shown"), F.when(F.col("status") == "exact", F.col("cost")).alias("money"))


def message_positions(spark, d):
    rows = conversation_events(spark, d).filter("kind <> 'meta'")
    return work.positions(rows, ["session_id", "kind"], "idx").select("session_id", "idx", "position")


def eligible_messages(spark, d):
    return work.eligible(conversation_events(spark, d)).select("session_id", "idx", F.length(tx.normalize_request(F.col("text"))).cast("long").alias("chars"))


def text_clips(spark, d):
    t = F.coalesce("text", F.lit(""))
    clipped = tx.clip_bytes(t, 100)
    return table(spark, d, "documents").select("doc_id", F.octet_length(clipped).cast("long").alias("bytes"), F.md5(clipped).alias("clipped"), F.md5(tx.diagnostic(t)).alias("told"))


def split_estimates(spark, d):
    rows = table(spark, d, "documents").select("doc_id", *tx.estimate_split(F.col("n_chars")), tx.duration(F.col("n_chars").cast("double")).alias("shown"))
    return rows


def json_digests(spark, d):
    return table(spark, d, "events").select("event_id", tx.json_digest(F.concat(F.lit('{"b": 1,  "a": '), F.col("props"), F.lit("}"))).alias("digest"))


def shell_reads(spark, d):
    rows = work_events(spark, d).filter("command is not null")
    return rows.groupBy("command", F.array_join(tx.read_paths(F.col("command")), ",").alias("paths")).agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        failure_leaves, failure_leaf_cases, failure_signals, cache_waits, cache_wait_groups, episode_facts, display_runs, stuck_stretches, thrashing_paths, tokens_by_model, phase_spend, expense_context,
        tier_ranks, continuation_range, monetary_amounts, message_positions, eligible_messages, text_clips, split_estimates, json_digests, shell_reads,
    )
}


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _work(body: str) -> str:
    return sql(body, "made", "work", "f")


_UPTO = "OVER (PARTITION BY session_id ORDER BY idx ROWS UNBOUNDED PRECEDING)"
#: This engine's patterns have no lookbehind and no possessive repeats: a dotted name ends where no more of it can follow.
_PLAIN = {
    "iam_permission_named": r"(?i)(?:permission|role)\s+['\"]?[\w-]+(?:\.[\w-]+)+|(?:^|[^\w.-])[\w-]+(?:\.[\w-]+)+(?:[^\w.\n-]|\.[^\w\n-]).*(?:permission|denied)|(?:missing|required)\s+(?:permission|role)\s+['\"]?[\w.-]+"
}
_TESTED = {n: f"coalesce(regexp_matches(text, {_q(_PLAIN.get(n, p))}), false)" for n, p in failures.SIGNALS.items()}
_TESTED["timeout"] = f"(coalesce(exit_code = {failures.TIMED_OUT}, false) OR {_TESTED['timeout']})"
_SIGNALS = ", ".join(f"{t} AS {n}" for n, t in _TESTED.items())
_SEGMENTS = "list_filter(string_split_regex(c_command, '[;|&\\n]+'), lambda x: trim(x) <> '')"
_CHECKED = f"list_filter({_SEGMENTS}, lambda x: regexp_matches(x, {_q(failures.CHECKS)}))"
_FAILING = f"CASE WHEN len({_SEGMENTS}) > 1 AND len({_CHECKED}) = 1 AND regexp_matches(text, {_q(failures.CHECKS)}) THEN trim({_CHECKED}[1]) END"
_LAST = "regexp_replace(trim(string_split_regex(c_command, '[;|&\\n]+')[-1]), '^\\S*/', '')"
_SILENT = f"""CASE WHEN exit_code = 1 AND c_command <> '' AND regexp_matches({_LAST}, {_q(tx._ANSWERS)}) AND trim(coalesce(text, '')) IN ('', {", ".join(map(_q, failures.SILENT))}) AND NOT coalesce(size > length(text), false) THEN true
    WHEN exit_code = 1 AND c_command <> '' AND (len({_SEGMENTS}) > 1 OR coalesce(size > length(text), false)) THEN NULL ELSE false END"""
_FAILED = f"""failed AS (SELECT session_id, idx, c_command AS command, exit_code, {_SILENT} AS no_match, coalesce(size > length(text), false) AS cut, text,
    coalesce({intent_sql("c_command")} = 'build_test', false) AS checked, coalesce(starts_with(c_command, 'grep'), false) AS probe, {_FAILING} AS failing, coalesce({intent_sql("failing")} = 'inspect', false) AS inspects, {_SIGNALS}
    FROM f WHERE kind = 'tool_result' AND ok = false)"""
_BILLED = "billed AS (SELECT * FROM f WHERE kind = 'usage' QUALIFY row_number() OVER (PARTITION BY session_id, response_id ORDER BY idx) = 1)"
_SPENT = "(" + " + ".join(f"coalesce({k}, 0) / 1e6 * {v}" for k, v in RATES.items()) + ")"
_ROUNDS = """rounds AS (SELECT session_id, response_id, min(idx) AS start, max(model) AS model, max(input) AS input, max(cache_read) AS cache_read, max(cache_write) AS cache_write,
    CASE WHEN count(*) FILTER (is_call) = 0 THEN 'no_tools' WHEN count(*) FILTER (is_call AND NOT (is_read OR coalesce(intent = 'inspect', false))) = 0 THEN 'inspection'
    WHEN count(*) FILTER (is_call AND NOT (category = 'subagent' OR lower(tool) IN ('wait_agent', 'list_agents'))) = 0 THEN 'coordination'
    WHEN count(*) FILTER (is_call AND category NOT IN ('execute', 'write')) = 0 THEN 'execution' ELSE 'mixed' END AS phase
    FROM f WHERE kind = 'usage' OR is_call GROUP BY session_id, response_id HAVING count(*) FILTER (kind = 'usage') = 1)"""
_WAITS = f"""{_ROUNDS}, stops AS (SELECT session_id, idx FROM f WHERE kind IN ('user_msg', 'compaction')),
waited AS (SELECT w.session_id, w.idx, w.r_idx, CASE WHEN w.r_ts >= w.ts THEN (w.r_ts - w.ts) / 1e6 END AS seconds,
    (SELECT max(start) FROM rounds r WHERE r.session_id = w.session_id AND r.start <= w.idx) AS p, (SELECT min(start) FROM rounds r WHERE r.session_id = w.session_id AND r.start > w.r_idx) AS n
    FROM f w WHERE w.paired AND lower(w.tool) IN ('wait_agent', 'get_subagent_result', 'wait')),
waits AS (SELECT w.*, a.response_id AS prior, b.response_id AS next, b.model, b.input, b.cache_write, b.start AS begins,
    coalesce(a.model = b.model AND a.cache_read IS NOT NULL AND b.cache_read IS NOT NULL AND b.cache_write IS NOT NULL
        AND NOT EXISTS (SELECT 1 FROM stops s WHERE s.session_id = w.session_id AND s.idx > w.p AND s.idx < w.n), false) AS comparable,
    coalesce(a.model = b.model AND a.cache_read IS NOT NULL AND b.cache_read = 0 AND b.cache_write >= 2000
        AND NOT EXISTS (SELECT 1 FROM stops s WHERE s.session_id = w.session_id AND s.idx > w.p AND s.idx < w.n), false) AS rewrite
    FROM waited w LEFT JOIN rounds a ON a.session_id = w.session_id AND a.start = w.p LEFT JOIN rounds b ON b.session_id = w.session_id AND b.start = w.n)"""
_BAND = "CAST(CASE " + " ".join(f"WHEN coalesce(seconds, 0) >= {e} THEN {e}" for e in reversed(_EDGES)) + " ELSE 0.0 END AS DOUBLE)"
_EPISODES = f"""gaps AS (SELECT *, (ts - lag(ts) OVER (PARTITION BY session_id ORDER BY idx)) / 1e6 AS hole,
    last_value(category IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM f),
reasons AS (SELECT *, CASE WHEN kind = 'user_msg' OR hole > 21600 OR (was = 'write' AND category = 'execute') THEN 1 ELSE 0 END AS breaks FROM gaps),
parts AS (SELECT *, sum(breaks) {_UPTO} AS part FROM reasons),
splits AS (SELECT *, greatest(sum(CASE WHEN is_call THEN 1 ELSE 0 END) OVER (PARTITION BY session_id, part ORDER BY idx ROWS UNBOUNDED PRECEDING) - 1, 0) // 6 AS split FROM parts),
numbered AS (SELECT *, dense_rank() OVER (PARTITION BY session_id ORDER BY part, split) AS episode, CASE WHEN is_call THEN row_number() OVER (PARTITION BY session_id, is_call, signature ORDER BY idx) END AS nth,
    CASE WHEN touch IS NOT NULL THEN lag(category) OVER (PARTITION BY session_id, touch IS NOT NULL, path ORDER BY idx) END AS touched_as, coalesce(intent = 'build_test', false) AS is_test FROM splits),
tested AS (SELECT *, max(CASE WHEN is_test THEN idx END) OVER (PARTITION BY session_id, episode) AS tested FROM numbered)"""
_IMPEDED = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(concat_ws(' ', text, error), {_q(p)}) THEN '{n}' END" for n, p in IMPEDIMENTS.items()) + "], lambda x: x IS NOT NULL)"

ORACLE_SQL = {
    "failure_leaves": _work(
        f"""AND_WITH {_FAILED}, leaves AS (SELECT session_id, CASE WHEN (coalesce(no_match, false) OR coalesce(exit_code = 1 AND inspects, false)) AND probe THEN 'expected_no_match'
            WHEN auth_refresh_blocked AND iam_permission_named THEN 'unresolved' WHEN auth_refresh_blocked THEN 'credential_refresh_blocked' WHEN iam_permission_named THEN 'iam_permission_missing'
            WHEN failing IS NOT NULL AND checked THEN 'compound_check_attributed' WHEN cli_argument_rejected THEN 'cli_invocation_rejected' WHEN read_range_invalid THEN 'read_range_invalid' WHEN executable_missing OR missing_dependency THEN 'command_unavailable'
            WHEN checked AND prompt_definition THEN 'prompt_definition_finding' WHEN checked AND static_format THEN 'static_format_finding' WHEN checked AND static_lint THEN 'static_lint_finding'
            WHEN checked AND static_type THEN 'static_type_finding' WHEN checked AND test_assertion THEN 'test_assertion_failure' WHEN checked AND compile_error THEN 'product_build_failure'
            WHEN timeout OR transport_failure THEN 'external_dependency_or_transport' ELSE 'unresolved' END AS leaf FROM failed)
        SELECT leaf, CASE WHEN starts_with(leaf, 'expected_') THEN 'expected' WHEN leaf = 'unresolved' THEN 'unresolved' ELSE 'terminal' END AS disposition,
        CASE leaf {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in failures.OWNERS.items())} ELSE 'agent' END AS owner, count(*) AS n, count(DISTINCT session_id) AS sessions FROM leaves GROUP BY leaf"""
    ),
    "failure_leaf_cases": _work(
        f"""AND_WITH said AS (SELECT * REPLACE (([{", ".join(map(_q, CASES))}])[turn % {len(CASES)} + 1] AS text, length(([{", ".join(map(_q, CASES))}])[turn % {len(CASES)} + 1]) + CASE WHEN turn % 9 = 0 THEN 5 ELSE 0 END AS size,
            CASE WHEN turn % 5 = 4 THEN NULL WHEN turn % {len(CASES)} IN (20, 21) THEN 'grep -rn foo src' WHEN turn % 7 = 3 THEN 'cd src; make lint' ELSE c_command END AS c_command, CASE WHEN turn % 23 = 7 THEN 143 ELSE exit_code END AS exit_code) FROM (SELECT *, session_id * 31 + idx // 4 AS turn FROM f WHERE kind = 'tool_result' AND ok = false)),
        failed AS (SELECT session_id, idx, c_command AS command, exit_code, {_SILENT} AS no_match, text, {_FAILING} AS failing, coalesce(exit_code = 1 AND {intent_sql("failing")} = 'inspect', false) AS inspects, {_SIGNALS}, {", ".join(
            f"({list(_VALUES)})[(session_id * {n + 3} + idx // 4 * {n * n + 1} + {3 * n}) % {len(_VALUES)} + 1] >= 0.7 AS y{n}, ({list(_VALUES)})[(session_id * {n + 3} + idx // 4 * {n * n + 1} + {3 * n}) % {len(_VALUES)} + 1] <= 0.3 AS n{n}" for n in range(len(ASKED)))} FROM said),
        leaves AS (SELECT session_id, idx, CASE WHEN y0 AND n1 AND missing_target THEN 'wrong_requested_identifier' WHEN y2 AND missing_target THEN 'expected_stop_precondition'
            WHEN (coalesce(no_match, false) OR inspects) AND y3 AND y4 THEN 'expected_no_match' WHEN auth_refresh_blocked AND iam_permission_named THEN 'unresolved' WHEN auth_refresh_blocked THEN 'credential_refresh_blocked'
            WHEN iam_permission_named THEN 'iam_permission_missing' WHEN tool_contract_rejected AND command IS NULL AND regexp_matches(text, {_q(failures._NAMED)}) THEN 'tool_contract_rejected'
            WHEN edit_match_missing AND command IS NULL AND regexp_matches(text, {_q(failures._PATH)}) THEN 'edit_match_missing' WHEN failing IS NOT NULL AND y8 THEN 'compound_check_attributed' WHEN cli_argument_rejected OR y9 THEN 'cli_invocation_rejected' WHEN read_range_invalid THEN 'read_range_invalid'
            WHEN executable_missing OR missing_dependency THEN 'command_unavailable' WHEN y5 AND y6 THEN 'post_action_verifier_mismatch' WHEN y7 AND (data_shape_exception OR y12) THEN 'agent_validator_data_shape'
            WHEN y7 AND (sql_schema_exception OR y13) THEN 'agent_validator_sql_schema' WHEN y8 AND (prompt_definition OR y10) THEN 'prompt_definition_finding' WHEN y8 AND static_format THEN 'static_format_finding'
            WHEN y8 AND static_lint THEN 'static_lint_finding' WHEN y8 AND static_type THEN 'static_type_finding' WHEN y8 AND test_assertion THEN 'test_assertion_failure' WHEN y8 AND compile_error THEN 'product_build_failure'
            WHEN product_runtime_error AND y11 THEN 'product_runtime_failure' WHEN timeout OR transport_failure THEN 'external_dependency_or_transport' WHEN missing_target AND y0 AND n4 THEN 'required_target_missing' ELSE 'unresolved' END AS leaf FROM failed)
        SELECT session_id, idx, leaf, CASE WHEN starts_with(leaf, 'expected_') THEN 'expected' WHEN leaf = 'unresolved' THEN 'unresolved' ELSE 'terminal' END AS disposition,
        CASE leaf {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in failures.OWNERS.items())} ELSE 'agent' END AS owner FROM leaves"""
    ),
    "failure_signals": _work(
        f"AND_WITH {_FAILED} SELECT signal, count(*) FILTER (value) AS yes, count(*) FILTER (NOT value) AS no, count(*) FILTER (value IS NULL) AS unknown FROM ("
        + " UNION ALL ".join(f"SELECT '{n}' AS signal, CASE WHEN {n} THEN true WHEN cut THEN NULL ELSE false END AS value FROM failed" for n in failures.SIGNALS)
        + ") GROUP BY signal"
    ),
    "cache_waits": _work(f"AND_WITH {_WAITS} SELECT session_id, idx, 'unspecified' AS mode, round(seconds, 6) AS seconds, prior, next, comparable, rewrite FROM waits"),
    "cache_wait_groups": _work(
        f"""AND_WITH {_WAITS}, banded AS (SELECT *, {_BAND} AS band FROM waits),
        spent AS (SELECT model, band, count(*) AS responses, CAST(sum(input) AS BIGINT) AS input, CAST(sum(cache_write) AS BIGINT) AS written FROM (
            SELECT DISTINCT model, band, session_id, begins, input, cache_write FROM banded WHERE next IS NOT NULL) GROUP BY model, band)
        SELECT c.model, 'unspecified' AS mode, c.band, waits, comparable, rewrites, responses, input, written FROM (SELECT model, band, count(*) AS waits, count(*) FILTER (comparable) AS comparable,
            count(*) FILTER (rewrite) AS rewrites FROM banded GROUP BY model, band) c LEFT JOIN spent s ON c.model IS NOT DISTINCT FROM s.model AND c.band = s.band"""
    ),
    "episode_facts": _work(
        f"""AND_WITH {_EPISODES} SELECT session_id, CAST(episode AS INTEGER) AS episode, min(idx) AS first_idx, max(idx) AS last_idx, count(*) FILTER (nth > 1) AS repeats,
        count(DISTINCT path) FILTER (is_read) AS paths_read, count(*) FILTER (is_read AND touched_as = 'read') AS reread_unchanged, count(*) FILTER (is_write) AS edits,
        count(*) FILTER (is_write AND idx > coalesce(tested, -1)) AS edits_untested, count(*) FILTER (is_test) AS tests, count(*) FILTER (is_test AND r_failed) AS tests_failed,
        arg_min({_IMPEDED}[1], idx) FILTER (kind = 'tool_result' AND ok = false AND len({_IMPEDED}) = 1) AS impediment, max(compacted IS NOT NULL) AS after_compaction,
        coalesce(arg_max(ok, idx) FILTER (kind = 'tool_result') = false, false) AS outstanding, coalesce(bool_or(said_row AND regexp_matches(text, {_q(work.SUCCESS)})), false) AS declares,
        coalesce(bool_or(((said_row OR kind = 'tool_result') AND regexp_matches(text, {_q(work.PROOF)})) OR (is_test AND coalesce(r_ok, false))), false) AS proved
        FROM tested GROUP BY session_id, episode"""
    ),
    "display_runs": _work(
        f"""SELECT session_id, CAST(run AS BIGINT) AS run, any_value(category) AS category, count(*) AS calls, min(idx) AS first_idx, max(idx) AS last_idx FROM (
        SELECT *, sum(CASE WHEN category IS DISTINCT FROM before OR was IS NULL THEN 1 ELSE 0 END) {_UPTO} AS run FROM (
            SELECT *, lag(category) OVER w AS before, lag(idx) OVER w AS was FROM f WHERE is_call WINDOW w AS (PARTITION BY session_id ORDER BY idx))) GROUP BY session_id, run"""
    ),
    "stuck_stretches": _work(
        f"""SELECT session_id, count(*) AS calls, min(idx) AS first_idx, max(idx) AS last_idx FROM (SELECT *, sum(CASE WHEN r_failed THEN 0 ELSE 1 END) {_UPTO} AS island FROM f WHERE is_call)
        WHERE r_failed GROUP BY session_id, island HAVING count(*) >= 2"""
    ),
    "thrashing_paths": _work(
        """SELECT session_id, path, count(DISTINCT test_failed) AS edits, min(idx) AS first_idx, max(idx) AS last_idx FROM f WHERE is_write AND path IS NOT NULL AND test_failed IS NOT NULL
        GROUP BY session_id, path HAVING count(DISTINCT test_failed) >= 2"""
    ),
    "tokens_by_model": _work(
        f"""AND_WITH {_BILLED} SELECT session_id, model, count(*) AS responses, CAST(sum(input) AS BIGINT) AS input, CAST(sum(output) AS BIGINT) AS output, CAST(sum(cache_read) AS BIGINT) AS cache_read,
        CAST(sum(cache_write) AS BIGINT) AS cache_write FROM billed GROUP BY session_id, model"""
    ),
    "phase_spend": _work(
        f"""AND_WITH {_BILLED}, {_ROUNDS} SELECT coalesce(phase, 'unallocated') AS phase, count(*) AS responses, round(sum({_SPENT.replace("input", "b.input").replace("cache_read", "b.cache_read").replace("cache_write", "b.cache_write")}), 8) AS cost
        FROM billed b LEFT JOIN rounds r ON b.session_id = r.session_id AND b.response_id = r.response_id GROUP BY 1"""
    ),
    "expense_context": _work(
        f"""AND_WITH {_BILLED}, per AS (SELECT session_id, scope, CAST(sum(coalesce(input, 0) + coalesce(output, 0)) AS BIGINT) AS tokens, count(*) AS responses FROM billed GROUP BY session_id, scope)
        SELECT *, round(tokens / sum(tokens) OVER (PARTITION BY session_id), 6) AS share, row_number() OVER (PARTITION BY session_id ORDER BY tokens DESC, scope) AS place FROM per QUALIFY place <= 3"""
    ),
    "tier_ranks": sql(
        """SELECT model, effort, CASE WHEN model = 'beta' AND effort = 'high' THEN 4 WHEN model = 'alpha' THEN 2 WHEN model = 'beta' THEN 1 WHEN starts_with(model, 'gam') THEN 3 ELSE 0 END AS tier, count(*) AS n
        FROM (SELECT (['alpha', 'beta', 'gamma', 'other'])[part_id % 4 + 1] AS model, CASE WHEN effort = 'A' THEN 'high' ELSE 'low' END AS effort FROM resp) GROUP BY ALL""",
        "resp",
    ),
    "continuation_range": _work(
        f"""AND_WITH {_BILLED}, used AS (SELECT session_id, scope, max(coalesce(input, 0) + coalesce(cache_read, 0)) AS occupancy FROM billed GROUP BY session_id, scope),
        asked AS (SELECT u.session_id, u.scope, occupancy, greatest(1, length(text) // 4) AS request FROM used u JOIN f ON f.session_id = u.session_id AND f.idx = u.scope AND f.kind = 'user_msg')
        SELECT session_id, scope, round(request / 1e6 * 3.0, 8) AS low, round((request + greatest(0, least(occupancy, greatest(occupancy - request, occupancy // 5)))) / 1e6 * 3.0, 8) AS high FROM asked"""
    ),
    "monetary_amounts": sql(
        f"""AND_WITH per AS (SELECT thread_id, CASE effort WHEN 'A' THEN 'exact' WHEN 'N' THEN 'estimated' ELSE 'unknown' END AS status, round(sum({_SPENT}), 8) AS cost FROM resp GROUP BY ALL)
        SELECT thread_id, status, CASE status WHEN 'exact' THEN printf('$%.2f', cost) WHEN 'estimated' THEN printf('~$%.2f', cost) ELSE 'unpriced' END AS shown, CASE WHEN status = 'exact' THEN cost END AS money FROM per""",
        "resp",
    ),
    "message_positions": sql("SELECT session_id, idx, row_number() OVER (PARTITION BY session_id, kind ORDER BY idx) || ' of ' || count(*) OVER (PARTITION BY session_id, kind) AS position FROM conv WHERE kind <> 'meta'", "conv"),
    "eligible_messages": sql("SELECT session_id, idx, length(trim(text)) AS chars FROM conv WHERE kind = 'user_msg' AND trim(text) <> ''", "conv"),
    "text_clips": f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), c AS (SELECT *, CASE WHEN octet_length(encode(text)) <= 100 THEN text ELSE
            left(text, list_max(list_filter(range(24, 98), lambda n: octet_length(encode(left(text, n))) <= 97))) || '…' END AS clipped,
            list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS lines FROM t),
        d AS (SELECT *, list_filter(lines, lambda x: regexp_matches(x, {_q(tx.DIAGNOSTIC)})) AS told FROM c)
        SELECT doc_id, CAST(octet_length(encode(clipped)) AS BIGINT) AS bytes, md5(clipped) AS clipped,
        md5(left(array_to_string(CASE WHEN len(told) > 0 THEN told[1:6] ELSE lines[greatest(len(lines) - 2, 1):len(lines)] END, chr(10)), 1200)) AS told FROM d""",
    "split_estimates": """WITH s AS (SELECT doc_id, n_chars, CAST(round_even(n_chars * 0.8, 0) AS BIGINT) AS cache_read, CAST(round_even(n_chars * 0.08, 0) AS BIGINT) AS output FROM documents)
        SELECT doc_id, cache_read, output, n_chars - cache_read - output AS input, CASE WHEN n_chars < 60 THEN printf('%.0f s', n_chars::DOUBLE) WHEN n_chars < 3600 THEN printf('%.1f min', (n_chars // 6) / 10)
        ELSE printf('%.1f h', (n_chars // 360) / 10) END AS shown FROM s""",
    "json_digests": """SELECT event_id, sha256('{"a":{"k":' || json_extract_string(props, '$.k') || '},"b":1}') AS digest FROM events""",
    "shell_reads": _work(
        """SELECT command, CASE command WHEN 'cat log.txt | grep error' THEN 'log.txt' WHEN 'grep -rn foo src' THEN 'src' WHEN 'ls -la src; rm -rf tmp' THEN 'src' WHEN 'sed -i s/a/b/ src/m1.py' THEN 'src/m1.py' ELSE '' END AS paths,
        count(*) AS n FROM work WHERE command IS NOT NULL GROUP BY command"""
    ),
}
