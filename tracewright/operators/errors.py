"""Failures: signals, categories, actions, incidents, recoveries and outcomes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions import text as tx

from .sequence import flag

#: Literal signals of a failed output.
SIGNALS = {
    "permission": "permission|EACCES", "egress": "egress|ENOTFOUND", "syntax": "syntax|malformed", "transport": "transport", "limit": "rate_limit|429",
    "timeout": "timeout|timed out", "build": "build_test|FAILED",
}
#: Patterns of error texts by category; the first that fits names it.
_REJECTED = "InputValidationError|required parameter|unexpected parameter|unexpected argument|invalid_type|-32602|validation error|invalid arguments|invalid params"
_UNEDITED = "File has not been read yet|String to replace not found|overlap"
_TEXTS = (
    ("mcp_transport", r"(?i)-32000|Client Closed|connection closed"),
    ("rate_limit", r"(?i)\b(?:429|529|overloaded|rate[_ ]?limit)\b"),
    (
        "sandbox_egress",
        r"(?i)network\s+(?:is\s+|access\s+(?:is\s+)?)?(?:disabled|blocked|not\s+allowed|unavailable|denied)|(?:network\s+)?egress\s+(?:is\s+)?(?:blocked|denied|disabled|restricted)|"
        r"\bnetwork\s+egress\b|outside\s+(?:of\s+)?(?:the\s+)?(?:sandbox|workspace|writable|project)\s+root|blocked\s+by\s+(?:the\s+)?sandbox|"
        r"sandbox(?:ed)?\s+(?:denied|blocked|violation|restriction|policy)|\bseatbelt\b|\bEPERM\b|Operation\s+not\s+permitted",
    ),
    ("permission", "Permission denied|EACCES"),
)
_ABSENT, _NETWORK = "EISDIR|ENOENT|No such file or directory|can't read|os error 2", r"(?i)ETIMEDOUT|ECONNREFUSED|ECONNRESET|ENOTFOUND|getaddrinfo|\bnetwork\b"
#: How grave each category is.
SEVERITIES = {
    "harness_blocked": "agent_error", "agent_syntax_error": "agent_error", "edit_mismatch": "agent_error", "file_not_found": "agent_error",
    "command_not_found": "agent_error", "permission": "agent_error", "timeout": "workflow", "cancelled": "workflow", "no_match_probe": "benign",
    "rate_limit": "workflow", "mcp_transport": "agent_error", "sandbox_egress": "workflow", "network": "workflow", "build_test_fail": "workflow", "other": "workflow",
}
#: What stands in the way, by pattern.
IMPEDIMENTS = {
    "sandbox_denied": r"(?i)sandbox|outside.*(?:root|workspace)|blocked by policy", "permission_prompt": r"(?i)permission denied|EACCES|askuser|approval required",
    "auth_failure": r"(?i)\b401\b|unauthorized|invalid.?api.?key|auth(?:entication|orization) failed", "rate_limit": r"(?i)\b(?:429|529|overloaded|rate[_ ]?limit)\b",
    "network": r"(?i)ETIMEDOUT|ECONNREFUSED|ECONNRESET|ENOTFOUND|getaddrinfo|\bdns\b", "missing_dependency": r"(?i)command not found|No module named|Cannot find module|not installed",
    "missing_resource": r"(?i)No such file or directory|ENOENT|not found", "tool_crash": r"(?i)segfault|panic:|fatal error|Aborted \(core dumped\)",
    "timeout": r"(?i)timed? ?out|deadline exceeded", "user_interrupt": r"(?i)interrupted|aborted by user|KeyboardInterrupt",
}
#: What to do about an error.
ACTIONS = {
    "permission": "grant_access", "sandbox_egress": "grant_access", "agent_syntax_error": "fix_call", "mcp_transport": "retry_later", "rate_limit": "retry_later",
    "timeout": "retry_later", "build_test_fail": "fix_code",
}


#: Marks of a test command, and of one that takes edits back.
TEST_MARKERS, REVERTS = ("pytest", "vitest", "jest", "tsc", "unittest", " test", "test "), ("git checkout", "git revert", "reset --hard", "git restore")


def tri_state(text: Column, pattern: str, truncated: Column) -> Column:
    """True on a match; without one unknown if the text was cut, else false. A null text knows nothing."""
    return F.when(text.rlike(pattern), True).when(text.isNull() | truncated, None).otherwise(False)


def signals(results: DataFrame, text: Column, truncated: Column) -> DataFrame:
    """Signal, value in long form for every result."""
    found = F.array(*(F.struct(F.lit(n).alias("signal"), tri_state(text, p, truncated).alias("value")) for n, p in SIGNALS.items()))
    return results.select(F.inline(found))


def classify(text: Column, tool: Column | None = None, exit_code: Column | None = None, command: Column | None = None) -> Column:
    """Category, severity, confidence of a failed result, the first rule that fits.

    Arguments are only held to be rejected where no shell command wrote the text. A line of several commands whose last
    one only reads has mostly done its work: it is benign, with low confidence."""
    none = F.lit(None)
    tool, command = (c if c is not None else none.cast("string") for c in (tool, command))
    text = F.coalesce(text, F.lit(""))
    code = F.coalesce(exit_code if exit_code is not None else none.cast("int"), tx.exit_code(text))
    yes = lambda c: F.coalesce(c, F.lit(False))
    last, shell = F.coalesce(tx.last_head(command), F.lit("")), yes(F.length(command) > 0)
    probe = yes(code == 1) & F.when(last.rlike(r"^(?:grep|rg|egrep|ugrep)(?:\s|$)"), F.length(F.trim(F.regexp_replace(text, r"^Exit code[^\n]*\n?", ""))) <= 40).otherwise(shell & yes(tx.exit1_is_answer(command)))
    rules = [
        ("harness_blocked", text.contains("Blocked:")),
        ("agent_syntax_error", (~shell | text.contains("<tool_use_error>")) & text.rlike(f"(?i){_REJECTED}")),
        ("edit_mismatch", yes(F.lower(tool).isin("edit", "multiedit", "write")) & text.rlike(_UNEDITED)),
        *((name, text.rlike(pattern)) for name, pattern in _TEXTS),
        ("file_not_found", text.rlike(_ABSENT) | (yes(code == 2) & last.rlike(tx.READERS))),
        ("command_not_found", yes(code == 127) | text.contains(": command not found") | text.contains(": not found")),
        ("timeout", yes(code == 143) | text.rlike("(?i)timed out|timeout")),
        ("cancelled", yes(code == 130) | text.contains("interrupted")),
        ("no_match_probe", probe),
        ("network", text.rlike(_NETWORK)),
        ("build_test_fail", yes(tx.command_intent(command) == "build_test") & yes(code != 0)),
    ]
    category = F.lit("other")
    for name, fits in reversed(rules):
        category = F.when(fits, name).otherwise(category)
    severity = F.create_map(*(F.lit(x) for kv in SEVERITIES.items() for x in kv))
    trailing = shell & yes(tx.is_compound(command)) & last.rlike(tx.READERS) & ~yes(code.isin(126, 127, 143)) & ~category.isin("harness_blocked", "agent_syntax_error", "edit_mismatch")
    return F.struct(
        category.alias("category"), F.when(trailing, "benign").otherwise(severity[category]).alias("severity"), F.when(trailing, "low").otherwise("high").alias("confidence")
    )


def classify_sql(text: str, command: str, code: str) -> str:
    """The SQL twin of classify() for results without a tool, with commands of one line without quotes."""
    quote = lambda p: "'" + p.replace("'", "''") + "'"
    last = f"regexp_replace(coalesce(trim(string_split_regex({command}, '[;|&\\n]+')[-1]), ''), '^\\S*/', '')"
    match = lambda p, t=text: f"regexp_matches({t}, {quote(p)})"
    rules = [
        ("harness_blocked", f"contains({text}, 'Blocked:')"), ("agent_syntax_error", f"{command} IS NULL AND {match('(?i)' + _REJECTED)}"), *((n, match(p)) for n, p in _TEXTS),
        ("file_not_found", f"{match(_ABSENT)} OR ({code} = 2 AND {match(tx.READERS, last)})"), ("command_not_found", f"{code} = 127 OR contains({text}, ': not found') OR contains({text}, ': command not found')"),
        ("timeout", f"{code} = 143 OR {match('(?i)timed out|timeout')}"), ("cancelled", f"{code} = 130 OR contains({text}, 'interrupted')"),
        ("no_match_probe", f"{code} = 1 AND {match('^(grep|rg|egrep|ugrep)( |$)', last)} AND length(trim({text})) <= 40"), ("network", match(_NETWORK)),
        ("build_test_fail", f"{intent_sql(command)} = 'build_test' AND {code} <> 0"),
    ]
    category = "CASE " + " ".join(f"WHEN {c} THEN '{n}'" for n, c in rules) + " ELSE 'other' END"
    severity = f"CASE {category} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SEVERITIES.items()) + " END"
    trailing = f"coalesce({match('[;|&]', command)} AND {match(tx.READERS, last)} AND coalesce({code}, 0) NOT IN (126, 127, 143) AND {category} NOT IN ('harness_blocked', 'agent_syntax_error'), false)"
    return f"{category} AS category, CASE WHEN {trailing} THEN 'benign' ELSE {severity} END AS severity, CASE WHEN {trailing} THEN 'low' ELSE 'high' END AS confidence"


def intent_sql(command: str) -> str:
    """The SQL twin of command_intent() for commands of one line without quotes, settings and wrappers."""
    case = "CASE " + " ".join("WHEN regexp_matches(x, '" + p.replace("'", "''") + f"') THEN '{i}'" for p, i in tx.INTENTS) + " ELSE 'other' END"
    heads = f"list_transform(string_split_regex({command}, '\\s*(?:;|\\||&&|\\n)+\\s*'), lambda x: regexp_replace(trim(x), '^(?:uv\\s+run\\s+)+', ''))"
    found = f"list_transform({heads}, lambda x: {case})"
    return f"CASE WHEN {command} IS NULL THEN NULL " + " ".join(f"WHEN list_contains({found}, '{i}') THEN '{i}'" for i in ("build_test", "mutate", "inspect")) + " ELSE 'other' END"


def impediment(text: Column, patterns: dict[str, str] = IMPEDIMENTS) -> Column:
    """C4: the one impediment that a text shows; null if it shows none or several."""
    hits = F.filter(F.array(*(F.when(text.rlike(p), n) for n, p in patterns.items())), lambda x: x.isNotNull())
    return F.when(F.size(hits) == 1, F.get(hits, F.lit(0)))


def action_groups(failed: DataFrame, examples: int = 3) -> DataFrame:
    """Errors by what to do about them, with the first few as examples.

    Only those few rows a group are gathered; the counts are pre-aggregated."""
    action = F.coalesce(F.create_map(*(F.lit(x) for kv in ACTIONS.items() for x in kv))[F.col("error")], F.lit("inspect"))
    acted = failed.withColumn("action", action)
    place = F.row_number().over(Window.partitionBy("action").orderBy("session_id", "idx"))
    first = acted.withColumn("r", place).filter(F.col("r") <= examples)
    name = F.struct("r", F.concat_ws(":", F.col("session_id").cast("string"), F.col("idx").cast("string")).alias("e"))
    shown = first.groupBy("action").agg(F.array_join(F.transform(F.array_sort(F.collect_list(name)), lambda x: x["e"]), ", ").alias("examples"))
    counts = acted.groupBy("action").agg(F.count("*").alias("n"), F.countDistinct("error").alias("errors"), F.countDistinct("session_id").alias("sessions"))
    return counts.join(shown, "action")


def incident_groups(results: DataFrame, keys: list[str]) -> DataFrame:
    """Failures of one signature between its successes."""
    upto = Window.partitionBy("session_id", *keys).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    rows = results.withColumn("reset", F.sum(flag(F.col("ok"))).over(upto)).filter("not ok")
    return rows.groupBy("session_id", *keys, "reset").agg(F.count("*").alias("failures"), F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"))


def recovery(results: DataFrame, signature: str) -> DataFrame:
    """For every failure the next success of its signature, the attempts until then, and how it ended."""
    own = Window.partitionBy("session_id", signature)
    by = own.orderBy("idx")
    later = own.orderBy(F.col("idx").desc()).rowsBetween(Window.unboundedPreceding, -1)
    rows = results.withColumns(
        {
            "place": F.row_number().over(by),
            "n": F.count("*").over(own),
        }
    ).withColumns({"success": F.min(F.when(F.col("ok"), F.col("idx"))).over(later), "success_place": F.min(F.when(F.col("ok"), F.col("place"))).over(later)})
    outcome = F.when(F.col("success").isNotNull(), "success").when(F.col("place") == F.col("n"), "terminal_stop").otherwise("unresolved")
    attempts = (F.coalesce("success_place", "n") - F.col("place")).cast("long")
    return rows.filter("not ok").select("session_id", signature, "idx", F.col("success").alias("recovered_idx"), attempts.alias("attempts"), outcome.alias("outcome"))


def outcomes(rows: DataFrame, correction: tuple[str, ...], positive: tuple[str, ...]) -> DataFrame:
    """Label and reason of each session of facts(), the first that holds: negative if the last message of the user
    corrects, the last test run failed, or a command takes back what was edited last; positive if that message
    approves, the last test run passed, or something was committed; else unknown."""
    low = F.lower("command")
    has = lambda *words: F.coalesce(reduce(lambda a, b: a | b, (F.contains(low, F.lit(w)) for w in words)), F.lit(False))
    command = F.coalesce((F.col("kind") == "tool_call") & (F.col("category") == "execute") & F.col("command").isNotNull(), F.lit(False))
    ok = F.coalesce("r_ok", "ok")
    tests = command & ((F.col("intent") == "build_test") | has(*TEST_MARKERS)) & ok.isNotNull()
    edit = F.max(F.when((F.col("kind") == "tool_call") & (F.col("category") == "write"), F.col("idx")))
    said = F.max(F.when((F.col("kind") == "user_msg") & (F.coalesce("text", F.lit("")) != ""), F.struct("idx", "text")))
    per = rows.groupBy("session_id").agg(
        said.alias("said"), F.max(F.when(tests, F.struct("idx", ok.alias("ok")))).alias("test"), edit.alias("edit"),
        F.max(F.when(command & has(*REVERTS), F.col("idx"))).alias("revert"), F.max(command & has("git commit") & F.coalesce(ok, F.lit(True))).alias("committed"),
    )
    spoke = lambda words: F.coalesce(tx.lexicon(F.col("said.text"), words), F.lit(False))
    test = F.col("test.ok")
    reason = (
        F.when(spoke(correction), "corrected").when(test == F.lit(False), "test_failed").when(F.col("revert") > F.col("edit"), "reverted")
        .when(spoke(positive), "approved").when(test, "test_passed").when(F.col("committed"), "committed").otherwise("no_signal")
    )
    label = F.when(F.col("reason").isin("corrected", "test_failed", "reverted"), "negative").when(F.col("reason") == "no_signal", "unknown").otherwise("positive")
    return per.select("session_id", reason.alias("reason")).withColumn("label", label)
