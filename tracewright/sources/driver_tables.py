"""The shared test tables as canonical trace tables. Each adapter has a SQL twin of the same columns in VIEWS."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What the key of an event stands for, by remainder.
COMMANDS = (
    "pytest -q tests", "git status", "sed -i s/a/b/ src/m1.py", "npm run build", "ls -la src", "cat log.txt | grep error",
    "git revert HEAD", "python -m pytest src", "echo done > out.txt", "sleep 5",
)
ERRORS = ("permission", "sandbox_egress", "agent_syntax_error", "mcp_transport", "rate_limit", "timeout", "build_test_fail")
MODELS = ("alpha", "beta:high", "beta:low")
#: What users and assistants of work_events() say.
ASKS = (
    "please fix the bug in src/m1.py and src/m2.py", "now do the parser, add a test", "no, that is wrong, undo it", "why does it fail?",
    "thanks, works great", "also implement src/m4.ts next to docs/m4.md", "still failing, revert it", "is src/m3.py done?",
)
SAYS = (
    "done, it should work", "the parser returns nothing", "that failed, retrying", "we could also add a cache",
    "all set", "reading on", "the cache is cold", "fixed: sk-abcdefghij0123456789xyz",
)
SHELL = (
    "pytest -q tests", "git status", "sed -i s/a/b/ src/m1.py", "npm run build", "grep -rn foo src", "cat log.txt | grep error",
    "git revert HEAD", "uv run pytest src/m1.py", "echo done > out.txt", "ls -la src; rm -rf tmp", "git commit -m x", "make check", "ruff format src",
)
OUTPUTS = ("ok", "Status: running", "Permission denied", "egress blocked", "2 failed", "rate limit", "import os, mod1", "^C")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Fixed value: events that a task deals with. What the windows over a session hold of one is a hundred times what it
#: takes in a shuffle, so tasks must not be put together by their bytes.
EVENTS_A_TASK = 10_000


def dealt_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` dealt by user, over as many tasks as their number asks for (the count is read from the files' footers)."""
    e = table(spark, sf_dir, "events")
    return e.repartition(max(spark.sparkContext.defaultParallelism, -(-e.count() // EVENTS_A_TASK)), "user_id")


def _pick(values: tuple[str, ...], key: F.Column) -> F.Column:
    return F.element_at(F.array(*map(F.lit, values)), (key % len(values) + 1).cast("int"))


def trace_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` as one session a user: signups are user messages, views and clicks calls, errors and purchases results."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = dealt_events(spark, sf_dir).withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    kind = F.when(F.col("event_type") == "signup", "user_msg").when(F.col("event_type").isin("view", "click"), "tool_call").otherwise("tool_result")
    category = F.when(F.col("event_type") == "view", "read").when(F.col("event_type") == "click", F.when(F.col("k") % 3 == 0, "write").otherwise("execute"))
    touches = (F.col("event_type") == "view") | ((F.col("event_type") == "click") & (F.col("k") % 3 == 0))
    return e.select(
        F.col("user_id").alias("session_id"),
        (F.row_number().over(order) - 1).cast("long").alias("idx"),
        "ts",
        kind.alias("kind"),
        category.alias("category"),
        F.when(F.col("event_type") == "view", F.when(F.col("k") % 10 == 0, "grep").otherwise("read_file"))
        .when(F.col("event_type") == "click", F.when(F.col("k") % 3 == 0, "edit").otherwise("shell"))
        .alias("tool"),
        F.when(F.col("event_type") == "error", False).when(F.col("event_type") == "purchase", True).alias("ok"),
        F.when(kind != "user_msg", F.concat(F.lit("c"), (F.col("k") % 20).cast("string"))).alias("call_id"),
        F.when(touches, F.concat(F.lit("src/m"), (F.col("k") % 12).cast("string"), F.lit(".py"))).alias("path"),
        F.when((F.col("event_type") == "click") & (F.col("k") % 3 != 0), _pick(COMMANDS, F.col("k"))).alias("command"),
        F.when(F.col("event_type") == "error", _pick(ERRORS, F.col("k"))).alias("error"),
        F.col("value").alias("seconds"),
        F.round(F.col("value") * 100).cast("long").alias("size"),
        _pick(MODELS, F.col("k")).alias("model"),
        F.col("k").cast("long").alias("k"),
    )


def work_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` as coding sessions, one a user: an event is a message, or a call with its result and the usage of the
    response that made it. Ids of calls are mostly their own; some are used again, and some calls have no result."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    k, kind = F.col("k"), F.col("event_type")
    e = dealt_events(spark, sf_dir).withColumn("k", F.get_json_object("props", "$.k").cast("long")).withColumn("at", (4 * (F.row_number().over(order) - 1)).cast("long"))
    e = e.withColumn("micros", F.unix_micros(F.col("ts").cast("timestamp")))
    name = F.col("name")
    tool = (
        F.when(kind == "view", F.when(k % 10 == 0, "Grep").otherwise("Read"))
        .when(kind == "click", F.when(k % 3 != 0, "Bash").when(k % 2 == 0, "Edit").otherwise("Write"))
        .when(kind == "error", F.when(k % 5 == 0, "Task").when(k % 5 == 1, "mcp.fs.list").otherwise("Bash"))
        .when(kind == "purchase", F.element_at(F.array(*map(F.lit, ("wait_agent", "Task", "list_agents", "TodoWrite"))), (k % 4 + 1).cast("int")))
    )
    rows = e.withColumn("name", tool)
    category = F.when(name.isin("Grep", "Read"), "read").when(name.isin("Edit", "Write"), "write").when(name == "Bash", "execute").when(name == "Task", "subagent").when(name == "TodoWrite", "planning").when(name.isNotNull(), "other")
    path = F.when(name.isin("Grep", "Read", "Edit", "Write"), F.when(k % 6 == 0, F.concat(F.lit("tests/test_m"), k % 12, F.lit(".py"))).otherwise(F.concat(F.lit("src/m"), k % 12, F.lit(".py"))))
    command = F.when(name == "Bash", _pick(SHELL, k))
    ok = F.when(kind == "error", False).when(name == "Bash", k % 4 != 1).otherwise(True)
    said = F.when(kind != "signup", None).when(k < 25, "user_msg").when(k >= 97, "compaction").when(k < 30, "thinking").otherwise("assistant_msg")
    words = F.when(said == "user_msg", _pick(ASKS, k)).when(said == "assistant_msg", _pick(SAYS, k)).when(name == "Task", F.concat(F.lit("review src/m"), k % 6, F.lit(".py")))
    rows = rows.withColumns({"category": category, "path": path, "command": command, "fine": ok, "said": said, "words": words})
    rows = rows.withColumn("id", F.when(k % 11 == 0, F.concat(F.lit("again"), k % 2)).otherwise(F.concat(F.lit("c"), F.col("at"))))
    failed, span = ~F.col("fine"), F.round(F.col("value") * 1_000_000).cast("long")
    size = F.when(F.col("category") == "read", 1000 + k % 8 * 100).otherwise(F.round(F.col("value") * 100)).cast("long")
    none = lambda t: F.lit(None).cast(t)
    time = lambda more: F.timestamp_micros(F.col("micros") + more)
    n = lambda by: F.round(F.col("value") * by).cast("long")
    call = {
        "kind": F.coalesce("said", F.lit("tool_call")), "ts": time(F.lit(0)), "tool": name, "category": F.col("category"), "call_id": F.when(name.isNotNull(), F.col("id")), "text": F.col("words"),
        "path": F.col("path"), "command": F.col("command"), "signature": F.when(name.isNotNull(), F.concat_ws(" ", name, F.coalesce("command", "path", "words", F.concat(F.lit("a"), k % 3)))),
        "old_text": F.when(name == "Edit", F.when(k % 4 == 0, "assert x\nassert y").otherwise("x")), "lines": F.when(name == "Write", k + 1).when(name == "Edit", 1),
        "new_text": F.when(name == "Edit", F.when(k % 3 == 0, F.concat(F.lit("import mod"), k % 7)).otherwise("y")).when(name == "Write", F.concat(F.lit("from mod"), k % 4, F.lit(" import z"))),
        "todos": F.when(name == "TodoWrite", (k % 7 + 1).cast("int")), "todos_done": F.when(name == "TodoWrite", F.when(k % 13 == 0, 1).otherwise(0)),
    }
    result = {
        "kind": F.lit("tool_result"), "ts": time(span), "tool": name, "call_id": F.col("id"), "text": _pick(OUTPUTS, k), "size": size, "ok": F.col("fine"),
        "error": F.when(failed, F.when(kind == "error", _pick(ERRORS, k)).when(k % 13 < 4, "build_test_fail").otherwise("other")), "exit_code": F.when(name == "Bash", F.when(~failed, 0).when(k % 25 == 2, 130).otherwise(1)),
    }
    usage = {
        "kind": F.lit("usage"), "ts": time(span), "model": _pick(MODELS, k), "input": n(1000), "output": n(100), "cache_write": F.when(k % 3 != 1, n(400)).otherwise(0),
        "cache_read": F.when(k % 17 == 16, None).when(k % 6 == 5, 0).otherwise(n(10_000)),
    }
    types = {
        "kind": "string", "ts": "timestamp", "tool": "string", "category": "string", "call_id": "string", "text": "string", "path": "string", "command": "string", "signature": "string",
        "old_text": "string", "new_text": "string", "lines": "long", "todos": "int", "todos_done": "int", "size": "long", "ok": "boolean", "error": "string", "exit_code": "int", "model": "string",
        "input": "long", "output": "long", "cache_read": "long", "cache_write": "long",
    }
    parts = [(0, call, F.lit(True)), (1, result, name.isNotNull() & ~((kind == "purchase") & (k % 8 == 0))), (2, usage, name.isNotNull() | (F.col("said") == "assistant_msg"))]
    each = [F.when(holds, F.struct(F.lit(i).alias("i"), *(c.get(t, none(d)).cast(d).alias(t) for t, d in types.items()))) for i, c, holds in parts]
    made = rows.select(F.col("user_id").alias("session_id"), "at", F.concat(F.lit("r"), F.col("event_id")).alias("response_id"), F.inline(F.filter(F.array(*each), lambda x: x.isNotNull())))
    return made.select("session_id", (F.col("at") + F.col("i")).alias("idx"), "response_id", *types)


def conversation_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`conversations` as sessions of messages; system turns are meta."""
    c = table(spark, sf_dir, "conversations")
    kind = F.when(F.col("role") == "user", "user_msg").when(F.col("role") == "assistant", "assistant_msg").otherwise("meta")
    return c.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("idx"), kind.alias("kind"), F.coalesce("text", F.lit("")).alias("text"))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`lineitem` and `orders` as model responses of threads; seq is a unique order within a thread."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return rows.select(
        F.col("l_orderkey").alias("thread_id"),
        F.row_number().over(order).cast("long").alias("seq"),
        F.col("l_linenumber").cast("long").alias("response_id"),
        F.col("o_orderdate").alias("ts"),
        F.col("l_shipdate").alias("ts_end"),
        F.col("o_orderpriority").alias("model"),
        F.col("l_returnflag").alias("effort"),
        F.col("l_partkey").alias("part_id"),
        F.round(F.col("l_quantity") * 1000).cast("long").alias("input"),
        F.round(F.col("l_extendedprice")).cast("long").alias("cache_read"),
        F.round(F.col("l_discount") * 100000).cast("long").alias("cache_write"),
        F.round(F.col("l_tax") * 100000).cast("long").alias("output"),
    )


def _pick_sql(values: tuple[str, ...], key: str) -> str:
    return f"([{', '.join(repr(v) for v in values)}])[{key} % {len(values)} + 1]"


_MADE = f"""SELECT *, CASE WHEN event_type <> 'signup' THEN NULL WHEN k < 25 THEN 'user_msg' WHEN k >= 97 THEN 'compaction' WHEN k < 30 THEN 'thinking' ELSE 'assistant_msg' END AS said,
    CASE event_type WHEN 'view' THEN CASE WHEN k % 10 = 0 THEN 'Grep' ELSE 'Read' END WHEN 'click' THEN CASE WHEN k % 3 <> 0 THEN 'Bash' WHEN k % 2 = 0 THEN 'Edit' ELSE 'Write' END
        WHEN 'error' THEN CASE k % 5 WHEN 0 THEN 'Task' WHEN 1 THEN 'mcp.fs.list' ELSE 'Bash' END WHEN 'purchase' THEN (['wait_agent', 'Task', 'list_agents', 'TodoWrite'])[k % 4 + 1] END AS name,
    CASE WHEN k % 11 = 0 THEN 'again' || (k % 2) ELSE 'c' || start END AS id
    FROM (SELECT *, 4 * (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) AS start FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))"""
VIEWS = {
    "work": f"""
SELECT session_id, start + i AS idx, response_id, kind, ts, tool, category, call_id, text, path, command,
    CASE WHEN i = 0 AND tool IS NOT NULL THEN tool || ' ' || coalesce(command, path, text, 'a' || (k % 3)) END AS signature, old_text, new_text, lines, todos, todos_done, size, ok, error, exit_code, model,
    input, output, cache_read, cache_write FROM (
    SELECT user_id AS session_id, start, 0 AS i, k, 'r' || event_id AS response_id, coalesce(said, 'tool_call') AS kind, epoch_us(ts) AS ts, name AS tool,
        CASE WHEN name IN ('Grep', 'Read') THEN 'read' WHEN name IN ('Edit', 'Write') THEN 'write' WHEN name = 'Bash' THEN 'execute' WHEN name = 'Task' THEN 'subagent'
            WHEN name = 'TodoWrite' THEN 'planning' WHEN name IS NOT NULL THEN 'other' END AS category, CASE WHEN name IS NOT NULL THEN id END AS call_id,
        CASE WHEN said = 'user_msg' THEN {_pick_sql(ASKS, "k")} WHEN said = 'assistant_msg' THEN {_pick_sql(SAYS, "k")} WHEN name = 'Task' THEN 'review src/m' || (k % 6) || '.py' END AS text,
        CASE WHEN name IN ('Grep', 'Read', 'Edit', 'Write') THEN CASE WHEN k % 6 = 0 THEN 'tests/test_m' ELSE 'src/m' END || (k % 12) || '.py' END AS path,
        CASE WHEN name = 'Bash' THEN {_pick_sql(SHELL, "k")} END AS command,
        CASE WHEN name = 'Edit' THEN CASE WHEN k % 4 = 0 THEN 'assert x' || chr(10) || 'assert y' ELSE 'x' END END AS old_text,
        CASE WHEN name = 'Edit' THEN CASE WHEN k % 3 = 0 THEN 'import mod' || (k % 7) ELSE 'y' END WHEN name = 'Write' THEN 'from mod' || (k % 4) || ' import z' END AS new_text,
        CASE name WHEN 'Write' THEN k + 1 WHEN 'Edit' THEN 1 END AS lines, CASE WHEN name = 'TodoWrite' THEN k % 7 + 1 END AS todos,
        CASE WHEN name = 'TodoWrite' THEN CASE WHEN k % 13 = 0 THEN 1 ELSE 0 END END AS todos_done, NULL::BIGINT AS size, NULL::BOOLEAN AS ok, NULL::VARCHAR AS error, NULL::INTEGER AS exit_code,
        NULL::VARCHAR AS model, NULL::BIGINT AS input, NULL::BIGINT AS output, NULL::BIGINT AS cache_read, NULL::BIGINT AS cache_write FROM made
    UNION ALL SELECT user_id, start, 1, k, 'r' || event_id, 'tool_result', epoch_us(ts) + CAST(round(value * 1000000) AS BIGINT), name, NULL, id, {_pick_sql(OUTPUTS, "k")}, NULL, NULL, NULL, NULL, NULL, NULL, NULL,
        CASE WHEN name IN ('Grep', 'Read') THEN 1000 + k % 8 * 100 ELSE CAST(round(value * 100) AS BIGINT) END, fine,
        CASE WHEN NOT fine THEN CASE WHEN event_type = 'error' THEN {_pick_sql(ERRORS, "k")} WHEN k % 13 < 4 THEN 'build_test_fail' ELSE 'other' END END,
        CASE WHEN name = 'Bash' THEN CASE WHEN fine THEN 0 WHEN k % 25 = 2 THEN 130 ELSE 1 END END, NULL, NULL, NULL, NULL, NULL
        FROM (SELECT *, CASE WHEN event_type = 'error' THEN false WHEN name = 'Bash' THEN k % 4 <> 1 ELSE true END AS fine FROM made)
        WHERE name IS NOT NULL AND NOT (event_type = 'purchase' AND k % 8 = 0)
    UNION ALL SELECT user_id, start, 2, k, 'r' || event_id, 'usage', epoch_us(ts) + CAST(round(value * 1000000) AS BIGINT), NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL,
        {_pick_sql(MODELS, "k")}, CAST(round(value * 1000) AS BIGINT), CAST(round(value * 100) AS BIGINT), CASE WHEN k % 17 = 16 THEN NULL WHEN k % 6 = 5 THEN 0 ELSE CAST(round(value * 10000) AS BIGINT) END,
        CASE WHEN k % 3 <> 1 THEN CAST(round(value * 400) AS BIGINT) ELSE 0 END FROM made WHERE name IS NOT NULL OR said = 'assistant_msg')""",
    "made": _MADE,
    "ev": f"""
SELECT user_id AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, ts,
    CASE WHEN event_type = 'signup' THEN 'user_msg' WHEN event_type IN ('view', 'click') THEN 'tool_call' ELSE 'tool_result' END AS kind,
    CASE WHEN event_type = 'view' THEN 'read' WHEN event_type = 'click' THEN CASE WHEN k % 3 = 0 THEN 'write' ELSE 'execute' END END AS category,
    CASE WHEN event_type = 'view' THEN CASE WHEN k % 10 = 0 THEN 'grep' ELSE 'read_file' END
        WHEN event_type = 'click' THEN CASE WHEN k % 3 = 0 THEN 'edit' ELSE 'shell' END END AS tool,
    CASE event_type WHEN 'error' THEN false WHEN 'purchase' THEN true END AS ok,
    CASE WHEN event_type <> 'signup' THEN 'c' || (k % 20) END AS call_id,
    CASE WHEN event_type = 'view' OR (event_type = 'click' AND k % 3 = 0) THEN 'src/m' || (k % 12) || '.py' END AS path,
    CASE WHEN event_type = 'click' AND k % 3 <> 0 THEN {_pick_sql(COMMANDS, "k")} END AS command,
    CASE WHEN event_type = 'error' THEN {_pick_sql(ERRORS, "k")} END AS error,
    value AS seconds, CAST(round(value * 100) AS BIGINT) AS size, {_pick_sql(MODELS, "k")} AS model, k
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)""",
    "conv": """
SELECT conv_id AS session_id, turn AS idx, CASE role WHEN 'user' THEN 'user_msg' WHEN 'assistant' THEN 'assistant_msg' ELSE 'meta' END AS kind,
    coalesce(text, '') AS text FROM conversations""",
    "resp": """
SELECT l_orderkey AS thread_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS seq,
    CAST(l_linenumber AS BIGINT) AS response_id, o_orderdate AS ts, l_shipdate AS ts_end, o_orderpriority AS model, l_returnflag AS effort,
    l_partkey AS part_id, CAST(round(l_quantity * 1000) AS BIGINT) AS input, CAST(round(l_extendedprice) AS BIGINT) AS cache_read,
    CAST(round(l_discount * 100000) AS BIGINT) AS cache_write, CAST(round(l_tax * 100000) AS BIGINT) AS output
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
}


def _facts_sql() -> str:
    """The SQL twin of operators.facts.facts() over work_events()."""
    from tracewright.functions import text as tx
    from tracewright.operators import errors, facts

    quote = lambda p: "'" + p.replace("'", "''") + "'"
    last = "regexp_replace(trim(string_split_regex({0}, '[;|&\\n]+')[-1]), '^\\S*/', '')"
    killed = "(coalesce({0}exit IN (130, 143), false) OR coalesce({0}error = 'cancelled', false) OR coalesce(rtrim({0}text) LIKE '%^C', false))"
    quiet = "coalesce({1} = 'read', false) AND length(trim(coalesce({0}text, ''))) <= 300"
    answer = "coalesce(regexp_matches(" + last + ", " + quote(tx._ANSWERS) + "), false)"
    benign = "coalesce({0}ok = false AND (coalesce({0}error = 'no_match_probe', false) OR " + killed + " OR ({0}exit = 1 AND coalesce({0}error, '') <> 'file_not_found' AND (" + answer.replace("{0}", "{3}") + " OR (" + quiet + ")))), false)"
    upto, before, after = (f"OVER (PARTITION BY session_id ORDER BY idx ROWS BETWEEN {a} AND {b})" for a, b in (("UNBOUNDED PRECEDING", "CURRENT ROW"), ("UNBOUNDED PRECEDING", "1 PRECEDING"), ("1 FOLLOWING", "UNBOUNDED FOLLOWING")))
    whole = "OVER (PARTITION BY session_id)"
    when = lambda c, fn="max": f"{fn}(CASE WHEN {c} THEN idx END)"
    code = f"regexp_matches(path, {quote(tx.CODE)})"
    return f"""
SELECT *, coalesce(said_row AND (next_said IS NULL OR next_user < next_said), false) AS terminal,
    min(CASE WHEN said_row AND (next_said IS NULL OR next_user < next_said) THEN idx END) {after} AS next_terminal FROM (
SELECT *, sum(CASE WHEN logical THEN 1 ELSE 0 END) {upto} - 1 AS pos, coalesce({when("kind = 'user_msg'")} {upto}, -1) AS scope, sum(CASE WHEN is_write THEN 1 ELSE 0 END) {upto} AS writes,
    sum(CASE WHEN logical THEN 1 ELSE 0 END) {whole} AS n_logical, {when("is_write", "min")} {whole} AS first_write, {when("kind = 'user_msg'")} {whole} AS last_user,
    {when(f"is_write AND {code}")} {whole} AS last_edit, {when("is_exec AND intent = 'build_test' AND r_ok")} {whole} AS last_pass,
    {when("kind = 'tool_result' AND ok = false AND error = 'build_test_fail'")} {upto} AS test_failed,
    {when("kind IN ('thinking', 'plan') OR (is_call AND category = 'planning')")} {before} IS NOT NULL AS planned, {when("is_read OR is_exec OR is_search")} {upto} IS NOT NULL AS observed,
    {when("kind = 'compaction'")} {before} AS compacted, {when("is_call", "min")} {after} AS next_call, {when("kind = 'user_msg'", "min")} {after} AS next_user, {when("is_write", "min")} {after} AS next_write,
    {when("said_row", "min")} {after} AS next_said, {when(f"said_row AND regexp_matches(text, {quote(facts.ACKNOWLEDGED)})", "min")} {after} AS next_ack,
    (stamp - last_value(stamp IGNORE NULLS) {before}) / 1e6 AS gap,
    CASE WHEN touches THEN sum(CASE WHEN touches THEN 1 ELSE 0 END) OVER (PARTITION BY session_id, path ORDER BY idx ROWS UNBOUNDED PRECEDING) END AS touch,
    CASE WHEN touches THEN {when("is_read", "min")} OVER (PARTITION BY session_id, path) END AS read_first, {benign.format("", "c_category", "", "c_command")} AND kind = 'tool_result' AS benign,
    coalesce(r_ok = false, false) AS r_failed, {benign.format("r_", "category", "", "command")} AND is_call AS r_benign, {killed.format("r_")} AS r_killed FROM (
SELECT b.*, b.exit_code AS exit, is_call AND n_calls = 1 AND n_results = 1 AND last_result > b.idx AS paired, CASE WHEN is_call THEN last_result END AS r_idx, r.ok AS r_ok, r.error AS r_error, r.exit_code AS r_exit,
    r.text AS r_text, r.size AS r_size, r.ts AS r_ts, c.command AS c_command, c.category AS c_category, (is_read OR is_write) AND b.path IS NOT NULL AS touches,
    CASE WHEN b.kind <> 'usage' THEN b.ts END AS stamp FROM (
SELECT *, kind NOT IN ('meta', 'usage') AS logical, kind = 'tool_call' AS is_call, kind = 'assistant_msg' AS said_row, coalesce(kind = 'tool_call' AND category = 'read', false) AS is_read,
    coalesce(kind = 'tool_call' AND category = 'write', false) AS is_write, coalesce(kind = 'tool_call' AND category = 'execute', false) AS is_exec,
    coalesce(kind = 'tool_call' AND lower(tool) IN ('grep', 'glob', 'find', 'rg', 'egrep', 'ugrep'), false) AS is_search, {errors.intent_sql("command")} AS intent,
    max(CASE WHEN kind = 'tool_result' THEN idx END) OVER c AS last_result, max(CASE WHEN kind = 'tool_call' THEN idx END) OVER c AS last_call,
    count(*) FILTER (kind = 'tool_call') OVER c AS n_calls, count(*) FILTER (kind = 'tool_result') OVER c AS n_results
    FROM work WINDOW c AS (PARTITION BY session_id, coalesce(call_id, '#' || idx))) b
LEFT JOIN (SELECT session_id, idx, ok, error, exit_code, text, size, ts FROM work) r ON b.is_call AND r.session_id = b.session_id AND r.idx = b.last_result
LEFT JOIN (SELECT session_id, idx, command, category FROM work) c ON b.kind = 'tool_result' AND c.session_id = b.session_id AND c.idx = b.last_call))"""


def sql(body: str, *views: str) -> str:
    """A query over canonical views: `body` goes on after their CTEs."""
    if "f" in views and "f" not in VIEWS:
        VIEWS["f"] = _facts_sql()
    ctes = ",\n".join(f"{v} AS ({VIEWS[v]})" for v in views)
    return f"WITH {ctes}{',' if body.lstrip().startswith('AND_WITH') else ''}\n{body.replace('AND_WITH', '', 1)}"
