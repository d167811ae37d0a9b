"""Decoders of the log formats: records to canonical trace events.

A decoder is one column: the array of events that a record holds. All records are parsed and decoded in one pass over
the logs, without a shuffle; what needs a whole file (its session, model, surface and replayed prefix, a message's last
usage) follows in windows over the decoded events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewright.functions import text as tx

from . import jsonl
from .jsonl import get

EVENT = {
    "kind": "string", "tool": "string", "category": "string", "call_id": "string", "text": "string", "ok": "boolean", "exit_code": "int", "size": "long", "path": "string",
    "command": "string", "args": "string", "model": "string", "response_id": "string", "turn_id": "string", "ts": "timestamp", "input": "long", "output": "long",
    "cache_read": "long", "cache_write": "long", "cumulative": "boolean", "old_text": "string", "new_text": "string", "lines": "long", "todos": "int", "todos_done": "int",
    "final": "boolean", "raw_type": "string", "head": "string", "agent": "string", "message": "string", "thread": "string", "surface": "string", "ordinal": "long",
}
#: Tools by what they do.
CATEGORIES = {
    "Read": "read", "Grep": "read", "Glob": "read", "LS": "read", "read": "read", "grep": "read", "find": "read", "ls": "read", "view_image": "read", "Edit": "write", "Write": "write",
    "MultiEdit": "write", "NotebookEdit": "write", "edit": "write", "write": "write", "apply_patch": "write", "file_change": "write", "Bash": "execute", "bash": "execute",
    "shell": "execute", "exec_command": "execute", "command_execution": "execute", "TodoWrite": "planning", "update_plan": "planning", "Task": "subagent", "Agent": "subagent",
    "spawn_agent": "subagent", "wait_agent": "subagent", "get_subagent_result": "subagent", "send_message": "subagent", "close_agent": "subagent", "list_agents": "subagent",
}
#: How texts start that a harness, not a person, puts in a user's mouth.
INJECTED = r"^\s*<(?:environment_context|user_instructions|system-reminder|command-name|local-command|permissions)|^\s*# AGENTS\.md|^Caveat:"
#: Seconds within which a compaction's record and item are one.
COMPACTION_SECONDS = 120


def category(tool: Column) -> Column:
    """exact name, then mcp. names as other, then the lower-case name."""
    known = F.create_map(*(F.lit(x) for kv in CATEGORIES.items() for x in kv))
    lower = F.create_map(*(F.lit(x) for k, v in {k.lower(): v for k, v in CATEGORIES.items()}.items() for x in (k, v)))
    return F.when(tool.isNotNull(), F.coalesce(known[tool], F.when(~tool.rlike("^mcp[._]"), lower[F.lower(tool)]), F.lit("other")))


def _event(**columns: Column | str | bool) -> Column:
    made = {k: c if isinstance(c, Column) else F.lit(c) for k, c in columns.items()}
    return F.struct(*(made.get(n, F.lit(None)).cast(t).alias(n) for n, t in EVENT.items()))


def _r(path: str, kind: str = "string") -> Column:
    return get("record", path, kind)


def _list(value: Column) -> Column:
    return F.try_variant_get(value, "$", "array<variant>")


def _is_list(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith("ARRAY"), F.lit(False))


def _flat(content: Column) -> Column:
    """a text, or the texts of a list of blocks with spaces between."""
    texts = F.filter(F.transform(_list(content), lambda b: F.coalesce(get(b, "$.text"), F.try_variant_get(b, "$", "string"))), lambda x: x.isNotNull())
    return F.when(_is_list(content), F.array_join(texts, " ")).otherwise(F.try_variant_get(content, "$", "string"))


def _json(value: Column) -> Column:
    """arguments as text: keys in order, white space collapsed."""
    return F.regexp_replace(F.to_json(value), r"(?:\\[ntr]|\s)+", " ")


def _user(text: Column) -> Column:
    """Whose words a user message holds."""
    return F.when(text.rlike(INJECTED), "meta").otherwise("user_msg")


def _todos(value: Column) -> tuple[Column, Column]:
    items = _list(value)
    done = F.filter(items, lambda x: F.lower(get(x, "$.status")) == "completed")
    return F.when(items.isNotNull(), F.size(items)), F.when(items.isNotNull(), F.size(done))


def _arguments(given: Column) -> dict[str, Column]:
    """What a call's arguments say, under the names that tools give them."""
    at = lambda *names: F.coalesce(*(get(given, f"$.{n}") for n in names))
    argv = F.array_join(F.try_variant_get(given, "$.command", "array<string>"), " ")
    new = at("new_string", "content", "new_source")
    todos, done = _todos(F.try_variant_get(given, "$.todos", "variant"))
    return {
        "path": at("file_path", "path", "notebook_path"), "command": F.coalesce(argv, at("command", "cmd", "script")), "args": _json(given), "old_text": at("old_string"), "new_text": new,
        "text": at("prompt", "message", "description"), "lines": F.when(get(given, "$.content").isNotNull(), F.size(F.split(get(given, "$.content"), "\n"))), "todos": todos, "todos_done": done,
    }


def _tokens(base: str, names: dict[str, str], within: bool) -> dict[str, Column]:
    """Token counts under a path; `within` says that the input holds the cached part too."""
    n = {k: _r(f"{base}.{v}", "long") for k, v in names.items()}
    if within:
        n["input"] = n["input"] - F.coalesce(n["cache_read"], F.lit(0))
    return n


def claude() -> Column:
    """Messages with content blocks. User texts are messages unless the line is meta; tool results carry
    ok; a compact boundary is a compaction. Each line repeats its message's usage: the last of a message counts."""
    kind, content = _r("$.type"), F.try_variant_get("record", "$.message.content", "variant")
    session = F.coalesce(_r("$.sessionId"), _r("$.session_id"))
    about = {"head": session, "agent": _r("$.parent_tool_use_id"), "ts": tx.parse_time(_r("$.timestamp")), "model": _r("$.message.model")}
    about |= {"message": F.coalesce(_r("$.message.id"), _r("$.requestId")), "response_id": F.coalesce(_r("$.message.id"), _r("$.requestId"))}
    meta = F.coalesce(_r("$.isMeta", "boolean"), F.lit(False))
    role = lambda text: F.when(kind == "assistant", "assistant_msg").when(meta, "meta").otherwise(_user(F.coalesce(text, F.lit(""))))

    def block(b: Column) -> Column:
        what, given = get(b, "$.type"), F.try_variant_get(b, "$.input", "variant")
        said = F.coalesce(get(b, "$.text"), get(b, "$.thinking"), _flat(F.try_variant_get(b, "$.content", "variant")))
        called, result = what == "tool_use", what == "tool_result"
        of = F.when(called, "tool_call").when(result, "tool_result").when(what == "thinking", "thinking").otherwise(role(said))
        arguments = {k: F.when(called, c) for k, c in _arguments(given).items()}
        text = F.when(called, arguments.pop("text")).otherwise(said)
        code = F.when(result, F.coalesce(_r("$.toolUseResult.exitCode", "int"), tx.exit_code(said)))
        return _event(
            kind=of, tool=get(b, "$.name"), call_id=F.coalesce(F.when(called, get(b, "$.id")), get(b, "$.tool_use_id")), text=text, size=F.when(result, F.length(F.coalesce(said, F.lit("")))),
            ok=F.when(result, ~F.coalesce(get(b, "$.is_error", "boolean"), F.lit(False))), exit_code=code, **arguments, **about,
        )

    plain = get(content, "$")
    told = F.when(_is_list(content), F.transform(_list(content), block)).otherwise(F.array(_event(kind=role(plain), text=plain, **about)))
    names = {"input": "input_tokens", "output": "output_tokens", "cache_read": "cache_read_input_tokens", "cache_write": "cache_creation_input_tokens"}
    used = _event(kind="usage", cumulative=False, **_tokens("$.message.usage", names, False), **about)
    has_usage = (kind == "assistant") & F.try_variant_get("record", "$.message.usage", "variant").isNotNull() & about["message"].isNotNull()
    said = F.when(kind.isin("assistant", "user") & content.isNotNull(), F.concat(told, F.when(has_usage, F.array(used)).otherwise(F.array())))
    cleared = F.when(_r("$.subtype") == "compact_boundary", F.array(_event(kind="compaction", **about)))
    return F.coalesce(said, cleared)


def codex_stdout() -> Column:
    """Started and completed items; turn.completed carries running totals of usage. A completed item without a
    started one is a call as well: of a call's two rows the first counts."""
    kind, item, i = _r("$.type"), _r("$.item.type"), _r("$.item.id")
    works = item.isin("command_execution", "file_change", "mcp_tool_call", "web_search")
    about = {"tool": item, "call_id": i}
    call = _event(kind="tool_call", command=_r("$.item.command"), path=_r("$.item.changes[0].path"), args=F.coalesce(_r("$.item.command"), _json(F.try_variant_get("record", "$.item.changes", "variant"))), message=F.concat(F.lit("call:"), i), **about)
    code, status, text = _r("$.item.exit_code", "int"), _r("$.item.status"), _r("$.item.aggregated_output")
    result = _event(kind="tool_result", text=text, size=F.length(F.coalesce(text, F.lit(""))), exit_code=code, ok=F.coalesce(code == 0, status == "completed", F.lit(True)), **about)
    names = {"input": "input_tokens", "output": "output_tokens", "cache_read": "cached_input_tokens"}
    used = _event(kind="usage", cumulative=True, **_tokens("$.usage", names, True))
    said = _event(kind=F.when(item == "reasoning", "thinking").otherwise("assistant_msg"), text=_r("$.item.text"))
    return (
        F.when(kind == "thread.started", F.array(_event(kind="head", head=_r("$.thread_id"))))
        .when((kind == "item.started") & works, F.array(call)).when((kind == "item.completed") & works, F.array(call, result))
        .when((kind == "item.completed") & item.isin("agent_message", "reasoning"), F.array(said)).when(kind == "turn.completed", F.array(used))
    )


def pi() -> Column:
    """Session and message records, and tool_execution_start and _end; updates are left out."""
    kind, given = _r("$.type"), F.try_variant_get("record", "$.args", "variant")
    ts = tx.parse_time(F.coalesce(_r("$.timestamp"), _r("$.message.timestamp")))
    about = {"tool": _r("$.toolName"), "call_id": _r("$.toolCallId"), "ts": ts}
    output = _flat(F.try_variant_get("record", "$.result.content", "variant"))
    result = _event(kind="tool_result", text=output, size=F.length(output), exit_code=tx.exit_code(output), ok=~F.coalesce(_r("$.isError", "boolean"), F.lit(False)), **about)
    role, text = _r("$.message.role"), _flat(F.try_variant_get("record", "$.message.content", "variant"))
    said = _event(kind=F.when(role == "user", _user(F.coalesce(text, F.lit("")))).when(role == "assistant", "assistant_msg").otherwise("meta"), text=text, model=_r("$.message.model"), ts=ts, response_id=_r("$.id"))
    names = {"input": "input", "output": "output", "cache_read": "cacheRead", "cache_write": "cacheWrite"}
    used = _event(kind="usage", cumulative=False, model=_r("$.message.model"), ts=ts, response_id=_r("$.id"), **_tokens("$.message.usage", names, False))
    has_usage = F.try_variant_get("record", "$.message.usage", "variant").isNotNull()
    return (
        F.when(kind == "session", F.array(_event(kind="head", head=_r("$.id"))))
        .when(kind == "tool_execution_start", F.array(_event(kind="tool_call", **_arguments(given), **about))).when(kind == "tool_execution_end", F.array(result))
        .when(kind.isin("message", "message_end"), F.when(has_usage, F.array(said, used)).otherwise(F.array(said))).when(kind == "model_change", F.array(_event(kind="model", model=_r("$.modelId"))))
    )


def _item(about: dict[str, Column]) -> Column:
    """The events of one completed item of the newest rollouts."""
    p = "$.payload.item"
    kind, i = _r(f"{p}.type"), _r(f"{p}.id")
    text = _flat(F.try_variant_get("record", f"{p}.content", "variant"))
    argv = F.coalesce(F.array_join(F.try_variant_get("record", f"{p}.command", "array<string>"), " "), _r(f"{p}.command"))
    parsed = _list(F.try_variant_get("record", f"{p}.parsed_cmd", "variant"))
    looks = F.coalesce(F.size(parsed) > 0, F.lit(False)) & F.coalesce(F.forall(parsed, lambda x: get(x, "$.type").isin("read", "list_files", "search")), F.lit(False))
    searches = F.coalesce(F.exists(parsed, lambda x: get(x, "$.type") == "search"), F.lit(False))
    seen = F.coalesce(get(F.get(parsed, F.lit(0)), "$.path"), get(F.get(parsed, F.lit(0)), "$.name"))
    out = F.coalesce(_r(f"{p}.aggregated_output"), _r(f"{p}.stdout"))
    code, status = F.coalesce(_r(f"{p}.exit_code", "int"), tx.exit_code(out)), _r(f"{p}.status")
    failed = F.coalesce(code != 0, status.isin("failed", "declined"), F.lit(False)) | F.coalesce(out.startswith("aborted by user"), F.lit(False))
    run = {"call_id": i, "tool": F.when(searches, "grep").otherwise("shell"), "raw_type": kind} | about
    ran = F.array(
        _event(kind="tool_call", category=F.when(looks, "read").otherwise("execute"), command=argv, path=F.when(looks, seen), args=argv, **run),
        _event(kind="tool_result", text=out, size=F.length(F.coalesce(out, F.lit(""))), exit_code=code, ok=~failed, **run),
    )
    changes = F.map_entries(F.try_variant_get("record", f"{p}.changes", "map<string,variant>"))
    added = F.forall(changes, lambda e: get(e["value"], "$.type") == "add")

    def change(e: Column, n: Column) -> Column:
        diff, content = get(e["value"], "$.unified_diff"), get(e["value"], "$.content")
        rows = F.coalesce(F.size(F.split(F.regexp_replace(content, r"\n$", ""), "\n")), tx.diff_lines(diff)[0])
        signed = lambda sign: F.array_join(F.filter(F.split(diff, "\n"), lambda x: x.startswith(sign) & ~x.startswith(sign * 3)), "\n")
        return _event(
            kind="tool_call", tool=F.when(get(e["value"], "$.type") == "add", "write").otherwise("file_change"), category="write", call_id=F.when(n == 0, i).otherwise(F.concat(i, F.lit("#"), n)),
            path=e["key"], args=F.concat_ws(" ", e["key"], content, diff), lines=rows, old_text=signed("-"), new_text=F.coalesce(content, signed("+")), raw_type=kind, **about,
        )

    changed = F.concat(
        F.transform(changes, change),
        F.array(_event(kind="tool_result", call_id=i, tool=F.when(added, "write").otherwise("file_change"), text=_r(f"{p}.stdout"), ok=F.coalesce(status == "completed", F.lit(True)), raw_type=kind, **about)),
    )
    named = F.concat_ws(".", F.lit("mcp"), _r(f"{p}.server"), _r(f"{p}.tool"))
    said = F.coalesce(_r(f"{p}.result.content"), _flat(F.try_variant_get("record", f"{p}.result.content", "variant")))
    mcp = {"call_id": i, "tool": named, "raw_type": kind} | about
    served = F.array(
        _event(kind="tool_call", args=F.coalesce(_r(f"{p}.arguments"), _json(F.try_variant_get("record", f"{p}.arguments", "variant"))), **mcp),
        _event(kind="tool_result", text=said, size=F.length(said), ok=~F.coalesce(_r(f"{p}.result.isError", "boolean"), F.lit(False)), **mcp),
    )
    agents = {"call_id": i, "tool": F.concat(F.regexp_replace(F.lower(_r(f"{p}.tool")), "agent$", ""), F.lit("_agent")), "category": F.lit("subagent"), "raw_type": kind} | about
    receivers = F.array_join(F.try_variant_get("record", f"{p}.receiver_thread_ids", "array<string>"), " ")
    handed = F.array(
        _event(kind="tool_call", text=_r(f"{p}.prompt"), args=_json(F.try_variant_get("record", p, "variant")), **agents),
        _event(kind="tool_result", text=F.concat_ws(" ", F.lit("agent_id:"), receivers), ok=~F.coalesce(status == "failed", F.lit(False)), **agents),
    )
    one = lambda of, **columns: F.array(_event(kind=of, raw_type=kind, **columns, **about))
    return (
        F.when(kind == "UserMessage", one(_user(F.coalesce(text, F.lit(""))), text=text)).when(kind == "AgentMessage", one("assistant_msg", text=text, final=_r(f"{p}.phase") == "final_answer"))
        .when(kind == "Reasoning", one("thinking", text=F.array_join(F.try_variant_get("record", f"{p}.summary_text", "array<string>"), " "))).when(kind == "CommandExecution", ran)
        .when(kind == "FileChange", changed).when(kind == "McpToolCall", served).when(kind == "CollabAgentToolCall", handed).when(kind == "ContextCompaction", one("compaction"))
        .when(kind == "Extension", one("tool_call", tool=_r(f"{p}.kind"), call_id=i, args=_r(f"{p}.query"))).when(kind == "ImageView", one("tool_call", tool=F.lit("view_image"), call_id=i, path=F.regexp_replace(_r(f"{p}.path"), "^file://", "")))
        .when(kind == "FunctionCallOutput", one("tool_result", call_id=i, tool=_r(f"{p}.name"), text=_r(f"{p}.output"), ok=True)).otherwise(one("meta"))
    )


def rollout() -> Column:
    """Rollouts of both surfaces. Each event says which surface it is of; trace_events() keeps one a file."""
    kind, what = _r("$.type"), _r("$.payload.type")
    p = lambda name, of="string": _r(f"$.payload.{name}", of)
    about = {"ts": tx.parse_time(_r("$.timestamp")), "turn_id": p("turn_id"), "thread": p("thread_id"), "ordinal": _r("$.ordinal", "long")}
    made = F.try_parse_json(F.coalesce(p("arguments"), p("input")))
    old = about | {"surface": F.lit("legacy")}
    call = _event(kind="tool_call", tool=p("name"), call_id=p("call_id"), **_arguments(made), **old)
    output = F.coalesce(p("output"), p("output.content"))
    code = tx.exit_code(output)
    result = _event(kind="tool_result", call_id=p("call_id"), text=output, size=F.length(output), exit_code=code, ok=F.coalesce(code == 0, p("output.success", "boolean"), F.lit(True)), **old)
    text = _flat(F.try_variant_get("record", "$.payload.content", "variant"))
    role = F.when(p("role") == "user", _user(F.coalesce(text, F.lit("")))).when(p("role") == "assistant", "assistant_msg").otherwise("meta")
    said = _event(kind=role, text=text, **old)
    thought = _event(kind="thinking", text=_flat(F.try_variant_get("record", "$.payload.summary", "variant")), **old)
    names = {"input": "input_tokens", "output": "output_tokens", "cache_read": "cached_input_tokens"}
    counted = _event(kind="usage", cumulative=True, raw_type="token_count", **_tokens("$.payload.info.total_token_usage", names, True), **about)
    used = _event(kind="usage", cumulative=False, raw_type="token_usage_record", response_id=p("response_id"), **_tokens("$.payload.usage", names | {"cache_write": "cache_write_input_tokens"}, True), **about)
    new = about | {"surface": F.lit("items")}
    meta = lambda of: F.array(_event(kind="meta", raw_type=of, **about))
    return (
        F.when(kind == "session_meta", F.array(_event(kind="head", head=F.coalesce(p("id"), p("session_id")), message=p("cli_version"), args=p("parent_thread_id"), old_text=p("forked_from_id"), size=p("subagent_history_start_ordinal", "long"), **about)))
        .when(kind == "turn_context", F.array(_event(kind="model", model=p("model"), **about))).when(kind == "token_usage_record", F.array(used))
        .when((kind == "compacted") | (what == "context_compacted"), F.array(_event(kind="compaction", text=p("message"), raw_type="compacted", **about)))
        .when((kind == "event_msg") & (what == "item_completed"), _item(new)).when((kind == "event_msg") & (what == "token_count") & _r("$.payload.info.total_token_usage.input_tokens", "long").isNotNull(), F.array(counted))
        .when((kind == "event_msg") & what.isin("task_started", "task_complete", "turn_aborted"), meta(what)).when((kind == "response_item") & what.isin("function_call", "custom_tool_call", "local_shell_call"), F.array(call))
        .when((kind == "response_item") & what.endswith("_call_output"), F.array(result)).when((kind == "response_item") & (what == "message"), F.array(said)).when((kind == "response_item") & (what == "reasoning"), F.array(thought))
    )


DECODERS = {"claude": claude, "codex_stdout": codex_stdout, "pi": pi, "rollout": rollout}


def decode(records: DataFrame) -> DataFrame:
    """path, place, block (the event's number in its record), family and the columns of EVENT for every event."""
    family, events = jsonl.family(), F.lit(None)
    for name, decoder in DECODERS.items():
        events = F.when(F.col("family") == name, decoder()).otherwise(events)
    rows = records.filter("not bad").withColumn("family", family).withColumn("events", events)
    found = rows.select(F.col("path").alias("file"), "place", "family", F.posexplode("events").alias("block", "e"))
    return found.select("file", "place", "family", "block", "e.*")


def _settle(events: DataFrame) -> DataFrame:
    """What a whole file decides: session, model, surface (S13), the replayed prefix and foreign usage of children
    (S12), a message's last usage, a call's first row and a compaction told twice."""
    of = Window.partitionBy("file").orderBy("place", "block")
    whole, upto = of.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), of.rowsBetween(Window.unboundedPreceding, 0)
    is_head = (F.col("kind") == "head") & F.col("head").isNotNull()
    stem = F.regexp_extract("file", r"([^/]+)\.jsonl$", 1)
    first = F.first(F.when(F.col("head").isNotNull(), F.struct("head", F.col("message").alias("version"), F.col("size").alias("start"))), ignorenulls=True)
    rows = events.withColumns(
        {
            "first": first.over(whole), "heads": F.count(F.when(is_head, 1)).over(upto), "current": F.last("model", ignorenulls=True).over(upto),
            "items": F.max(F.when(F.col("surface") == "items", 1)).over(whole), "records": F.max(F.when(F.col("raw_type") == "token_usage_record", 1)).over(whole),
            "n": F.row_number().over(of) - 1, "told": F.max(F.when(F.col("raw_type") == "compacted", F.col("ts"))).over(of.rowsBetween(Window.unboundedPreceding, -1)),
        }
    )
    newest = F.col("items").isNotNull() | (F.regexp_extract("first.version", r"0\.(\d+)", 1).try_cast("int") >= 150)
    own = F.coalesce(F.when(F.col("family") == "claude", F.concat_ws("/", F.coalesce("head", stem), "agent")), F.col("first.head"), stem)
    foreign = F.coalesce(F.col("thread") != F.col("first.head"), F.lit(False))
    prefix = F.when(F.col("first.start").isNotNull(), F.coalesce("ordinal", "n") < F.col("first.start")).otherwise((F.col("heads") > 1) & (F.col("thread").isNull() | foreign))
    replayed = (F.col("family") == "rollout") & F.coalesce(prefix, F.lit(False))
    twice = (F.col("raw_type") == "ContextCompaction") & (F.col("kind") == "compaction") & (F.unix_seconds("ts") - F.unix_seconds("told") <= COMPACTION_SECONDS)
    other = F.when(newest, F.col("surface") == "legacy").otherwise(F.col("surface") == "items") & F.col("surface").isNotNull()
    counted = (F.col("raw_type") == "token_count") & F.col("records").isNotNull()
    rows = rows.withColumns({"session_id": own, "model": F.coalesce("model", "current")})
    rows = rows.filter(~F.col("kind").isin("head", "model") & ~replayed & ~F.coalesce(twice, F.lit(False)) & ~F.coalesce(other, F.lit(False)) & ~F.coalesce(counted, F.lit(False)))
    rows = rows.filter(~(foreign & (F.col("raw_type") == "token_usage_record")))
    same = Window.partitionBy("file", "message", "kind").orderBy(F.col("place").desc(), F.col("block").desc())
    first_of = Window.partitionBy("file", "message", "kind").orderBy("place", "block")
    once = F.when((F.col("kind") == "usage") & F.col("message").isNotNull(), F.row_number().over(same)).when(F.col("message").startswith("call:"), F.row_number().over(first_of)).otherwise(1)
    return rows.withColumn("once", once).filter("once = 1").drop("once", "first", "heads", "current", "items", "records", "n", "told", "head", "agent", "message", "thread", "surface", "ordinal")


def thread_links(events: DataFrame) -> DataFrame:
    """Child, parent, kind of the sessions of decode() that name another as theirs."""
    heads = events.filter("kind = 'head' and family = 'rollout'")
    own = heads.groupBy("file").agg(F.min_by(F.struct("head", F.col("args").alias("spawned"), F.col("old_text").alias("forked")), "place").alias("h"))
    kind = F.when(F.col("h.spawned").isNotNull(), "spawn").otherwise("fork")
    found = own.select(F.col("h.head").alias("child"), F.coalesce("h.spawned", "h.forked").alias("parent"), kind.alias("kind"))
    return found.filter("child is not null and parent is not null and child <> parent").distinct()


def trace_events(spark: SparkSession, path: str) -> DataFrame:
    """Canonical events of all logs below a path: copies and older snapshots of a file are left out, records
    decoded by their shape, events numbered by file and line, running usage as deltas, calls' tools on their results,
    and the category of each tool."""
    gone = jsonl.distinct_files(jsonl.lines(spark, path)).filter("role <> 'kept'").select("path")
    kept = jsonl.records(spark, path).join(gone, "path", "left_anti")
    events = _settle(decode(kept))
    order = Window.partitionBy("session_id").orderBy("file", "place", "block")
    events = events.withColumn("idx", (F.row_number().over(order) - 1).cast("long"))
    used = Window.partitionBy("session_id", "cumulative").orderBy("idx")
    for c in ("input", "output", "cache_read"):
        delta = F.col(c) - F.coalesce(F.lag(c).over(used), F.lit(0))
        events = events.withColumn(c, F.when(F.col("cumulative"), F.when(delta < 0, F.col(c)).otherwise(delta)).otherwise(F.col(c)))
    key = F.coalesce("call_id", F.concat(F.lit("\u0000"), F.col("idx").cast("string")))
    named = F.max(F.when(F.col("kind") == "tool_call", F.struct("idx", "tool"))).over(Window.partitionBy("session_id", key))
    events = events.withColumn("tool", F.coalesce("tool", F.when(F.col("kind") == "tool_result", named["tool"])))
    called = F.col("kind") == "tool_call"
    return events.withColumns(
        {"category": F.when(called, F.coalesce("category", category(F.col("tool")))), "signature": F.when(called, F.concat_ws(" ", "tool", F.coalesce("args", "command", "path")))}
    ).drop("args", "place", "block", "family")
