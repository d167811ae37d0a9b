"""What the rules and measurements need to know of each event, worked out once a session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions import text as tx

from . import sequence as s

#: Columns of a trace table that rules read. Those a source has not are null.
COLUMNS = {
    "ts": "timestamp", "kind": "string", "tool": "string", "category": "string", "call_id": "string", "signature": "string", "text": "string", "size": "long",
    "ok": "boolean", "error": "string", "exit_code": "int", "path": "string", "command": "string", "model": "string", "response_id": "string", "input": "long",
    "output": "long", "cache_read": "long", "cache_write": "long", "old_text": "string", "new_text": "string", "lines": "long", "todos": "int", "todos_done": "int",
    "final": "boolean", "raw_type": "string",
}
#: Rows beside what a session did; tools that search, that edit in place and that write whole files.
ASIDE, SEARCHES, EDITS, WRITES = ("meta", "usage"), ("grep", "glob", "find", "rg", "egrep", "ugrep"), ("edit", "multiedit", "notebookedit", "file_change", "apply_patch"), ("write",)
#: Words with which a failure is acknowledged.
ACKNOWLEDGED = (
    r"(?i)\b(?:\w*error\w*|\w*exception\w*|traceback|fail|fails|failed|failing|failure|issue|problem|retry|retrying|fix|fixing|wrong|broke|broken|didn'?t|couldn'?t|can'?t|cannot|"
    r"could\s+not|unable|revert|timed\s+out|timeout|mismatch|not\s+found|failed\s+to|missing|no\s+match(?:es)?|blocked|blocks|denied|unavailable|crash(?:ed)?)\b"
)
#: Output of a reading call that exits with 1 up to which it just found nothing.
QUIET_CHARS = 300


def of_kind(kind: str) -> Column:
    return F.col("kind") == kind


def is_call() -> Column:
    return of_kind("tool_call")


def is_result() -> Column:
    return of_kind("tool_result")


def is_user() -> Column:
    return of_kind("user_msg")


def is_said() -> Column:
    return of_kind("assistant_msg")


def is_read() -> Column:
    return is_call() & (F.col("category") == "read")


def is_write() -> Column:
    return is_call() & (F.col("category") == "write")


def is_exec() -> Column:
    return is_call() & (F.col("category") == "execute")


def named(tool: Column, names: tuple[str, ...]) -> Column:
    return F.coalesce(F.lower(tool).isin(*names), F.lit(False))


def is_search() -> Column:
    return is_call() & named(F.col("tool"), SEARCHES)


def is_edit() -> Column:
    return is_write() & named(F.col("tool"), EDITS)


def is_whole() -> Column:
    return is_write() & named(F.col("tool"), WRITES)


def killed(exit_code: Column, error: Column, text: Column) -> Column:
    """The process was interrupted: exit 130 or 143, cancelled, or ^C at the end."""
    return F.coalesce(exit_code.isin(130, 143), F.lit(False)) | F.coalesce(error == "cancelled", F.lit(False)) | F.coalesce(F.rtrim(text).endswith("^C"), F.lit(False))


def benign(ok: Column, exit_code: Column, error: Column, text: Column, command: Column, category: Column) -> Column:
    """A failed result that says nothing: no match, killed, a command whose exit 1 is an answer, or a quiet probe."""
    quiet = F.coalesce(category == "read", F.lit(False)) & (F.length(F.trim(F.coalesce(text, F.lit("")))) <= QUIET_CHARS)
    one = (exit_code == 1) & ~F.coalesce(error == "file_not_found", F.lit(False)) & (F.coalesce(tx.exit1_is_answer(command), F.lit(False)) | quiet)
    return (ok == F.lit(False)) & (F.coalesce(error == "no_match_probe", F.lit(False)) | killed(exit_code, error, text) | F.coalesce(one, F.lit(False)))


def whole(events: DataFrame) -> DataFrame:
    """The events with all COLUMNS, null where the source has none."""
    return events.withColumns({c: F.lit(None).cast(t) for c, t in COLUMNS.items() if c not in events.columns})


def facts(events: DataFrame) -> DataFrame:
    """The events with, for each:

    logical, pos (position among the logical events so far), scope (W7), writes (write calls so far), intent of a
    command; on calls r_idx, r_ok, r_error, r_exit, r_text, r_size, r_ts of the last result of the id (J1) and paired
    (J2: one call and one later result have the id); on results c_idx, c_command, c_tool, c_category and benign (P7);
    touch (how often the session has read or written the path so far) and read_first (the idx of its first read); of the
    session n_logical, first_write, last_user, last_edit (of code) and last_pass (of a test run); before the event
    test_failed (a failed test run's idx), planned, observed, compacted and compacted_pos; after it the next idx of a
    call, user message, write, answer that ends a turn (W12) and acknowledgement; gap (seconds since the last stamp).

    Sessions are dealt once, by the first window; events that come dealt by session stay in the tasks they are in. Every
    window below sorts within that. Ids and paths that are null do not meet each other.
    """
    rows = whole(events)
    logical = ~F.col("kind").isin(*ASIDE)
    alone = F.concat(F.lit("\u0000"), F.col("idx").cast("string"))
    rows = rows.withColumns({"logical": logical, "intent": F.when(is_exec(), tx.command_intent(F.col("command"))), "id_key": F.coalesce("call_id", alone), "path_key": F.coalesce("path", alone)})
    rows = rows.withColumns(
        {
            "pos": F.sum(s.flag(logical)).over(s.upto()) - 1,
            "scope": F.coalesce(F.max(F.when(is_user(), F.col("idx"))).over(s.upto()), F.lit(-1)),
            "writes": F.sum(s.flag(is_write())).over(s.upto()),
        }
    )
    by_id, by_path = Window.partitionBy("session_id", "id_key"), Window.partitionBy("session_id", "path_key").orderBy("idx")
    result = F.max(F.when(is_result(), F.struct("idx", "ok", "error", "exit_code", "text", "size", "ts"))).over(by_id)
    call = F.max(F.when(is_call(), F.struct("idx", "command", "tool", "category"))).over(by_id)
    rows = rows.withColumns({"r": result, "c": call, "n_calls": F.sum(s.flag(is_call())).over(by_id), "n_results": F.sum(s.flag(is_result())).over(by_id)})
    on_call = {f"r_{n}": F.when(is_call(), F.col(f"r.{c}")) for n, c in (("idx", "idx"), ("ok", "ok"), ("error", "error"), ("exit", "exit_code"), ("text", "text"), ("size", "size"), ("ts", "ts"))}
    on_result = {f"c_{c}": F.when(is_result(), F.col(f"c.{c}")) for c in ("idx", "command", "tool", "category")}
    touches = (is_read() | is_write()) & F.col("path").isNotNull()
    rows = rows.withColumns(
        on_call
        | on_result
        | {
            "paired": is_call() & (F.col("n_calls") == 1) & (F.col("n_results") == 1) & (F.col("r.idx") > F.col("idx")),
            "touch": F.when(touches, F.sum(s.flag(touches)).over(by_path)),
            "read_first": F.when(touches, F.min(F.when(is_read(), F.col("idx"))).over(Window.partitionBy("session_id", "path_key"))),
        }
    ).drop("r", "c", "n_calls", "n_results", "id_key")
    ends = F.coalesce(F.col("raw_type") == "task_complete", F.lit(False))
    answered, plain = F.coalesce(is_said() & F.col("final"), F.lit(False)) | ends, is_said() & F.col("final").isNull()
    session, gone_by = Window.partitionBy("session_id"), lambda c: F.max(F.when(c, F.col("idx")))
    passed = is_exec() & (F.col("intent") == "build_test") & F.coalesce(F.col("r_ok"), F.lit(False))
    first = lambda c: F.min(F.when(c, F.col("idx")))
    stamp = F.when(F.col("kind") != "usage", F.unix_micros(F.col("ts").cast("timestamp")))
    rows = rows.withColumns(
        {
            "n_logical": F.sum(s.flag(logical)).over(session), "first_write": first(is_write()).over(session), "last_user": gone_by(is_user()).over(session),
            "last_edit": gone_by(is_write() & F.col("path").rlike(tx.CODE)).over(session), "last_pass": gone_by(passed).over(session),
            "test_failed": gone_by(is_result() & ~F.col("ok") & (F.col("error") == "build_test_fail")).over(s.upto()),
            "planned": gone_by((F.col("kind").isin("thinking", "plan")) | (is_call() & (F.col("category") == "planning"))).over(s.before()).isNotNull(),
            "observed": gone_by(is_read() | is_exec() | is_search()).over(s.upto()).isNotNull(),
            "compacted": gone_by(F.col("kind") == "compaction").over(s.before()), "compacted_pos": F.max(F.when(F.col("kind") == "compaction", F.col("pos"))).over(s.before()),
            "next_call": first(is_call()).over(s.after()), "next_user": first(is_user()).over(s.after()), "next_write": first(is_write()).over(s.after()), "next_said": first(plain).over(s.after()), "next_end": first(is_user() | ends).over(s.after()), "last_end": gone_by(answered).over(session),
            "next_ack": first(is_said() & F.col("text").rlike(ACKNOWLEDGED)).over(s.after()), "stamp": stamp,
            "gap": (stamp - F.last(stamp, ignorenulls=True).over(s.before())) / 1e6,
        }
    )
    terminal = answered & ~ends | (plain & (F.col("next_said").isNull() | (F.col("next_end") < F.col("next_said"))))
    rows = rows.withColumn("terminal", F.coalesce(terminal, F.lit(False))).withColumn("next_terminal", first(F.col("terminal")).over(s.after()))
    gone = F.coalesce(is_result() & benign(F.col("ok"), F.col("exit_code"), F.col("error"), F.col("text"), F.col("c_command"), F.col("c_category")), F.lit(False))
    r_benign = F.coalesce(is_call() & benign(F.col("r_ok"), F.col("r_exit"), F.col("r_error"), F.col("r_text"), F.col("command"), F.col("category")), F.lit(False))
    return rows.withColumns({"benign": gone, "r_failed": F.coalesce(F.col("r_ok") == F.lit(False), F.lit(False)), "r_benign": r_benign})
