"""Log readers on small inline logs."""

import json

import pytest

from tracewright.sources import decoders, jsonl

CLAUDE = [
    {"type": "user", "uuid": "1", "sessionId": "s1", "timestamp": "2026-01-01T12:00:00Z", "message": {"role": "user", "content": "fix it"}},
    {"type": "assistant", "uuid": "2", "sessionId": "s1", "timestamp": "2026-01-01T12:00:01Z", "message": {"id": "m1", "role": "assistant", "model": "x", "content": [{"type": "thinking", "thinking": "hm"}], "usage": {"input_tokens": 5, "output_tokens": 1, "cache_read_input_tokens": 7}}},
    {"type": "assistant", "uuid": "3", "sessionId": "s1", "timestamp": "2026-01-01T12:00:02Z", "message": {"id": "m1", "role": "assistant", "model": "x", "content": [{"type": "tool_use", "id": "t1", "name": "Read", "input": {"file_path": "a.py"}}], "usage": {"input_tokens": 5, "output_tokens": 9, "cache_read_input_tokens": 7}}},
    {"type": "user", "uuid": "4", "sessionId": "s1", "message": {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "t1", "is_error": True, "content": [{"type": "text", "text": "no"}, {"type": "text", "text": "file"}]}]}},
    {"type": "user", "uuid": "5", "sessionId": "s1", "isMeta": True, "message": {"role": "user", "content": "injected"}},
]
CODEX_OUT = [
    {"type": "thread.started", "thread_id": "th"},
    {"type": "item.started", "item": {"id": "i1", "type": "command_execution", "command": "pytest"}},
    {"type": "item.completed", "item": {"id": "i1", "type": "command_execution", "command": "pytest", "aggregated_output": "1 failed", "exit_code": 1, "status": "failed"}},
    {"type": "item.completed", "item": {"id": "i2", "type": "agent_message", "text": "done"}},
    {"type": "turn.completed", "usage": {"input_tokens": 100, "cached_input_tokens": 40, "output_tokens": 10}},
    {"type": "turn.completed", "usage": {"input_tokens": 150, "cached_input_tokens": 60, "output_tokens": 12}},
]
PI = [
    {"type": "session", "id": "p", "cwd": "/w", "timestamp": "2026-01-01T12:00:00Z"},
    {"type": "message", "message": {"role": "user", "content": [{"type": "text", "text": "hello"}], "timestamp": 1767268800000}},
    {"type": "message", "message": {"role": "assistant", "content": [{"type": "text", "text": "hi"}], "usage": {"input": 3, "output": 4, "cacheRead": 5, "cacheWrite": 6}}},
]
ROLLOUT = [
    {"timestamp": "2026-01-01T12:00:00Z", "type": "session_meta", "payload": {"id": "r"}},
    {"timestamp": "2026-01-01T12:00:01Z", "type": "response_item", "payload": {"type": "message", "role": "user", "content": [{"type": "input_text", "text": "go"}]}},
    {"timestamp": "2026-01-01T12:00:02Z", "type": "response_item", "payload": {"type": "function_call", "name": "shell", "call_id": "c", "arguments": '{"command": ["ls", "-l"]}'}},
    {"timestamp": "2026-01-01T12:00:03Z", "type": "response_item", "payload": {"type": "function_call_output", "call_id": "c", "output": "exit code: 2"}},
]


@pytest.fixture(scope="module")
def logs(tmp_path_factory):
    top = tmp_path_factory.mktemp("logs")

    def write(name, rows, extra=""):
        (top / name).parent.mkdir(parents=True, exist_ok=True)
        (top / name).write_text("\n".join(map(json.dumps, rows)) + "\n" + extra)

    write("a/claude.jsonl", CLAUDE, "not json\n[1]\n")
    write("b/stdout.jsonl", CODEX_OUT)
    write("c/pi.jsonl", PI)
    write("d/rollout.jsonl", ROLLOUT)
    write("x.quarantine/bad.jsonl", PI)
    return str(top)


def test_records_and_formats(spark, logs):
    rows = jsonl.records(spark, logs)
    assert rows.filter("bad").count() == 2 and rows.filter("path like '%quarantine%'").count() == 0
    assert {r.path.rsplit("/", 1)[1]: r.format for r in jsonl.formats(rows).collect()} == {
        "claude.jsonl": "claude_native", "stdout.jsonl": "codex_stdout", "pi.jsonl": "pi_native", "rollout.jsonl": "codex_native",
    }


def test_discovery(spark, tmp_path):
    (tmp_path / "one.jsonl").write_text('{"a":1}\n')
    (tmp_path / "two.jsonl").write_text('{"a":1}\n')
    (tmp_path / "three.jsonl").write_text('{"a":1}\n{"b":2}\n')
    (tmp_path / "four.jsonl").write_text('{"c":1}\n')
    got = {r.path.rsplit("/", 1)[1]: (r.role, r.canonical.rsplit("/", 1)[1]) for r in jsonl.distinct_files(jsonl.lines(spark, str(tmp_path))).collect()}
    assert got == {"one.jsonl": ("snapshot", "three.jsonl"), "two.jsonl": ("snapshot", "three.jsonl"), "three.jsonl": ("kept", "three.jsonl"), "four.jsonl": ("kept", "four.jsonl")}


def test_trace_events(spark, logs):
    rows = decoders.trace_events(spark, logs).orderBy("session_id", "idx").collect()
    by = {}
    for r in rows:
        by.setdefault(r.session_id, []).append(r)
    assert [r.kind for r in by["s1"]] == ["user_msg", "thinking", "tool_call", "usage", "tool_result", "meta"]
    assert (by["s1"][2].category, by["s1"][2].path, by["s1"][4].ok, by["s1"][4].text, by["s1"][4].tool) == ("read", "a.py", False, "no file", "Read")
    assert (by["s1"][3].input, by["s1"][3].output, by["s1"][3].cache_read) == (5, 9, 7)
    assert [r.kind for r in by["th"]] == ["tool_call", "tool_result", "assistant_msg", "usage", "usage"]
    assert [(r.input, r.cache_read, r.output) for r in by["th"][3:]] == [(60, 40, 10), (30, 20, 2)] and by["th"][1].ok is False
    assert [r.kind for r in by["p"]] == ["user_msg", "assistant_msg", "usage"] and by["p"][0].text == "hello"
    assert [(r.kind, r.command, r.ok) for r in by["r"]] == [("user_msg", None, None), ("tool_call", "ls -l", None), ("tool_result", None, False)]


def test_analysis_of_logs(spark, logs, tmp_path):
    from tracewright.__main__ import main

    assert main(["analyze", logs, str(tmp_path / "out"), "--since", "2025-01-01", "--fail-on", "high"]) == 0
    sessions = {r.session_id: r for r in spark.read.parquet(str(tmp_path / "out/sessions")).collect()}
    assert (sessions["s1"].calls, sessions["s1"].errors, sessions["s1"].output) == (1, 1, 9)
    found = {(r.detector, r.session_id) for r in spark.read.parquet(str(tmp_path / "out/findings")).collect()}
    assert ("thin_prompt", "s1") in found


def test_model_filter(spark, logs):
    from tracewright.operators import analysis

    events = decoders.trace_events(spark, logs)
    assert {r.session_id for r in analysis.in_range(events, models=("X",)).select("session_id").distinct().collect()} == {"s1"}
