"""Rules and measurements on decoded logs, with small logs written inline."""

import json

import pytest
from pyspark.sql import functions as F

from tracewright import config
from tracewright.operators import analysis, detectors, graph, handovers, tails
from tracewright.operators.facts import facts
from tracewright.sources import decoders, jsonl


def write(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join(json.dumps(r) + "\n" for r in rows))


def at(second):
    return f"2026-01-01T{12 + second // 3600:02d}:{second // 60 % 60:02d}:{second % 60:02d}Z"


def legacy(second, **payload):
    return {"timestamp": at(second), "type": "response_item", "payload": payload}


def item(second, thread="own", **made):
    return {"timestamp": at(second), "type": "event_msg", "payload": {"type": "item_completed", "thread_id": thread, "turn_id": "t", "item": made}}


def failing_rollout(n=25):
    rows = [{"timestamp": at(0), "type": "session_meta", "payload": {"id": "r"}}, legacy(1, type="message", role="user", content=[{"type": "input_text", "text": "please read the file for me now, thank you very much"}])]
    for i in range(n):
        rows.append(legacy(2 + 2 * i, type="function_call", name="shell", call_id=f"c{i}", arguments='{"command": ["cat", "a.py"]}'))
        rows.append(legacy(3 + 2 * i, type="function_call_output", call_id=f"c{i}", output="exit code: 1\ncat: a.py: Permission denied"))
    return rows


@pytest.fixture(scope="module")
def rollout_facts(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("copies")
    for name in ("a/r.jsonl", "b/copy.jsonl"):
        write(top / name, failing_rollout())
    write(top / "c/older.jsonl", failing_rollout(9))
    return facts(analysis.enrich(decoders.trace_events(spark, str(top)))).cache()


def test_copies_and_snapshots_count_once(rollout_facts):
    assert rollout_facts.count() == 51 and rollout_facts.filter("error = 'permission'").count() == 25


def test_one_command_that_fails_again_and_again(rollout_facts):
    found = {(r.kind, r.value) for r in tails.incidents(rollout_facts).filter("kind in ('retry_attempts', 'failure_chain', 'delegation_fanout', 'poll_amplification')").collect()}
    assert found == {("retry_attempts", 25.0), ("failure_chain", 25.0)}
    names = {r.detector: r.value for r in detectors.run(rollout_facts, known=True).collect()}
    assert names["PERMISSION_FRICTION"] == 25 and names["NO_ADAPT_RETRY"] == 25 and names["RETRY_STORM"] == 21
    assert not {"EDIT_THRASH", "TEST_GAMING", "idle_gap", "overlong_trace"} & set(names)


def test_lines_of_a_split_file_stay_in_order(spark, tmp_path):
    rows = [{"type": "user", "uuid": str(i), "sessionId": "s", "message": {"content": f"message {i} " + "x" * 300}} for i in range(400)]
    write(tmp_path / "s.jsonl", rows)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
        spark.conf.set("spark.sql.files.openCostInBytes", "1k")
        read = jsonl.lines(spark, str(tmp_path))
        assert read.rdd.getNumPartitions() > 3
        events = decoders.trace_events(spark, str(tmp_path)).orderBy("idx").collect()
        assert [r.line for r in jsonl.numbered(jsonl.records(spark, str(tmp_path))).orderBy("line").collect()] == list(range(1, 401))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert [r.text.split()[1] for r in events] == [str(i) for i in range(400)]


def test_two_files_of_one_session_do_not_interleave(spark, tmp_path):
    for name, words in (("a", "one two three"), ("b", "four five")):
        write(tmp_path / f"{name}.jsonl", [{"type": "user", "uuid": w, "sessionId": "s", "message": {"content": w}} for w in words.split()])
    assert [r.text for r in decoders.trace_events(spark, str(tmp_path)).orderBy("idx").collect()] == ["one", "two", "three", "four", "five"]


def newest():
    return [
        {"timestamp": at(0), "type": "session_meta", "payload": {"id": "own", "cli_version": "0.153.4", "parent_thread_id": "boss"}},
        {"timestamp": at(1), "type": "turn_context", "payload": {"turn_id": "t", "model": "m-1"}},
        item(2, type="UserMessage", id="u", content=[{"type": "text", "text": "go"}]),
        item(3, type="Reasoning", id="r", summary_text=["hm"]),
        item(4, type="CommandExecution", id="c1", command=["rg", "x"], parsed_cmd=[{"type": "search", "cmd": "rg x", "path": "src"}], exit_code=1, status="failed", aggregated_output=""),
        item(5, type="CommandExecution", id="c2", command=["make"], parsed_cmd=[{"type": "unknown", "cmd": "make"}], exit_code=0, status="completed", aggregated_output="ok"),
        item(6, type="FileChange", id="f", changes={"/w/new.py": {"type": "add", "content": "x\ny\n"}, "/w/old.py": {"type": "update", "unified_diff": "@@\n-a\n+b\n+c\n"}}, status="completed"),
        item(7, type="McpToolCall", id="m", server="app", tool="list", arguments='{"n":1}', result={"content": "[]", "isError": True}),
        item(8, type="CollabAgentToolCall", id="ca", tool="spawn", receiver_thread_ids=["kid"], prompt="review src/a.py"),
        legacy(9, type="message", role="assistant", content=[{"type": "output_text", "text": "told twice"}]),
        {"timestamp": at(10), "type": "compacted", "payload": {"message": "short"}},
        item(11, type="ContextCompaction", id="cc"),
        item(12, type="AgentMessage", id="a", content=[{"type": "Text", "text": "done"}], phase="final_answer"),
        {"timestamp": at(13), "type": "token_usage_record", "payload": {"thread_id": "own", "response_id": "r1", "usage": {"input_tokens": 100, "cached_input_tokens": 40, "cache_write_input_tokens": 7, "output_tokens": 10}}},
        {"timestamp": at(14), "type": "event_msg", "payload": {"type": "token_count", "info": {"total_token_usage": {"input_tokens": 100, "output_tokens": 10}}}},
        {"timestamp": at(15), "type": "token_usage_record", "payload": {"thread_id": "boss", "response_id": "r2", "usage": {"input_tokens": 999, "output_tokens": 9}}},
    ]


def test_newest_rollouts_are_read_item_first(spark, tmp_path):
    write(tmp_path / "rollout.jsonl", newest())
    rows = decoders.trace_events(spark, str(tmp_path)).orderBy("idx").collect()
    kinds = [(r.kind, r.tool, r.category) for r in rows]
    assert kinds == [
        ("user_msg", None, None), ("thinking", None, None), ("tool_call", "grep", "read"), ("tool_result", "grep", None), ("tool_call", "shell", "execute"), ("tool_result", "shell", None),
        ("tool_call", "write", "write"), ("tool_call", "file_change", "write"), ("tool_result", "file_change", None), ("tool_call", "mcp.app.list", "other"), ("tool_result", "mcp.app.list", None),
        ("tool_call", "spawn_agent", "subagent"), ("tool_result", "spawn_agent", None), ("compaction", None, None), ("assistant_msg", None, None), ("usage", None, None),
    ]
    assert {r.session_id for r in rows} == {"own"} and rows[4].command == "make" and rows[2].path == "src" and (rows[3].ok, rows[3].exit_code) == (False, 1)
    assert [(r.path, r.lines, r.old_text, r.new_text) for r in rows[6:8]] == [("/w/new.py", 2, None, "x\ny\n"), ("/w/old.py", 2, "-a", "+b\n+c")]
    assert (rows[10].ok, rows[14].final, rows[14].text) == (False, True, "done")
    assert (rows[15].input, rows[15].cache_read, rows[15].cache_write, rows[15].output, rows[15].response_id, rows[15].model) == (60, 40, 7, 10, "r1", "m-1")
    links = decoders.thread_links(decoders.decode(jsonl.records(spark, str(tmp_path)))).collect()
    assert [tuple(r) for r in links] == [("own", "boss", "spawn")]


def test_replayed_history_of_a_parent_is_dropped(spark, tmp_path):
    own = newest()
    boss = [{"timestamp": at(0), "type": "session_meta", "payload": {"id": "boss"}}, {"timestamp": at(0), "type": "compacted", "payload": {"message": "parent"}}, item(1, "boss", type="UserMessage", id="p", content=[{"type": "text", "text": "parent's"}])]
    write(tmp_path / "a.jsonl", [own[0], *boss, own[2], own[13], own[15]])
    started = own[0] | {"payload": own[0]["payload"] | {"id": "late", "subagent_history_start_ordinal": 3}}
    mine = item(5, "late", type="UserMessage", id="q", content=[{"type": "text", "text": "mine"}])
    write(tmp_path / "b.jsonl", [started | {"ordinal": 0}, own[2] | {"ordinal": 1}, own[5] | {"ordinal": 2}, mine | {"ordinal": 3}])
    got = decoders.trace_events(spark, str(tmp_path)).orderBy("session_id", "idx").collect()
    assert [(r.session_id, r.kind, r.text, r.response_id) for r in got] == [("late", "user_msg", "mine", None), ("own", "user_msg", "go", None), ("own", "usage", None, "r1")]


def trace(spark, rows):
    """Facts of one session; rows are (kind, given columns)."""
    return traces(spark, {1: rows})


def traces(spark, sessions):
    """Facts of sessions, each a list as for trace()."""
    names = sorted({k for rows in sessions.values() for _, given in rows for k in given})
    kinds = {"idx": "long", "ok": "boolean", "exit_code": "int", "size": "long", "input": "long", "output": "long", "cache_read": "long", "cache_write": "long", "ts": "timestamp", "lines": "long", "todos": "int", "todos_done": "int", "final": "boolean"}
    frame = spark.createDataFrame([(s, i, k, *(given.get(n) for n in names)) for s, rows in sessions.items() for i, (k, given) in enumerate(rows)], "session_id long, idx long, kind string" + "".join(f", {n} {kinds.get(n, 'string')}" for n in names))
    return facts(frame)


def call(i, tool, category, **given):
    return ("tool_call", {"call_id": i, "tool": tool, "category": category, "signature": f"{tool} {given}"} | given)


def result(i, ok=True, **given):
    return ("tool_result", {"call_id": i, "ok": ok} | given)


def values(found):
    return sorted((r.kind, r.value) for r in found.collect())


def test_requests_with_many_responses(spark):
    used = lambda **n: ("usage", {"model": "m", "input": 1, "output": 1, "cache_read": 0, "cache_write": 0} | n)
    rows = [used(cache_read=9)] * 6 + [("user_msg", {"text": "go"})] + [used(cache_read=10, cache_write=3)] * 5 + [("user_msg", {"text": "on"})] + [used(cache_read=10)] * 4
    frame = trace(spark, rows)
    assert values(tails.context_replay(frame)) == [("context_replay", 50.0)] and values(tails.cache_creation(frame)) == [("cache_creation", 15.0)]
    assert tails.model_usage(frame).count() == 30


def test_cache_rebuilds_need_a_warm_neighbour(spark):
    used = lambda r, w, m="m": ("usage", {"model": m, "cache_read": r, "cache_write": w})
    rows = [("user_msg", {"text": "go"}), used(5, 0), used(0, 20_000), used(5, 0), ("compaction", {}), used(0, 20_000), used(5, 0), used(0, 20_000, "n"), used(5, 0, "n"), used(0, 9_999, "n"), used(7, 0, "n"), used(0, 10_000, "n")]
    assert values(tails.cache_rebuilds(trace(spark, rows))) == [("cache_rebuilds", 2.0)]


def test_polls_and_waits(spark):
    poll = [call(f"p{i}", "list_agents", "other") for i in range(3)]
    rows = [*poll, call("x", "Bash", "execute", command="ls"), result("x"), *poll[:2], call("w", "wait_agent", "other", ts=None), result("w")]
    frame = trace(spark, rows)
    assert values(tails.poll_amplification(frame)) == [("poll_amplification", 3.0)]
    times = [("tool_call", {"call_id": "w", "tool": "wait_agent", "category": "other", "ts": None})]
    import datetime

    t = lambda s: datetime.datetime(2026, 1, 1, 12, 0, s)
    times = [("tool_call", {"call_id": i, "tool": n, "category": "other", "ts": t(0)}) for i, n in (("w", "wait_agent"), ("b", "Bash"))] + [("tool_result", {"call_id": i, "ok": True, "ts": t(s)}) for i, s in (("w", 30), ("b", 5))]
    assert values(tails.round_trips(trace(spark, times))) == [("parent_wait", 30.0), ("tool_latency", 5.0)]


def test_repeated_outputs_and_checks(spark):
    same = lambda i, ok=True, **g: [call(i, "Read", "read", path="a.py"), result(i, ok, text="same", size=1500, **g)]
    check = lambda i, command, ok=True: [call(i, "Bash", "execute", command=command), result(i, ok, exit_code=0 if ok else 1, text="x")]
    rows = [("user_msg", {"text": "a"}), *same("1"), *same("2"), *same("3", False), ("user_msg", {"text": "b"}), *same("4"), *check("5", "pytest"), *check("6", "pytest"), *check("7", "pytest", False), *check("8", "ruff format"), *check("9", "ruff format"), *check("10", "make deploy"), *check("11", "make deploy")]
    frame = trace(spark, rows)
    assert values(tails.output_repetition(frame)) == [("output_repetition", 1500.0)] and values(tails.verification_repetition(frame)) == [("verification_repetition", 1.0)]


def test_delegations(spark):
    import datetime

    t = lambda m: datetime.datetime(2026, 1, 1, 12, m)
    spawn = lambda i, m, text, tool="spawn_agent": call(i, tool, "subagent", text=text, ts=t(m))
    rows = [
        ("user_msg", {"text": "go", "ts": t(0)}), spawn("a", 1, "review src/a.py"), result("a", text='{"agent_id": "kid-1"}', ts=t(1)), spawn("b", 2, "review src/b.py"), result("b", text="agent_id: kid-2", ts=t(2)),
        call("w", "wait_agent", "subagent", ts=t(3)), result("w", text="agent_id: kid-1 all good", ts=t(5)), spawn("c", 6, "please verify src/a.py"), result("c", text="agent_id: kid-3", ts=t(6)),
        spawn("d", 7, "go", "Task"), result("d", text="answer", ts=t(9)), spawn("e", 9, "no"), result("e", False, text="refused", ts=t(9)), ("user_msg", {"text": "bye", "ts": t(20)}),
    ]
    frame = trace(spark, rows)
    got = {r.idx: (r.status, r.seconds, r.agent) for r in handovers.handovers(frame).collect()}
    assert got == {1: ("completed", 240.0, "kid-1"), 3: ("running", None, "kid-2"), 7: ("running", None, "kid-3"), 9: ("completed", 120.0, None), 11: ("refused", None, None)}
    assert values(tails.delegations(frame)) == [("delegation_lifetime", 120.0), ("delegation_lifetime", 240.0), ("delegation_open", 840.0), ("delegation_open", 1080.0)]
    assert values(tails.delegation_repetition(frame)) == [("delegation_repetition", 1.0)] and values(tails.delegation_fanout(frame)) == [("delegation_fanout", 5.0)]


def found(frame, *names, **knobs):
    return [(r.detector, r.span_start, r.span_end, r.value) for r in detectors.run(frame, knobs, known=True, enabled=set(names)).orderBy("detector", "span_start").collect()]


def test_completion_claims(spark):
    edit = [call("e", "Edit", "write", path="src/abc.py", old_text="x", new_text="y"), result("e")]
    done = ("assistant_msg", {"text": "All set."})
    test = lambda c: [call("t", "Bash", "execute", command=c), result("t", exit_code=0)]
    names = ("LOOKS_RIGHT_RUNS_WRONG", "UNVERIFIED_COMPLETION")
    assert [f[0] for f in found(trace(spark, [*edit, done]), *names)] == list(names)
    assert [f[0] for f in found(trace(spark, [*edit, *test("pytest tests/test_other.py"), done]), *names)] == ["LOOKS_RIGHT_RUNS_WRONG"]
    assert found(trace(spark, [*edit, *test("pytest tests/test_abc.py"), done]), *names) == []
    assert found(trace(spark, [*edit, *test("make check"), ("assistant_msg", {"text": "I am reading"})]), *names) == []


def test_amnesia_needs_a_compaction(spark):
    read = lambda i: call(i, "Read", "read", path=f"{i[0]}.py")
    rows = [read("a1"), read("b1"), ("user_msg", {"text": "x"}), read("a2"), ("compaction", {}), read("a3"), read("a4"), read("c1"), ("user_msg", {"text": "y"}), read("b2")]
    assert found(trace(spark, rows), "COMPACTION_AMNESIA") == [("COMPACTION_AMNESIA", 4, 5, 1.0)]


def test_swallowed_errors(spark):
    bad = [call("a", "Bash", "execute", command="make"), result("a", False, exit_code=2, text="boom")]
    probe = [call("b", "Bash", "execute", command="rg x"), result("b", False, exit_code=1, text="")]
    answer = lambda text: ("assistant_msg", {"text": text})
    assert found(trace(spark, [*bad, answer("Here you are.")]), "SILENT_ERROR_SWALLOW") == [("SILENT_ERROR_SWALLOW", 1, 2, 1.0)]
    assert found(trace(spark, [*bad, answer("It failed.")]), "SILENT_ERROR_SWALLOW") == []
    assert found(trace(spark, [*bad, *probe, answer("Here.")]), "SILENT_ERROR_SWALLOW") == []
    note, final = ("assistant_msg", {"text": "Reading on.", "final": False}), ("assistant_msg", {"text": "Here.", "final": True})
    assert found(trace(spark, [*bad, note, final]), "SILENT_ERROR_SWALLOW") == [("SILENT_ERROR_SWALLOW", 1, 3, 1.0)]
    assert found(trace(spark, [*bad, note, ("meta", {"raw_type": "task_complete"}), final]), "SILENT_ERROR_SWALLOW") == []


def test_runaways_that_end_well(spark):
    rows = [("user_msg", {"text": "go"})] + [call("c", "Read", "read", path="a")] * 6
    assert found(trace(spark, [*rows, result("c")]), "RUNAWAY_SESSION", RUNAWAY_SESSION={"events": 5}) == [("RUNAWAY_SESSION", 0, 7, 8.0)]
    assert found(trace(spark, [*rows, result("c"), ("assistant_msg", {"text": "x", "final": True})]), "RUNAWAY_SESSION", RUNAWAY_SESSION={"events": 5}) == []
    assert found(trace(spark, [*rows, result("c"), ("assistant_msg", {"text": "x"}), ("user_msg", {"text": "Perfect, thanks"})]), "RUNAWAY_SESSION", RUNAWAY_SESSION={"events": 5}) == []


def test_scope_style_and_todos(spark):
    write_ = lambda i: call(i, "Write", "write", path=f"src/{i}.py", new_text="import zed\n", lines=1)
    rows = [("user_msg", {"text": "fix the bug in src/x.py"}), write_("a"), result("a", text="import os"), write_("b"), write_("c"), call("t", "TodoWrite", "planning", todos=1, todos_done=0), call("u", "TodoWrite", "planning", todos=4, todos_done=0)]
    got = found(trace(spark, rows), "OVER_ENGINEERING", "GOAL_DRIFT", "STYLE_IMPOSITION", "runaway_todo")
    assert got == [("GOAL_DRIFT", 0, 0, 0.0), ("OVER_ENGINEERING", 0, 0, 3.0), ("STYLE_IMPOSITION", 1, 1, 1.0), ("runaway_todo", 5, 6, 4.0)]


def test_long_chains_are_no_cycles(spark):
    edges = spark.createDataFrame([(f"n{i:03d}", f"n{i - 1:03d}", "spawn") for i in range(1, 201)] + [("x", "y", "fork"), ("y", "x", "fork"), ("a", "x", "spawn")], "child string, parent string, kind string")
    got = {r.node: (r.root, r.depth) for r in graph.walk(edges).collect()}
    assert {k: v for k, v in got.items() if k.startswith("n")} == {f"n{i:03d}": ("n000", i) for i in range(201)}
    assert got["x"] == got["y"] == got["a"] == ("x", None)


def test_settings(tmp_path):
    (tmp_path / "s.toml").write_text('idle_minutes = 7.5\n[detectors]\ndisabled = ["idle_gap"]\n[detectors.knobs.retry_storm]\nleast = 9\n[lexicons]\npositive = ["yay"]\n')
    got = config.load(str(tmp_path / "s.toml"))
    assert got["idle_minutes"] == 7.5 and got["lexicons"]["positive"] == ["yay"] and got["lexicons"]["completion"][0] == "done"
    assert config.knobs_of(got) == {"RETRY_STORM": {"least": 9}} and config.DEFAULTS["idle_minutes"] == 5.0
    for bad in ("nothing = 1", "lexicons = 3"):
        with pytest.raises(ValueError):
            config.load(text=bad)


def test_large_groups_are_ranked_whole(spark):
    from tracewright.operators.ranks import ranked_values

    rows = spark.range(1000).select(F.lit("k").alias("kind"), (F.col("id") % 2).cast("string").alias("cohort"), (F.col("id") % 97).cast("double").alias("value"))
    want = {}
    for i in range(1000):
        want.setdefault(str(i % 2), []).append(float(i % 97))
    for r in ranked_values(rows, ["kind", "cohort"], "value").collect():
        assert (r.above, r.n, r["size"]) == (sum(v > r.value for v in want[r.cohort]), want[r.cohort].count(r.value), 500)
