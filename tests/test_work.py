"""Failures, waits, runs of a benchmark and settings on small tables."""

import json

import pytest
from pyspark.sql import functions as F

from tracewright.functions import text as tx
from tracewright.operators import errors, failures, labels, waits, work
from tracewright.sources import decoders, runs

from .test_logs import call, result, trace, traces, write


def leaf_of(spark, text, answers=(), **given):
    command = given.pop("command", None)
    rows = trace(spark, [call("a", "Bash", "execute", command=command) if command else call("a", "Edit", "write"), result("a", False, text=text, size=len(text), exit_code=given.get("exit_code", 1), error="other")])
    features = spark.createDataFrame([(1, 1, n, float(v), None) for n, v in answers], "session_id long, idx long, feature string, value double, reason string")
    return failures.leaves(failures.records(rows), failures.answers(features)).first()


def test_failure_leaves(spark):
    check, named, probe = ("intent.project_check", 0.9), ("intent.user_named_identifier", 0.9), ("intent.presence_probe", 0.9)
    got = [
        leaf_of(spark, "refresh needs an interactive tty", command="gcloud x"), leaf_of(spark, "refresh: interactive; missing permission 'a.b'", command="x"),
        leaf_of(spark, "unknown flag --x", command="x"), leaf_of(spark, "AssertionError: 1", [check], command="pytest"), leaf_of(spark, "AssertionError: 1", [("intent.project_check", 0.5)], command="pytest"),
        leaf_of(spark, "no such file", [named, ("intent.identifier_matches", 0.1)], command="cat a"), leaf_of(spark, "", [probe, ("intent.absence_acceptable", 0.7)], command="grep x y"),
        leaf_of(spark, "old_string was not found in src/a.py"), leaf_of(spark, "validation error for argument path"), leaf_of(spark, "deadline exceeded", command="curl x"),
    ]
    assert [r.leaf for r in got] == [
        "credential_refresh_blocked", "unresolved", "cli_invocation_rejected", "test_assertion_failure", "unresolved", "wrong_requested_identifier", "expected_no_match", "edit_match_missing",
        "tool_contract_rejected", "external_dependency_or_transport",
    ]
    assert [r.owner for r in got[:4]] == ["environment", "unknown", "agent", "product"] and got[6].disposition == "expected"


def test_signals_that_need_more_than_a_word(spark):
    told = [
        # text, exit status, command, size, what holds
        ("storage.objects.get access denied", 1, "gcloud x", None, {"iam_permission_named": True, "no_match": False}), ("No such file or directory: 'jq'", 1, "jq x", None, {"executable_missing": True}),
        ("v1.2.permission", 1, "x", None, {"iam_permission_named": False}), ("see a.b for more", 1, "x", None, {"iam_permission_named": False}),
        ("", 143, "make", None, {"timeout": True}), ("", 1, "make", None, {"timeout": False, "no_match": False}), ("x", 1, "make", 99, {"timeout": None, "no_match": None}),
        ("", 1, "grep a b", None, {"no_match": True}), ("Script completed", 1, "grep a b", None, {"no_match": True}), ("boom", 1, "grep a b", None, {"no_match": False}), ("", 2, "grep a b", None, {"no_match": False}),
        ("boom", 1, "cat a | sort", None, {"no_match": None}), ("", 1, "grep a b", 5, {"no_match": None}),
        ("2 test failures", 1, "cd a && make lint; ls", None, {"failing_segment": "make lint"}), ("2 test failures", 1, "make lint; make test", None, {"failing_segment": None}),
    ]
    rows = {k: [call("a", "Bash", "execute", command=c), result("a", False, text=t, size=size or len(t), exit_code=e, error="other")] for k, (t, e, c, size, _) in enumerate(told)}
    got = {r.session_id: r for r in failures.records(traces(spark, rows)).collect()}
    for k, (*_, want) in enumerate(told):
        assert {n: got[k][n] for n in want} == want, told[k]
    assert leaf_of(spark, "the build broke", [("intent.project_check", 0.9)], command="ls; make build").leaf == "compound_check_attributed"


def test_how_a_session_ended(spark):
    words, praise = ("wrong", "undo"), ("thanks",)
    run = lambda i, command, ok: [call(i, "Bash", "execute", command=command), result(i, ok)]
    edit, said = [call("e", "Edit", "write", path="a.py"), result("e")], lambda t: [("user_msg", {"text": t})]
    cases = {
        "corrected": [*run("1", "pytest", True), *said("thanks, but wrong")], "test_failed": [*said("thanks"), *run("1", "pytest", True), *run("2", "npx jest a", False)],
        "reverted": [*edit, *run("1", "git checkout a.py", True), *said("thanks")], "approved": [*run("1", "git restore a", True), *edit, *said("thanks")],
        "test_passed": [*run("1", "pytest", False), *run("2", "pytest", True)], "committed": [*run("1", "git commit -m x", True)], "no_signal": [*run("1", "git commit -m x", False), *run("2", "ls", True)],
    }
    got = {r.session_id: (r.reason, r.label) for r in errors.outcomes(traces(spark, dict(enumerate(cases.values()))), words, praise).collect()}
    label = lambda reason: {"no_signal": "unknown"}.get(reason, "negative" if reason in ("corrected", "test_failed", "reverted") else "positive")
    assert got == {k: (reason, label(reason)) for k, reason in enumerate(cases)}


def test_waits_between_responses(spark):
    used = lambda i, **n: ("usage", {"response_id": i, "model": "m", "input": 1, "output": 1} | n)
    wait = lambda i: [call(i, "wait_agent", "subagent", response_id=i), result(i)]
    rows = [*wait("a"), used("a", cache_read=50, cache_write=0), used("b", cache_read=0, cache_write=20_000), *wait("c"), used("c", cache_read=9, cache_write=1), ("user_msg", {"text": "x"}), used("d", cache_read=0, cache_write=20_000)]
    got = {r.idx: (r.prior.response_id, r.next.response_id, r.comparable, r.rewrite) for r in waits.cache_waits(trace(spark, rows)).collect()}
    assert got == {0: ("a", "b", True, True), 4: ("c", "d", False, False)}


def test_stuck_and_thrashing(spark):
    bad = lambda i: [call(i, "Bash", "execute", command="pytest"), result(i, False, error="build_test_fail", exit_code=1)]
    edit = lambda i: [call(i, "Edit", "write", path="a.py"), result(i)]
    rows = [*bad("1"), *edit("2"), *bad("3"), *edit("4"), *bad("5"), *bad("6"), *bad("7")]
    frame = trace(spark, rows)
    assert [(r.first_idx, r.last_idx, r.calls) for r in work.stuck(frame, 3).collect()] == [(8, 12, 3)]
    assert [(r.path, r.edits) for r in work.thrashing(frame, 2).collect()] == [("a.py", 2)]


def test_runs_and_their_missing_usage(spark, tmp_path):
    def run(name, tokens, used):
        write(tmp_path / name / "stdout.jsonl", [{"type": "thread.started", "thread_id": name}, {"type": "item.completed", "item": {"id": "i", "type": "agent_message", "text": "hi"}}, *([{"type": "turn.completed", "usage": {"input_tokens": 5, "output_tokens": 1}}] if used else [])])
        (tmp_path / name / "run.json").write_text(json.dumps({"run_id": name, "instance_id": "x", "experiment": "e", "harness": "codex", "model": "m", "session_id": name}))
        if tokens:
            (tmp_path / name / "metrics.json").write_text(json.dumps({"tokens": {"input": 100, "output": 7, "cache_read": 3, "cache_write": 0}, "cost": {"total": 0.5}}))
            (tmp_path / name / "verification.json").write_text(json.dumps({"instance_id": "x", "resolved": True}))

    run("full", True, True)
    run("empty", True, False)
    run("bare", False, False)
    found = runs.runs(spark, str(tmp_path))
    assert {r.run_id: (r.resolved, r.m_cost) for r in found.collect()} == {"full": (True, 0.5), "empty": (True, 0.5), "bare": (None, None)}
    rows = runs.backfill(decoders.trace_events(spark, str(tmp_path)), found)
    usage = {r.session_id: (r.input, r.output, r.idx, r.reliable) for r in rows.filter("kind = 'usage'").collect()}
    assert usage == {"full": (5, 1, 1, True), "empty": (100, 7, 1, False)} and rows.filter("session_id = 'bare'").count() == 1


def test_question_bank(spark):
    text = '[[question]]\nid = "a"\ntext = "A?"\nrequires = ["tools"]\n[[question]]\nid = "b"\nkind = "choice"\ntext = "B?"\noptions = ["x", "y"]\npositive = 0.8\n'
    bank = runs.bank(spark, text)
    assert [(r.feature_id, r.kind, r.high) for r in bank.collect()] == [("a", "noul", 0.7), ("b", "choice", 0.8)]
    able = spark.createDataFrame([("s", {"tools": 1}), ("t", {"tools": 0})], "session_id string, capabilities map<string,int>")
    assert sorted(map(tuple, runs.askable(bank, able).collect())) == [("s", "a"), ("s", "b"), ("t", "b")]
    objects = spark.createDataFrame([("o",)], "object_id string")
    done = spark.createDataFrame([("o", "a")], "object_id string, feature_id string")
    assert [tuple(r) for r in labels.drafts(objects, bank, done).collect()] == [("o", "b")]
    for bad in ('[[question]]\nid = "a"\ntext = "A"\n[[question]]\nid = "a"\ntext = "B"\n', '[[question]]\nid = "a"\ntext = "A"\nkind = "choice"\n', '[[question]]\nid = "a"\ntext = "A"\nnegative = 0.9\n'):
        with pytest.raises(ValueError):
            runs.bank(spark, bad)


def test_texts_of_commands_and_outputs(spark):
    reads = {"cat a.txt b.txt | head -n 5": "a.txt,b.txt", "sed -n '1,20p' src/x.py": "src/x.py", "rg -n foo src tests": "src,tests", "cd w && ls": "", "grep 'a b' f > out": "f", "python x.py": "", "head -20 y": "y"}
    frame = spark.createDataFrame([(k,) for k in reads], "c string")
    assert {r.c: r.p for r in frame.select("c", F.array_join(tx.read_paths(F.col("c")), ",").alias("p")).collect()} == reads
    texts = spark.createDataFrame([("é" * 60, "a\nfailed x\nb"), ("abc", "1\n2\n3\n4"), (None, None)], "t string, o string")
    got = texts.select(tx.clip_bytes(F.col("t"), 20), tx.diagnostic(F.col("o"))).collect()
    assert [tuple(r) for r in got] == [("é" * 8 + "…", "failed x"), ("abc", "2\n3\n4"), (None, None)]
    asked = spark.createDataFrame([("<user_query> do it </user_query>",), ("<environment_context>x</environment_context>",), (" plain ",)], "t string")
    assert [r[0] for r in asked.select(tx.normalize_request(F.col("t"))).collect()] == ["do it", "", "plain"]
    assert asked.select(tx.tag(F.col("t"), "user_query")).first()[0] == "do it"


def test_costs_that_records_state(spark):
    rows = spark.createDataFrame([('{"total_cost_usd": 1.5, "cost": 9}',), ('{"cost": {"total": 2}}',), ('{"cost": true}',), ("{}",)], "r string").select(F.parse_json("r").alias("r"))
    assert [r[0] for r in rows.select(work.cost_of(F.col("r"))).collect()] == [1.5, 2.0, None, None]


def test_label_store_commands(spark, tmp_path, capsys):
    from tracewright.__main__ import main

    rows = [("r", "dev", "o", "f", a, v) for a, v in (("ann", 1.0), ("bob", 0.9))] + [("r", "dev", "p", "f", a, v) for a, v in (("ann", 1.0), ("bob", 0.0))]
    store = spark.createDataFrame(rows, "root string, split string, object_id string, feature_id string, annotator string, value double")
    store.coalesce(1).write.json(str(tmp_path / "s"))
    got = labels.eval_store(store).collect()
    assert [tuple(r) for r in got] == [("f", "dev", 4, 0.75, 2, 0.5)]
    write(tmp_path / "new.json", [{"root": "q", "split": "held_out", "object_id": "o", "feature_id": "g", "annotator": "ann", "value": 1.0}])
    assert main(["label", str(tmp_path / "s"), str(tmp_path / "new.json")]) == 0 and main(["eval", str(tmp_path / "s")]) == 0 and main(["version"]) == 0
    assert "held_out" in capsys.readouterr().out
    whole = spark.read.schema(store.schema).json(str(tmp_path / "s"))
    assert labels.burned(whole, store.limit(0)).count() == 1
