"""The run report on small tables."""

import json

from tracewright.operators import briefs


def test_a_report_of_few_findings(spark):
    sessions = spark.createDataFrame([("a",), ("b",), ("c",)], "session_id string")
    found = [("TAIL_MODEL_INPUT", "low", "a"), ("TAIL_MODEL_INPUT", "low", "b"), ("PANIC_REVERT", "high", "a"), ("thin_prompt", "info", "a"), ("thin_prompt", "info", "a"), ("idle_gap", "info", "c")]
    findings = spark.createDataFrame(found, "detector string, severity string, session_id string")
    themes = spark.createDataFrame([("model_input", 9, 2, 40.0), ("retry_attempts", 1, 1, 60.0)], "kind string, n long, sessions long, score double")
    priorities = spark.createDataFrame([("TAIL_MODEL_INPUT", "low", 2, 2, "measure", 1)], "detector string, severity string, incidents long, sessions long, route string, place long")
    table = briefs.lines(sessions, findings, themes, priorities)
    got = {(r.section, r.place): (r.name, r.label, r.n, r.sessions) for r in table.collect()}
    assert [got["overview", k][0] for k in range(1, 5)] == ["sessions", "findings", "signals", "severity"]
    assert [got["overview", k][2] for k in range(1, 4)] == [3, 6, 4] and got["overview", 4][1] == "high"
    assert [got["finding", k] for k in range(1, 5)] == [("PANIC_REVERT", "high", 1, 1), ("TAIL_MODEL_INPUT", "low", 2, 2), ("thin_prompt", "info", 2, 1), ("idle_gap", "info", 1, 1)]
    assert got["theme", 1][:2] == ("retry_attempts", None) and got["theme", 2][:2] == ("model_input", "TAIL_MODEL_INPUT")
    report = json.loads(briefs.as_object(table).first().report)
    assert set(report) == set(briefs.SECTIONS) and [x["name"] for x in report["priority"]] == ["TAIL_MODEL_INPUT"]
    empty = briefs.lines(sessions.limit(0), findings.limit(0), themes.limit(0), priorities.limit(0)).collect()
    assert {r.name: (r.label, r.n) for r in empty} == {"sessions": (None, 0), "findings": (None, 0), "signals": (None, 0), "severity": (None, None)}
