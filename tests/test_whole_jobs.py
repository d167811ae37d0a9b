"""Operators that must take all of their input, on small tables with brute-force answers."""

import json

import duckdb
from pyspark.sql import functions as F

from tracewright.functions import text as tx
from tracewright.operators import analysis, detectors, memory, structure
from tracewright.plans import evidence, structures
from tracewright.sources import decoders
from tracewright.sources.driver_tables import sql, trace_events


def test_components_take_every_link(spark, sf_dir):
    rows = trace_events(spark, sf_dir).filter("kind = 'tool_call' and path is not null").select("session_id", "path").distinct().collect()
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for r in rows:
        a, b = sorted((root(f"s{r.session_id}"), root(r.path)))
        up[b] = a
    assert len({f"s{r.session_id}" for r in rows}) > 12
    assert {r.node: r.label for r in evidence.components(spark, sf_dir).collect()} == {x: root(x) for x in list(up)}


def test_duplicate_work_is_a_repeated_read(spark):
    rows = [("read", "a"), ("read", "b"), ("read", "a"), ("write", "a"), ("read", None), ("read", None), ("read", "a"), ("read", "c")]
    frame = spark.createDataFrame([(1, i, c, p) for i, (c, p) in enumerate(rows)] + [(2, 0, "read", "a")], "session_id long, idx long, category string, path string")
    assert sorted((r.session_id, r.idx) for r in structure.repeated_reads(frame).collect()) == [(1, 2), (1, 6)]


def test_waste_counts_repeated_reads(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{sf_dir}/events.parquet'")
    want = con.execute(
        sql(
            """AND_WITH scoped AS (SELECT *, coalesce(max(CASE WHEN kind = 'user_msg' THEN idx END) OVER (PARTITION BY session_id ORDER BY idx), -1) AS unit,
            row_number() OVER (PARTITION BY session_id, category, path ORDER BY idx) AS nth FROM ev),
            per AS (SELECT session_id, unit, bool_or(coalesce(error IN ('rate_limit', 'sandbox_egress'), false)) AS blocked,
                CAST(sum(size) FILTER (category = 'read' AND nth > 1) AS BIGINT) AS amount FROM scoped GROUP BY session_id, unit)
            SELECT session_id, unit, amount FROM per WHERE amount IS NOT NULL AND NOT blocked""",
            "ev",
        )
    ).fetchall()
    assert sorted(map(tuple, structures.vetoed_diagnoses(spark, sf_dir).select("session_id", "unit", "amount").collect())) == sorted(want)
    got = structures.waste_partition(spark, sf_dir).filter(F.col("claim") == "DUPLICATE_WORK").first()
    assert (got.units, got.amount) == (len(want), sum(r[2] for r in want))


def test_evidence_keeps_messages_whole(spark):
    message, result = "m" * 9000 + " a@b.org", "h" * 1000 + "x" * 5000 + "t" * 1000
    rows = [("user_msg", message), ("assistant_msg", message), ("tool_result", result), ("tool_result", "y" * 2000), ("tool_call", result), ("tool_result", None)]
    frame = spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], "session_id long, idx long, kind string, text string")
    got = {r.idx: r.text for r in memory.evidence(frame, tx.redact).collect()}
    whole = "m" * 9000 + " <email>"
    assert got == {0: whole, 1: whole, 2: "h" * 1000 + "\n[... tool result truncated ...]\n" + "t" * 1000, 3: "y" * 2000, 4: result, 5: None}


def test_rules_on_decoded_logs(spark, tmp_path):
    """An assert that goes after a failed test run, a gap of ten minutes and a shell poll that is no poll by name."""
    use = lambda i, at, name, **given: ("assistant", at, {"type": "tool_use", "id": i, "name": name, "input": given})
    says = lambda i, at, bad: ("user", at, {"type": "tool_result", "tool_use_id": i, "content": "Exit code 1\n1 failed, AssertionError" if bad else "ok", "is_error": bad})
    blocks = [use("a", "00:00", "Bash", command="pytest"), says("a", "00:01", True)]
    edits = [("tests/test_a.py", "assert x\nassert y", "assert x"), ("src/m0.py", "assert x", ""), ("tests/test_a.py", "x", "y"), ("b.spec.ts", "it()", "it.skip()")]
    blocks += [use(f"e{i}", "00:02", "Edit", file_path=p, old_string=o, new_string=n) for i, (p, o, n) in enumerate(edits)]
    blocks += [use(f"s{i}", "00:13", "Bash", command="sleep 5") for i in range(4)] + [use(f"t{i}", "00:13", "spawn_agent", command="go") for i in range(4)]
    lines = [{"type": t, "sessionId": "s", "timestamp": f"2026-01-01T{at}:00Z", "message": {"role": t, "content": [b]}} for t, at, b in blocks]
    (tmp_path / "projects").mkdir()
    (tmp_path / "projects" / "s.jsonl").write_text("".join(json.dumps(x) + "\n" for x in lines))
    rich = analysis.enrich(decoders.trace_events(spark, str(tmp_path))).cache()
    paths = {r.idx: r.path for r in rich.filter("category = 'write'").collect()}
    assert rich.filter("error = 'build_test_fail'").count() == 1
    found = detectors.run(rich, enabled={"TEST_GAMING", "idle_gap", "RETRY_STORM", "overlong_trace"}).collect()
    assert sorted(paths[r.span_end] for r in found if r.detector == "TEST_GAMING") == ["b.spec.ts", "tests/test_a.py"]
    assert [(r.detector, r.value) for r in found if r.detector != "TEST_GAMING"] == [("idle_gap", 11.0)]
    assert detectors.REGISTRY["overlong_trace"].knobs["minutes"] == 90 and detectors.REGISTRY["bloated_opener"].knobs["tokens"] == 2000
