"""The registered queries against their SQL, and operators on small inline tables."""

import datetime
import glob
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from tracewright import catalog
from tracewright.functions import text as tx
from tracewright.operators import detectors, errors, graph, joins, labels, memory, metrics, rankings
from tracewright.operators import sequence as s
from tracewright.sources import sinks


def rows_of(values):
    def canon(v):
        if isinstance(v, float):
            return round(v, 6)
        if isinstance(v, datetime.datetime):
            return v.isoformat()
        return v if not isinstance(v, (list, tuple)) else [canon(x) for x in v]

    return sorted(str([canon(v) for v in row]) for row in values)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, sf_dir, name):
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    frame = catalog.queries()[name](spark, sf_dir)
    result = con.execute(catalog.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(frame.columns)
    assert rows_of(frame.select(*columns).collect()) == rows_of(result.fetchall())


def events(spark, rows):
    return spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], "session_id long, idx long, kind string, ok boolean, call_id string")


def test_failure_chain_ignores_polls(spark):
    rows = [("tool_result", False, "a"), ("tool_result", False, "poll"), ("tool_result", True, "poll"), ("tool_result", False, "b"), ("tool_result", False, "c"), ("user_msg", None, None), ("tool_result", False, "d")]
    found = s.failure_chains(events(spark, rows), 3, F.coalesce(F.col("call_id") == "poll", F.lit(False))).collect()
    assert [(r.failures, r.first_idx, r.last_idx) for r in found] == [(3, 0, 4)]


def test_pairing_of_duplicate_ids(spark):
    rows = [("tool_call", None, "a"), ("tool_call", None, "b"), ("tool_result", True, "a"), ("tool_result", False, "a"), ("tool_result", True, "b"), ("tool_call", None, "c")]
    frame = events(spark, rows).withColumn("tool", F.lit("t")).withColumn("ts", F.lit("2026-01-01").cast("timestamp"))
    assert sorted((r.call_id, r.result_idx) for r in joins.pair_last(frame).collect() if r.result_idx) == [("a", 3), ("b", 4)]
    assert [(r.call_id, r.idx, r.result_idx) for r in joins.pair_unique(frame).collect()] == [("b", 1, 4)]


def test_price_lookup(spark):
    prices = spark.createDataFrame([("gpt", 1.0), ("gpt-5", 2.0), ("default", 9.0)], "prefix string, price double")
    keys = spark.createDataFrame([("gpt-5",), ("gpt-5-mini",), ("gpt-4",), ("other",), (None,)], "model string")
    got = {r.key: (r.price, r.status) for r in joins.longest_prefix(keys, "model", prices).collect()}
    assert got == {"gpt-5": (2.0, "exact"), "gpt-5-mini": (2.0, "estimated"), "gpt-4": (1.0, "estimated"), "other": (9.0, "estimated")}


def test_anonymous_rows_are_not_deduplicated(spark):
    frame = spark.createDataFrame([(1, "a", 1), (1, "a", 2), (1, None, 3), (1, None, 4)], "thread long, response string, seq long")
    assert sorted(r.seq for r in joins.first_of(frame, ["thread", "response"], ["seq"]).collect()) == [1, 3, 4]


def test_decumulation_with_a_reset(spark):
    frame = spark.createDataFrame([(1, i, v) for i, v in enumerate((10, 25, 5, 9))], "session_id long, idx long, total long")
    assert [r.delta for r in s.decumulate(frame, "session_id", "idx", "total").orderBy("idx").collect()] == [10, 15, 5, 4]


def test_trees_with_cycles(spark):
    edges = spark.createDataFrame([("b", "a", "spawn"), ("c", "b", "fork"), ("x", "y", "spawn"), ("y", "x", "created"), ("z", "y", "spawn")], "child string, parent string, kind string")
    got = {r.node: (r.root, r.depth) for r in graph.walk(graph.ranked_edges(edges)).collect()}
    assert got["c"] == ("a", 2) and got["a"] == ("a", 0) and got["x"] == got["y"] and got["x"][1] is None
    kept = {r.child for r in graph.without_cycles(graph.ranked_edges(edges)).collect()}
    assert kept == {"b", "c", "x", "z"}


def test_families(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (10, 11), (3, 9)], "a long, b long")
    assert {r.node: r.label for r in graph.families(links).collect()} == {1: 1, 2: 1, 3: 1, 9: 1, 10: 10, 11: 10}


def test_commands(spark):
    want = {
        "cd src && pytest -q": "build_test", "git commit -m 'a; b'": "mutate", "cat a | grep b": "inspect", "sed -i s/a/b/ f": "mutate", "FOO=1 sudo ls": "inspect",
        "echo hi > f": "other", "bash -lc 'cd x && uv run pytest'": "build_test", "npm run dev": "other", "git push": "other", "sleep 1": "other", "echo 'a && pytest'": "other", "python -m pytest": "build_test",
    }
    frame = spark.createDataFrame([(k,) for k in want], "c string")
    assert {r.c: r.i for r in frame.select("c", tx.command_intent(F.col("c")).alias("i")).collect()} == want
    edits = {"echo hi > src/f.py": True, "echo hi > /tmp/f": False, "cat a > out.log": False, "ls 2>&1": False, "x | tee -a b.md": True, "sed -i.bak s/a/b/ f": True, "python - <<'E'\nx > y.py\nE": False}
    frame = spark.createDataFrame([(k,) for k in edits], "c string")
    assert {r.c: r.i for r in frame.select("c", tx.edits_file(F.col("c")).alias("i")).collect()} == edits
    checks = {"make check": True, "make deploy": False, "ruff format": False, "ruff format --check": True, "uv run pytest": True, "ruff check --fix": False, "ls": False}
    frame = spark.createDataFrame([(k,) for k in checks], "c string")
    assert {r.c: r.i for r in frame.select("c", tx.check_command(F.col("c")).alias("i")).collect()} == checks


def test_text_functions(spark):
    frame = spark.createDataFrame([("mail a.b@c.org, see https://x.io/a?b and src/m.py or `f()`",), (None,), ("",)], "t string")
    got = frame.select(tx.redact(F.col("t")).alias("r"), tx.deliverables(F.col("t")).alias("d"), tx.word_count(F.col("t")).alias("n")).collect()
    assert got[0].r == "mail <email>, see <url> and src/m.py or `f()`" and got[0].d[0] == "https://x.io/a?b" and "`f()`" in got[0].d
    assert got[1].r is None and got[2].n == 0
    times = spark.createDataFrame([("2026-01-01T12:00:00Z",), ("1767268800",), ("1767268800000",), ("soon",)], "v string")
    assert [r[0] for r in times.select(tx.parse_time(F.col("v"))).collect()] == [datetime.datetime(2026, 1, 1, 12)] * 3 + [None]
    args = spark.createDataFrame([({"b": "x  y", "a": "1"},)], "m map<string,string>")
    assert args.select(tx.norm_args(F.col("m"))).first()[0] == "a=1; b=x y"


def test_tri_state_signals(spark):
    frame = spark.createDataFrame([("timeout", False), ("fine", False), ("fine", True), (None, False)], "t string, cut boolean")
    got = [r[0] for r in frame.select(errors.tri_state(F.col("t"), "timeout", F.col("cut"))).collect()]
    assert got == [True, False, None, None]
    assert frame.select(errors.impediment(F.col("t"), {"time": "time", "out": "out"})).first()[0] is None


def test_labels(spark):
    store = spark.createDataFrame([("r", "train", 1, 1), ("r", "test", 2, 2), ("q", "test", 3, 3)], "root string, split string, at long, label_id long")
    assert [r.root for r in labels.pinned_conflicts(store).collect()] == ["r"]
    assert {r.split for r in labels.pin(store).filter("root = 'r'").collect()} == {"train"}


def test_label_store(spark, tmp_path):
    first = spark.createDataFrame([("r", "train")], "root string, split string")
    first.write.json(str(tmp_path / "s"))
    sinks.append_labels(spark.createDataFrame([("q", "test")], first.schema), str(tmp_path / "s"))
    with pytest.raises(ValueError):
        sinks.append_labels(spark.createDataFrame([("r", "test")], first.schema), str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "s")).count() == 2


def test_batches_stay_under_their_limit(spark):
    frame = spark.createDataFrame([(i, 1 + i % 7) for i in range(200)] + [(999, 50)], "id long, bytes long")
    packed = memory.batches(frame, "id", "bytes", 20, 50).toPandas()
    assert packed.lane.nunique() > 2
    sums = packed.groupby(["lane", "batch"]).bytes.agg(["sum", "count"])
    assert ((sums["sum"] <= 20) | (sums["count"] == 1)).all() and len(packed) == 201


def test_cover(spark):
    frame = spark.createDataFrame([(1, 1, 9.0, [1, 2]), (1, 2, 5.0, [2]), (1, 3, 4.0, [3])], "session_id long, id long, score double, touches array<long>")
    assert [r.id for r in rankings.cover(frame, 5).orderBy("place").collect()] == [1, 3]


def test_detector_choice(spark, sf_dir):
    from tracewright.sources.driver_tables import trace_events

    rows = trace_events(spark, sf_dir)
    assert {d.id for d in detectors.applicable(rows, enabled={"idle_gap", "thin_prompt"})} == {"idle_gap"}
    found = detectors.run(rows, {"idle_gap": {"minutes": 1}}, {"idle_gap": "high"}, enabled={"idle_gap"})
    assert {r.severity for r in found.collect()} == {"high"} and sinks.fails(found, "medium")


def test_empty_group_percentiles(spark):
    frame = spark.createDataFrame([(None, 1.0), ("a", None), ("a", 3.0)], "g string, v double")
    got = {(r.scope, r.grp): (r.n, r.p50) for r in metrics.group_stats(frame, ["g"], "v").collect()}
    assert got == {("all", "all"): (3, 2.0), ("g", "a"): (2, 3.0)}


def test_streamed_failure_chains(spark, tmp_path):
    from tracewright.streaming import twins

    bad, good = ("tool_result", False, "a"), ("tool_result", True, "a")
    rows = [bad] * 4 + [("user_msg", None, None), bad, good, bad, bad, ("tool_call", None, "b"), bad, good, bad, bad]
    events(spark, rows).coalesce(1).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("session_id long, idx long, kind string, ok boolean, call_id string").json(str(tmp_path / "in"))
    query = twins.failure_chains(stream).writeStream.format("memory").queryName("chains").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(90)
    assert sorted(tuple(r) for r in spark.table("chains").collect()) == [(1, 0, 4), (1, 7, 3)]


def test_entry_without_training_data():
    """The rest imports and answers where the llm folders and the pipeline are gone."""
    code = (
        "import importlib.util as u, importlib; old = u.find_spec\n"
        "u.find_spec = lambda n, *a: None if n in ('tracewright.llm', 'corpus_pipeline') else old(n, *a)\n"
        "import __spark_entry__ as e; assert e.queries() and not any(k.startswith('op1_') for k in e.queries()); assert e.oracle_sql()"
    )
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    assert subprocess.run([sys.executable, "-c", code], cwd=root, timeout=120).returncode == 0
