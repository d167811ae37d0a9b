"""Delegations and levels against single-threaded walks: rival candidates, deep chains, wide trees, hand-made traces."""

import random

from pyspark.sql import functions as F

from tracewright.operators import delegations as g
from tracewright.operators import levels

PAIR = "trace_id long, session_id string, idx long, child string, rank int, at_ord long, at_idx long, place int"


def greedy(pairs):
    """One walk down the sorted pairs."""
    taken, lefts, rights = set(), set(), set()
    for p in sorted(pairs, key=lambda p: (*p[4:], p[3], *p[:3])):
        left, right = p[:3], (p[0], p[3])
        if left not in lefts and right not in rights:
            taken.add(p)
            lefts.add(left)
            rights.add(right)
    return taken


def test_matching_of_rival_candidates_equals_a_walk_down_the_list(spark):
    rng = random.Random(7)
    for size, ids in ((60, 8), (150, 40), (40, 2)):
        pairs = {}
        for place in rng.sample(range(10 * size), size):
            trace, idx, child = rng.randrange(3), rng.randrange(12), f"c{rng.randrange(ids)}"
            pairs[trace, f"s{idx % 3}", idx, child] = (rng.randrange(1, 3), rng.randrange(3), rng.randrange(4), place)
        rows = [(*k, *v) for k, v in pairs.items()]
        got = g.bind(spark.createDataFrame(rows, PAIR).repartition(5), ["trace_id", "session_id", "idx"], ["trace_id", "child"], ["rank", "at_ord", "at_idx", "place"])
        found = [tuple(r[c] for c in ("trace_id", "session_id", "idx", "child", "rank", "at_ord", "at_idx", "place")) for r in got.collect()]
        assert set(found) == greedy(rows) and len(found) == len(set(found))
    assert g.bind(spark.createDataFrame([], PAIR), ["trace_id", "session_id", "idx"], ["trace_id", "child"], ["rank"]).count() == 0


def test_matching_alternates_through_a_chain(spark):
    """Each pair is second best to its neighbour, so only one can be taken a round from the top."""
    pairs = [(0, "s", k, f"c{k}", 1, 0, 2 * k, 0) for k in range(6)] + [(0, "s", k + 1, f"c{k}", 1, 0, 2 * k + 1, 0) for k in range(6)]
    got = g.bind(spark.createDataFrame(pairs, PAIR), ["trace_id", "session_id", "idx"], ["trace_id", "child"], ["rank", "at_ord", "at_idx", "place"])
    assert {(r.idx, r.child) for r in got.collect()} == {(p[2], p[3]) for p in greedy(pairs)}


def chain_and_bush(depth=50, wide=400):
    nodes = [f"n{k}" for k in range(depth)] + [f"w{k}" for k in range(wide)] + ["alone", "x", "y", "z"]
    edges = [(f"n{k}", f"n{k + 1}") for k in range(depth - 1)] + [(f"n{min(10, depth - 1)}", f"w{k}") if k < 300 else (f"w{k - 300}", f"w{k}") for k in range(wide)]
    edges += [("x", "y"), ("y", "x"), ("y", "z"), ("gone", "alone"), ("n3", "n3")]
    return nodes, edges


def test_levels_give_what_a_walk_gives(spark):
    nodes, edges = chain_and_bush(12)
    frame = spark.createDataFrame([(n, k if k % 5 else None) for k, n in enumerate(nodes)], "node string, v long")
    links = spark.createDataFrame(edges, "parent string, child string")
    placed = levels.place(frame, links)
    value = {n: (k if k % 5 else None) for k, n in enumerate(nodes)}
    up = {c: p for p, c in edges if p != c and p in value}
    under = {n: [n] for n in nodes if n not in "xyz"}
    for n in nodes:
        seen, at = {n}, up.get(n)
        while at is not None and at not in seen:
            seen.add(at)
            if at in under and n not in "xyz":
                under[at].append(n)
            at = up.get(at)
    sums = {r.node: r.v for r in levels.subtree_sums(placed, ["v"]).collect()}
    want = {n: (sum(x) if (x := [value[m] for m in below if value[m] is not None]) else None) for n, below in under.items()}
    assert sums == want
    seen = levels.subtree_values(placed, frame.select("node", (F.coalesce("v", F.lit(0)) % 7).alias("p")), "p").groupBy("node").agg(F.sort_array(F.collect_list("p")).alias("p"))
    assert {r.node: r.p for r in seen.collect()} == {n: sorted({(value[m] or 0) % 7 for m in below}) for n, below in under.items()}
    assert levels.subtree_sums(levels.place(frame.limit(0), links.limit(0)), ["v"]).count() == 0


def test_a_deep_chain_and_a_wide_tree_parents_first(spark):
    nodes, edges = chain_and_bush(50)
    up = {c: p for p, c in edges if p != c and p in nodes}
    placed = levels.place(spark.createDataFrame([(n,) for n in nodes], "node string"), spark.createDataFrame(edges, "parent string, child string"))

    def step(ready, given):
        if given is None:
            return ready.select("node", F.col("node").alias("path"))
        return given.select(F.col("to").alias("node"), F.concat_ws(">", "path", "to").alias("path"))

    done, left = levels.in_order(placed, step)

    def path(n):
        return path(up[n]) + ">" + n if n in up else n

    assert {r.node: r.path for r in done.collect()} == {n: path(n) for n in nodes if n not in "xyz"}
    assert {r.node for r in left.collect()} == {"x", "y", "z"}


EVENT = "trace_id long, session_id string, ord long, idx long, kind string, tool string, call_id string, agent string, text string, ok boolean, raw_type string, status string, final boolean"
UUIDS = [f"{k:08d}-0000-4000-8000-000000000000" for k in range(9)]


def trace(*said, parent="p"):
    """Events of a parent from (tool, agent, request, reply, ok): a call and its result each; reply None: no result."""
    rows = []
    for k, (tool, agent, asked, reply, ok) in enumerate(said):
        rows.append((1, parent, 0, 2 * k, "tool_call", tool, f"c{k}", agent, asked, None, None, None, None))
        if reply is not None:
            rows.append((1, parent, 0, 2 * k + 1, "tool_result", None, f"c{k}", None, reply, ok, None, None, None))
    return rows


def books(spark, rows, children, links=()):
    events = spark.createDataFrame(rows, EVENT)
    sessions = spark.createDataFrame([(1, "p", 0)] + [(1, c, k + 1) for k, c in enumerate(children)], "trace_id long, session_id string, ord long")
    edges = spark.createDataFrame([(1, "p", c, "spawn", k, "high") for k, c in enumerate(links)], "trace_id long, parent_id string, child_id string, kind string, ord long, confidence string")
    launched, said = g.ledger(events, sessions, edges)
    return {r.idx: r for r in launched.collect()}, {r.idx: r for r in said.collect()}


def test_each_kind_of_evidence_binds_a_child(spark):
    a, b, c = UUIDS[:3]
    launched, said = books(
        spark,
        trace(
            ("spawn_agent", None, "look at src/a.py", f"Agent ID: {a}", True),  # 0
            ("steer_subagent", a, "more", "ok", True),  # 2
            ("spawn_agent", None, "again", f"Agent ID: {a}", True),  # 4: the last launch that names a has it
            ("agent", a, "go on", "ok", True),  # 6: resumes it
            ("create_thread", None, "threads", f"made {b} beside {a}", True),  # 8: mentions b
            ("spawn_agent", None, "silent", None, None),  # 10: the only launch without a child gets c by its link
            ("get_subagent_result", "nobody", None, "Status: completed", True),  # 12: no such launch
        ),
        [a, b, c],
        [a, b, c],
    )
    assert {i: (r.child, r.evidence, r.confidence) for i, r in launched.items()} == {
        0: (None, None, "unknown"), 4: (a, "exact_id", "high"), 8: (b, "mentioned_thread", "medium"), 10: (c, "unique_unmatched_spawn", "medium"),
    }
    assert launched[0].names == a and launched[0].steers == 1 and launched[4].resumes == 1 and launched[0].request_files == ["src/a.py"]
    assert {i: (r.action, r.l_idx) for i, r in said.items()} == {2: ("steer", 0), 6: ("resume", 4), 12: ("wait", None)}


def test_two_silent_launches_are_not_guessed(spark):
    launched, _ = books(spark, trace(("spawn_agent", None, "x", None, None), ("spawn_agent", None, "y", None, None)), UUIDS[:1], UUIDS[:1])
    assert [r.child for r in launched.values()] == [None, None]


def test_status_of_a_launch(spark):
    a = UUIDS[:8]
    said = [
        ("spawn_agent", None, "x", "nope", False), ("spawn_agent", None, "x", f"Agent ID: {a[1]} in the background", True), ("spawn_agent", None, "x", f"Agent ID: {a[2]} in the background", True),
        ("get_subagent_result", a[2], None, "Status: completed. All fine", True), ("spawn_agent", None, "x", f"Agent ID: {a[3]} in the background", True),
        ("spawn_agent", None, "x", f"Agent ID: {a[4]} in the background", True), ("spawn_agent", None, "x", "done", True), ("spawn_agent", a[5], "x", None, None),
        ("spawn_agent", None, "x", f"Agent ID: {a[6]} in the background", True),
    ]
    rows = trace(*said)
    notice = lambda idx, agent, status, text=None: (1, "p", 0, idx, "notification", None, None, agent, text, None, "subagent-notification", status, None)
    rows += [notice(100, a[3], "failed"), notice(101, a[3], "terminated"), notice(102, a[4], "completed"), notice(103, a[4], "running")]
    rows.append((1, a[6], 1, 0, "assistant_msg", None, None, None, "the answer", None, None, None, True))
    launched, _ = books(spark, rows, a)
    assert [r.status for _, r in sorted(launched.items())] == [
        "spawn-rejected", "running-at-capture", "completed", "terminated", "result-unavailable", "completed", "unknown", "completed",
    ]
    assert [r.notices for _, r in sorted(launched.items())][3:5] == [2, 2]


def test_interventions_take_the_first_reason(spark):
    launched = spark.createDataFrame([(1, "p", k, k == 0) for k in range(7)], "trace_id long, session_id string, idx long, refused boolean")
    answers = spark.createDataFrame(
        [(1, "p", i, q, v, None, high, x) for i, q, v, high, x in [
            (0, g.CHANGES[0], 1.0, None, False), (2, g.CHANGES[1], 0.9, None, False), (2, g.CONTRACT[0], 0.0, None, False), (3, g.CONTRACT[2], 0.2, None, False),
            (4, g.RETURN[3], 0.1, None, False), (5, g.CHANGES[0], 0.9, 0.95, False), (5, g.CONTRACT[0], 0.0, None, True), (6, g.RETURN[0], None, None, False)]],
        "trace_id long, session_id string, idx long, question string, value double, low double, high double, abstains boolean",
    )
    failed = launched.filter("idx = 1").select("trace_id", "session_id", "idx")
    got = [r.intervention for r in g.interventions(launched, answers, failed).orderBy("idx").collect()]
    assert got == ["repair_child_execution"] * 2 + ["manage_requirement_change", "improve_initial_contract", "improve_child_return"] + ["investigate_visibility"] * 2


def test_subtree_counts_give_what_a_walk_gives(spark):
    """a node's values come in its row; values met twice on the way up, and in one array, count once."""
    nodes, edges = chain_and_bush(6, 40)
    own = {n: [f"p{k % 7}", f"p{k % 3}"] if k % 4 else None for k, n in enumerate(nodes)}
    placed = levels.place(spark.createDataFrame(list(own.items()), "node string, p array<string>"), spark.createDataFrame(edges, "parent string, child string"))
    up = {c: p for p, c in edges if p != c and p in own}
    want = {n: set(own[n] or ()) for n in nodes if n not in "xyz"}
    for n in want:
        above = n
        while above in up:
            above = up[above]
            want[above] |= set(own[n] or ())
    assert {r.node: r.n for r in levels.subtree_counts(placed, "p").collect()} == {n: len(p) for n, p in want.items() if p}


def test_children_keep_no_plain_checkpoints(spark, sf_dir):
    """what the delegations keep is compressed; the trees' and events' files and all shuffle files but the result's go."""
    from pathlib import Path

    from tracewright.operators import graph
    from tracewright.plans import delegations

    folder = Path(graph._checkpoint_folder(spark).removeprefix("file:"))
    there = set(folder.iterdir())
    found = delegations.delegation_children(spark, sf_dir)
    new = {p.name.split("-")[0] for p in set(folder.iterdir()) - there if not p.name.startswith(".")}
    assert new == {"stored"} and found.count() > 100
    assert spark.conf.get(graph.CLEANUP) == "false"


def test_calls_of_other_tools_are_not_shuffled(spark):
    """only what starts, steers or awaits a subagent, and results with an id, meet in coordination()."""
    rows = [("tool_call", "Read", None), ("tool_call", "spawn_agent", "l"), ("tool_result", None, "l"), ("tool_result", None, None), ("usage", None, None)]
    events = spark.createDataFrame([(1, "s", 0, i, *r) for i, r in enumerate(rows)], "trace_id long, session_id string, ord long, idx long, kind string, tool string, call_id string")
    found = g.coordination(events)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "isnotnull(call_id" in plan[plan.index("Window") :]
    assert [(r.idx, r.action, r.r_idx) for r in found.collect()] == [(1, "spawn", 2)]


def test_sums_and_values_go_up_together(spark, sf_dir, monkeypatch):
    """one way up for sums and files, by numbers in place of names, gives what two ways gave."""
    from tracewright.plans.delegations import delegation_children

    edges = spark.createDataFrame([(1, 2), (1, 3), (3, 4), (6, 7), (7, 6), (7, 8)], "parent long, child long")
    rows = [(1, 1, ["a"]), (2, None, ["a", "b", "b"]), (3, 5, None), (4, 7, ["c", "a"]), (5, None, []), (6, 1, ["a"]), (7, 1, ["b"]), (8, 1, ["c"])]
    placed = levels.place(spark.createDataFrame(rows, "node long, x long, paths array<string>"), edges)
    got = {r.node: (r.x, r.n) for r in levels.subtree_totals(placed, ["x"], "paths").collect()}
    assert got == {1: (13, 3), 2: (None, 2), 3: (12, 2), 4: (7, 2), 5: (None, 0)}
    sums, counts = ({r[0]: r[1] for r in f.collect()} for f in (levels.subtree_sums(placed, ["x"]), levels.subtree_counts(placed, "paths")))
    assert got == {k: (v, counts.get(k, 0)) for k, v in sums.items()}
    seen = []
    monkeypatch.setattr(g, "place", lambda nodes, edges: seen.append((dict(nodes.dtypes)["node"], edges.dtypes)) or levels.place(nodes, edges))
    assert delegation_children(spark, sf_dir).count() > 1000
    assert seen == [("bigint", [("parent", "bigint"), ("child", "bigint")])]
