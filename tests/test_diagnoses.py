"""Question passes, overlays, priced stretches and continuations against single-threaded walks."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tracewright.operators import diagnoses as dg
from tracewright.operators import questions as q


def walk_questions(objects, bank, gates, answers, barred):
    """state of each (object, question), one object after the other."""
    out = {}
    for scope, obj in objects:
        mine = [question for s, question in bank if s == scope]
        best = {}
        for o, question, value, choice, reason, abstains in answers:
            if o == obj and reason is None and not abstains and (value is not None or choice is not None):
                best[question] = max(best.get(question, (float("-inf"), "")), (float("-inf") if value is None else value, choice or ""))
        asked, todo = set(), [x for x in mine if x not in {g[0] for g in gates}]
        while todo:
            question = todo.pop()
            if question in asked:
                continue
            asked.add(question)
            if question not in best or (obj, question) in barred:
                continue
            value, choice = best[question]
            for opened, parent, least in gates:
                if parent == question and opened in mine and ((least is not None and value >= least) or (choice and choice not in q.ESCAPES)):
                    todo.append(opened)
        for question in mine:
            state = "not_asked" if question not in asked else "insufficient_observability" if (obj, question) in barred else "answered" if question in best else "unanswered"
            out[obj, question] = state
    return out


def test_only_positive_parents_open_questions(spark):
    rng = random.Random(5)
    names = [f"q{k}" for k in range(14)]
    bank = [("a", n) for n in names[:9]] + [("b", n) for n in names[5:]]
    gates = list({(rng.choice(names[3:]), rng.choice(names)): rng.choice([0.3, 0.6, 0.9, None]) for _ in range(20)}.items())
    gates = [(a, b, least) for (a, b), least in gates] + [("q13", "q12", 0.1), ("q12", "q13", 0.1), ("q3", "q0", 0.1), ("q4", "q3", 0.1), ("q6", "q4", 0.1)]
    objects = [("a" if k % 2 else "b", k) for k in range(60)]
    answers = [(k, n, rng.choice([None, rng.random()]), rng.choice([None, None, "other", "yes"]), rng.choice([None, None, None, "low_support"]), rng.choice([None, False, False, True])) for _, k in objects for n in names if rng.random() < 0.8]
    answers += [a for a in answers if rng.random() < 0.1]
    barred = {(k, n) for _, k in objects for n in names if rng.random() < 0.05}
    frame = lambda rows, schema: spark.createDataFrame(list(rows), schema).repartition(3)
    got = q.ask_passes(
        frame(objects, "scope string, object_id long"), frame(bank, "scope string, question string"), frame(gates, "question string, parent string, least double"),
        frame(answers, "object_id long, question string, value double, choice string, reason string, abstains boolean"), frame(barred, "object_id long, question string"),
    ).collect()
    states = {(r.object_id, r.question): r.state for r in got}
    want = walk_questions(objects, bank, gates, answers, barred)
    assert len(states) == len(got) and {k: (v, want.get(k)) for k, v in states.items() if want.get(k) != v} == {} and len(want) == len(states)
    assert len(set(states.values())) == 4 and max(r["round"] or 0 for r in got) >= 2
    assert all((r.value is None and r.choice is None) == (r.state != "answered") for r in got)


def test_overlay_takes_the_first_level_and_the_last_begun_range(spark):
    rng = random.Random(8)
    points = [(s, rng.randrange(60), f"p{k}") for s in range(5) for k in range(50)]
    ranges, starts = [], set()
    for k in range(120):
        s, level, first = rng.randrange(6), rng.choice("xyz"), rng.randrange(60)
        if (s, level, first) not in starts:
            starts.add((s, level, first))
            ranges.append((s, level, first, first + rng.choice([-1, 0, 3, 25]), f"l{k}"))
    got = q.overlay(spark.createDataFrame(points, "session_id long, idx long, name string").repartition(3), spark.createDataFrame(ranges, "session_id long, level string, first_idx long, last_idx long, label string"), ["y", "x", "z"], ["label"])
    want = []
    for s, idx, name in points:
        found = (None, None, None)
        for level in "yxz":
            begun = [r for r in ranges if r[0] == s and r[1] == level and r[2] <= idx]
            if begun and (last := max(begun, key=lambda r: r[2]))[3] >= idx:
                found = (last[4], level, last[2])
                break
        want.append((s, idx, name, *found))
    assert sorted(map(str, (tuple(r) for r in got.select("session_id", "idx", "name", "label", "level", "from").collect()))) == sorted(map(str, want))
    kinds = spark.createDataFrame([("orient", 0.7), ("orient", 0.6), ("verify", 0.9), (None, 0.9), ("investigate", None)], "purpose string, produce double")
    assert [r[0] for r in kinds.select(q.purpose(F.col("purpose"), F.col("produce"))).collect()] == ["produce", "orient", "verify", None, "investigate"]


def test_overlapping_claims_are_priced_once(spark):
    rng = random.Random(2)
    spend = [(s, 3 * k + rng.randrange(3), rng.choice([None, 0, rng.randrange(1000)])) for s in range(6) for k in range(40)]
    claims = [(s, f"c{k}", a, a + rng.choice([-2, 0, 5, 30, 120]), rng.randrange(3)) for s in range(5) for k in range(rng.choice([0, 1, 25])) for a in [rng.randrange(-5, 130)]]
    claims += [(9, "nothing spent", 0, 10, 0)]
    spent = spark.createDataFrame(spend, "session_id long, idx long, micros long").repartition(3)
    got = dg.priced_once(spark.createDataFrame(claims, "session_id long, claim string, first_idx long, last_idx long, priority int").repartition(4), spent)
    rows = {(r.session_id, r.claim): r for r in got.collect()}
    for s, name, first, last, _ in claims:
        inside = [(idx, m or 0) for t, idx, m in spend if t == s and first <= idx <= last]
        raw = sum(m for _, m in inside)
        order = sorted((c for c in claims if c[0] == s), key=lambda c: (c[2], c[4], c[1]))
        before = order[: [c[1] for c in order].index(name)]
        own = sum(m for idx, m in inside if not any(c[2] <= idx <= c[3] for c in before))
        assert (rows[s, name].raw, rows[s, name].priced) == (raw, own), (s, name)
    for r in dg.conserved(got, spent).collect():
        covered = sum(m or 0 for t, idx, m in spend if t == r.session_id and any(c[0] == t and c[2] <= idx <= c[3] for c in claims))
        assert r.priced == covered and r.spent == r.priced + r.unclaimed and r.raw >= r.priced


def test_a_burden_needs_an_unrelated_task_and_a_trigger(spark):
    at = lambda minute: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)
    names = "session_id string, idx long, ts timestamp, kind string, response_id string, input long, output long, cache_read long, cache_write long"
    ask, use = lambda i, m: ("s", i, at(m), "user_msg", None, None, None, None, None), lambda i, m, n, r, key=None: ("s", i, at(m), "usage", key or f"r{i}", n, 1, r, 0)
    events = [
        ask(0, 0), use(1, 1, 900, 100), use(2, 1, 5, 5, "r1"),  # missed the cache, no gap
        ask(10, 30), use(11, 31, 900, 0), use(12, 32, 1_000_000, 0),  # missed; its message is a minute before the call
        ask(20, 60), use(21, 90, 900, 50),  # missed, half an hour after the message
        ask(30, 95), use(31, 95, 100, 900),  # hit
        ask(40, 100), ("s", 41, at(100), "compaction", None, None, None, None, None), use(42, 100, 100, 900),
        ask(50, 200), use(51, 200, 100, 700_000), ask(60, 300), ask(70, 400), use(71, 500, 900, 0),
    ]
    tasks = [("s", t, t, t + 9, "related" if t == 70 else "unrelated", "x" * 40, "m" if t != 60 else None, t == 30) for t in range(0, 80, 10)]
    touched = [("s", 40, "a"), ("s", 50, "a"), ("s", 20, "b")]
    rows = spark.createDataFrame(events, names)
    frame = spark.createDataFrame(tasks, "session_id string, task long, first_idx long, last_idx long, edge string, text string, model string, abstains boolean")
    used = spark.createDataFrame(touched, "session_id string, task long, path string")
    got = {r.task: r for r in dg.continuations(rows, frame, used, {"m": (2.0, 1.0, 0.0)}).collect()}
    assert 30 not in got and {t for t, r in got.items() if r.diagnosis == "CONTINUATION_BURDEN"} == {20, 40}
    r = got[20]
    assert (r.missed, r.after_gap, r.occupancy, r.status) == (True, True, 950, "exact")
    invoice, request = (900 * 2 + 50) / 1e6, 10
    assert abs(r.high - (invoice - request * 2 / 1e6)) < 1e-12 and abs(r.low - max(0, invoice - (request + 940) * 2 / 1e6)) < 1e-12
    assert got[50].reuse == 1 and got[40].compacted and got[60].status == "unknown" and got[60].occupancy == 0
    union = dg.counterfactual(spark.createDataFrame(list(got.values())), "session_id").collect()
    assert len(union) == 1 and union[0].n == 2 and union[0].low == min(got[20].low, got[40].low) and union[0].high == max(got[20].high, got[40].high)
