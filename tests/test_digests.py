"""Episode digests against a plain fold, at budgets that need no, some and all stages of shrinking."""

import json
import random

from pyspark.sql import functions as F

from tracewright.operators import digests as dg

from .test_logs import call, result, trace


def ends(text, cap):
    if not text or len(text) <= cap:
        return text or ""
    keep = max(1, (cap - len(dg.MARK)) // 2)
    return text[:keep] + dg.MARK + text[-keep:]


def fold(rows, bounds):
    """One digest after the other, for events in order."""
    out = {}
    for episode, first, last, trigger in bounds:
        inside = [r for r in rows if first <= r["idx"] <= last]
        ops, kinds = [], []
        for r in inside:
            if r["kind"] != "tool_call":
                continue
            past = [q for q in rows if q["idx"] < r["idx"]]
            calls = [q for q in past if q["kind"] == "tool_call"]
            same = [q for q in calls if r["signature"] is not None and q["signature"] == r["signature"]]
            path = [q for q in calls if r["path"] is not None and q["path"] == r["path"]]
            runs = [q for q in calls if r["command"] is not None and q["command"] == r["command"]]
            ops.append({
                "idx": r["idx"], "kind": r["tool"] or "op", "text": ends(r["command"] or r["path"] or r["text"], dg.TEXT_CAP), "exit": r["r_exit"], "ok": r["r_ok"], "repeats": len(same),
                "ago": r["idx"] - same[-1]["idx"] if same else None, "path_edits": sum(q["category"] == "write" for q in path), "read_before": any(q["category"] == "read" for q in path),
                "exit_before": runs[-1]["r_exit"] if runs else None, "edited_before": any(q["category"] == "write" for q in calls),
            })
        for o in ops[dg.MOST_OPS :]:
            kinds.append(o["kind"])
        notes = [{"idx": r["idx"], "role": "user" if r["kind"] == "user_msg" else "assistant", "text": ends(r["text"], dg.TEXT_CAP)} for r in inside if r["kind"] in ("user_msg", "assistant_msg") and r["text"]]
        before = [r for r in rows if r["idx"] < inside[0]["idx"]][-dg.LOOK_BACK :]
        said = [r["text"] for r in before if r["kind"] in ("user_msg", "assistant_msg") and r["text"]]
        shown = [" ".join(x for x in (r["tool"] or "op", r["command"] or r["path"], f"(exit {r['r_exit']})" if r["r_exit"] is not None else None) if x is not None) for r in before if r["kind"] == "tool_call"]
        tests = [r for r in inside if r["kind"] == "tool_call" and r["intent"] == "build_test"]
        total = lambda c: sum(x) if (x := [r[c] for r in inside if r["kind"] == "usage" and r[c] is not None]) else None  # noqa: B023, E731
        out[episode] = {
            "trigger": trigger, "last_message": ends(said[-1] if said else "", dg.TEXT_CAP), "last_ops": [ends(x, 120) for x in shown][-dg.LAST_OPS :], "ops": ops[: dg.MOST_OPS],
            "omitted_ops": max(0, len(ops) - dg.MOST_OPS), "omitted_kinds": [{"kind": k, "n": kinds.count(k)} for k in sorted(set(kinds))], "messages": notes[-dg.MOST_MESSAGES :],
            "omitted_messages": max(0, len(notes) - dg.MOST_MESSAGES),
            "counts": {"reads": sum(r["kind"] == "tool_call" and r["category"] == "read" for r in inside), "edits": sum(r["kind"] == "tool_call" and r["category"] == "write" for r in inside), "tests": len(tests),
                       "tests_failed": sum(r["r_ok"] is False for r in tests), "failed": sum(r["kind"] == "tool_result" and r["ok"] is False for r in inside)},
            "usage": {c: total(c) for c in ("input", "output", "cache_read")},
        }
    return out


def plain(x):
    """Without nulls, as JSON leaves them out."""
    if isinstance(x, dict):
        return {k: plain(v) for k, v in x.items() if v is not None}
    return [plain(v) for v in x] if isinstance(x, list) else x


def size(digest):
    return max(1, len(json.dumps(plain(digest), ensure_ascii=False, separators=(",", ":"))) // dg.CHARS_PER_TOKEN)


def shrunk(d, budget):
    cap = dg.TEXT_CAP
    for _ in range(dg.STAGES):
        if size(d) <= budget:
            return d
        ops = [o | {"text": ends(o["text"], cap), "kind": ends(o["kind"], cap)} for o in d["ops"][:1]]
        d = d | {"omitted_ops": d["omitted_ops"] + max(0, len(d["ops"]) - 1), "ops": ops, "messages": [], "last_message": ends(d["last_message"], cap), "last_ops": [ends(o, cap) for o in d["last_ops"]]}
        d["omitted_kinds"] = [k | {"kind": ends(k["kind"], cap)} for k in d["omitted_kinds"]]
        cap = max(dg.LEAST_CAP, cap // 2)
    if size(d) <= budget:
        return d
    d = d | {"trigger": "", "last_message": "", "last_ops": [], "ops": [], "omitted_kinds": []}
    return d if size(d) <= budget else None


def test_digests_equal_a_plain_fold_and_never_pass_the_budget(spark):
    rng = random.Random(4)
    rows = []
    for k in range(90):
        kind = rng.choice(["call", "call", "call", "say", "ask", "usage"])
        if kind == "call":
            command, path = (rng.choice(["pytest -q", "ls " + "x" * rng.choice([3, 900]), "make"]), None) if rng.random() < 0.5 else (None, f"src/{rng.randrange(4)}é.py")
            category = "execute" if command else rng.choice(["read", "write"])
            tool = {"execute": "Bash", "read": "Read", "write": "Edit"}[category]
            given = {"command": command, "path": path, "signature": None if rng.random() < 0.2 else f"{tool} {command or path}"}
            ok = rng.random() < 0.6
            rows += [call(f"c{k}", tool, category, **given), result(f"c{k}", ok, exit_code=0 if ok else 1, error=None if ok else "build_test_fail")]
        elif kind == "usage":
            rows.append(("usage", {"input": rng.choice([None, 5]), "output": 7}))
        else:
            rows.append(("assistant_msg" if kind == "say" else "user_msg", {"text": rng.choice(["", 'quote " and \n line', "y" * 1000, "short…"])}))
    frame = trace(spark, rows)
    known = [r.asDict() for r in frame.orderBy("idx").collect()]
    bounds = [(k, a, a + width - 1, "user_turn") for k, (a, width) in enumerate([(0, 1), (1, 30), (31, 60), (91, 3), (len(rows) - 20, 20)])]
    episodes = spark.createDataFrame([(1, *b) for b in bounds], "session_id long, episode long, first_idx long, last_idx long, trigger string")
    want = fold(known, bounds)
    seen = set()
    budgets = (10_000, 700, 200, 110, 60, 20)
    whole = dg.digests(frame, episodes, 10**6)
    every = whole.select("episode", F.explode(F.array(*(F.struct(F.lit(b).alias("budget"), dg.shrink(F.col("digest"), b).alias("digest")) for b in budgets))).alias("s"))
    every = every.select("episode", "s.*", F.length(F.to_json("s.digest")).alias("n")).collect()
    for budget in budgets:
        got = [r for r in every if r.budget == budget]
        assert len(got) == len(bounds)
        for r in got:
            expected = shrunk(want[r.episode], budget)
            assert (None if r.digest is None else plain(r.digest.asDict(recursive=True))) == (None if expected is None else plain(expected)), (budget, r.episode)
            assert r.digest is None or r.n // dg.CHARS_PER_TOKEN <= budget
            seen.add("none" if expected is None else "whole" if expected == want[r.episode] else "bare" if not expected["ops"] else "cut")
    assert seen == {"none", "whole", "bare", "cut"}
    assert dg.digests(frame, episodes.limit(0), 100).count() == 0
