"""Who did what for whom: launches bound to child sessions, what was said to them, what came back, and what they did."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions import text as tx

from .graph import settings, stored
from .handovers import SPAWNS, tool_name
from .levels import in_order, place, subtree_totals

#: How a result names its subagent; thread ids; tools that speak to one and wait for one; rows that tell of one.
AGENT_ID = r"Agent(?: ID)?:\s*([\w-]+)"
THREAD_ID = r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
STEERS, WAITS, NOTICES = ("steer_subagent", "agent.message"), ("get_subagent_result", "agent.wait"), ("subagents:record", "subagent-notification")
#: Columns that the operators read beside trace_id, session_id, ord (place of the session in its trace) and idx.
COLUMNS = {
    "kind": "string", "tool": "string", "call_id": "string", "agent": "string", "text": "string", "ok": "boolean", "raw_type": "string", "status": "string", "final": "boolean",
    "path": "string", "category": "string", "model": "string", "input": "long", "output": "long", "cache_read": "long", "cache_write": "long",
}
PLACE = ("trace_id", "session_id", "idx")


def _whole(events: DataFrame) -> DataFrame:
    return events.withColumns({c: F.lit(None).cast(t) for c, t in COLUMNS.items() if c not in events.columns})


def _named(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def coordination(events: DataFrame) -> DataFrame:
    """Calls that start, resume, steer or wait for a subagent, with their last result of the same id.

    trace_id, session_id, ord, idx, action, tool, agent (the target in the arguments), text, r_idx, r_ok, r_text, r_agent.
    `agent` of a call is the id in its arguments (receiver or target), of a result the id in its record. Calls and
    results meet by id in a window; a call without an id has no result.
    """
    rows = _whole(events).filter(F.col("kind").isin("tool_call", "tool_result"))
    name = tool_name(F.col("tool"))
    action = (
        F.when((name == "agent") & F.col("agent").isNotNull(), "resume").when(name.isin(*STEERS), "steer").when(name.isin(*WAITS), "wait").when(name.isin(*SPAWNS), "spawn")
    )
    is_call = F.col("kind") == "tool_call"
    rows = rows.withColumns({"action": F.when(is_call, action), "key": F.coalesce("call_id", F.concat(F.lit("\u0000"), F.col("idx").cast("string")))})
    # Nothing else is asked for below: calls of other tools, and results that no id can lead to, are not shuffled.
    rows = rows.filter(F.col("action").isNotNull() | (~is_call & F.col("call_id").isNotNull()))
    met = Window.partitionBy("trace_id", "session_id", "key")
    rows = rows.withColumn("r", F.max(F.when(F.col("kind") == "tool_result", F.struct("idx", "ok", "text", "agent"))).over(met))
    result = {f"r_{c}": F.col(f"r.{c}") for c in ("idx", "ok", "text", "agent")}
    return rows.filter("action is not null").withColumns(result).select("trace_id", "session_id", "ord", "idx", "action", "tool", "agent", "text", *result)


def launches(calls: DataFrame) -> DataFrame:
    """Spawning calls of coordination(): agent is the id that the arguments, the result's record or its text give, in
    that order; mentions are thread ids that the result of a created thread shows besides."""
    agent = F.coalesce("agent", "r_agent", _named(F.col("r_text"), AGENT_ID))
    shown = F.when(tool_name(F.col("tool")) == "create_thread", F.regexp_extract_all("r_text", F.lit(THREAD_ID), F.lit(0)))
    found = calls.filter("action = 'spawn'").withColumns({"agent": agent, "mentions": F.coalesce(F.array_distinct(shown), F.array().cast("array<string>"))})
    return found.select("trace_id", "session_id", "ord", "idx", "agent", F.array_except("mentions", F.array("agent")).alias("mentions"), "text", "r_idx", "r_ok", "r_text")


def bind(pairs: DataFrame, left: list[str], right: list[str], order: list[str]) -> DataFrame:
    """Of candidate pairs, those of a one-to-one matching that takes the best pair first, as rows of `pairs`.

    `order` (ascending) says which pair is better; ties go to the smaller right, then the smaller left side. In each round a pair is taken if it is
    the best of both its sides, and all other pairs of the two go; so as many pairs are taken at once as can be, and
    the result is that of one walk down the sorted list. Only aggregates and joins with one row a side are used: no
    side with many candidates is brought together.
    """
    rest, taken = stored(pairs), None
    both = list(dict.fromkeys((*left, *right)))

    def best_of(side: list[str]) -> DataFrame:
        others = [*order, *(c for c in both if c not in side)]
        found = rest.groupBy(*side).agg(F.min(F.struct(*others)).alias("best"))
        return found.select(*side, *(F.col(f"best.{c}").alias(c) for c in others)).select(*both)

    while True:
        won = stored(best_of(left).join(best_of(right), both, "left_semi"))
        if won.isEmpty():
            return rest if taken is None else taken
        took = rest.join(won, both, "left_semi")
        taken = stored(took if taken is None else taken.unionByName(took))
        rest = stored(rest.join(won.select(*left), left, "left_anti").join(won.select(*right), right, "left_anti"))


def bound_launches(launched: DataFrame, sessions: DataFrame, links: DataFrame) -> DataFrame:
    """Launches with child, confidence and evidence; no child has two launches and no launch two children.

    Evidence in order: the launch's own id is a session of its trace (of several launches the last has it), its result
    mentions the session (the first that does has it), or its session has just this one launch without a known child
    and a spawned child without a launch (the first by place). `sessions` are (trace_id, session_id), `links`
    (trace_id, parent_id, child_id, kind, ord). A launch whose id is a session that a later launch has keeps it in
    `names`: it started that child before.
    """
    known = sessions.select("trace_id", F.col("session_id").alias("child"))
    back = lambda c: (-F.col(c)).alias(f"at_{c}")
    exact = launched.filter("agent is not null").select(*PLACE, F.col("agent").alias("child"), F.lit(1).alias("rank"), back("ord"), back("idx"), F.lit(0).alias("place"))
    shown = launched.select(*PLACE, F.posexplode("mentions").alias("place", "child"), F.lit(2).alias("rank"), F.col("ord").alias("at_ord"), F.col("idx").alias("at_idx"))
    pairs = exact.unionByName(shown).filter("child <> session_id").join(known, ["trace_id", "child"], "left_semi")
    pairs = stored(pairs)
    matched = bind(pairs, list(PLACE), ["trace_id", "child"], ["rank", "at_ord", "at_idx", "place"]) if not pairs.isEmpty() else pairs
    matched = matched.select(*PLACE, "child", "rank")
    named = pairs.filter("rank = 1").select(*PLACE, F.col("child").alias("names"))
    every = launched.join(matched, list(PLACE), "left").join(named, list(PLACE), "left")
    spare = every.filter("child is null and names is null").groupBy("trace_id", "session_id").agg(F.count("*").alias("n"), F.min("idx").alias("idx")).filter("n = 1")
    free = links.filter("kind = 'spawn'").select("trace_id", F.col("parent_id").alias("session_id"), F.col("child_id").alias("child"), "ord")
    free = free.join(matched.select("trace_id", "child"), ["trace_id", "child"], "left_anti")
    first = free.groupBy("trace_id", "session_id").agg(F.min(F.struct("ord", "child")).alias("free"))
    recovered = spare.join(first, ["trace_id", "session_id"]).select(*PLACE, F.col("free.child").alias("only"))
    linked = links.select("trace_id", F.col("child_id").alias("child"), F.col("confidence").alias("linked")).dropDuplicates(["trace_id", "child"])
    found = every.join(recovered, list(PLACE), "left").withColumn("child", F.coalesce("child", "only")).join(linked, ["trace_id", "child"], "left")
    evidence = F.when(F.col("only").isNotNull(), "unique_unmatched_spawn").when(F.col("rank") == 1, "exact_id").when(F.col("rank") == 2, "mentioned_thread")
    confidence = F.when(F.col("child").isNull(), "unknown").when(F.col("only").isNotNull() | (F.col("rank") == 2), "medium").otherwise(F.coalesce("linked", F.lit("unknown")))
    return found.withColumns({"evidence": evidence, "confidence": confidence}).drop("rank", "only", "linked")


def followups(calls: DataFrame, bound: DataFrame) -> DataFrame:
    """Resumes, steers and waits with the launch (l_session, l_idx) that they speak to: the last one before them in
    the trace's order that has the target's id as its agent or its child. One merged stream of launches and calls by
    id, so it is linear in them. Those whose target is no launch stay, with nulls; those without a target have none."""
    names = F.array_distinct(F.array_compact(F.array("agent", "child")))
    keys = bound.select("trace_id", "ord", "idx", F.explode(names).alias("key"), F.struct("session_id", "idx").alias("l"))
    asked = calls.filter("action <> 'spawn'").select(*PLACE, "ord", "action", "r_text", F.col("agent").alias("key"))
    fields = ["trace_id", "session_id", "ord", "idx", "action", "r_text", "key", "l"]
    none = lambda t: F.lit(None).cast(t)
    place = "struct<session_id:string,idx:bigint>"
    stream = asked.withColumn("l", none(place)).select(*fields).unionByName(
        keys.select("trace_id", none("string").alias("session_id"), "ord", "idx", none("string").alias("action"), none("string").alias("r_text"), "key", F.col("l").cast(place))
    )
    upto = Window.partitionBy("trace_id", "key").orderBy("ord", "idx").rowsBetween(Window.unboundedPreceding, 0)
    found = stream.filter("key is not null").withColumn("l", F.last("l", ignorenulls=True).over(upto)).filter("action is not null")
    alone = stream.filter("key is null and action is not null")
    return found.unionByName(alone).select(*PLACE, "action", "r_text", F.col("key").alias("target"), F.col("l.session_id").alias("l_session"), F.col("l.idx").alias("l_idx"))


def ledger(events: DataFrame, sessions: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(launches, followups). A launch has agent, child, names, confidence, evidence, steers, resumes, waits,
    notices, request_files and status: completed (its own result, a wait, a notice or the child's last answer brought a
    reply), result-unavailable (a notice says completed, without one), failed, terminated (the last such notice),
    spawn-rejected, running-at-capture (its result says that it runs in the background) or unknown."""
    rows = _whole(events)
    calls = stored(coordination(rows))
    bound = stored(bound_launches(launches(calls), sessions, links))
    said = stored(followups(calls, bound))
    at = {"l_session": "session_id", "l_idx": "idx"}
    done = F.coalesce(F.col("r_text").contains("Status: completed"), F.lit(False))
    count = lambda a: F.count_if(F.col("action") == a).alias(f"{a}s")
    spoken = said.filter("l_idx is not null").groupBy("trace_id", "l_session", "l_idx").agg(count("steer"), count("resume"), count("wait"), F.max((F.col("action") == "wait") & done).alias("wait_done"))
    last = bound.filter("agent is not null").groupBy("trace_id", "agent").agg(F.max(F.struct("ord", "idx", "session_id")).alias("l"))
    notices = rows.filter(F.col("raw_type").isin(*NOTICES)).select("trace_id", "ord", F.col("idx").alias("at"), "agent", "status", F.col("text").alias("reply"))
    final_status = F.when(F.col("status").isin("completed", "terminated", "failed", "error"), F.struct("ord", "at", "status"))
    told = notices.join(last, ["trace_id", "agent"]).groupBy("trace_id", F.col("l.session_id").alias("session_id"), F.col("l.idx").alias("idx")).agg(
        F.count("*").alias("notices"), F.max(final_status).alias("last_notice"), F.max((F.col("status") == "completed") & (F.coalesce("reply", F.lit("")) != "")).alias("notice_done")
    )
    answers = rows.withColumn("answer", final_answer()).filter("answer is not null").groupBy("trace_id", F.col("session_id").alias("child")).agg(F.max("answer").alias("answer"))
    joined = bound.join(spoken.withColumnsRenamed(at), list(PLACE), "left").join(told, list(PLACE), "left").join(answers, ["trace_id", "child"], "left")
    refused, replied = F.coalesce(~F.col("r_ok"), F.lit(False)), F.coalesce(F.col("r_text"), F.lit("")) != ""
    background = F.coalesce(F.lower("r_text").contains("background"), F.lit(False))
    yes = lambda c: F.coalesce(c, F.lit(False))
    completed = (replied & ~refused & ~background) | yes(F.col("wait_done")) | yes(F.col("notice_done")) | F.col("answer").isNotNull()
    notice = F.col("last_notice.status")
    status = (
        F.when(completed, "completed").when(notice == "completed", "result-unavailable").when(notice == "terminated", "terminated").when(notice.isNotNull(), "failed")
        .when(refused, "spawn-rejected").when(replied & background, "running-at-capture").otherwise("unknown")
    )
    files = F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(tx.PATHS), F.lit(0))))
    number = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    found = joined.select(
        *PLACE, "ord", "agent", "child", "names", "confidence", "evidence", number("steers"), number("resumes"), number("waits"), number("notices"), files.alias("request_files"), refused.alias("refused"), status.alias("status")
    )
    return stored(found), said


def final_answer() -> Column:
    """struct (idx, text) of an answer that ends a turn, for a maximum over a session."""
    return F.when((F.col("kind") == "assistant_msg") & F.coalesce("final", F.lit(False)) & (F.coalesce("text", F.lit("")) != ""), F.struct("idx", "text"))


def children(launched: DataFrame, events: DataFrame, links: DataFrame) -> DataFrame:
    """H2: what the child of each bound launch did: tokens by kind (null where no usage has them), models in order of
    first use, files read and written, the last answer, and over its whole subtree tree_sessions, tree_input, tree_output,
    tree_calls, tree_files (distinct paths). Sums and file sets of children go to their parents level by level; a path
    is a row there, so no set is held in a row or a task."""
    kinds = ("input", "output", "cache_read", "cache_write")
    calls, usage = F.col("kind") == "tool_call", F.col("kind") == "usage"
    touches = calls & F.col("path").isNotNull() & F.col("category").isin("read", "write")
    answer = final_answer()
    rows = _whole(events).select(
        "trace_id", F.col("session_id").alias("child"), F.when(calls, 1).alias("call"), *(F.when(usage, F.col(k)).alias(k) for k in kinds), F.when(usage, F.col("model")).alias("model"),
        F.when(usage, F.col("idx")).alias("first"), F.when(touches, F.col("category")).alias("category"), F.when(touches, F.col("path")).alias("path"), answer["idx"].alias("said_at"), answer["text"].alias("said"),
    )
    # Sessions are dealt once: what a session has of a model, a path or an answer is one row, and both sums stay in the task.
    items = rows.repartition("trace_id", "child").groupBy("trace_id", "child", "model", "category", "path", "said_at", "said")
    items = items.agg(*(F.sum(k).alias(k) for k in kinds), F.count("call").alias("calls"), F.min("first").alias("first"))
    op = lambda c: F.array_sort(F.collect_list(F.when(F.col("category") == c, F.col("path"))))
    models = F.transform(F.array_sort(F.collect_list(F.when(F.col("model").isNotNull(), F.struct("first", "model")))), lambda m: m["model"])
    last = F.max(F.when(F.col("said_at").isNotNull(), F.struct("said_at", "said")))["said"]
    own = items.groupBy("trace_id", "child").agg(
        *(F.sum(k).alias(k) for k in kinds), F.sum("calls").alias("calls"), last.alias("answer"), models.alias("models"), op("read").alias("files_read"), op("write").alias("files_written")
    )
    # Sorted by session once; by hash, lists would be sorted on both sides of the sum, as soon as a task has 129 sessions.
    with settings(own.sparkSession, {"spark.sql.execution.useObjectHashAggregateExec": "false"}):
        own = stored(own)
    node = lambda c: F.concat_ws("\u0000", F.col("trace_id").cast("string"), F.col(c))
    one_parent = links.withColumns({"node": node("child_id"), "up": node("parent_id")}).groupBy("node").agg(F.min(F.struct("ord", "up")).alias("p"))
    edges = stored(one_parent.select(F.col("p.up").alias("parent"), F.col("node").alias("child")))
    ends = edges.select(F.col("parent").alias("node")).unionByName(edges.select(F.col("child").alias("node"))).distinct()
    has = own.select(node("child").alias("node"), "input", "output", "calls", F.array_union("files_read", "files_written").alias("paths"))
    # On the way up sessions have numbers: names would be most of what each level shuffles.
    nodes = stored(ends.join(has, "node", "full").withColumns({"id": F.monotonically_increasing_id(), "sessions": F.lit(1).cast("long"), "calls": F.coalesce("calls", F.lit(0))}))
    number = lambda c: nodes.select(F.col("node").alias(c), F.col("id").alias(f"{c}_id"))
    numbered = edges.join(number("parent"), "parent").join(number("child"), "child").select(F.col("parent_id").alias("parent"), F.col("child_id").alias("child"))
    totals = subtree_totals(place(nodes.drop("node").withColumnRenamed("id", "node"), numbered), ["sessions", "input", "output", "calls"], "paths")
    totals = totals.select(F.col("node").alias("id"), *(F.col(c).alias(f"tree_{c}") for c in ("sessions", "input", "output", "calls")), F.col("n").alias("tree_files"))
    tree = nodes.select("node", "id").join(totals, "id").drop("id")
    met = launched.filter("child is not null").select(*PLACE, "child").join(own, ["trace_id", "child"], "left")
    met = met.withColumns({"node": node("child"), "calls": F.coalesce("calls", F.lit(0))})
    empty = F.array().cast("array<string>")
    return met.join(tree, "node", "left").drop("node").withColumns({c: F.coalesce(c, empty) for c in ("models", "files_read", "files_written")})


#: Questions whose answers choose an intervention.
CHANGES = ("handover.steer.material_change", "handover.steer.ownership_change")
CONTRACT = ("handover.request.bounded_deliverable", "handover.request.file_ownership", "handover.request.acceptance_check")
RETURN = ("handover.reply.outcome_stated", "handover.reply.artifact_identified", "handover.reply.check_evidence", "handover.reply.request_coverage")


def interventions(launched: DataFrame, answers: DataFrame, failed: DataFrame) -> DataFrame:
    """Launches with intervention, chosen by the first that holds: repair_child_execution (refused, or a failure
    of it is in `failed`), manage_requirement_change (a steer's change is supported), improve_initial_contract,
    improve_child_return (a question about the request, the reply is answered no), investigate_visibility.

    `answers` are (trace_id, session_id, idx, question, value, low, high, abstains): an answer supports yes from `high`
    (0.8 where null) and no up to `low` (0.2); one that abstains or has no value supports neither."""
    usable = answers.filter(F.col("value").isNotNull() & ~F.coalesce("abstains", F.lit(False)))
    yes = F.col("value") >= F.coalesce("high", F.lit(0.8))
    no = F.col("value") <= F.coalesce("low", F.lit(0.2))
    said = usable.groupBy(*PLACE).agg(
        F.max(F.col("question").isin(*CHANGES) & yes).alias("change"), F.max(F.col("question").isin(*CONTRACT) & no).alias("contract"), F.max(F.col("question").isin(*RETURN) & no).alias("reply")
    )
    broken = failed.select(*PLACE).distinct().withColumn("broken", F.lit(True))
    rows = launched.join(said, list(PLACE), "left").join(broken, list(PLACE), "left")
    chosen = (
        F.when(F.col("refused") | F.coalesce("broken", F.lit(False)), "repair_child_execution").when(F.coalesce("change", F.lit(False)), "manage_requirement_change")
        .when(F.coalesce("contract", F.lit(False)), "improve_initial_contract").when(F.coalesce("reply", F.lit(False)), "improve_child_return").otherwise("investigate_visibility")
    )
    return rows.withColumn("intervention", chosen).drop("change", "contract", "reply", "broken")


def parents_first(sessions: DataFrame, links: DataFrame, launched: DataFrame) -> DataFrame:
    """For each session its root, depth, path (the idx of the launches from the root down) and spawned_at (session
    and idx of its launch), each level from its parents' rows. `links` give one parent a session; sessions on a cycle
    have nulls. A child without a bound launch has ? in its path."""
    node = lambda c: F.concat_ws("\u0000", F.col("trace_id").cast("string"), F.col(c))
    spawned = launched.filter("child is not null").select("trace_id", F.col("child").alias("session_id"), F.struct(F.col("session_id").alias("session_id"), "idx").alias("spawned_at"))
    nodes = sessions.select("trace_id", "session_id").distinct().join(spawned, ["trace_id", "session_id"], "left").withColumn("node", node("session_id"))
    up = links.withColumns({"child": node("child_id"), "parent": node("parent_id")}).groupBy("child").agg(F.min(F.struct("ord", "parent")).alias("p"))
    edges = up.select(F.col("p.parent").alias("parent"), "child")

    def step(ready: DataFrame, given: DataFrame | None) -> DataFrame:
        top = ready.withColumns({"root": F.col("session_id"), "depth": F.lit(0).cast("long"), "path": F.lit("")})
        if given is None:
            return top
        above = given.select(F.col("to").alias("node"), F.col("root").alias("a_root"), (F.col("depth") + 1).alias("a_depth"), F.col("path").alias("a_path"))
        here = F.concat("a_path", F.lit("/"), F.coalesce(F.col("spawned_at.idx").cast("string"), F.lit("?")))
        return ready.join(above, "node").select(*ready.columns, F.col("a_root").alias("root"), F.col("a_depth").alias("depth"), here.alias("path"))

    done, left = in_order(place(nodes, edges), step)
    none = left.withColumns({"root": F.lit(None).cast("string"), "depth": F.lit(None).cast("long"), "path": F.lit(None).cast("string")})
    return done.unionByName(none).drop("node")
