"""The detector registry and the rules that turn trace tables into findings.

A rule is of one of three stages. A `session` rule gives aggregates of a session and a finding of them; all session rules
share one groupBy. An `event` rule gives a finding of each row of facts(); all event rules share one projection. A `table`
rule gives findings as a DataFrame of its own. run() works out facts() once, in one partitioning by session.
Knobs are a rule's thresholds by name; the defaults are those for logs.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright import config
from tracewright.functions import text as tx

from . import sequence as s
from .facts import is_call, is_edit, is_exec, is_read, is_result, is_said, is_search, is_user, is_whole, is_write, facts
from .graph import cut_lineage

LEXICONS = config.DEFAULTS["lexicons"]
#: Paths of tests, marks of skipped tests, asserts, claims about a program, reverts, requests to fix, and
#: proposals of more than was asked.
TEST_PATH = r"(?i)(?:^|/)(?:test_|tests?/)|_test\.|\.test\.|\.spec\."
_SKIP, _ASSERT = r"(?i)@pytest\.mark\.(?:skip|xfail)|\bxfail\b|\.skip\s*\(|\bskip\b|@unittest\.skip", r"\bassert\b|\bexpect\s*\("
_CLAIM = r"(?i)\bthe\s+\w+\s+(?:returns|is|does|will|should)\b"
_REVERT = r"(?i)git\s+(?:checkout|revert)|reset\s+--hard|git\s+restore|git\s+clean\s+-"
_FIX = r"(?i)\b(?:fix|bug|repair|correct|patch|resolve)\b"
_CREEP = r"(?i)\b(?:we could also|it would be better if|might as well|while we'?re at it|for good measure)\b"


@dataclass(frozen=True)
class Detector:
    id: str
    severity: str
    kind: str
    stage: str
    rule: Callable
    knobs: dict = field(default_factory=dict)
    needs: tuple[str, ...] = ()


@dataclass(frozen=True)
class Finding:
    """When a rule finds something, its value, and the events it lies between (null: the whole session)."""

    when: Column
    value: Column
    start: Column | None = None
    end: Column | None = None
    aggregates: dict[str, Column] = field(default_factory=dict)


REGISTRY: dict[str, Detector] = {}


def detector(id: str, severity: str, stage: str, kind: str = "taxonomy", needs: tuple[str, ...] = (), **knobs):
    """Registers a rule; `needs` names the columns without which it is silent."""

    def register(rule):
        REGISTRY[id] = Detector(id, severity, kind, stage, rule, knobs, needs)
        return rule

    return register


def applicable(events: DataFrame, enabled: set[str] | None = None, disabled: set[str] = frozenset()) -> list[Detector]:
    """The enabled detectors whose columns the events have."""
    return [d for d in REGISTRY.values() if d.id not in disabled and (enabled is None or d.id in enabled) and set(d.needs) <= set(events.columns)]


def _finding(d: Detector, severity: str, f: Finding) -> Column:
    null = F.lit(None).cast("long")
    fields = [F.lit(d.id).alias("detector"), F.lit(d.kind).alias("kind"), F.lit(severity).alias("severity")]
    fields += [(null if c is None else c.cast("long")).alias(n) for n, c in (("span_start", f.start), ("span_end", f.end if f.end is not None else f.start))]
    return F.when(f.when, F.struct(*fields, F.round(f.value.cast("double"), 6).alias("value")))


def run(events: DataFrame, knobs: dict[str, dict] | None = None, severities: dict[str, str] | None = None, known: bool = False, **choice) -> DataFrame:
    """Findings (detector, kind, severity, session_id, span_start, span_end, value) of all applicable rules.

    `known` says that the events are facts() already."""
    chosen = applicable(events, **choice)
    rows = events if known else cut_lineage(facts(events))
    severity = lambda d: (severities or {}).get(d.id, d.severity)
    given = lambda d: d.knobs | (knobs or {}).get(d.id, {})
    columns, parts = ("detector", "kind", "severity", "session_id", "span_start", "span_end", "value"), []
    in_events = [_finding(d, severity(d), d.rule(given(d))) for d in chosen if d.stage == "event"]
    if in_events:
        parts.append(rows.select("session_id", F.inline(F.filter(F.array(*in_events), lambda x: x.isNotNull()))).select(*columns))
    sessions = [(d, d.rule(given(d), lambda n, d=d: F.col(f"{d.id}__{n}"))) for d in chosen if d.stage == "session"]
    if sessions:
        aggregates = [a.alias(f"{d.id}__{n}") for d, f in sessions for n, a in f.aggregates.items()]
        each = F.array(*(_finding(d, severity(d), f) for d, f in sessions))
        parts.append(rows.groupBy("session_id").agg(*aggregates).select("session_id", F.inline(F.filter(each, lambda x: x.isNotNull()))).select(*columns))
    for d in chosen:
        if d.stage == "table":
            found = d.rule(rows, given(d))
            own = Finding(F.lit(True), F.col("value"), F.col("span_start"), F.col("span_end"))
            parts.append(found.select("session_id", F.inline(F.array(_finding(d, severity(d), own)))).select(*columns))
    return reduce(DataFrame.unionByName, parts)


def tallies(found: DataFrame) -> DataFrame:
    """The findings of each detector and severity: n and sessions. A session's findings of a rule are one row before
    sessions are counted, so no set of sessions is held."""
    per = found.groupBy("session_id", "detector", "severity").agg(F.count("*").alias("n"))
    return per.groupBy("detector", "severity").agg(F.sum("n").alias("n"), F.count("session_id").alias("sessions"))


def _idx(condition: Column) -> Column:
    return F.when(condition, F.col("idx"))


def _opener(column: str) -> Column:
    return F.min_by(column, _idx(is_user()))


def _tokens() -> Column:
    return F.sum(F.coalesce("input", F.lit(0)) + F.coalesce("output", F.lit(0)))


def _stamped() -> Column:
    """Half of what a session did has a time."""
    return F.count("stamp") * 2 >= F.count(F.when(F.col("kind") != "usage", 1))


@detector("bloated_opener", "info", "session", "smell", needs=("text",), tokens=2000)
def bloated_opener(k, c):
    """The first user message is long."""
    n = tx.approx_tokens(c("text"))
    return Finding(n > k["tokens"], n, aggregates={"text": _opener("text")})


@detector("thin_prompt", "info", "session", "smell", needs=("text",), words=8)
def thin_prompt(k, c):
    """The first user message has hardly any words."""
    n = tx.word_count(c("text"))
    return Finding(n < k["words"], n, aggregates={"text": _opener("text")})


@detector("cold_start_reads", "low", "session", "smell", needs=("category", "path"), most=8)
def cold_start_reads(k, c):
    """D3: more distinct paths read before the first write than allowed, reads without a path counting as one; silent
    without a write."""
    early = is_read() & (F.col("idx") < F.col("first_write"))
    return Finding(c("n") > k["most"], c("n"), aggregates={"n": F.size(F.collect_set(F.when(early, F.coalesce("path", F.lit("")))))})


@detector("slow_to_action", "info", "session", "smell", needs=("category",), most=6)
def slow_to_action(k, c):
    """The first call stands late; without a call, the number of logical events counts."""
    first = F.coalesce(F.min(F.when(is_call(), F.col("pos"))), F.count_if("logical"))
    return Finding(c("n") > k["most"], c("n"), aggregates={"n": first})


@detector("overlong_trace", "low", "session", "smell", needs=("ts",), events=400, tokens=150_000, minutes=90)
def overlong_trace(k, c):
    """Too many events, too many tokens or too long."""
    over = (c("n") > k["events"]) | (c("tokens") > k["tokens"]) | (c("stamped") & (c("minutes") > k["minutes"]))
    minutes = (F.max("stamp") - F.min("stamp")) / 6e7
    return Finding(over, c("n"), aggregates={"n": F.count_if("logical"), "tokens": _tokens(), "minutes": minutes, "stamped": _stamped()})


@detector("context_bloat_no_clear", "medium", "session", "smell", needs=("input", "cache_read"), share=0.7, window=config.DEFAULTS["context_window"])
def context_bloat(k, c):
    """The largest context is over a share of the window and nothing was compacted."""
    context = F.coalesce("input", F.lit(0)) + F.coalesce("cache_read", F.lit(0))
    found = {"n": F.max(context), "idx": F.max_by("idx", F.struct(context, -F.col("idx"))), "cleared": F.bool_or(F.col("kind") == "compaction")}
    return Finding((c("n") > k["share"] * k["window"]) & ~c("cleared"), c("n"), c("idx"), aggregates=found)


@detector("tool_monoculture", "low", "table", "smell", needs=("tool",), least=10, share=0.8)
def tool_monoculture(rows, k):
    """One tool makes most of the calls; the wrapper `exec` does not count."""
    counts = rows.filter(is_call() & (F.coalesce("tool", F.lit("?")) != "exec")).groupBy("session_id", F.coalesce("tool", F.lit("?")).alias("tool"))
    found = counts.agg(F.count("*").alias("n"), F.min("idx").alias("a"), F.max("idx").alias("b")).groupBy("session_id")
    found = found.agg(F.sum("n").alias("calls"), F.max("n").alias("most"), F.min("a").alias("span_start"), F.max("b").alias("span_end"))
    return found.withColumn("value", F.col("most") / F.col("calls")).filter((F.col("calls") >= k["least"]) & (F.col("value") > k["share"]))


def _linear(k, c):
    """Many reads and no search."""
    reads = is_read() & ~is_search()
    found = {"n": F.count_if(reads), "searches": F.count_if(is_search()), "a": F.min(_idx(reads)), "b": F.max(_idx(reads))}
    return Finding((c("n") > k["most"]) & (c("searches") == 0), c("n"), c("a"), c("b"), found)


detector("linear_scan_search", "low", "session", "smell", needs=("category", "tool"), most=10)(_linear)
detector("LINEAR_SCAN", "low", "session", needs=("category", "tool"), most=10)(_linear)


@detector("bash_as_editor", "low", "session", "smell", needs=("command",))
def bash_as_editor(k, c):
    """A shell command changes a project file."""
    return Finding(c("n") > 0, c("n"), aggregates={"n": F.count_if(is_exec() & tx.edits_file(F.col("command")))})


@detector("no_plan_dive", "low", "session", "smell", needs=("category",), before=4)
def no_plan_dive(k, c):
    """A write at the very start with no thinking or plan before it."""
    return Finding(c("idx").isNotNull(), F.lit(1), c("idx"), aggregates={"idx": F.min(_idx(is_write() & (F.col("idx") < k["before"]) & ~F.col("planned")))})


@detector("runaway_todo", "low", "session", "smell", needs=("todos", "todos_done"), least=3)
def runaway_todo(k, c):
    """A list of tasks grows and nothing on it is ever done."""
    at = F.when(F.col("todos").isNotNull(), F.col("idx"))
    found = {
        "n": F.count("todos"), "first": F.min_by("todos", at), "last": F.max_by("todos", at), "most": F.max("todos"), "done": F.sum("todos_done"), "a": F.min(at), "b": F.max(at),
    }
    return Finding((c("n") >= 2) & (c("last") > c("first")) & (c("most") >= k["least"]) & (c("done") == 0), c("most"), c("a"), c("b"), found)


@detector("idle_gap", "info", "session", "smell", needs=("ts",), minutes=config.DEFAULTS["idle_minutes"])
def idle_gap(k, c):
    """The longest gap between neighbours by idx."""
    found = {"n": F.max("gap") / 60, "idx": F.max_by("idx", F.when(F.col("gap").isNotNull(), F.struct("gap", -F.col("idx")))), "stamped": _stamped()}
    return Finding(c("stamped") & (c("n") > k["minutes"]), c("n"), c("idx"), aggregates=found)


@detector("CONTEXT_ROT", "low", "session", needs=("ok",), ratio=2.0, share=0.6, window=config.DEFAULTS["context_window"], words=tuple(LEXICONS["correction"]))
def context_rot(k, c):
    """Failures, corrections and writes crowd in the last third of a session of nine events or more, while the
    context is full."""
    third = F.floor(F.col("n_logical") / 3)
    hit = F.col("logical") & ((is_result() & (F.col("ok") == F.lit(False))) | (is_user() & F.col("text").rlike(tx.words_pattern(k["words"]))) | is_write())
    late = F.col("logical") & (F.col("pos") >= F.col("n_logical") - third)
    found = {
        "first": F.count_if(hit & (F.col("pos") < third)), "last": F.count_if(hit & late), "n": F.max("n_logical"),
        "peak": F.max(F.col("input") + F.coalesce("cache_read", F.lit(0))), "a": F.min(_idx(late)), "b": F.max(_idx(late)),
    }
    full = c("peak").isNull() | (c("peak") > k["share"] * k["window"])
    return Finding((c("n") >= 9) & (c("first") >= 1) & (c("last") >= 2) & (c("last") >= k["ratio"] * c("first")) & full, c("last"), c("a"), c("b"), found)


@detector("KITCHEN_SINK", "low", "session", needs=("text",), least=2, words=tuple(LEXICONS["task_intro"]))
def kitchen_sink(k, c):
    """Several messages that each open a task, with nothing compacted between the first and the last."""
    opens = is_user() & F.col("text").rlike(tx.words_pattern(k["words"]))
    found = {"n": F.count_if(opens), "a": F.min(_idx(opens)), "b": F.max(_idx(opens)), "cleared": F.collect_list(_idx(F.col("kind") == "compaction"))}
    return Finding((c("n") >= k["least"]) & ~F.exists(c("cleared"), lambda i: (i > c("a")) & (i < c("b"))), c("n"), c("a"), c("b"), found)


@detector("CORRECTION_LOOP", "medium", "table", needs=("text",), least=3, rows=30, words=tuple(LEXICONS["correction"]))
def correction_loop(rows, k):
    """Corrections crowd in a window of logical events."""
    hit = is_user() & F.col("text").rlike(tx.words_pattern(k["words"]))
    frame = Window.partitionBy("session_id").orderBy("pos").rangeBetween(1 - k["rows"], 0)
    found = rows.filter(hit).withColumns({"n": F.count("*").over(frame), "start": F.min("idx").over(frame)}).filter(F.col("n") >= k["least"])
    return found.groupBy("session_id").agg(F.min_by("start", "idx").alias("span_start"), F.min("idx").alias("span_end"), F.lit(k["least"]).alias("value"))


@detector("EDIT_THRASH", "medium", "table", needs=("category", "path"), rows=20)
def edit_thrash(rows, k):
    """Three edits of a path in a short span with no read of it between; the first such span of a path."""
    w = Window.partitionBy("session_id", "path").orderBy("idx")
    touched = rows.filter("touch is not null").withColumn("reads", F.sum(s.flag(is_read())).over(w))
    edits = touched.filter(is_write()).withColumns({"third": F.lead("idx", 2).over(w), "reads_third": F.lead("reads", 2).over(w)})
    hits = edits.filter((F.col("third") - F.col("idx") <= k["rows"]) & (F.col("reads_third") == F.col("reads")))
    return hits.groupBy("session_id", "path").agg(F.min("idx").alias("span_start"), F.min_by("third", "idx").alias("span_end"), F.lit(3).alias("value"))


@detector("EDIT_WITHOUT_READ", "medium", "table", needs=("category", "path"), rows=50)
def edit_without_read(rows, k):
    """An edit in place of a path that the session has neither read nor written before, nor looked into its folder
    or named it to a reading command in the last events; silent for sessions without reads."""
    first = rows.filter(is_edit() & (F.col("touch") == 1)).select("session_id", "idx", "pos", "path", tx.basename(F.col("path")).alias("name"))
    looks = rows.filter(is_read() | is_search() | (is_exec() & (F.col("intent") == "inspect")))
    sees = looks.select("session_id").distinct()
    looks = looks.select("session_id", F.col("pos").alias("at"), F.col("path").alias("seen"), F.concat_ws(" ", "command", "path").alias("said"))
    # An edit meets only the looks of its own stretch of events and of the one before.
    stretch = lambda c: F.floor(F.col(c) / k["rows"])
    looks = looks.withColumn("stretch", stretch("at"))
    met = first.withColumn("stretch", F.explode(F.array(stretch("pos"), stretch("pos") - 1))).join(looks, ["session_id", "stretch"])
    near = (F.col("at") < F.col("pos")) & (F.col("at") >= F.col("pos") - k["rows"])
    into = F.col("path").startswith(F.concat(F.regexp_replace("seen", "/+$", ""), F.lit("/"))) & (F.length("seen") > 0)
    named = (F.length("name") >= 4) & F.col("said").contains(F.col("name"))
    grounded = met.filter(near & (F.coalesce(into, F.lit(False)) | named)).select("session_id", "idx")
    found = first.join(sees, "session_id", "left_semi").join(grounded, ["session_id", "idx"], "left_anti")
    return found.select("session_id", F.col("idx").alias("span_start"), F.col("idx").alias("span_end"), F.lit(1).alias("value"))


@detector("FULL_FILE_REWRITE", "low", "event", needs=("category", "path", "lines"), lines=50)
def full_file_rewrite(k):
    """A long file that was there before is written anew."""
    return Finding(is_whole() & (F.col("touch") > 1) & (F.col("lines") >= k["lines"]), F.col("lines"), F.col("idx"))


def polling() -> Column:
    """Calls that come again by design: of subagents, and MCP tools that wait, list or poll."""
    return F.coalesce(F.col("category") == "subagent", F.lit(False)) | F.coalesce(F.col("tool").rlike(r"^mcp[._]") & F.col("tool").rlike("(?i)wait|list|poll"), F.lit(False))


@detector("RETRY_STORM", "medium", "table", needs=("signature", "ok"), least=4, rows=40)
def retry_storm(rows, k):
    """One call with the same arguments again and again within a window of logical events, nothing else
    written between, one of them truly failed; the first such run of a call."""
    calls = rows.filter(is_call() & F.col("signature").isNotNull() & ~polling())
    own = Window.partitionBy("session_id", "tool", "signature").orderBy("idx")
    others = F.col("writes") - F.sum(s.flag(is_write())).over(own.rowsBetween(Window.unboundedPreceding, 0))
    run = Window.partitionBy("session_id", "tool", "signature", "others").orderBy("pos").rangeBetween(0, k["rows"])
    real = F.sum(s.flag(F.col("r_failed") & ~F.col("r_benign"))).over(run)
    found = calls.withColumn("others", others).withColumns({"n": F.count("*").over(run), "real": real, "last": F.max("idx").over(run)})
    found = found.filter((F.col("n") >= k["least"]) & (F.col("real") > 0)).groupBy("session_id", "tool", "signature")
    return found.agg(F.min("idx").alias("span_start"), F.min_by("last", "idx").alias("span_end"), F.min_by("n", "idx").alias("value"))


@detector("NO_ADAPT_RETRY", "medium", "table", needs=("signature", "ok", "tool"), least=2, distance=5)
def no_adapt_retry(rows, k):
    """Consecutive failing calls of one tool whose arguments hardly change; any other call or user message
    between ends the run, and killed runs are no failures."""
    from .facts import killed

    key = F.trim(F.regexp_replace(F.coalesce("command", "signature"), r"\s+", " "))
    failed = is_call() & F.col("r_failed") & ~killed(F.col("r_exit"), F.col("r_error"), F.col("r_text"))
    acts = rows.filter(is_call() | is_user()).withColumns({"key": key, "failed": failed})
    w = s.session()
    apart = F.levenshtein(F.col("key"), F.lag("key").over(w), k["distance"] - 1)
    allowed = F.greatest(F.lit(1), F.floor(F.least(F.length("key"), F.length(F.lag("key").over(w))) / 4))
    near = F.col("failed") & F.lag("failed").over(w) & (F.lag("tool").over(w) == F.col("tool")) & (apart >= 0) & (apart <= allowed)
    acts = acts.withColumn("near", F.coalesce(near, F.lit(False))).withColumn("island", F.sum(s.flag(~F.col("near"))).over(s.upto()))
    found = acts.filter("failed").groupBy("session_id", "island").agg(F.min("idx").alias("span_start"), F.max("idx").alias("span_end"), F.count("*").alias("value"))
    return found.filter(F.col("value") >= k["least"])


@detector("ASSUMING_NOT_OBSERVING", "low", "session", needs=("text",), claim=_CLAIM)
def assuming(k, c):
    """A claim about the program before anything was looked at; the first of a session."""
    return Finding(c("idx").isNotNull(), F.lit(1), c("idx"), aggregates={"idx": F.min(_idx(is_said() & F.col("text").rlike(k["claim"]) & ~F.col("observed")))})


@detector("TEST_GAMING", "high", "event", needs=("category", "error", "path", "old_text", "new_text"), path=TEST_PATH)
def test_gaming(k):
    """After a failed test run, an edit of a test's path that adds a skip or removes asserts."""
    old, new = (F.coalesce(c, F.lit("")) for c in ("old_text", "new_text"))
    asserts = lambda c: F.regexp_count(c, F.lit(_ASSERT))
    loosened = (new.rlike(_SKIP) & ~old.rlike(_SKIP)) | (asserts(old) > asserts(new))
    return Finding(is_write() & F.col("test_failed").isNotNull() & F.col("path").rlike(k["path"]) & loosened, F.lit(1), F.col("idx"))


@detector("PANIC_REVERT", "high", "session", needs=("command", "error"), rows=5, revert=_REVERT)
def panic_revert(k, c):
    """A revert soon after a failing test; the first of a session."""
    hit = is_exec() & F.col("command").rlike(k["revert"]) & (F.col("idx") - F.col("test_failed") <= k["rows"])
    return Finding(c("idx").isNotNull(), F.lit(1), c("failed"), c("idx"), {"idx": F.min(_idx(hit)), "failed": F.min_by("test_failed", _idx(hit))})


@detector("ACTING_ON_QUESTION", "medium", "event", needs=("text", "category"), words=tuple(LEXICONS["interrogative"]))
def acting_on_question(k):
    """A question is followed by a write before the user speaks again."""
    hit = is_user() & tx.asks(F.col("text"), k["words"]) & (F.col("next_write") < F.coalesce("next_user", F.lit(1 << 62)))
    return Finding(hit, F.lit(1), F.col("idx"), F.col("next_write"))


@detector("PERMISSION_FRICTION", "low", "table", needs=("error", "command"), least=2)
def permission_friction(rows, k):
    """The same command meets a permission error again."""
    denied = rows.filter(is_result() & (F.col("ok") == F.lit(False)) & (F.col("error") == "permission")).groupBy("session_id", F.coalesce("c_command", F.lit("?")).alias("of"))
    return denied.agg(F.min("idx").alias("span_start"), F.max("idx").alias("span_end"), F.count("*").alias("value")).filter(F.col("value") >= k["least"])


def _errors(category: str):
    def rule(k, c):
        hit = is_result() & (F.col("ok") == F.lit(False)) & (F.col("error") == category)
        return Finding(c("n") >= k["least"], c("n"), c("a"), c("b"), {"n": F.count_if(hit), "a": F.min(_idx(hit)), "b": F.max(_idx(hit))})

    return rule


detector("SANDBOX_EGRESS_FAIL", "low", "session", needs=("error",), least=1)(_errors("sandbox_egress"))
detector("TOOL_ARG_MALFORMED", "medium", "session", needs=("error",), least=1)(_errors("agent_syntax_error"))
detector("MCP_TRANSPORT_ERR", "low", "session", needs=("error",), least=1)(_errors("mcp_transport"))
detector("RATE_LIMIT_LOOP", "low", "session", needs=("error",), least=2)(_errors("rate_limit"))


@detector("PERFECTIONISM_LOOP", "low", "session", needs=("category", "command"), least=2)
def perfectionism_loop(k, c):
    """Writes after the last passing test with no later user message."""
    later = is_write() & (F.col("idx") > F.col("last_pass"))
    found = {"n": F.count_if(later), "a": F.min(_idx(later)), "b": F.max(_idx(later)), "spoke": F.bool_or(is_user() & (F.col("idx") > F.col("last_pass")))}
    return Finding((c("n") >= k["least"]) & ~F.coalesce(c("spoke"), F.lit(False)), c("n"), c("a"), c("b"), found)


@detector("OVER_ENGINEERING", "low", "session", needs=("text", "category"), files=3, fix=_FIX, creep=_CREEP)
def over_engineering(k, c):
    """A request to fix ends in many new files, or the assistant proposes more than was asked."""
    found = {
        "text": _opener("text"), "asked": F.min(_idx(is_user())), "files": F.count_if(is_whole() & (F.col("touch") == 1)),
        "creep": F.min(_idx(is_said() & F.col("text").rlike(k["creep"]))),
    }
    many = F.coalesce(c("text").rlike(k["fix"]), F.lit(False)) & (c("files") >= k["files"])
    return Finding(many | c("creep").isNotNull(), F.when(many, c("files")).otherwise(1), F.when(many, c("asked")).otherwise(c("creep")), aggregates=found)


@detector("GOAL_DRIFT", "low", "session", needs=("text", "category", "path"), recall=0.2)
def goal_drift(k, c):
    """Hardly any of the source files that the first message names are edited."""
    source = lambda p: p.rlike(tx.SOURCE)
    asked = F.filter(F.regexp_extract_all(c("text"), F.lit(tx.PATHS), 0), lambda p: source(p) & ~p.rlike(tx.DOCUMENTS))
    asked = F.array_distinct(F.transform(asked, tx.basename))
    found = {"text": _opener("text"), "idx": F.min(_idx(is_user())), "edited": F.collect_set(F.when(is_write() & source(F.col("path")), tx.basename(F.col("path"))))}
    value = F.size(F.array_intersect(asked, c("edited"))) / F.nullif(F.size(asked), F.lit(0))
    return Finding((F.size(asked) > 0) & (F.size(c("edited")) > 0) & (value < k["recall"]), value, c("idx"), aggregates=found)


def _after_edit() -> Column:
    return F.col("idx") > F.col("last_edit")


def _completion(words) -> dict[str, Column]:
    tests = is_exec() & (F.col("intent") == "build_test") & _after_edit()
    return {
        "edit": F.max("last_edit"), "claim": F.max(_idx(is_said() & _after_edit() & F.coalesce("final", F.lit(True)) & F.col("text").rlike(tx.words_pattern(words)))), "tests": F.collect_set(F.when(tests, F.col("command"))),
        "paths": F.collect_set(F.when(is_write() & F.col("path").rlike(tx.CODE), F.col("path"))),
    }


def exercises(command: Column, paths: Column) -> Column:
    """Whether a test run can have exercised one of the files: it names none, or one of them or its test."""
    named = r"(?:^|\s)((?:[\w.-]+/)*[\w.-]+\.[A-Za-z0-9]{1,6})(?=\s|$)"
    of = lambda seg: F.filter(F.regexp_extract_all(seg, F.lit(named), 1), lambda f: f.rlike(tx.CODE))
    same = lambda f, p: (tx.basename(f) == tx.basename(p)) | ((F.length(tx.stem(p)) >= 3) & F.contains(tx.stem(f), tx.stem(p)))
    runs = F.filter(tx.split_segments(command), lambda seg: tx.segment_intent(seg) == "build_test")
    return F.exists(runs, lambda seg: (F.size(of(seg)) == 0) | F.exists(of(seg), lambda f: F.exists(paths, lambda p: same(f, p))))


@detector("LOOKS_RIGHT_RUNS_WRONG", "medium", "session", needs=("text", "category", "command"), words=tuple(LEXICONS["completion"]))
def looks_right(k, c):
    """Code is edited and declared done, and no later test run can have exercised it."""
    ran = F.exists(c("tests"), lambda t: exercises(t, c("paths")))
    return Finding(c("edit").isNotNull() & c("claim").isNotNull() & ~ran, F.size(c("paths")), c("edit"), aggregates=_completion(k["words"]))


@detector("UNVERIFIED_COMPLETION", "medium", "session", needs=("text", "category", "command"), words=tuple(LEXICONS["completion"]))
def unverified_completion(k, c):
    """Code is edited and declared done, and no test runs after."""
    return Finding(c("edit").isNotNull() & c("claim").isNotNull() & (F.size(c("tests")) == 0), F.lit(1), c("edit"), aggregates=_completion(k["words"]))


@detector("SILENT_ERROR_SWALLOW", "medium", "event", needs=("ok", "text"))
def silent_error_swallow(k):
    """A true failure is followed by the turn's answer, with no call and no word about it between."""
    far = F.lit(1 << 62)
    answer = F.col("next_terminal")
    swallowed = (answer < F.coalesce("next_end", far)) & (answer < F.coalesce("next_call", far)) & (answer < F.coalesce("next_ack", far))
    return Finding(is_result() & (F.col("ok") == F.lit(False)) & ~F.col("benign") & swallowed, F.lit(1), F.col("idx"), answer)


@detector("COMPACTION_AMNESIA", "medium", "table", needs=("category", "path"), rows=20)
def compaction_amnesia(rows, k):
    """Soon after a compaction and before the user speaks, paths are read that were read before it."""
    again = is_read() & (F.col("read_first") < F.col("compacted")) & (F.col("pos") - F.col("compacted_pos") <= k["rows"]) & (F.col("scope") < F.col("compacted"))
    paths = rows.filter(again).groupBy("session_id", "compacted", "path").agg(F.min("idx").alias("idx"))
    return paths.groupBy("session_id", F.col("compacted").alias("span_start")).agg(F.max("idx").alias("span_end"), F.count("*").alias("value"))


@detector("STYLE_IMPOSITION", "low", "table", needs=("text", "new_text", "category"))
def style_imposition(rows, k):
    """An edit imports a module that no output of the session names; the first of a session that has outputs."""
    outputs = rows.filter(is_result() & (F.length(F.trim(F.coalesce("text", F.lit("")))) > 0)).select("session_id", F.col("text").alias("said"))
    imports = rows.filter(is_write()).select("session_id", "idx", F.explode(tx.imported(F.coalesce("new_text", F.lit("")))).alias("module"))
    names = imports.select("session_id", "module").distinct()
    seen = names.join(outputs, "session_id").filter(F.contains("said", "module")).select("session_id", "module").distinct()
    found = imports.join(outputs.select("session_id").distinct(), "session_id", "left_semi").join(seen, ["session_id", "module"], "left_anti")
    return found.groupBy("session_id").agg(F.min("idx").alias("span_start"), F.min("idx").alias("span_end"), F.lit(1).alias("value"))


@detector("CREDENTIAL_LEAK", "high", "event", needs=("text",), secrets=tuple(LEXICONS["secret"]))
def credential_leak(k):
    """A secret in what the assistant says or hands to a tool; the value is the length of what matched."""
    found = F.length(F.regexp_extract(F.concat_ws("\n", "text", "command", "path", "old_text", "new_text"), "|".join(f"(?:{p})" for p in k["secrets"]), 0))
    return Finding((is_said() | is_call()) & (found > 0), found, F.col("idx"))


@detector("RUNAWAY_SESSION", "medium", "session", needs=("ok", "ts"), events=400, tokens=150_000, minutes=90, idle=10.0, words=tuple(LEXICONS["positive"]))
def runaway_session(k, c):
    """A cap on events, tokens or active minutes is passed, and the session does not end well: by an answer marked
    as final after the last user message, by a user's praise after an answer, or by a passing test and a commit."""
    praise = is_user() & (F.col("idx") == F.col("last_user")) & F.col("text").rlike(tx.words_pattern(k["words"]))
    found = {
        "n": F.count_if("logical"), "tokens": _tokens(), "minutes": F.sum(F.when((F.col("gap") >= 0) & (F.col("gap") <= 60 * k["idle"]), F.col("gap"))) / 60, "stamped": _stamped(),
        "praised": F.bool_or(praise), "answered": F.bool_or(is_said() & (F.col("idx") < F.col("last_user"))), "passed": F.max("last_pass").isNotNull(),
        "committed": F.bool_or(is_exec() & F.lower("command").contains("git commit")), "a": F.min("idx"), "b": F.max("idx"), "concluded": F.max("last_end") > F.coalesce(F.max("last_user"), F.lit(-1)),
    }
    yes = lambda x: F.coalesce(x, F.lit(False))
    over = (c("n") > k["events"]) | yes(c("tokens") > k["tokens"]) | yes(c("stamped") & (c("minutes") > k["minutes"]))
    well = yes(c("concluded")) | (yes(c("praised")) & yes(c("answered"))) | (c("passed") & yes(c("committed")))
    return Finding(over & ~well, c("n"), c("a"), c("b"), found)
