"""Tail measurements: incidents (kind, cohort, session_id, idx, value), their distributions and observations.

Every measure takes facts() of decoded events. Values are measured burdens; none claims that anything was wasted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright import config
from tracewright.functions import text as tx

from . import handovers as h
from . import sequence as s
from .facts import is_call, is_read, is_user, named
from .ranks import ranked_values

#: How grave an observation of each kind is; its threshold is a setting.
SEVERITIES = {
    "tool_latency": "low", "parent_wait": "low", "delegation_lifetime": "info", "delegation_open": "info", "retry_attempts": "medium", "failure_chain": "medium",
    "output_volume": "low", "poll_amplification": "low", "model_input": "low", "model_output": "low", "delegation_fanout": "low", "context_replay": "low", "cache_creation": "low",
    "status_probes": "low", "inspection_rounds": "info", "output_repetition": "low", "delegation_repetition": "low", "verification_repetition": "low", "cache_rebuilds": "low",
}
THRESHOLDS = {k: (config.DEFAULTS["tails"][k], v) for k, v in SEVERITIES.items()}
#: Tools that wait for a subagent, and that ask how things stand.
WAITS = ("wait_agent", "get_subagent_result", "wait", "collaboration.wait_agent")
POLLS = (*WAITS, "write_stdin", "functions.write_stdin", "list_agents", "collaboration.list_agents")
#: How an output says that what it started still runs.
_RUNNING = r"(?i)\b(?:process|script|agent) (?:is (?:still )?)?running\b|\brunning in (?:the )?background\b"


def is_poll() -> Column:
    return is_call() & named(F.col("tool"), POLLS)


def is_usage() -> Column:
    return F.col("kind") == "usage"


def is_inspection() -> Column:
    return is_read() | (is_call() & F.coalesce(F.col("intent") == "inspect", F.lit(False)))


def _key() -> Column:
    return F.coalesce("signature", "tool", F.lit(""))


def status_probe(tool: Column, signature: Column) -> Column:
    """Asks how things stand without waiting."""
    name = F.regexp_extract(F.lower(tool), r"([^.]*)$", 1)
    at_once = F.coalesce(signature.rlike(r"\"timeout_ms\"\s*:\s*0\b|\"wait\"\s*:\s*false"), F.lit(False))
    idle = (name == "write_stdin") & F.coalesce(signature.rlike(r"\"yield_time_ms\"\s*:\s*0\b") & ~signature.rlike(r"\"chars\"\s*:\s*\"[^\"]"), F.lit(False))
    return F.coalesce((name == "list_agents") | (name.isin("get_subagent_result", "wait_agent", "wait_threads") & at_once) | idle, F.lit(False))


def _incident(rows: DataFrame, kind: str | Column, value: Column, cohort: Column | None = None, idx: str = "idx") -> DataFrame:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    name = F.concat_ws(":", kind, F.coalesce(cohort, F.lit("unknown"))) if cohort is not None else kind
    return rows.select(kind.alias("kind"), name.alias("cohort"), "session_id", F.col(idx).cast("long").alias("idx"), value.cast("double").alias("value"))


def model_usage(rows: DataFrame) -> DataFrame:
    """Uncached input and output of each response, by model."""
    each = F.array(*(F.struct(F.lit(f"model_{c}").alias("name"), F.col(c).alias("tokens")) for c in ("input", "output")))
    found = rows.filter(is_usage()).select("session_id", "idx", "model", F.inline(each)).filter("tokens >= 0")
    return _incident(found, F.col("name"), F.col("tokens"), F.col("model"))


def round_trips(rows: DataFrame) -> DataFrame:
    """Seconds from a call to its only result, by tool; waits for subagents are apart."""
    seconds = (F.unix_micros(F.col("r_ts").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 1e6
    found = rows.filter("paired").withColumn("seconds", seconds).filter("seconds >= 0")
    return _incident(found, F.when(named(F.col("tool"), WAITS), "parent_wait").otherwise("tool_latency"), F.col("seconds"), F.col("tool"))


def output_volume(rows: DataFrame) -> DataFrame:
    """Characters of each call's output, by tool."""
    return _incident(rows.filter("paired and r_size >= 0"), "output_volume", F.col("r_size"), F.col("tool"))


def _attempts(rows: DataFrame) -> DataFrame:
    """Calls and user messages but polls, with what ends all open lists: user messages and calls without one result."""
    acts = rows.filter((is_call() & ~is_poll()) | is_user())
    stops = is_user() | ~F.col("paired")
    return acts.withColumns({"stops": stops, "barrier": F.sum(s.flag(stops)).over(s.upto()), "failed": ~stops & F.col("r_failed"), "key": _key()})


def retry_attempts(rows: DataFrame) -> DataFrame:
    """Attempts of one call up to its success, a user message or a call without one result; two failures at least."""
    own = Window.partitionBy("session_id", "key", "barrier").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    tried = _attempts(rows).filter("not stops")
    tried = tried.withColumn("closed", F.coalesce(F.sum(s.flag(~F.col("failed"))).over(own), F.lit(0)))
    found = tried.groupBy("session_id", "key", "barrier", "closed").agg(F.count("*").alias("attempts"), F.count_if("failed").alias("failures"), F.min("idx").alias("idx"))
    return _incident(found.filter("attempts >= 2 and failures >= 2"), "retry_attempts", F.col("attempts"))


def failure_chain(rows: DataFrame) -> DataFrame:
    """Three failed calls or more with no success, user message or call without one result between; polls
    neither extend nor end a chain."""
    runs = _attempts(rows).withColumn("island", F.sum(s.flag(~F.col("failed"))).over(s.upto())).filter("failed")
    found = runs.groupBy("session_id", "island").agg(F.count("*").alias("failures"), F.min("idx").alias("idx"))
    return _incident(found.filter("failures >= 3"), "failure_chain", F.col("failures"))


def poll_amplification(rows: DataFrame) -> DataFrame:
    """Three equal polls or more with no other kind of call and no user message between."""
    acts = rows.filter(is_call() | is_user()).withColumn("island", F.sum(s.flag(~is_poll())).over(s.upto())).filter(is_poll())
    found = acts.groupBy("session_id", "island", _key().alias("key")).agg(F.count("*").alias("polls"), F.min("idx").alias("idx"))
    return _incident(found.filter("polls >= 3"), "poll_amplification", F.col("polls"))


def _per_request(rows: DataFrame, kind: str, hit: Column, value: Column, least: int) -> DataFrame:
    found = rows.filter(hit & (F.col("scope") >= 0)).groupBy("session_id", "scope").agg(F.count("*").alias("n"), value.alias("value"), F.min("idx").alias("idx"))
    return _incident(found.filter(F.col("n") >= least), kind, F.col("value"))


def delegation_fanout(rows: DataFrame) -> DataFrame:
    """Subagents started in one request, two at least."""
    return _per_request(rows, "delegation_fanout", h.is_spawn(), F.count("*"), 2)


def context_replay(rows: DataFrame) -> DataFrame:
    """Cached tokens read in one request, by five responses at least."""
    return _per_request(rows, "context_replay", is_usage() & (F.col("cache_read") > 0), F.sum("cache_read"), 5)


def cache_creation(rows: DataFrame) -> DataFrame:
    """Cached tokens written in one request, by five responses at least."""
    return _per_request(rows, "cache_creation", is_usage() & (F.col("cache_write") > 0), F.sum("cache_write"), 5)


def rounds(rows: DataFrame) -> DataFrame:
    """Responses with exactly one usage row, with what their calls do: no_tools, inspection, coordination,
    execution or mixed; session_id, response_id, idx, scope, model, tokens, calls, category."""
    of = rows.filter((is_usage() | is_call()) & F.col("response_id").isNotNull()).groupBy("session_id", "response_id")
    calls = lambda c: F.count_if(is_call() & c) == F.count_if(is_call())
    category = (
        F.when(F.count_if(is_call()) == 0, "no_tools").when(calls(is_inspection()), "inspection").when(calls(h.is_coordination()), "coordination")
        .when(calls(F.col("category").isin("execute", "write")), "execution").otherwise("mixed")
    )
    pick = lambda c: F.max(F.when(is_usage(), F.col(c))).alias(c)
    found = of.agg(F.count_if(is_usage()).alias("n"), F.min("idx").alias("idx"), F.count_if(is_call()).alias("calls"), category.alias("category"), *(pick(c) for c in ("scope", "model", "input", "output", "cache_read", "cache_write")))
    return found.filter("n = 1").drop("n")


def model_activity(rows: DataFrame) -> DataFrame:
    """Rounds, calls and tokens by what the rounds do, by model and by whether any of their token counts is missing."""
    tokens = ("input", "output", "cache_read", "cache_write")
    part = rounds(rows).withColumn("incomplete", reduce(lambda a, b: a | b, (F.col(c).isNull() for c in tokens)))
    return part.groupBy("category", "model", "incomplete").agg(F.count("*").alias("rounds"), F.sum("calls").alias("calls"), *(F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in tokens))


def inspection_rounds(rows: DataFrame) -> DataFrame:
    """Responses of one request that only look at things, three at least."""
    found = rounds(rows).filter("category = 'inspection'").groupBy("session_id", "scope").agg(F.count("*").alias("n"), F.min("idx").alias("idx"))
    return _incident(found.filter("n >= 3"), "inspection_rounds", F.col("n"))


def status_probes(rows: DataFrame) -> DataFrame:
    """Calls of one request that ask how things stand, three at least."""
    hit = F.col("paired") & status_probe(F.col("tool"), F.col("signature"))
    found = rows.filter(hit).groupBy("session_id", "scope").agg(F.count("*").alias("n"), F.min("idx").alias("idx"))
    return _incident(found.filter("n >= 3"), "status_probes", F.col("n"))


def output_repetition(rows: DataFrame) -> DataFrame:
    """Characters that equal inspections of one request say again, a thousand at least."""
    looked = rows.filter(F.col("paired") & F.col("r_ok") & is_inspection() & F.col("r_text").isNotNull())
    found = looked.groupBy("session_id", "scope", _key().alias("key"), F.sha2("r_text", 256).alias("digest")).agg(
        F.count("*").alias("n"), F.min("r_size").alias("least"), F.max("r_size").alias("most"), F.min("idx").alias("idx")
    )
    extra = F.col("most") * (F.col("n") - 1)
    return _incident(found.filter((F.col("n") >= 2) & (F.col("least") == F.col("most")) & (extra >= 1000)), "output_repetition", extra)


def verification_repetition(rows: DataFrame) -> DataFrame:
    """Checks of one request with the same arguments that came back well, without the first."""
    together = F.col("next_user").isNull() | (F.col("next_user") > F.col("r_idx"))
    well = F.col("r_ok") & (F.coalesce("r_exit", F.lit(0)) == 0) & ~(F.col("r_exit").isNull() & F.coalesce(F.col("r_text").rlike(_RUNNING), F.lit(False)))
    checks = rows.filter(F.col("paired") & well & together & tx.check_command(F.col("command")))
    found = checks.groupBy("session_id", "scope", _key().alias("key")).agg(F.count("*").alias("n"), F.min("idx").alias("idx"))
    return _incident(found.filter("n >= 2"), "verification_repetition", F.col("n") - 1)


def cache_rebuilds(rows: DataFrame, tokens: int = config.DEFAULTS["tails"]["cache_rebuild_tokens"]) -> DataFrame:
    """Responses of one request that write a cache anew, right after one of the same model read from it."""
    w = s.session()
    last = {f"last_{c}": F.lag(c).over(w) for c in ("cache_read", "model", "scope", "idx")}
    used = rows.filter(is_usage()).withColumns(last)
    warm = (F.col("last_cache_read") > 0) & (F.col("cache_read") == 0) & (F.col("cache_write") >= tokens)
    same = (F.col("model") == F.col("last_model")) & (F.col("scope") == F.col("last_scope")) & (F.col("scope") >= 0) & (F.coalesce("compacted", F.lit(-1)) < F.col("last_idx"))
    found = used.filter(warm & same).groupBy("session_id", "scope").agg(F.count("*").alias("n"), F.min("last_idx").alias("idx"))
    return _incident(found, "cache_rebuilds", F.col("n"))


def delegations(rows: DataFrame) -> DataFrame:
    """Seconds from a subagent's start to its end, or as far as the log goes while none is seen."""
    ended = h.handovers(rows)
    open_for = F.when(F.col("status").isin("running", "unknown"), F.col("open_seconds"))
    found = ended.withColumn("value", F.coalesce("seconds", open_for)).filter("value >= 0")
    return _incident(found, F.when(F.col("seconds").isNotNull(), "delegation_lifetime").otherwise("delegation_open"), F.col("value"))


def delegation_repetition(rows: DataFrame) -> DataFrame:
    """Reviews handed out after earlier ones of the same request, over some of the same files, had come back."""
    found = h.repeated(h.handovers(rows))
    return _incident(found, "delegation_repetition", F.col("earlier"))


MEASURES = (
    model_usage, round_trips, output_volume, retry_attempts, failure_chain, poll_amplification, delegation_fanout, context_replay, cache_creation, inspection_rounds,
    status_probes, output_repetition, verification_repetition, cache_rebuilds, delegations, delegation_repetition,
)


#: Those that window or group a session's rows, without joins.
GATHERED = (
    retry_attempts, failure_chain, poll_amplification, delegation_fanout, context_replay, cache_creation, inspection_rounds, status_probes, output_repetition,
    verification_repetition, cache_rebuilds,
)


def incidents(rows: DataFrame, tasks: int | None = None, measures: tuple = MEASURES) -> DataFrame:
    """The measurements of facts(), all of them unless told otherwise. A checkpoint does not know any more how its rows were dealt; `tasks` is over how
    many tasks its sessions are dealt again, as adaptive execution would put them together by their bytes."""
    dealt = rows if tasks is None else rows.repartition(tasks, "session_id")
    return reduce(DataFrame.unionByName, (m(dealt if m in GATHERED else rows) for m in measures))


def coverage(rows: DataFrame) -> DataFrame:
    """How much of the calls the measurements could use."""
    return rows.filter(is_call()).agg(
        F.count("*").alias("calls"), F.count_if("paired").alias("paired"), F.count_if(~F.col("paired")).alias("unpaired"),
        F.count_if(F.col("paired") & F.col("ts").isNotNull() & F.col("r_ts").isNotNull()).alias("timed"), F.count_if(F.col("paired") & F.col("r_size").isNotNull()).alias("sized"),
    )


def distributions(found: DataFrame) -> DataFrame:
    """N, median, nearest-rank p95 and p99, maximum and the share of the top 1 % of every cohort.

    The median is the true one; p95 and p99 are values of the cohort."""
    rows = ranked_values(found, ["kind", "cohort"], "value")
    first = F.col("size") - F.col("above") - F.col("n")  # how many values are smaller
    at = lambda place: F.max(F.when((first < place) & (place <= first + F.col("n")), F.col("value")))
    size = F.col("size")
    top = F.greatest(F.lit(0), F.least(F.col("n"), F.greatest(F.lit(1), F.ceil(size * 0.01)) - F.col("above")))
    return rows.groupBy("kind", "cohort").agg(
        F.max("size").alias("n"),
        F.round((at(F.floor((size + 1) / 2)) + at(F.floor(size / 2) + 1)) / 2, 6).alias("p50"),
        F.round(at(F.ceil(size * 0.95)), 6).alias("p95"),
        F.round(at(F.ceil(size * 0.99)), 6).alias("p99"),
        F.round(F.max("value"), 6).alias("largest"),
        F.round(F.sum(F.col("value") * top) / F.sum(F.col("value") * F.col("n")), 6).alias("top_share"),
    )


def retained(found: DataFrame, most: int = 10, scale: float = 1.0) -> DataFrame:
    """The `most` largest of each cohort, with their place, and all others that reach their threshold, with the
    ratio to the median where the cohort has five values. Only the largest of each task meet to be placed."""
    limit = F.create_map(*(F.lit(x) for k, (t, _) in THRESHOLDS.items() for x in (k, float(t) * scale)))
    order = Window.partitionBy("cohort").orderBy(F.col("value").desc(), "session_id", "idx")
    top = found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)
    keys = ["kind", "cohort", "session_id", "idx", "value"]
    beyond = found.filter(F.col("value") >= limit[F.col("kind")]).join(top.select(*keys), keys, "left_anti").withColumn("place", F.lit(None).cast("int"))
    shape = distributions(found).select(F.col("cohort").alias("of"), "n", "p50")
    placed = top.unionByName(beyond).withColumn("exceeds", F.col("value") >= limit[F.col("kind")])
    placed = placed.join(shape, F.col("cohort") == F.col("of"))
    ratio = F.when((F.col("n") >= 5) & (F.col("p50") > 0), F.round(F.col("value") / F.col("p50"), 6))
    return placed.select("kind", "cohort", "session_id", "idx", F.round("value", 6).alias("value"), F.col("place").cast("long").alias("place"), "exceeds", ratio.alias("median_ratio"))


def _reached(scale: float) -> Column:
    limit = F.create_map(*(F.lit(x) for k, (t, _) in THRESHOLDS.items() for x in (k, float(t) * scale)))
    return F.col("value") >= limit[F.col("kind")]


def _observed() -> list[Column]:
    severity = F.create_map(*(F.lit(x) for k, (_, v) in THRESHOLDS.items() for x in (k, v)))
    return [F.concat(F.lit("TAIL_"), F.upper("kind")).alias("detector"), severity[F.col("kind")].alias("severity")]


def observations(found: DataFrame, scale: float = 1.0) -> DataFrame:
    """A finding for every incident that reaches its kind's threshold."""
    detector, severity = _observed()
    return found.filter(_reached(scale)).select(detector, F.lit("observation").alias("kind"), severity, "session_id", "idx", F.round("value", 6).alias("value"))


def tallies(found: DataFrame, scale: float = 1.0) -> DataFrame:
    """The incidents of each kind in one pass: kind, n, sessions, total (of the values), and detector, severity,
    observed, observed_sessions of those that reach the threshold. A session's incidents of a kind are one row before
    sessions are counted, so no set of sessions is held."""
    per = found.groupBy("session_id", "kind").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.count_if(_reached(scale)).alias("observed"))
    per = per.groupBy("kind").agg(
        F.sum("n").alias("n"), F.count("session_id").alias("sessions"), F.sum("total").alias("total"), F.sum("observed").alias("observed"),
        F.count(F.when(F.col("observed") > 0, F.col("session_id"))).alias("observed_sessions"),
    )
    return per.select("*", *_observed())
