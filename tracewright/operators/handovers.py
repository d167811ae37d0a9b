"""Work handed to subagents: launches, what becomes of them, and launches that repeat earlier ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions import text as tx

from .facts import is_call, is_result

#: Tools that start, steer, wait for and end subagents.
SPAWNS = ("agent", "task", "spawn_agent", "create_thread", "fork_thread")
STEERS = ("steer_subagent", "send_message", "send_message_to_agent", "send_message_to_thread")
WAITS = ("get_subagent_result", "wait_agent", "wait_threads", "wait")
ENDS = ("interrupt_agent", "close_agent")
#: Words of a request to review, and how a text names a subagent.
_REVIEW = r"(?i)\b(?:review|audit|verify|verification|validate|validation|qa|fact.check)\b"
_AGENT = r"(?i)\bagent[_ -]?id\b[\"']?\s*[:=]\s*[\"']?([\w-]+)|\b([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})\b"


def tool_name(tool: Column) -> Column:
    """The last part of a tool's name, lower case."""
    return F.regexp_replace(F.regexp_extract(F.lower(tool), r"([^.]*)$", 1), r"^mcp__codex_app__(?:.*__)?", "")


def _is(tool: Column, names: tuple[str, ...]) -> Column:
    return F.coalesce(tool_name(tool).isin(*names), F.lit(False))


def is_spawn() -> Column:
    return is_call() & _is(F.col("tool"), SPAWNS)


def is_coordination() -> Column:
    return is_call() & (F.coalesce(F.col("category") == "subagent", F.lit(False)) | _is(F.col("tool"), (*SPAWNS, *STEERS, *WAITS, *ENDS, "list_agents")))


def coordination_kind(tool: Column, probe: Column) -> Column:
    """Poll, spawn, steer, wait, control or other."""
    return (
        F.when(probe, "poll").when(_is(tool, SPAWNS), "spawn").when(_is(tool, STEERS), "steer").when(_is(tool, WAITS), "wait").when(_is(tool, ENDS), "control").otherwise("other")
    )


def agent_of(text: Column) -> Column:
    """The subagent that a text names: an agent id, else the first UUID."""
    found = F.coalesce(F.nullif(F.regexp_extract(text, _AGENT, 1), F.lit("")), F.nullif(F.regexp_extract(text, _AGENT, 2), F.lit("")))
    return found


def handovers(rows: DataFrame) -> DataFrame:
    """A row a launch in facts(): session_id, idx, scope, agent, files, review, status, returned (the idx
    of the result that ended it), seconds, open_seconds.

    A launch whose own result names a subagent ends with the first later result or message that names it and does not
    say that it still runs; any other ends with its own result. A failed own result means that it was refused."""
    spawned = rows.filter(is_spawn() & F.col("paired")).withColumns({"agent": agent_of(F.col("r_text")), "micros": F.unix_micros(F.col("ts").cast("timestamp"))})
    unpaired = rows.filter(is_spawn() & ~F.col("paired")).withColumns({"agent": F.lit(None).cast("string"), "micros": F.unix_micros(F.col("ts").cast("timestamp"))})
    launches = spawned.unionByName(unpaired).select(
        "session_id", "idx", "scope", "agent", "micros", "r_idx", "r_ok", F.unix_micros(F.col("r_ts").cast("timestamp")).alias("r_micros"), "paired",
        F.array_distinct(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(tx.PATHS), 0)).alias("files"), F.coalesce(F.col("text").rlike(_REVIEW), F.lit(False)).alias("review"),
    )
    told = rows.filter((is_result() | (F.col("kind") == "notification")) & F.col("text").isNotNull() & ~F.col("text").rlike(r"(?i)\bstill running\b|\bStatus:\s*running\b"))
    told = told.select("session_id", F.col("idx").alias("at"), agent_of(F.col("text")).alias("agent"), F.coalesce("ok", F.lit(True)).alias("fine"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at_micros"))
    met = launches.filter("agent is not null").join(told.filter("agent is not null"), ["session_id", "agent"]).filter("at > r_idx")
    ends = met.groupBy("session_id", "idx").agg(F.min(F.struct("at", "fine", "at_micros")).alias("end"))
    last = rows.groupBy("session_id").agg(F.max(F.unix_micros(F.col("ts").cast("timestamp"))).alias("last_micros"))
    joined = launches.join(ends, ["session_id", "idx"], "left").join(last, "session_id")
    own = F.col("paired") & F.col("agent").isNull()
    returned = F.coalesce("end.at", F.when(own, F.col("r_idx")))
    at = F.coalesce("end.at_micros", F.when(own, F.col("r_micros")))
    refused = F.col("paired") & ~F.coalesce("r_ok", F.lit(True))
    status = (
        F.when(refused, "refused").when(F.col("end").isNotNull(), F.when(F.col("end.fine"), "completed").otherwise("failed")).when(own, "completed")
        .when(F.col("agent").isNotNull(), "running").otherwise("unknown")
    )
    return joined.select(
        "session_id", "idx", "scope", "agent", "files", "review", status.alias("status"), F.when(~refused, returned).alias("returned"),
        F.when(~refused, (at - F.col("micros")) / 1e6).alias("seconds"), ((F.col("last_micros") - F.col("micros")) / 1e6).alias("open_seconds"),
    )


def repeated(launches: DataFrame) -> DataFrame:
    """Reviews that follow others of the same request over some of the same files, which had come back before: the
    number of those."""
    reviews = launches.filter("review and status <> 'refused'")
    earlier = reviews.filter("returned is not null").select("session_id", "scope", F.col("idx").alias("p_idx"), F.col("returned").alias("p_returned"), F.col("files").alias("p_files"))
    met = reviews.join(earlier, ["session_id", "scope"]).filter((F.col("p_idx") < F.col("p_returned")) & (F.col("p_returned") < F.col("idx")) & F.arrays_overlap("files", "p_files"))
    return met.groupBy("session_id", "idx").agg(F.count("*").alias("earlier"))


def consumption(rows: DataFrame) -> DataFrame:
    """H3: after a launch has come back, the next call of its parent and how many calls read before the next write."""
    back = handovers(rows).filter("returned is not null").select("session_id", "idx", "returned")
    calls = rows.filter(is_call()).select("session_id", F.col("idx").alias("at"), "category")
    later = back.join(calls, "session_id").filter("at > returned").groupBy("session_id", "idx", "returned")
    found = later.agg(F.min("at").alias("next_call"), F.min(F.when(F.col("category") == "write", F.col("at"))).alias("next_write"), F.collect_list(F.when(F.col("category") == "read", F.col("at"))).alias("reads"))
    before = F.size(F.filter("reads", lambda r: F.col("next_write").isNull() | (r < F.col("next_write"))))
    return found.select("session_id", "idx", "returned", "next_call", "next_write", before.cast("long").alias("reads_before_write"))

