"""Order-dependent operators as windows over (session, idx). Order is by idx, never by time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def session() -> WindowSpec:
    return Window.partitionBy("session_id").orderBy("idx")


def before() -> WindowSpec:
    return session().rowsBetween(Window.unboundedPreceding, -1)


def upto() -> WindowSpec:
    return session().rowsBetween(Window.unboundedPreceding, 0)


def after() -> WindowSpec:
    """The rows behind each row, for aggregates that do not depend on their order: a running frame from the session's
    end, as one that starts at each row and runs to the end would be worked out anew for every row."""
    return Window.partitionBy("session_id").orderBy(F.col("idx").desc()).rowsBetween(Window.unboundedPreceding, -1)


def logical(events: DataFrame) -> DataFrame:
    """Events without meta rows, with their position from 0 among those that are left."""
    return events.filter("kind <> 'meta'").withColumn("pos", F.row_number().over(session()) - 1)


def flag(condition: Column) -> Column:
    return F.when(condition, 1).otherwise(0)


def sliding_max(events: DataFrame, condition: Column, rows: int) -> DataFrame:
    """The most matches of a condition in any `rows` consecutive logical events of a session."""
    frame = session().rowsBetween(1 - rows, 0)
    found = logical(events).withColumn("n", F.sum(flag(condition)).over(frame))
    return found.groupBy("session_id").agg(F.max("n").alias("most"))


def first_window(events: DataFrame, condition: Column, rows: int, least: int) -> DataFrame:
    """session_id, start_idx, end_idx of the earliest window of `rows` events that holds `least` matches.

    The start is the oldest match in the window as it stands when the threshold is reached."""
    frame = session().rowsBetween(1 - rows, 0)
    found = (
        logical(events)
        .withColumn("hit", condition)
        .withColumn("n", F.sum(flag(F.col("hit"))).over(frame))
        .withColumn("start_idx", F.min(F.when(F.col("hit"), F.col("idx"))).over(frame))
        .filter(F.col("n") >= least)
    )
    return found.groupBy("session_id").agg(F.min_by("start_idx", "idx").alias("start_idx"), F.min("idx").alias("end_idx"))


def request_scope(events: DataFrame) -> DataFrame:
    """Each event's scope, the idx of the latest user message up to it, or -1."""
    return events.withColumn("scope", F.coalesce(F.max(F.when(F.col("kind") == "user_msg", F.col("idx"))).over(upto()), F.lit(-1)))


def islands(events: DataFrame, breaks: Column) -> DataFrame:
    """Runs between rows where `breaks` holds: the column island counts the breaks up to and including each row."""
    return events.withColumn("island", F.sum(flag(breaks)).over(upto()))


def failure_chains(events: DataFrame, least: int = 3, is_poll: Column | None = None) -> DataFrame:
    """Runs of failed results; a success or a user message ends a run, polls neither extend nor end it."""
    poll = is_poll if is_poll is not None else F.lit(False)
    breaks = (F.col("kind") == "user_msg") | ((F.col("kind") == "tool_result") & F.col("ok") & ~poll)
    failed = (F.col("kind") == "tool_result") & ~F.col("ok") & ~poll
    runs = islands(events, breaks).filter(failed).groupBy("session_id", "island")
    return runs.agg(F.count("*").alias("failures"), F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx")).filter(F.col("failures") >= least)


def retry_groups(results: DataFrame, signature: str, least: int = 2) -> DataFrame:
    """Attempts of one signature up to its success or the next user message; `least` attempts and failures.

    Takes results and user messages (session_id, idx, kind, ok, signature). The group number is the count of what has
    closed the signature's list before the row: its own successes and the session's user messages."""
    scoped = request_scope(results).filter("kind = 'tool_result'")
    own = Window.partitionBy("session_id", signature, "scope").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    groups = scoped.withColumn("closed", F.coalesce(F.sum(flag(F.col("ok"))).over(own), F.lit(0)))
    found = groups.groupBy("session_id", signature, "scope", "closed").agg(
        F.count("*").alias("attempts"), F.count_if(~F.col("ok")).alias("failed"), F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx")
    )
    return found.filter((F.col("attempts") >= least) & (F.col("failed") >= least)).drop("closed")


def poll_runs(calls: DataFrame, poll: Column, key: str, least: int = 3) -> DataFrame:
    """Identical polls in a row; any other call and any user message flush the run."""
    breaks = (F.col("kind") == "user_msg") | ((F.col("kind") == "tool_call") & ~poll)
    runs = islands(calls, breaks).filter((F.col("kind") == "tool_call") & poll).groupBy("session_id", "island", key)
    return runs.agg(F.count("*").alias("polls"), F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx")).filter(F.col("polls") >= least)


def decumulate(usage: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Running totals as deltas; where the total falls, the counter was reset and the total itself is the delta."""
    last = F.lag(value).over(Window.partitionBy(key).orderBy(order))
    delta = F.col(value) - F.coalesce(last, F.lit(0))
    return usage.withColumn("delta", F.when(delta < 0, F.col(value)).otherwise(delta))


def turns(events: DataFrame) -> DataFrame:
    """Turn (from 1, 0 before the first user message) and its bounds, events and calls."""
    numbered = events.withColumn("turn", F.sum(flag(F.col("kind") == "user_msg")).over(upto()))
    return numbered.groupBy("session_id", "turn").agg(
        F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"), F.count("*").alias("n_events"), F.count_if(F.col("kind") == "tool_call").alias("n_calls")
    )


def thirds(events: DataFrame, condition: Column, least: int = 9) -> DataFrame:
    """Matches in the first and the last third (by position, floor(n / 3) rows each) of sessions of `least` events."""
    n = F.count("*").over(Window.partitionBy("session_id"))
    rows = logical(events).withColumn("n", n).withColumn("third", F.floor(F.col("n") / 3))
    found = rows.filter(F.col("n") >= least).groupBy("session_id", "n").agg(
        F.count_if(condition & (F.col("pos") < F.col("third"))).alias("first_hits"),
        F.count_if(condition & (F.col("pos") >= F.col("n") - F.col("third"))).alias("last_hits"),
    )
    return found.withColumn("n", F.col("n").cast("long"))


def ordered_prior_next(marked: DataFrame, prior: Column, following: Column) -> DataFrame:
    """For every row, the idx of the last earlier row where `prior` holds and of the first later with `following`."""
    return marked.withColumn("prior_idx", F.max(F.when(prior, F.col("idx"))).over(before())).withColumn(
        "next_idx", F.min(F.when(following, F.col("idx"))).over(after())
    )


def adjacent_gaps(events: DataFrame) -> DataFrame:
    """Seconds since the session's event before, by idx."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return events.withColumn("gap", (micros - F.lag(micros).over(session())) / 1e6)


def terminal_messages(messages: DataFrame) -> DataFrame:
    """Assistant messages that no other assistant message follows before the next user message or the end."""
    nxt = F.lead("kind").over(session())
    return messages.filter("kind <> 'meta'").withColumn("next_kind", nxt).filter("kind = 'assistant_msg' and (next_kind is null or next_kind = 'user_msg')").drop("next_kind")


def no_adapt_clusters(failed: DataFrame, signature: str, least: int = 2, distance: int = 5) -> DataFrame:
    """Consecutive failing calls of one tool whose arguments hardly change.

    The edit distance must be below `distance` and at most a quarter of the shorter text (1 at least); Spark's
    levenshtein gives -1 beyond its limit."""
    w = Window.partitionBy("session_id").orderBy("idx")
    last = F.lag(signature).over(w)
    apart = F.levenshtein(F.col(signature), last, distance - 1)
    allowed = F.greatest(F.lit(1), F.floor(F.least(F.length(signature), F.length(last)) / 4))
    near = (F.lag("tool").over(w) == F.col("tool")) & (apart >= 0) & (apart <= allowed)
    runs = failed.withColumn("near", F.coalesce(near, F.lit(False)))
    runs = runs.withColumn("island", F.sum(flag(~F.col("near"))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    found = runs.groupBy("session_id", "island").agg(F.count("*").alias("attempts"), F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"))
    return found.filter(F.col("attempts") >= least).drop("island")
