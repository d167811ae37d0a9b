"""Tasks, episodes, delegations and waste: what a session is made of."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import sequence as s


def episodes(events: DataFrame, idle_seconds: float, most_calls: int) -> DataFrame:
    """Episodes of a session with their bounds, calls and reason.

    An episode ends before a user message, after an idle gap, and where work turns from edits to commands; a run of
    calls that none of these ends is split every `most_calls` calls, counted from the last boundary."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = events.withColumns({"gap": (micros - F.lag(micros).over(s.session())) / 1e6, "was": F.last("category", ignorenulls=True).over(s.before())})
    shift = (F.col("was") == "write") & (F.col("category") == "execute")
    reason = F.when(F.col("kind") == "user_msg", "user_turn").when(F.col("gap") > idle_seconds, "idle_gap").when(shift, "phase_shift")
    rows = rows.withColumn("reason", reason).withColumn("part", F.sum(s.flag(F.col("reason").isNotNull())).over(s.upto()))
    in_part = Window.partitionBy("session_id", "part").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    calls = F.sum(s.flag(F.col("kind") == "tool_call")).over(in_part)
    rows = rows.withColumn("split", F.floor(F.greatest(calls - 1, F.lit(0)) / most_calls))
    found = rows.groupBy("session_id", "part", "split").agg(
        F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"), F.count_if(F.col("kind") == "tool_call").alias("calls"), F.max("reason").alias("reason")
    )
    named = F.when(F.col("split") > 0, "cap_split").otherwise(F.coalesce("reason", F.lit("start")))
    return found.select("session_id", "first_idx", "last_idx", "calls", named.alias("reason"))


def tasks(events: DataFrame, opens: Column) -> DataFrame:
    """Tasks of a session: each message that opens one, its amendments, events, and last answer."""
    rows = events.filter("kind <> 'meta'").withColumn("opens", opens).withColumn("task", F.sum(s.flag(F.col("opens"))).over(s.upto()))
    return rows.filter("task > 0").groupBy("session_id", "task").agg(
        F.min("idx").alias("first_idx"),
        F.count("*").alias("n_events"),
        F.count_if((F.col("kind") == "user_msg") & ~F.col("opens")).alias("amendments"),
        F.max(F.when(F.col("kind") == "assistant_msg", F.col("idx"))).alias("last_answer"),
    )


def wait_cohorts(rows: DataFrame, edges: list[float]) -> DataFrame:
    """Waits between neighbouring responses by model and band: waits, cache writes after them, rewrites."""
    from .costs import band

    w = Window.partitionBy("thread_id").orderBy("ts_end", "seq")
    micros = F.unix_micros(F.col("ts_end").cast("timestamp"))
    waits = rows.withColumns({"wait": (micros - F.lag(micros).over(w)) / 1e6, "before": F.lag("cache_read").over(w)}).filter("wait is not null")
    waits = waits.withColumn("band", band(F.col("wait"), edges))
    return waits.groupBy("model", "band").agg(F.count("*").alias("waits"), F.sum("cache_write").alias("written"), F.count_if(F.col("cache_read") < F.col("before")).alias("rewrites"))


def repeated_reads(events: DataFrame) -> DataFrame:
    """M7: reads of a path that the session has read before."""
    nth = F.row_number().over(Window.partitionBy("session_id", "path").orderBy("idx"))
    return events.filter("category = 'read' and path is not null").withColumn("nth", nth).filter("nth > 1").drop("nth")


def claim(candidates: list[tuple[str, DataFrame]]) -> DataFrame:
    """M7: a partition of units (session_id, unit, amount) among claims: the first in the list that names it wins."""
    union = reduce(DataFrame.unionByName, (c.withColumns({"claim": F.lit(n), "priority": F.lit(i)}) for i, (n, c) in enumerate(candidates)))
    first = F.row_number().over(Window.partitionBy("session_id", "unit").orderBy("priority"))
    return union.withColumn("r", first).filter("r = 1").drop("r", "priority")


def veto(diagnoses: DataFrame, vetoes: DataFrame, keys: list[str]) -> DataFrame:
    """Diagnoses without those that a veto names."""
    return diagnoses.join(vetoes.select(*keys).distinct(), keys, "left_anti")


def coverage(values: DataFrame, keys: list[str], questions: int) -> DataFrame:
    """Objects, those with every question answered, and answers by kind; an object's last value of a question counts."""
    last = F.row_number().over(Window.partitionBy(*keys, "object_id", "feature_id").orderBy(F.col("at").desc()))
    rows = values.withColumn("r", last).filter("r = 1")
    per = rows.groupBy(*keys, "object_id").agg(F.count_if(F.col("status") == "answered").alias("answered"), F.count_if(F.col("status") == "uncertain").alias("uncertain"))
    return per.groupBy(*keys).agg(
        F.count("*").alias("objects"), F.count_if(F.col("answered") == questions).alias("complete"), F.sum("answered").alias("answered"), F.sum("uncertain").alias("uncertain")
    )


def answer_status(confidence: Column, low: float = 0.3, high: float = 0.7) -> Column:
    """P20, Q2: an answer between the bounds, or without support, abstains."""
    return F.when(confidence.isNull(), "unavailable").when(confidence.between(low, high), "uncertain").otherwise("answered")


def lattice(rows: DataFrame, by: str, capability: str, level: Column) -> DataFrame:
    """The least and the greatest level of each capability in a tree."""
    return rows.groupBy(by, capability).agg(F.min(level).cast("long").alias("declared"), F.max(level).cast("long").alias("observed"))
