"""Session and group measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sequence import session, upto


def session_metrics(events: DataFrame) -> DataFrame:
    """Counts by kind and category, first call, errors and retries of each session.

    Sums keep NULL where nothing was measured; a failed result counts as retried if any call follows it."""
    last_call = F.max(F.when(F.col("kind") == "tool_call", F.col("idx"))).over(Window.partitionBy("session_id"))
    first_write = F.min(F.when(F.col("category") == "write", F.col("idx"))).over(Window.partitionBy("session_id"))
    rows = events.withColumns({"last_call": last_call, "first_write": first_write})
    failed = (F.col("kind") == "tool_result") & ~F.col("ok")
    is_call = F.col("kind") == "tool_call"
    return rows.groupBy("session_id").agg(
        F.count("*").alias("n_events"),
        F.count_if(F.col("kind") == "user_msg").alias("user_messages"),
        F.count_if(is_call).alias("calls"),
        F.count_if(F.col("category") == "read").alias("reads"),
        F.count_if(F.col("category") == "write").alias("writes"),
        F.count_if(F.col("category") == "execute").alias("executes"),
        F.min(F.when(is_call, F.col("idx"))).alias("first_call_idx"),
        F.count_if((F.col("category") == "read") & (F.col("idx") < F.col("first_write"))).alias("reads_before_write"),
        F.countDistinct(F.when(is_call, F.col("tool"))).alias("tools"),
        F.countDistinct("path").alias("paths"),
        F.count_if(failed).alias("errors"),
        F.count_if(failed & (F.col("idx") < F.col("last_call"))).alias("retried_errors"),
        F.round(F.count_if(failed) / F.nullif(F.count_if(F.col("kind") == "tool_result"), F.lit(0)), 6).alias("error_rate"),
        F.sum(F.when(F.col("kind") == "tool_result", F.col("size"))).alias("output_size"),
    )


def counts_by(events: DataFrame, *keys: str) -> DataFrame:
    """Long-form counts; rows without any of the keys are left out."""
    return events.dropna(subset=list(keys)).groupBy(*keys).agg(F.count("*").alias("n"))


def error_streaks(events: DataFrame) -> DataFrame:
    """A5: the longest run of failed results, results only, of each session with one."""
    results = events.filter("kind = 'tool_result'").withColumn("streak", F.sum(F.when(F.col("ok"), 1).otherwise(0)).over(upto()))
    runs = results.filter("not ok").groupBy("session_id", "streak").agg(F.count("*").alias("n"))
    return runs.groupBy("session_id").agg(F.max("n").alias("longest"))


def active_idle(events: DataFrame, cap_seconds: float) -> DataFrame:
    """Seconds between events in time order, those over the cap as idle."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    by_time = Window.partitionBy("session_id").orderBy("ts", "idx")
    gaps = events.withColumn("gap", (micros - F.lag(micros).over(by_time)) / 1e6)
    return gaps.groupBy("session_id").agg(
        F.round(F.sum(F.when(F.col("gap") <= cap_seconds, F.col("gap"))), 6).alias("active_seconds"),
        F.round(F.sum(F.when(F.col("gap") > cap_seconds, F.col("gap"))), 6).alias("idle_seconds"),
        F.count_if(F.col("gap") > cap_seconds).alias("idle_gaps"),
    )


def test_runs(events: DataFrame, is_test: Column) -> DataFrame:
    """Test commands, distinct commands and edit-to-test cycles: tests with an edit since the test before."""
    tests = F.count_if(is_test)
    last_edit = F.max(F.when(F.col("category") == "write", F.col("idx"))).over(upto())
    last_test = F.max(F.when(is_test, F.col("idx"))).over(session().rowsBetween(Window.unboundedPreceding, -1))
    rows = events.withColumns({"last_edit": last_edit, "last_test": last_test})
    cycle = is_test & F.col("last_edit").isNotNull() & (F.col("last_edit") > F.coalesce("last_test", F.lit(-1)))
    found = rows.groupBy("session_id").agg(tests.alias("tests"), F.countDistinct(F.when(is_test, F.trim("command"))).alias("commands"), F.count_if(cycle).alias("cycles"))
    return found.filter("tests > 0")


def group_stats(rows: DataFrame, keys: list[str], value: str, *, percents=(0.5, 0.95)) -> DataFrame:
    """N and linear percentiles overall and by each key on its own, in one pass of GROUPING SETS.

    Groups whose key is null are left out; the overall group has scope `all`."""
    grouped = rows.groupingSets([[], *([F.col(k)] for k in keys)], *keys).agg(
        *(F.grouping(k).alias(f"__without_{k}") for k in keys),
        F.count("*").alias("n"),
        F.count(value).alias("n_value"),
        F.round(F.avg(value), 6).alias("mean"),
        *(F.round(F.percentile(value, p), 6).alias(f"p{round(p * 100)}") for p in percents),
    )
    scope, group = F.lit("all"), F.lit("all")
    for k in keys:
        own = F.col(f"__without_{k}") == 0
        scope, group = F.when(own, k).otherwise(scope), F.when(own, F.col(k).cast("string")).otherwise(group)
    found = grouped.select(scope.alias("scope"), group.alias("grp"), "n", "n_value", "mean", *(f"p{round(p * 100)}" for p in percents))
    return found.filter("grp is not null")


def top_counts(rows: DataFrame, by: str, item: str, n: int = 10) -> DataFrame:
    """The most frequent items of each group; equal counts by item."""
    counts = rows.dropna(subset=[by, item]).groupBy(by, item).agg(F.count("*").alias("n"))
    order = Window.partitionBy(by).orderBy(F.col("n").desc(), item)
    return counts.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n).withColumn("place", F.col("place").cast("long"))


def strict_majority(rows: DataFrame, by: str, item: str) -> DataFrame:
    """The item with more rows than any other of its group, null on a tie."""
    counts = rows.dropna(subset=[by, item]).groupBy(by, item).agg(F.count("*").alias("n"))
    most = F.max("n").over(Window.partitionBy(by))
    best = counts.withColumn("most", most).filter("n = most").groupBy(by)
    return best.agg(F.when(F.count("*") == 1, F.min(item)).alias("winner"), F.max("n").alias("n"))


def file_state(events: DataFrame) -> DataFrame:
    """Reads, edits, last operation and whether a file was read before its first edit, by session and path."""
    touched = events.filter("kind = 'tool_call' and path is not null")
    found = touched.groupBy("session_id", "path").agg(
        F.count_if(F.col("category") == "read").alias("reads"),
        F.count_if(F.col("category") == "write").alias("edits"),
        F.max_by("category", "idx").alias("last_op"),
        F.min(F.when(F.col("category") == "read", F.col("idx"))).alias("first_read"),
        F.min(F.when(F.col("category") == "write", F.col("idx"))).alias("first_edit"),
    )
    return found.withColumn("read_first", F.coalesce(F.col("first_read") < F.col("first_edit"), F.col("first_edit").isNull()))


def file_read_analytics(events: DataFrame, group: Column) -> DataFrame:
    """Per path, reads, reading sessions, independent groups of sessions and repeated reads."""
    reads = events.filter("category = 'read' and path is not null").withColumn("__group", group)
    return reads.groupBy("path").agg(
        F.count("*").alias("reads"),
        F.countDistinct("session_id").alias("sessions"),
        F.countDistinct("__group").alias("groups"),
        (F.count("*") - F.countDistinct("session_id")).alias("repeats"),
    )


def null_safe_total(rows: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """A1, A2: sums that stay null if nothing is present, and the total of those present."""
    sums = rows.groupBy(by).agg(*(F.sum(c).alias(c) for c in columns))
    present = F.filter(F.array(*columns), lambda x: x.isNotNull())
    total = F.when(F.size(present) > 0, F.aggregate(present, F.lit(0).cast("long"), lambda a, x: a + x))
    return sums.withColumn("total", total)


def pivot_counts(findings: DataFrame, by: str, item: str, items: list[str]) -> DataFrame:
    """K3: one row a group and a count a known item, 0 where there is none."""
    wide = findings.groupBy(by).pivot(item, items).count()
    return wide.select(by, *(F.coalesce(F.col(f"`{i}`"), F.lit(0)).cast("long").alias(f"n_{i}") for i in items))
