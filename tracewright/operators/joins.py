"""Joins that traces need: call and result, ranges, prefixes, anti joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pair_last(events: DataFrame) -> DataFrame:
    """Every call with the last result of its call id in the session, null without one. Later ids win."""
    results = events.filter("kind = 'tool_result' and call_id is not null").groupBy("session_id", "call_id")
    last = results.agg(F.max("idx").alias("result_idx"), F.max_by("ok", "idx").alias("result_ok"))
    calls = events.filter("kind = 'tool_call'").select("session_id", "idx", "call_id", "tool")
    return calls.join(last, ["session_id", "call_id"], "left")


def pair_unique(events: DataFrame) -> DataFrame:
    """Calls with their result where the id has one call and one result in the session, the result later."""
    ids = events.filter("kind in ('tool_call', 'tool_result') and call_id is not null").groupBy("session_id", "call_id")
    is_call = F.col("kind") == "tool_call"
    pairs = ids.agg(
        F.count_if(is_call).alias("calls"),
        F.count_if(~is_call).alias("results"),
        F.min(F.when(is_call, F.col("idx"))).alias("idx"),
        F.min(F.when(~is_call, F.col("idx"))).alias("result_idx"),
        F.min(F.when(is_call, F.col("ts"))).alias("ts"),
        F.min(F.when(~is_call, F.col("ts"))).alias("ts_end"),
        F.min(F.when(is_call, F.col("tool"))).alias("tool"),
        F.min(F.when(~is_call, F.col("ok").cast("int"))).cast("boolean").alias("ok"),
    )
    return pairs.filter("calls = 1 and results = 1 and result_idx > idx").drop("calls", "results")


def within_turn(rows: DataFrame, turns: DataFrame) -> DataFrame:
    """Rows with the turn whose bounds hold their idx; an equi join on the session keeps it from being a cross join."""
    bounds = turns.select(F.col("session_id").alias("of"), "turn", "first_idx", "last_idx")
    return rows.join(bounds, (rows.session_id == bounds.of) & rows.idx.between(F.col("first_idx"), F.col("last_idx")), "left").drop("of")


def longest_prefix(rows: DataFrame, key: str, prices: DataFrame, default: str = "default") -> DataFrame:
    """Price and status of every key: exact, else its longest priced prefix (estimated), else the default, else
    unknown. Keys are looked up once each. The prices (prefix, price) are a table that people keep; the keys are cut
    at every length and joined, so no pair of key and price that cannot match is made."""
    keys = rows.select(F.col(key).alias("key")).distinct().filter("key is not null")
    cut = keys.select("key", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("key")))).alias("n"))
    cut = cut.withColumn("prefix", F.expr("left(key, n)"))
    best = cut.join(prices, "prefix").groupBy("key").agg(F.max("n").alias("n"), F.max_by("price", "n").alias("price"))
    fallback = prices.filter(F.col("prefix") == default).agg(F.max("price").alias("fallback"))
    found = keys.join(best, "key", "left").join(F.broadcast(fallback))
    status = (
        F.when(F.col("n") == F.length("key"), "exact").when(F.col("n").isNotNull(), "estimated").when(F.col("fallback").isNotNull(), "estimated").otherwise("unknown")
    )
    return found.select("key", F.coalesce("price", "fallback").alias("price"), status.alias("status"))


def orphans(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Children without a parent."""
    return children.join(parents.select(F.col(parent_key).alias("__parent")), F.col(child_key) == F.col("__parent"), "left_anti")


def first_of(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key; rows with a null in the key are anonymous and all stay."""
    named = F.lit(True)
    for k in keys:
        named = named & F.col(k).isNotNull()
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("__first", F.when(named, first).otherwise(1)).filter("__first = 1").drop("__first")


def double_labels(labels: DataFrame, item: list[str]) -> DataFrame:
    """The first two annotators' values (by name) of every item that two have labelled."""
    order = F.row_number().over(Window.partitionBy(*item).orderBy("annotator"))
    placed = labels.withColumn("__place", order).filter("__place <= 2")
    pairs = placed.groupBy(*item).agg(*(F.max(F.when(F.col("__place") == i, F.col("value"))).alias(f"value_{i}") for i in (1, 2)), F.count("*").alias("n"))
    return pairs.filter("n = 2").drop("n")
