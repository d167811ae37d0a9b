"""Waits for subagents between responses, and what they cost in cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright import config

from .costs import band
from .facts import is_user, named
from .tails import WAITS, rounds, status_probe


def mode(tool: Column, signature: Column) -> Column:
    """Whether a wait blocks."""
    blocking = F.coalesce(signature.rlike(r"\"wait\"\s*:\s*true|\"timeout_ms\"\s*:\s*[1-9]"), F.lit(False))
    return F.when(status_probe(tool, signature), "nonblocking").when(blocking, "blocking").otherwise("unspecified")


def cache_waits(rows: DataFrame, tokens: int = config.DEFAULTS["tails"]["cache_rebuild_tokens"]) -> DataFrame:
    """A row a wait of facts() with the response before it (the one that issued it included) and the first
    after its result, whether the two can be compared (one model, nothing compacted and no user message between), and
    whether the second wrote the cache anew.

    Responses, waits, results, compactions and user messages are ranked together in one window a session."""
    told = rounds(rows).select("session_id", F.col("idx").alias("at"), F.lit(0).alias("rank"), F.struct("response_id", "model", "input", "cache_read", "cache_write", F.col("idx").alias("start")).alias("m"))
    waits = rows.filter(F.col("paired") & named(F.col("tool"), WAITS))
    none = F.lit(None).cast(told.schema["m"].dataType).alias("m")
    marks = [waits.select("session_id", F.col(c).alias("at"), F.lit(k).alias("rank"), none, F.col("idx").alias("wait")) for c, k in (("idx", 1), ("r_idx", 2))]
    stops = rows.filter(is_user() | (F.col("kind") == "compaction")).select("session_id", F.col("idx").alias("at"), F.lit(3).alias("rank"), none)
    every = told.unionByName(stops).withColumn("wait", F.lit(None).cast("long"))
    for part in marks:
        every = every.unionByName(part)
    order = Window.partitionBy("session_id").orderBy("at", "rank")
    every = every.withColumn("stops", F.sum(F.when(F.col("rank") == 3, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    every = every.withColumn("m", F.when(F.col("m").isNotNull(), F.struct("m.*", "stops")))
    prior = F.last("m", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    backwards = Window.partitionBy("session_id").orderBy(F.col("at").desc(), F.col("rank").desc())
    following = F.last("m", ignorenulls=True).over(backwards.rowsBetween(Window.unboundedPreceding, -1))
    found = every.withColumns({"prior": prior, "next": following}).filter("wait is not null").groupBy("session_id", F.col("wait").alias("idx"))
    ends = found.agg(F.max(F.when(F.col("rank") == 1, F.col("prior"))).alias("prior"), F.max(F.when(F.col("rank") == 2, F.col("next"))).alias("next"))
    seconds = (F.unix_micros(F.col("r_ts").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 1e6
    about = waits.select("session_id", "idx", mode(F.col("tool"), F.col("signature")).alias("mode"), F.when(seconds >= 0, seconds).alias("seconds"))
    same = (F.col("prior.model") == F.col("next.model")) & (F.col("prior.stops") == F.col("next.stops"))
    known = F.col("prior.cache_read").isNotNull() & F.col("next.cache_read").isNotNull() & F.col("next.cache_write").isNotNull()
    joined = about.join(ends, ["session_id", "idx"]).withColumn("comparable", F.coalesce(same & known, F.lit(False)))
    rewrite = F.col("comparable") & (F.col("next.cache_read") == 0) & (F.col("next.cache_write") >= tokens)
    return joined.withColumn("rewrite", F.coalesce(rewrite, F.lit(False)))


def cohorts(waits: DataFrame, edges: list[float]) -> DataFrame:
    """Waits by model, mode and band: how many, how many comparable and rewritten, and the input and written tokens
    of the responses after them, each response once a cohort however many waits it follows."""
    rows = waits.withColumn("band", band(F.coalesce("seconds", F.lit(0.0)), edges)).withColumn("model", F.col("next.model"))
    keys = ["model", "mode", "band"]
    counts = rows.groupBy(*keys).agg(F.count("*").alias("waits"), F.count_if("comparable").alias("comparable"), F.count_if("rewrite").alias("rewrites"))
    after = rows.filter("next is not null").select(*keys, "session_id", "next.start", "next.input", "next.cache_write").distinct()
    spent = after.groupBy(*keys).agg(F.count("*").alias("responses"), F.sum("input").alias("input"), F.sum("cache_write").alias("written"))
    spent = spent.select(*(F.col(k).alias(f"of_{k}") for k in keys), "responses", "input", "written")
    met = [F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in keys]
    return counts.join(spent, met, "left").drop(*(f"of_{k}" for k in keys))
