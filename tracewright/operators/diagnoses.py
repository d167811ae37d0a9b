"""Priced diagnoses: stretches of a session that several claim are priced once; what going on in a session cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import questions, work
from .costs import status_name, status_rank

#: Fixed value: a call with less than this share of its input from the cache has missed it.
CACHE_MISS_RATIO = 0.1


def priced_once(claims: DataFrame, spend: DataFrame) -> DataFrame:
    """Claims (session_id, claim, first_idx, last_idx, priority, ...) with raw and priced amounts.

    `spend` (session_id, idx, micros) is what was spent where, in whole millionths so that sums are exact; `claim` names
    a claim within its session. raw is all that was spent in the claim's stretch, both ends included. priced is the
    part of it that no earlier claim has, in order of first_idx, priority and claim: the sum of priced over a session
    is what the union of its claims cost. Bounds and spending are one stream with a running sum; the sweep then needs
    only the largest running sum that an earlier claim has reached. A claim that ends before it begins is worth 0.
    """
    bound = lambda c, rank, side: claims.select("session_id", F.col(c).alias("idx"), F.lit(rank).alias("rank"), F.lit(0).cast("long").alias("micros"), "claim", F.lit(side).alias("side"))
    none = F.lit(None).cast("string")
    spent = spend.select("session_id", "idx", F.lit(1).alias("rank"), F.coalesce("micros", F.lit(0)).cast("long").alias("micros"), F.lit(None).cast(claims.schema["claim"].dataType).alias("claim"), none.alias("side"))
    stream = spent.unionByName(bound("first_idx", 0, "low")).unionByName(bound("last_idx", 2, "high"))
    # Rows of one place differ by rank alone: starts are before what is spent there, ends behind.
    upto = Window.partitionBy("session_id").orderBy("idx", "rank").rangeBetween(Window.unboundedPreceding, 0)
    sums = stream.withColumn("sum", F.sum("micros").over(upto)).filter("side is not null")
    side = lambda s: F.max(F.when(F.col("side") == s, F.col("sum"))).alias(s)
    sides = sums.groupBy("session_id", "claim").agg(side("low"), side("high"))
    known = claims.join(sides, ["session_id", "claim"]).withColumn("high", F.greatest("low", "high"))
    earlier = Window.partitionBy("session_id").orderBy("first_idx", "priority", "claim").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.coalesce(F.max("high").over(earlier), F.lit(0))
    priced = F.greatest(F.lit(0).cast("long"), F.col("high") - F.greatest("low", reached))
    return known.withColumns({"raw": F.col("high") - F.col("low"), "priced": priced}).drop("low", "high")


def conserved(priced: DataFrame, spend: DataFrame) -> DataFrame:
    """Per session what was spent, what claims say in all, what they were priced at, and what nobody claimed."""
    total = spend.groupBy("session_id").agg(F.sum(F.coalesce("micros", F.lit(0))).cast("long").alias("spent"))
    claimed = priced.groupBy("session_id").agg(F.count("*").alias("claims"), F.sum("raw").alias("raw"), F.sum("priced").alias("priced"))
    joined = total.join(claimed, "session_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("claims", "raw", "priced")})
    return joined.withColumn("unclaimed", F.col("spent") - F.col("priced"))


def continuations(events: DataFrame, tasks: DataFrame, touched: DataFrame, rates: dict[str, tuple[float, float, float]], idle_minutes: float = 5.0, pressure: float = 0.6, window: int = 200_000) -> DataFrame:
    """M8: for each task CONTINUATION_BURDEN, with the range of what it cost over a fresh session, or CONTEXT_CARRYOVER.

    `tasks` (session_id, task, first_idx, last_idx, edge, text, model, abstains) lie apart; `touched` (session_id, task,
    path) are their artifacts. A task bears a burden if it is unrelated to the one before, reuses no earlier artifact,
    its model is priced, and its first call either missed the cache after a gap, or filled more than `pressure` of the
    window, or there was a compaction in it. `rates` give a model's price of a million tokens of input, cache read and
    cache write; a model without has no amount. Tasks whose relation a classifier abstained from have no row.

    Events find their task by questions.overlay(), gaps by a running maximum of time: no join by range.
    """
    rows = events.withColumn("micros", F.unix_micros(F.col("ts").cast("timestamp")))
    stamp = F.when(~F.col("kind").isin("meta", "usage"), F.col("micros"))
    past = Window.partitionBy("session_id").orderBy("micros").rangeBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("gap", (F.col("micros") - F.max(stamp).over(past)) / 60e6)
    rows = rows.filter(F.col("kind").isin("usage", "compaction")).select("session_id", "idx", "kind", "response_id", "input", "cache_read", "cache_write", "gap")
    ranges = tasks.select("session_id", F.lit("task").alias("level"), "first_idx", "last_idx", "task")
    within = questions.overlay(rows, ranges, ["task"], ["task"]).filter("task is not null").drop("level", "from")
    calls = work.billed(within)
    number = lambda c: F.coalesce(c, F.lit(0))
    tokens = {c: F.sum(number(c)).alias(c) for c in ("input", "cache_read", "cache_write")}
    used = calls.groupBy("session_id", "task").agg(*tokens.values(), F.min(F.struct("idx", number("input").alias("input"), number("cache_read").alias("cache_read"), "gap")).alias("call"))
    squeezed = within.filter("kind = 'compaction'").select("session_id", "task", F.lit(True).alias("compacted")).distinct()
    first = touched.groupBy("session_id", "path").agg(F.min("task").alias("first"))
    again = touched.distinct().join(first, ["session_id", "path"]).groupBy("session_id", "task").agg(F.count_if(F.col("first") < F.col("task")).alias("reuse"))
    joined = tasks.filter(~F.coalesce("abstains", F.lit(False))).join(used, ["session_id", "task"], "left").join(squeezed, ["session_id", "task"], "left").join(again, ["session_id", "task"], "left")
    rate = lambda k: F.coalesce(*(F.when(F.col("model") == m, F.lit(float(r[k]))) for m, r in sorted(rates.items())), F.lit(None).cast("double"))
    held = number("call.input") + number("call.cache_read")
    joined = joined.withColumns(
        {
            "occupancy": F.when(F.col("call").isNotNull(), held).otherwise(0), "compacted": F.coalesce("compacted", F.lit(False)), "reuse": number("reuse").cast("long"),
            "missed": F.coalesce((held > 0) & (F.col("call.cache_read") / held < CACHE_MISS_RATIO), F.lit(False)), "after_gap": F.coalesce(F.col("call.gap") > idle_minutes, F.lit(False)),
            "spent": (F.col("input") * rate(0) + F.col("cache_read") * rate(1) + F.col("cache_write") * rate(2)) / 1e6, "rate": rate(0),
        }
    )
    trigger = (F.col("missed") & F.col("after_gap")) | (F.col("occupancy") / window > pressure) | F.col("compacted")
    fires = (F.col("edge") == "unrelated") & (F.col("reuse") == 0) & trigger & F.col("rate").isNotNull() & F.col("call").isNotNull()
    joined = joined.withColumn("fires", F.coalesce(fires, F.lit(False)))
    low, high = (c * F.col("rate") for c in work.fresh_tokens(F.col("text"), F.col("occupancy")))
    over = lambda base: F.when(F.col("fires"), F.greatest(F.lit(0.0), F.col("spent") - base))
    diagnosis = F.when(F.col("fires"), "CONTINUATION_BURDEN").otherwise("CONTEXT_CARRYOVER")
    status = F.when(F.col("rate").isNotNull(), "exact").otherwise("unknown")
    found = joined.withColumns({"diagnosis": diagnosis, "low": over(high), "high": over(low), "status": status})
    return found.select("session_id", "task", "diagnosis", "low", "high", ((F.col("low") + F.col("high")) / 2).alias("amount"), "status", "missed", "after_gap", "compacted", "occupancy", "reuse")


def counterfactual(diagnoses: DataFrame, *keys: str) -> DataFrame:
    """The union of the CONTINUATION_BURDEN ranges by key: the lowest low, the highest high, their middle and the
    worst status. Keys without such a diagnosis have no row."""
    burdens = diagnoses.filter("diagnosis = 'CONTINUATION_BURDEN' and (low is not null or high is not null or amount is not null)")
    low, high = F.coalesce("low", "amount"), F.coalesce("high", "amount")
    found = burdens.groupBy(*keys).agg(F.min(low).alias("low"), F.max(high).alias("high"), F.max(status_rank(F.col("status"))).alias("worst"), F.count("*").alias("n"))
    return found.select(*keys, "low", "high", ((F.col("low") + F.col("high")) / 2).alias("amount"), status_name(F.col("worst")).alias("status"), "n")


def micros(input_rate: int, output_rate: int) -> Column:
    """Spending of a usage row in millionths, at whole prices of a million tokens."""
    return F.coalesce("input", F.lit(0)) * input_rate + F.coalesce("output", F.lit(0)) * output_rate
