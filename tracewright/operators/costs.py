"""Prices, invoices, reallocation and rollups of model responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import ranked_values

#: Pricing statuses from best to worst.
STATUS = ("exact", "estimated", "unknown")


def status_rank(status: Column) -> Column:
    """0 for exact, 1 for estimated, 2 for all else."""
    return F.when(status == "exact", 0).when(status == "estimated", 1).otherwise(2)


def status_name(rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, STATUS)), (rank + 1).cast("int"))


def charge(rows: DataFrame, rates: dict[str, float]) -> DataFrame:
    """M2, F32: the cost of each response, tokens / 1e6 * rate summed over the token kinds."""
    cost = sum((F.coalesce(F.col(k), F.lit(0)) / 1e6 * rate for k, rate in rates.items()), F.lit(0.0))
    return rows.withColumn("cost", cost)


def money(rows: DataFrame, *keys: str) -> DataFrame:
    """Costs added up by key; the status is the worst of them, the amount null if nothing is priced."""
    grouped = rows.groupBy(*keys).agg(F.round(F.sum("cost"), 8).alias("amount"), F.max(status_rank(F.col("status"))).alias("worst"), F.count("*").alias("n"))
    return grouped.withColumn("status", status_name(F.col("worst"))).drop("worst")


def origin_attributed(rows: DataFrame, cache_rate: float) -> DataFrame:
    """M5: cache reads charged to the responses whose tokens they read again.

    Each response's cache-read cost is spread over the tokens introduced before it, in proportion. For a response that
    is its tokens times the sum, over later ones, of their cost per token introduced so far: two running sums, no
    self join. What the first response reads was introduced by nobody and stays with it."""
    order = Window.partitionBy("thread_id").orderBy("seq")
    past = order.rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy("thread_id").orderBy(F.col("seq").desc()).rowsBetween(Window.unboundedPreceding, -1)
    tokens, cost = F.col("input") + F.col("output"), F.col("cache_read") / 1e6 * cache_rate
    known = rows.withColumn("known", F.coalesce(F.sum(tokens).over(past), F.lit(0)))
    rated = known.withColumn("rate", F.when(F.col("known") > 0, cost / F.col("known")).otherwise(0.0))
    own = F.when(F.col("known") > 0, 0.0).otherwise(cost)
    return rated.withColumn("attributed", own + tokens * F.coalesce(F.sum("rate").over(later), F.lit(0.0)))


def band(value: Column, edges: list[float]) -> Column:
    """Half-open bands named by their lower edge; below the first edge is band 0."""
    out = F.lit(0.0)
    for edge in edges:
        out = F.when(value >= edge, F.lit(float(edge))).otherwise(out)
    return out


def monthly(rows: DataFrame, zone: str = "UTC") -> DataFrame:
    """Month, model class and effort cells: responses once each, threads, cost, worst status, cache share."""
    month = F.date_format(F.from_utc_timestamp(F.col("ts").cast("timestamp"), zone), "yyyy-MM")
    cells = rows.withColumn("month", F.coalesce(month, F.lit("unknown"))).groupBy("month", "model", "effort")
    found = cells.agg(
        F.count("*").alias("responses"),
        F.countDistinct("thread_id").alias("threads"),
        F.round(F.sum("cost"), 8).alias("cost"),
        F.max(status_rank(F.col("status"))).alias("worst"),
        F.round(F.sum("cache_read") / F.nullif(F.sum(F.col("cache_read") + F.col("input")), F.lit(0)), 6).alias("cache_share"),
    )
    return found.withColumn("status", status_name(F.col("worst"))).drop("worst")


def spend_overview(rows: DataFrame) -> DataFrame:
    """Spend overall, by model, by effort and by both, in one pass of grouping sets."""
    sets = [[], [F.col("model")], [F.col("effort")], [F.col("model"), F.col("effort")]]
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    return rows.groupingSets(sets, "model", "effort").agg(
        F.grouping_id().cast("long").alias("level"), F.count("*").alias("responses"), *map(count, STATUS), F.round(F.sum("cost"), 8).alias("cost"),
        F.count_if(F.col("response_id").isNull()).alias("anonymous"),
    )


def expense_tail(rows: DataFrame, share: float = 0.05) -> DataFrame:
    """The most expensive share of the units, with all that tie with the last of them.

    The cutoff is the value at place ceil(n * share), found by ranked_values(); it is one row, which is broadcast."""
    placed = ranked_values(rows.filter("cost is not null").withColumn("__all", F.lit(1)), ["__all"], "cost")
    cutoff = placed.filter(F.col("above") < F.ceil(F.col("size") * share)).agg(F.min("value").alias("cutoff"))
    return rows.join(F.broadcast(cutoff), F.col("cost") >= F.col("cutoff")).drop("cutoff")


def share_of_top(rows: DataFrame, by: str, value: str, share: float = 0.01) -> DataFrame:
    """What part of each cohort's sum its largest units (a share of them, one at least) have."""
    placed = ranked_values(rows, [by], value)
    top = F.greatest(F.lit(0), F.least(F.col("n"), F.greatest(F.lit(1), F.ceil(F.col("size") * share)) - F.col("above")))
    return placed.groupBy(by).agg(F.round(F.sum(F.col("value") * top) / F.sum(F.col("value") * F.col("n")), 6).alias("top_share"))
