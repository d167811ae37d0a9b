"""Connected components over links between documents, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage


def _stars(links: DataFrame, small: bool) -> DataFrame:
    """One step: every node points its larger (large star) or smaller (small star) neighbours to its least one."""
    if small:
        both = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    else:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
    near = both.join(least, "a")
    if small:
        out = near.select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(
            least.select("a", F.col("least").alias("b"))
        )
    else:
        out = near.filter("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return out.filter("a <> b").distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) for every node of the links (a, b: long, not null).

    Alternates large and small stars until nothing changes; each round is a checkpoint, so the plan stays
    short and a lost executor costs one round. The number of rounds grows with the logarithm of the longest chain.
    Links to itself and repeated links change nothing; no links give no rows.
    """

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    links = cut_lineage(links.select("a", "b").filter("a <> b").distinct())
    now = state(links)
    while now[0]:
        links = cut_lineage(_stars(_stars(links, small=False), small=True))
        before, now = now, state(links)
        if now == before:
            break
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
