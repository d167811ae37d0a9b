"""Ranks within large groups, without ordering any group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import cut_lineage


def ranked_values(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """The columns `by`, value, n (rows with it), above (rows of the group with a larger value), size (rows of the group).

    Values are counted first, the counts dealt by range of group and value, each part numbered by itself, and the
    parts' sums, one row a part and group, added up."""
    counts = rows.groupBy(*by, F.col(value).alias("value")).agg(F.count("*").alias("n"))
    parts = cut_lineage(counts.repartitionByRange(*by, F.col("value").desc()).withColumn("part", F.spark_partition_id()))
    sums = parts.groupBy(*by, "part").agg(F.sum("n").alias("in_part"))
    ahead = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumns({"before": F.coalesce(F.sum("in_part").over(ahead), F.lit(0)), "size": F.sum("in_part").over(Window.partitionBy(*by))})
    within = Window.partitionBy(*by, "part").orderBy(F.col("value").desc()).rowsBetween(Window.unboundedPreceding, -1)
    return parts.join(sums, [*by, "part"]).select(*by, "value", "n", (F.col("before") + F.coalesce(F.sum("n").over(within), F.lit(0))).alias("above"), "size")


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """The rows with their place from 1 in one order of all of them: dealt by range, numbered part by part, and the
    parts' sizes, one row a part, added up. The order must tell all rows apart."""
    parts = cut_lineage(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = parts.groupBy("part").agg(F.count("*").alias("in_part"))
    sizes = sizes.select("part", F.coalesce(F.sum("in_part").over(ahead), F.lit(0)).alias("ahead"))
    within = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return parts.join(F.broadcast(sizes), "part").withColumn(name, (F.col("ahead") + within).cast("long")).drop("part", "ahead")
