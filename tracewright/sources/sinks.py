"""Sinks: reports, per-trace CSV, label stores, command datasets and the exit gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import publish

#: Severities from least to most.
SEVERITIES = ("info", "low", "medium", "high")


def severity_rank(severity: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), severity)


def write_report(runs: DataFrame, path: str) -> None:
    """K1: one JSON object a run."""
    runs.write.mode("errorifexists").json(path)


def trace_table(metrics: DataFrame, findings: DataFrame, detectors: list[str]) -> DataFrame:
    """K3: a row a trace with its measures and a count of each finding; only the counts are filled with 0."""
    counts = findings.groupBy("session_id").pivot("detector", detectors).count()
    wide = metrics.join(counts, "session_id", "left")
    return wide.select(*metrics.columns, *(F.coalesce(F.col(f"`{d}`"), F.lit(0)).cast("long").alias(d) for d in detectors))


def write_csv(table: DataFrame, path: str) -> None:
    """K3: nulls as empty fields and doubles with six significant digits."""
    text = [F.format_string("%.6g", F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in table.dtypes]
    table.select(*text).write.mode("errorifexists").option("header", True).option("nullValue", "").csv(path)


def append_labels(labels: DataFrame, store: str) -> None:
    """K7: appends labels to a store, and refuses those whose root is pinned to another split there. Check and append
    are one writer's at a time (publish.lease)."""
    spark = labels.sparkSession
    with publish.lease(spark, store):
        held = spark.read.schema(labels.schema).json(store).select("root", F.col("split").alias("pinned")).distinct()
        conflict = labels.join(held, "root").filter("split <> pinned").select("root").limit(1).collect()
        if conflict:
            raise ValueError(f"{conflict[0].root} is pinned to another split")
        labels.write.mode("append").json(store)


def write_commands(commands: DataFrame, path: str, kind: str = "json") -> str:
    """K8: a command dataset as json or csv; returns a digest that does not depend on the order of its rows."""
    commands.write.mode("errorifexists").format(kind).save(path)
    row = F.sha2(F.to_json(F.struct(*sorted(commands.columns))), 256)
    half = F.conv(F.substring(row, 1, 15), 16, 10).cast("decimal(38,0)")
    return str(commands.agg(F.sum(half).alias("digest")).first().digest)


def fails(findings: DataFrame, least: str) -> bool:
    """Whether any finding is at least this severe."""
    most = findings.agg(F.max(severity_rank(F.col("severity"))).alias("most")).first().most
    return most is not None and most >= SEVERITIES.index(least) + 1
