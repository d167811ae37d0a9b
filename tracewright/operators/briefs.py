"""The run report as one object: overview, findings by severity, themes with the detectors they stand for, priorities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Severities from least to most.
SEVERITIES = ("info", "low", "medium", "high")
SECTIONS = ("overview", "finding", "theme", "priority")


def _rank(severity: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), severity)


def lines(sessions: DataFrame, findings: DataFrame, themes: DataFrame, priorities: DataFrame) -> DataFrame:
    """Section, place, name, label, n, sessions, score.

    overview: number of sessions and of findings, of detectors that fired (signals) and the worst severity. finding: a
    line a detector and severity, the gravest and most frequent first. theme: by score, with the detector of its kind as
    label if that has findings. priority: in their order, with their route. `sessions` has a row a session, `findings` (detector,
    severity, session_id) one a finding; both are grouped before anything is ordered, so what is ordered is bounded by
    the number of detectors and kinds.
    """
    per = findings.groupBy("detector", "severity").agg(F.count("*").alias("n"), F.countDistinct("session_id").alias("sessions"))
    return of_counts(sessions.agg(F.count("*").alias("sessions")), per, themes, priorities)


def of_counts(number: DataFrame, per: DataFrame, themes: DataFrame, priorities: DataFrame) -> DataFrame:
    """lines() of what is counted already: one row (sessions), and per detector and severity n and sessions."""
    none = lambda kind: F.lit(None).cast(kind)
    row = lambda section, place, name, label, n, held, score: [F.lit(section).alias("section"), place.cast("long").alias("place"), name.alias("name"), label.alias("label"), n.cast("long").alias("n"), held.cast("long").alias("sessions"), score.cast("double").alias("score")]
    totals = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("findings"), F.countDistinct("detector").alias("signals"), F.max(_rank(F.col("severity"))).alias("worst"))
    totals = totals.crossJoin(number)  # one row each
    worst = F.get(F.array(*map(F.lit, SEVERITIES)), (F.col("worst") - 1).cast("int"))
    shown = (("sessions", none("string"), F.col("sessions")), ("findings", none("string"), F.col("findings")), ("signals", none("string"), F.col("signals")), ("severity", worst, none("long")))
    overview = [totals.select(*row("overview", F.lit(k + 1), F.lit(name), label, n, none("long"), none("double"))) for k, (name, label, n) in enumerate(shown)]
    order = F.row_number().over(Window.orderBy(_rank(F.col("severity")).desc(), F.col("n").desc(), "detector"))
    found = per.select(*row("finding", order, F.col("detector"), F.col("severity"), F.col("n"), F.col("sessions"), none("double")))
    fired = per.select(F.col("detector").alias("of")).distinct()
    attached = themes.join(fired, F.concat(F.lit("TAIL_"), F.upper("kind")) == F.col("of"), "left")
    best = F.row_number().over(Window.orderBy(F.col("score").desc(), "kind"))
    ranked = attached.select(*row("theme", best, F.col("kind"), F.col("of"), F.col("n"), F.col("sessions"), F.col("score")))
    queue = priorities.select(*row("priority", F.col("place"), F.col("detector"), F.col("route"), F.col("incidents"), F.col("sessions"), none("double")))
    return reduce(DataFrame.unionByName, [*overview, found, ranked, queue])


def as_object(table: DataFrame) -> DataFrame:
    """K2: lines() as one row of JSON, each section a list in its order. A report has as many lines as there are detectors,
    kinds and severities, whatever the number of sessions."""
    entry = F.struct("place", "name", "label", "n", "sessions", "score")
    one = table.groupBy().agg(*(F.array_sort(F.collect_list(F.when(F.col("section") == s, entry))).alias(s) for s in SECTIONS))
    return one.select(F.to_json(F.struct(*SECTIONS)).alias("report"))
