"""The whole analysis of a trace table: what a user of the command line gets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import briefs, detectors, errors, handovers, metrics, rankings, tails
from .facts import facts
from .graph import cut_lineage


def enrich(events: DataFrame) -> DataFrame:
    """Decoded events with error and error_severity, the category of a failed result's text and command."""
    failed = (F.col("kind") == "tool_result") & ~F.col("ok")
    key = F.coalesce("call_id", F.concat(F.lit("\u0000"), F.col("idx").cast("string")))
    command = F.max(F.when(F.col("kind") == "tool_call", F.struct("idx", "command"))).over(Window.partitionBy("session_id", key))["command"]
    told = errors.classify(F.col("text"), F.col("tool"), F.col("exit_code"), F.col("of_command"))
    rows = events.withColumn("of_command", command).withColumn("e", F.when(failed, told))
    return rows.withColumns({"error": F.col("e.category"), "error_severity": F.col("e.severity")}).drop("e", "of_command")


def in_range(events: DataFrame, since: str | None = None, until: str | None = None, models: tuple[str, ...] = ()) -> DataFrame:
    """Sessions whose first event lies between the dates and that use any of the model families."""
    first = events.groupBy("session_id").agg(F.to_date(F.min("ts")).alias("day"), F.collect_set("model").alias("used"))
    keep: Column = F.lit(True)
    if since:
        keep = keep & (F.col("day") >= F.lit(since).cast("date"))
    if until:
        keep = keep & (F.col("day") <= F.lit(until).cast("date"))
    if models:
        wanted = [m.lower().replace("_", "-") for m in models]
        keep = keep & F.exists("used", lambda u: _any_of(F.translate(F.lower(u), "_", "-"), wanted))
    return events.join(first.filter(keep).select("session_id"), "session_id", "left_semi")


def _any_of(text: Column, parts: list[str]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | text.contains(p)
    return out


def analyze(
    events: DataFrame, knobs: dict[str, dict] | None = None, severities: dict[str, str] | None = None, enabled: set[str] | None = None, disabled: frozenset[str] = frozenset()
) -> dict[str, DataFrame]:
    """Sessions, usage, findings, incidents and their distributions, model activity and delegations of decoded events,
    and the brief that sums them up.

    The events are written once (a checkpoint), so the rules do not decode the logs again each."""
    rows = cut_lineage(facts(enrich(events)))
    incidents = cut_lineage(tails.incidents(rows))
    acts = rows.filter("logical")
    usage = rows.filter("kind = 'usage'").groupBy("session_id").agg(*(F.sum(c).alias(c) for c in ("input", "output", "cache_read", "cache_write")))
    found = {
        "sessions": metrics.session_metrics(acts).join(usage, "session_id", "left"),
        "findings": detectors.run(rows, knobs, severities, known=True, enabled=enabled, disabled=disabled).unionByName(_observed(incidents)),
        "incidents": tails.retained(incidents),
        "distributions": tails.distributions(incidents),
        "themes": rankings.themes(incidents),
        "priorities": rankings.priorities(tails.observations(incidents)),
        "activity": tails.model_activity(rows),
        "delegations": handovers.handovers(rows).withColumn("files", F.array_join("files", "\n")),
    }
    return found | {"brief": briefs.lines(found["sessions"], cut_lineage(found["findings"]), found["themes"], found["priorities"])}


def _observed(incidents: DataFrame) -> DataFrame:
    rows = tails.observations(incidents)
    return rows.select("detector", "kind", "severity", "session_id", F.col("idx").alias("span_start"), F.col("idx").alias("span_end"), "value")
