"""Report rankings: themes, priorities, prevalence and the greedy choice of incidents.

Their inputs are grouped first, so what a ranking orders is one row a theme, not a row an event."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranks import numbered


def themes(incidents: DataFrame) -> DataFrame:
    """A score of volume (30), spend (15), reach (35) and ease (20) for each kind."""
    return scored(incidents.groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("session_id").alias("sessions"), F.sum("value").alias("total")))


def scored(per: DataFrame) -> DataFrame:
    """The themes of what is counted already: kind, n, sessions, total."""
    whole = Window.partitionBy()
    part = lambda c: F.col(c) / F.max(c).over(whole)
    score = 30 * part("n") + 15 * part("total") + 35 * part("sessions") + 20 * (1 - F.col("n") / F.sum("n").over(whole))
    return per.select("kind", "n", "sessions", F.round(score, 6).alias("score"))


def priorities(observed: DataFrame, supported: int = 20, investigate: int = 5) -> DataFrame:
    """Observations by detector, routed by how many sessions show them, in order of route and number."""
    return routed(observed.groupBy("detector", "severity").agg(F.count("*").alias("incidents"), F.countDistinct("session_id").alias("sessions")), supported, investigate)


def routed(per: DataFrame, supported: int = 20, investigate: int = 5) -> DataFrame:
    """The priorities of what is counted already: detector, severity, incidents, sessions."""
    route = F.when(F.col("sessions") >= supported, "supported").when(F.col("sessions") >= investigate, "investigate").otherwise("measure")
    order = F.when(F.col("sessions") >= supported, 0).when(F.col("sessions") >= investigate, 1).otherwise(2)
    place = F.row_number().over(Window.orderBy(order, F.col("incidents").desc(), "detector")).cast("long")
    return per.select("detector", "severity", "incidents", "sessions", route.alias("route"), place.alias("place"))


def prevalence(events: DataFrame, item: str) -> DataFrame:
    """Three rankings of an item's values that are not mixed: rows, sessions, and rows a session. Items may be as many
    as paths are, so no ranking is made in one task."""
    per = events.filter(F.col(item).isNotNull()).groupBy(F.col(item).alias("item")).agg(F.count("*").alias("n"), F.countDistinct("session_id").alias("sessions"))
    per = per.withColumn("per_session", F.round(F.col("n") / F.col("sessions"), 6))
    for column, name in (("n", "by_n"), ("sessions", "by_sessions"), ("per_session", "by_rate")):
        per = numbered(per, [F.col(column).desc(), F.col("item").asc()], name)
    return per


def cover(incidents: DataFrame, most: int) -> DataFrame:
    """Of each session, the incidents by value over threshold that touch an event no better one has touched.

    Takes rows (session_id, id, score, touches: array). The choice depends on the order, so it is a fold over a
    session's incidents, which are at most `most` times its kinds."""
    order = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "id", "touches")))

    def step(acc, x):
        new = F.size(F.array_except(x["touches"], acc["seen"])) > 0
        room = F.size(acc["ids"]) < most
        return F.struct(
            F.when(new & room, F.array_union(acc["seen"], x["touches"])).otherwise(acc["seen"]).alias("seen"),
            F.when(new & room, F.concat(acc["ids"], F.array(x["id"]))).otherwise(acc["ids"]).alias("ids"),
        )

    start = F.struct(F.array().cast("array<bigint>").alias("seen"), F.array().cast("array<bigint>").alias("ids"))
    chosen = incidents.groupBy("session_id").agg(order.alias("all")).select("session_id", F.aggregate("all", start, step, lambda a: a["ids"]).alias("ids"))
    return chosen.select("session_id", F.posexplode("ids").alias("place", "id"))
