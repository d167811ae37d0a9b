"""Questions asked of objects in dependent passes, and labels laid over events by precedence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import cut_lineage

#: Choices that open nothing, purposes that a produced artifact overrides, and from when it does.
ESCAPES, OVERRIDDEN, PRODUCE_GATE = ("other", "unclear"), ("investigate", "orient"), 0.7
#: A bank is a file that people write; a larger one is refused, as it is broadcast.
MOST_QUESTIONS = 10_000


def _bounded(table: DataFrame) -> DataFrame:
    if table.limit(MOST_QUESTIONS + 1).count() > MOST_QUESTIONS:
        raise ValueError(f"a bank of more than {MOST_QUESTIONS} rows")
    return F.broadcast(table)


def ask_passes(objects: DataFrame, bank: DataFrame, gates: DataFrame, answers: DataFrame, barred: DataFrame) -> DataFrame:
    """Q4: each object with every question of its scope: state, round, value and choice.

    `objects` (scope, object_id), `bank` (question, scope), `answers` (object_id, question, value, choice, reason,
    abstains), `barred` (object_id, question: cannot be observed). A question without a gate is asked in round 0. A gate
    (question, parent, least) opens a question once its parent has been asked and has a usable answer of at least
    `least`, or a choice other than ESCAPES; one open gate is enough, and questions that no positive parent opens are
    never asked. An answer with a reason, or that abstains, is not usable. Rounds go on until nothing new is asked; a
    question is asked once, so circles of gates end too.

    States: answered, unanswered (asked without a usable answer), not_asked (no gate opened), insufficient_observability
    (would have been asked, but is barred: it opens nothing). Where an object has several answers to a question the
    largest value counts. Objects meet the bank by broadcast; each round joins only what it has newly asked.
    """
    bank, gates = _bounded(bank.select("scope", "question").distinct()), gates.select("question", "parent", "least").distinct()
    usable = F.col("reason").isNull() & ~F.coalesce("abstains", F.lit(False)) & (F.col("value").isNotNull() | F.col("choice").isNotNull())
    best = answers.filter(usable).groupBy("object_id", "question").agg(F.max(F.struct("value", "choice")).alias("a"))
    stopped = barred.select("object_id", "question", F.lit(True).alias("barred")).distinct()
    every = objects.select("scope", "object_id").distinct().join(bank, "scope").join(best, ["object_id", "question"], "left").join(stopped, ["object_id", "question"], "left")
    every = cut_lineage(every.select("scope", "object_id", "question", "a.value", "a.choice", F.coalesce("barred", F.lit(False)).alias("barred")))
    gated = _bounded(gates.select("question").distinct())
    rest = every.join(gated, "question", "left_semi")
    fresh = every.join(gated, "question", "left_anti").withColumn("round", F.lit(0))
    opens = _bounded(gates.select(F.col("question").alias("opened"), F.col("parent").alias("question"), "least"))
    said = F.coalesce(F.col("value") >= F.col("least"), F.lit(False)) | F.coalesce(~F.col("choice").isin(*ESCAPES), F.lit(False))
    asked, number = cut_lineage(fresh), 0
    fresh = asked
    while True:
        number += 1
        opened = fresh.filter("not barred").join(opens, "question").filter(said).select("object_id", F.col("opened").alias("question")).distinct()
        fresh = cut_lineage(rest.join(opened, ["object_id", "question"], "left_semi").withColumn("round", F.lit(number)))
        if fresh.isEmpty():
            break
        asked = asked.unionByName(fresh)
        rest = cut_lineage(rest.join(fresh.select("object_id", "question"), ["object_id", "question"], "left_anti"))
    has = F.col("value").isNotNull() | F.col("choice").isNotNull()
    state = F.when(F.col("barred"), "insufficient_observability").when(has, "answered").otherwise("unanswered")
    shown = lambda c: F.when(F.col("state") == "answered", F.col(c)).alias(c)
    done = asked.withColumn("state", state).select("scope", "object_id", "question", "state", F.col("round").cast("long").alias("round"), shown("value"), shown("choice"))
    closed = rest.select("scope", "object_id", "question", F.lit("not_asked").alias("state"), F.lit(None).cast("long").alias("round"), F.lit(None).cast("double").alias("value"), F.lit(None).cast("string").alias("choice"))
    return done.unionByName(closed)


def overlay(points: DataFrame, ranges: DataFrame, levels: list[str], carried: list[str]) -> DataFrame:
    """`points` (session_id, idx, ...) with the carried columns, level and from (first_idx) of the label over each.

    `ranges` (session_id, level, first_idx, last_idx, carried...) are labels of a level; the first of `levels` that has
    one over a point wins. Within a level the range that began last is the one that holds, and an earlier one does not
    come back once it is over. Points and range starts are one stream by session, and a running window carries each
    level's last range: linear in both, however many ranges lie over each other. Points keep their repeats; a point
    without a label has nulls.
    """
    kept = [c for c in points.columns if c not in ("session_id", "idx")]
    held = F.struct("first_idx", "last_idx", *carried)
    blank, point = F.lit(None), F.struct(*kept) if kept else F.struct(F.lit(1).alias("one"))
    starts = ranges.select("session_id", F.col("first_idx").alias("idx"), F.lit(0).alias("rank"), "level", held.alias("held"))
    shape = {f.name: f.dataType for f in starts.schema.fields}
    rows = points.select("session_id", "idx", F.lit(1).alias("rank"), blank.cast("string").alias("level"), blank.cast(shape["held"]).alias("held"), point.alias("point"))
    stream = rows.unionByName(starts.withColumn("point", blank.cast(rows.schema["point"].dataType)))
    upto = Window.partitionBy("session_id").orderBy("idx", "rank", "held.last_idx").rowsBetween(Window.unboundedPreceding, 0)
    last = {f"level_{k}": F.last(F.when(F.col("level") == name, F.col("held")), ignorenulls=True).over(upto) for k, name in enumerate(levels)}
    stream = stream.withColumns(last).filter("rank = 1")
    over = [F.when(F.col(f"level_{k}.last_idx") >= F.col("idx"), F.struct(F.lit(name).alias("level"), F.col(f"level_{k}").alias("held"))) for k, name in enumerate(levels)]
    found = stream.withColumn("label", F.coalesce(*over))
    return found.select("session_id", "idx", *(F.col(f"point.{c}").alias(c) for c in kept), *(F.col(f"label.held.{c}").alias(c) for c in carried), F.col("label.level").alias("level"), F.col("label.held.first_idx").alias("from"))


def purpose(purpose: Column, produce: Column) -> Column:
    """A label's purpose; looking round that yields an artifact is `produce`."""
    return F.when(purpose.isin(*OVERRIDDEN) & F.coalesce(produce >= PRODUCE_GATE, F.lit(False)), "produce").otherwise(purpose)
