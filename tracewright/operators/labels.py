"""Label stores and their evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import double_labels


def agreement(pairs: DataFrame, keys: list[str], first: str, second: str) -> DataFrame:
    """Rates of both annotators and how often they agree, by key."""
    rate = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 6)
    return pairs.groupBy(*keys).agg(
        F.count("*").alias("n"), rate(F.col(first) == 1).alias("first_rate"), rate(F.col(second) == 1).alias("second_rate"), rate(F.col(first) == F.col(second)).alias("agreement")
    )


def confusion(rows: DataFrame, keys: list[str], gold: Column, predicted: Column) -> DataFrame:
    """Confusion counts and rates; a null prediction abstains, and misses if the gold is positive."""
    rows = rows.withColumns({"__g": gold, "__p": predicted})
    g, p = F.col("__g"), F.col("__p")
    counts = rows.groupBy(*keys).agg(
        F.count_if(g & p).alias("tp"), F.count_if(~g & p).alias("fp"), F.count_if(g & ~F.coalesce(p, F.lit(False))).alias("fn"), F.count_if(~g & ~p).alias("tn"),
        F.count_if(p.isNull()).alias("abstained"),
    )
    share = lambda a, b: F.round(a / F.nullif(b, F.lit(0)), 6)
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    return counts.select("*", share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"), share(tp + tn, tp + fp + fn + tn).alias("accuracy"))


def eval_store(store: DataFrame) -> DataFrame:
    """Of a label store (root, split, object_id, feature_id, annotator, value from 0 to 1), by feature and split:
    labels, share of yes (0.7 or more) among the sure ones, items that two have labelled, and how often they agree."""
    sure = (F.col("value") >= 0.7) | (F.col("value") <= 0.3)
    keys = ["feature_id", "split"]
    per = store.groupBy(*keys).agg(F.count("*").alias("labels"), F.round(F.count_if(F.col("value") >= 0.7) / F.nullif(F.count_if(sure), F.lit(0)), 6).alias("yes"))
    pairs = double_labels(store.select("object_id", *keys, "annotator", "value"), ["object_id", *keys])
    alike = (F.col("value_1") >= 0.5) == (F.col("value_2") >= 0.5)
    agreed = pairs.groupBy(*keys).agg(F.count("*").alias("pairs"), F.round(F.avg(alike.cast("int")), 6).alias("agreement"))
    return per.join(agreed, keys, "left")


def burned(store: DataFrame, marks: DataFrame) -> DataFrame:
    """L4: the labels of held-out splits that have not been looked at: those without a mark (feature_id, split)."""
    return store.filter("split = 'held_out'").join(marks.select("feature_id", "split").distinct(), ["feature_id", "split"], "left_anti")


#: Questions that a bank may hold.
MOST_QUESTIONS = 10_000


def drafts(objects: DataFrame, features: DataFrame, done: DataFrame) -> DataFrame:
    """L1: every object with every question it lacks. `features` is a question bank, a table that people keep, so it is
    broadcast; one of over MOST_QUESTIONS is refused."""
    bank = features.select("feature_id").distinct()
    if bank.limit(MOST_QUESTIONS + 1).count() > MOST_QUESTIONS:
        raise ValueError(f"a question bank has at most {MOST_QUESTIONS} questions")
    listed = F.broadcast(bank.agg(F.array_sort(F.collect_list("feature_id")).alias("bank")).withColumn("one", F.lit(1)))
    wanted = objects.select("object_id").distinct().withColumn("one", F.lit(1)).join(listed, "one").select("object_id", F.explode("bank").alias("feature_id"))
    return wanted.join(done.select("object_id", "feature_id"), ["object_id", "feature_id"], "left_anti")


def pinned_conflicts(labels: DataFrame) -> DataFrame:
    """L2, K7: roots whose labels name more than one split."""
    return labels.groupBy("root").agg(F.countDistinct("split").alias("splits"), F.min("split").alias("split")).filter("splits > 1")


def pin(labels: DataFrame) -> DataFrame:
    """L2: every label with the split of its root's first label."""
    first = F.first("split").over(Window.partitionBy("root").orderBy("at", "label_id"))
    return labels.withColumn("split", first)
