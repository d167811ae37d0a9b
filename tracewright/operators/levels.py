"""Evaluation of session trees level by level, parents before children or children before parents."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import scratch, stored, walk


class Levels(NamedTuple):
    """Nodes with their depth, the edges among them, and the greatest depth (-1 without nodes that have one)."""

    nodes: DataFrame
    edges: DataFrame
    deepest: int


def place(nodes: DataFrame, edges: DataFrame) -> Levels:
    """Levels of a forest: depths from the roots, found by pointer doubling.

    `nodes` (node, ...) are rows with a distinct node; `edges` (parent, child) give a child one parent at most; edges
    from or to nodes that are not there, and loops, are passed over. Nodes on cycles and under them have no depth. Only
    the number of levels comes to the driver.
    """
    nodes = stored(nodes)
    known = nodes.select("node")
    inner = edges.select("parent", "child").filter("parent <> child").distinct()
    inner = inner.join(known.select(F.col("node").alias("parent")), "parent", "left_semi").join(known.select(F.col("node").alias("child")), "child", "left_semi")
    inner = stored(inner)
    with scratch(nodes.sparkSession) as keep:
        depths = walk(inner, keep).select("node", "depth", F.lit(True).alias("linked"))
        placed = nodes.join(depths, "node", "left")
        placed = stored(placed.withColumn("depth", F.when(F.col("linked").isNull(), 0).otherwise(F.col("depth"))).drop("linked"))
    deepest = placed.agg(F.max("depth")).first()[0]
    return Levels(placed, inner, -1 if deepest is None else deepest)


def in_order(levels: Levels, step: Callable[[DataFrame, DataFrame | None], DataFrame], up: bool = False) -> tuple[DataFrame, DataFrame]:
    """(results, left) of a step taken for all nodes of a level at once, after the level before it.

    Levels go from the roots down, or with `up` from the deepest nodes to the roots. step(ready, given) gets the level's
    rows and, but for the first level, what the step has returned for their parents (with `up` their children): rows
    (to, ...result columns) in which `to` is the level's node and `node` the one that was done. It returns rows
    (node, ...), one or more for a node. `left` are the nodes without a depth.

    A level's result is stored; it is joined with the next level alone, so what is done costs nothing more.
    """
    placed, inner, deepest = levels
    left = placed.filter("depth is null").drop("depth")
    if deepest < 0:
        return step(left, None), left
    to, of = ("parent", "child") if up else ("child", "parent")
    links, parts = inner.select(F.col(to).alias("to"), F.col(of).alias("of")), []
    for depth in range(deepest, -1, -1) if up else range(deepest + 1):
        ready = placed.filter(F.col("depth") == depth).drop("depth")
        given = links.join(parts[-1], links["of"] == parts[-1]["node"]).drop("of") if parts else None
        parts.append(stored(step(ready, given)))
    return reduce(DataFrame.unionByName, parts), left


def subtree_sums(levels: Levels, columns: list[str]) -> DataFrame:
    """H2: node and, for each of `columns`, the sum over the node and all nodes under it.

    Nulls are passed over; a sum of nulls alone is null. Nodes on a cycle and under one have no sum."""

    def step(ready: DataFrame, given: DataFrame | None) -> DataFrame:
        own = ready.select("node", *columns)
        if given is None:
            return own
        return own.unionByName(given.select(F.col("to").alias("node"), *columns)).groupBy("node").agg(*(F.sum(c).alias(c) for c in columns))

    return in_order(levels, step, up=True)[0]


def subtree_values(levels: Levels, own: DataFrame, value: str) -> DataFrame:
    """H2: node and each value that it or a node under it has in `own` (node, value), once. A value is a row on the way
    up, so no set is held in a row or a task."""
    held = stored(own.select("node", value))

    def step(ready: DataFrame, given: DataFrame | None) -> DataFrame:
        mine = held.join(ready.select("node"), "node", "left_semi")
        return mine if given is None else mine.unionByName(given.select(F.col("to").alias("node"), value)).distinct()

    return in_order(levels, step, up=True)[0]


def subtree_counts(levels: Levels, values: str) -> DataFrame:
    """H2: node and n, the number of distinct values that it and the nodes under it have in the array column `values`. On
    the way up a value is a row, as in subtree_values(), but a node's own ones come with it, without a join; nodes without
    any have no row."""

    def step(ready: DataFrame, given: DataFrame | None) -> DataFrame:
        mine = ready.select("node", F.explode(F.array_distinct(values)).alias("value"))
        return mine if given is None else mine.unionByName(given.select(F.col("to").alias("node"), "value")).distinct()

    return in_order(levels, step, up=True)[0].groupBy("node").agg(F.count("*").alias("n"))


def subtree_totals(levels: Levels, columns: list[str], values: str) -> DataFrame:
    """H2: subtree_sums() and subtree_counts() in one way up: node, the sums of `columns` and n, the number of distinct
    values in the arrays `values` (0 without any). A node's sums are a row without a value beside the rows of its values,
    so each level meets the edges once."""

    def step(ready: DataFrame, given: DataFrame | None) -> DataFrame:
        none = F.array(F.lit(None).cast(ready.schema[values].dataType.elementType))
        each = F.explode(F.concat(none, F.coalesce(F.array_compact(F.array_distinct(values)), F.array_compact(none)))).alias("value")
        mine = ready.select("node", *columns, each).withColumns({c: F.when(F.col("value").isNull(), F.col(c)) for c in columns})
        if given is None:
            return mine
        return mine.unionByName(given.select(F.col("to").alias("node"), *columns, "value")).groupBy("node", "value").agg(*(F.sum(c).alias(c) for c in columns))

    return in_order(levels, step, up=True)[0].groupBy("node").agg(*(F.sum(c).alias(c) for c in columns), F.count("value").alias("n"))
