"""Session trees: ranked edges, roots and depths, families."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Whether the shuffle files of a write go when it ends; they would stay until the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _checkpoint_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only a local session that names none gets a local one."""
    if spark.sparkContext.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="tracewright-"))
    return spark.sparkContext.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """A checkpoint in the folder of spark.checkpoint.dir."""
    _checkpoint_folder(df.sparkSession)
    return df.checkpoint()


@contextmanager
def settings(spark: SparkSession, given: dict[str, str]) -> Iterator[None]:
    """Settings that hold for what is run within the block."""
    before = {k: spark.conf.get(k, None) for k in given}
    try:
        for k, v in given.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@contextmanager
def kept(df: DataFrame) -> Iterator[DataFrame]:
    """The rows by column on the executors' disks, for the block. They stay in the tasks they were made in, and how they
    were dealt is still known: what is dealt by the same key is not dealt again, nor are joins on that key and others."""
    with settings(df.sparkSession, {"spark.sql.requireAllClusterKeysForCoPartition": "false"}):
        rows = df.persist(StorageLevel.DISK_ONLY)
        try:
            yield rows
        finally:
            rows.unpersist()


def _written(df: DataFrame, folder: str) -> DataFrame:
    with settings(df.sparkSession, {CLEANUP: "true"}):
        df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def stored(df: DataFrame) -> DataFrame:
    """The rows as Parquet beside the checkpoints: less than a tenth of a checkpoint of the same rows, and the shuffle
    files of the write go with its end. How they were dealt is not known any more, so a checkpoint suits what is small."""
    return _written(df, f"{_checkpoint_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}")


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """stored() for rows that nothing reads after the block: their files are deleted at its end."""
    folder = f"{_checkpoint_folder(spark)}/scratch-{uuid.uuid4().hex}"
    try:
        yield lambda df: _written(df, f"{folder}/{uuid.uuid4().hex}")
    finally:
        at = spark._jvm.org.apache.hadoop.fs.Path(folder)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def ranked_edges(edges: DataFrame) -> DataFrame:
    """G1: one parent a child: spawn before fork before created, then the smaller parent."""
    rank = F.when(F.col("kind") == "spawn", 1).when(F.col("kind") == "fork", 2).otherwise(3)
    place = F.row_number().over(Window.partitionBy("child").orderBy(rank, "parent"))
    return edges.filter("child <> parent").withColumn("place", place).filter("place = 1").drop("place")


def walk(edges: DataFrame, keep: Callable[[DataFrame], DataFrame] = cut_lineage) -> DataFrame:
    """Node, root, depth of every node, by pointer doubling: each round follows twice as many edges.

    Takes one parent a child. Nodes on a cycle, and those under one, get the cycle's smallest member as root and a null
    depth. A parent that is no child is a root of depth 0. A node that has reached its root is put aside, so no join
    meets the many nodes of one root. Rounds go on until every node has, or has gone as many steps as there are edges,
    which only nodes at a cycle can; the lineage of each is cut by `keep`, so the plan stays small however deep the trees are."""
    roots = edges.select(F.col("parent").alias("node")).join(edges.select(F.col("child").alias("node")), "node", "left_anti").distinct()
    top = keep(roots.select(F.col("node").alias("root")))
    first = edges.select(F.col("child").alias("node"), F.col("parent").alias("up"), F.lit(1).cast("long").alias("steps"), F.least("child", "parent").alias("low"))
    first = keep(first.join(top, F.col("up") == F.col("root"), "left"))
    steps, most = 1, first.count()
    done, active = first.filter("root is not null"), first.filter("root is null")
    every, left = first, active.count()
    while left and steps < 2 * most:
        ahead = every.select(F.col("node").alias("at"), F.col("up").alias("further"), F.col("steps").alias("more"), F.col("low").alias("lower"), F.col("root").alias("ends"))
        moved = active.join(ahead, active.up == ahead["at"]).select(
            "node", F.col("further").alias("up"), (F.col("steps") + F.col("more")).alias("steps"), F.least("low", "lower").alias("low"), F.col("ends").alias("root")
        )
        moved = keep(moved)
        done, active, steps = done.unionByName(moved.filter("root is not null")), moved.filter("root is null"), 2 * steps
        every = keep(done.unionByName(active))
        done, left = every.filter("root is not null"), active.count()
    # After that many steps a node stands on its cycle, all of which its walk from there has seen.
    around = active.select(F.col("node").alias("on"), F.col("low").alias("least"))
    cycles = active.join(around, active.up == around["on"]).select("node", F.col("least").alias("root"), F.lit(None).cast("long").alias("depth"))
    found = done.select("node", "root", F.col("steps").alias("depth")).unionByName(cycles)
    return found.unionByName(top.select(F.col("root").alias("node"), "root", F.lit(0).cast("long").alias("depth")))


def without_cycles(edges: DataFrame) -> DataFrame:
    """The edges without the weakest of each cycle (the latest kind, then the larger child)."""
    far = walk(edges)
    members = far.filter("depth is null").select(F.col("node").alias("child"), F.col("root").alias("cycle"))
    rank = F.when(F.col("kind") == "spawn", 1).when(F.col("kind") == "fork", 2).otherwise(3)
    inner = edges.join(members, "child")
    # A member that is nobody's parent within the cycle only hangs from it, and so do those under it.
    while True:
        parents = inner.select(F.col("parent").alias("child"), F.col("cycle").alias("of")).distinct()
        on = cut_lineage(inner.join(parents, "child").filter("cycle = of").select(*inner.columns))
        if on.count() == inner.count():
            break
        inner = on
    weakest = on.groupBy("cycle").agg(F.max_by("child", F.struct(rank, "child")).alias("child"))
    return edges.join(weakest.select("child"), "child", "left_anti")


def families(links: DataFrame) -> DataFrame:
    """Node and label, the smallest node that it is linked with over any links (a, b).

    Rounds of the least label among neighbours, each followed by a jump to the label's own label, until nothing
    changes; each round is a checkpoint."""
    both = cut_lineage(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label")))
    changed = 1
    while changed:
        near = both.join(label, both.b == label.node).groupBy(F.col("a").alias("of")).agg(F.min("label").alias("seen"))
        lower = cut_lineage(label.join(near, label.node == near.of).select("node", F.col("label").alias("was"), F.least("label", "seen").alias("label")))
        jump = lower.select(F.col("node").alias("at"), F.col("label").alias("further"))
        moved = cut_lineage(lower.join(jump, lower.label == jump["at"]).select("node", "was", F.least("label", "further").alias("label")))
        changed = moved.filter("was <> label").limit(1).count()
        label = moved.drop("was")
    return label


def tree_rollup(values: DataFrame, nodes: DataFrame, value: str) -> DataFrame:
    """M3: a value summed over each root's tree; nodes without a tree are their own root."""
    joined = values.join(nodes.select("node", "root"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    return joined.groupBy("root").agg(F.count("*").alias("nodes"), F.round(F.sum(value), 2).alias("total"))
