"""Published tables: written aside, described by a manifest, made current by one rename, by one writer at a time."""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names in a published folder.
CURRENT, LEASE, VERSIONS = "_current", "_lease", "_versions"


class Busy(RuntimeError):
    """Another writer holds the folder's lease."""


def _files(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def _write(spark: SparkSession, path: str, text: str, overwrite: bool = False) -> None:
    fs, at = _files(spark, path)
    stream = fs.create(at, overwrite)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def _read(spark: SparkSession, path: str) -> str | None:
    fs, at = _files(spark, path)
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def _rename_over(spark: SparkSession, source: str, target: str) -> None:
    """One rename that replaces the target, which readers see before or after but never half."""
    jvm = spark._jvm
    fs, at = _files(spark, source)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(kind, 1)
    options[0] = kind.OVERWRITE
    context.rename(at, jvm.org.apache.hadoop.fs.Path(target), options)


@contextmanager
def lease(spark: SparkSession, folder: str, seconds: float = 3600) -> Iterator[str]:
    """K9: the right to write to a folder, a file that only one writer can make; Busy if another has it.

    A lease that is older than `seconds` is one of a writer that died: it is renamed away, which only one of those who
    find it can do, and taken anew. It is given back only by its owner.
    """
    path, owner = f"{folder.rstrip('/')}/{LEASE}", uuid.uuid4().hex
    fs, at = _files(spark, path)
    fs.mkdirs(at.getParent())
    if fs.exists(at) and time.time() - fs.getFileStatus(at).getModificationTime() / 1000 > seconds:
        aside = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{owner}")
        if fs.rename(at, aside):
            fs.delete(aside, False)
    try:
        _write(spark, path, owner)
    except Exception as error:
        if fs.exists(at):
            raise Busy(folder) from error
        raise
    try:
        yield owner
    finally:
        if _read(spark, path) == owner:
            fs.delete(at, False)


def digest(table: DataFrame) -> tuple[int, str]:
    """Rows of a table and a digest of them that does not depend on their order: one pass, partial sums."""
    row = F.sha2(F.to_json(F.struct(*sorted(table.columns))), 256)
    part = F.conv(F.substring(row, 1, 15), 16, 10).cast("decimal(38,0)")
    n, total = table.agg(F.count("*"), F.coalesce(F.sum(part), F.lit(0).cast("decimal(38,0)"))).first()
    return n, hashlib.sha256(f"{n}:{total}:{sorted(table.dtypes)}".encode()).hexdigest()


def manifest(spark: SparkSession, folder: str) -> dict | None:
    """What is current in a folder: version, rows, digest, key; None before the first publication."""
    name = _read(spark, f"{folder.rstrip('/')}/{CURRENT}")
    return None if name is None else json.loads(_read(spark, f"{folder.rstrip('/')}/{VERSIONS}/{name}.json"))


def publish(table: DataFrame, folder: str, key: str = "", keep: int = 2, seconds: float = 3600) -> dict:
    """K9: makes a table the current version of a folder, and returns its manifest.

    The rows are written to a folder of their own and read back for their number and digest; then the manifest is
    written, and the pointer to it is renamed over the old one. Whatever fails before that rename leaves the old version
    current and readable. The `keep` latest versions stay, so readers of the one before are not cut off.
    """
    spark, folder = table.sparkSession, folder.rstrip("/")
    with lease(spark, folder, seconds):
        version = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
        data = f"{folder}/{VERSIONS}/{version}"
        table.write.parquet(data)
        rows, sum_of_rows = digest(spark.read.parquet(data))
        made = {"version": version, "rows": rows, "digest": sum_of_rows, "key": key}
        _write(spark, f"{data}.json", json.dumps(made))
        _write(spark, f"{folder}/{CURRENT}.{version}", version)
        _rename_over(spark, f"{folder}/{CURRENT}.{version}", f"{folder}/{CURRENT}")
        fs, at = _files(spark, f"{folder}/{VERSIONS}")
        published = sorted(n.removesuffix(".json") for f in fs.listStatus(at) if (n := f.getPath().getName()).endswith(".json"))
        for old in published[: max(0, len(published) - keep)]:
            # The manifest goes first: data without one is no version.
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{VERSIONS}/{old}.json"), False)
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{VERSIONS}/{old}"), True)
    return made


def current(spark: SparkSession, folder: str, check: bool = False) -> DataFrame:
    """The current version's rows. With `check` they are held against their manifest; a difference is refused."""
    held = manifest(spark, folder)
    if held is None:
        raise FileNotFoundError(f"nothing is published in {folder}")
    table = spark.read.parquet(f"{folder.rstrip('/')}/{VERSIONS}/{held['version']}")
    if check and digest(table) != (held["rows"], held["digest"]):
        raise ValueError(f"the rows in {folder} are not those of its manifest")
    return table


def stage(spark: SparkSession, folder: str, name: str, inputs: list[str], settings: dict, make: Callable[[], DataFrame]) -> tuple[DataFrame, bool]:
    """(rows, whether they were made) of a stage, made anew only if its name, its inputs' digests or its settings
    have changed since what is current in the folder was published."""
    key = hashlib.sha256(json.dumps([name, sorted(inputs), settings], sort_keys=True).encode()).hexdigest()
    held = manifest(spark, folder)
    if held is not None and held["key"] == key:
        return current(spark, folder), False
    publish(make(), folder, key)
    return current(spark, folder), True


def differences(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Key, change and was for what two runs do not have in common: added, removed, changed (the same key with
    other columns) or moved (`was` is the old key of the one row that had, and the one that now has, these columns).

    Keys are distinct in each run. Rows are compared by a digest of their other columns; contents that several rows
    have lost or gained are not paired. One full join by key, and one of the unpaired contents.
    """
    columns = sorted(c for c in new.columns if c != key)
    side = lambda t, n: t.select(F.col(key).alias("key"), F.sha2(F.to_json(F.struct(*columns)), 256).alias(n))
    met = side(old, "was_d").join(side(new, "now_d"), "key", "full").filter(~F.col("was_d").eqNullSafe(F.col("now_d")))
    change = F.when(F.col("was_d").isNull(), "added").when(F.col("now_d").isNull(), "removed").otherwise("changed")
    rows = met.select("key", change.alias("change"), F.coalesce("now_d", "was_d").alias("d"))
    gone, come = (F.col("change") == c for c in ("removed", "added"))
    moved = rows.filter("change <> 'changed'").groupBy("d").agg(F.count_if(gone).alias("g"), F.count_if(come).alias("c"), F.max(F.when(gone, F.col("key"))).alias("was"), F.max(F.when(come, F.col("key"))).alias("now")).filter("g = 1 and c = 1")
    pairs = moved.select(F.col("now").alias("key"), F.lit("moved").alias("change"), "was")
    done = moved.select(F.col("now").alias("key")).unionByName(moved.select(F.col("was").alias("key")))
    rest = rows.join(done, "key", "left_anti").select("key", "change", F.lit(None).cast(rows.schema["key"].dataType).alias("was"))
    return pairs.unionByName(rest)
