"""Publication: killed and rival writers, manifests, stages that are not made again, differences of two runs."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tracewright.sources import publish


def rows(table):
    return sorted(map(tuple, table.collect()))


def test_a_killed_write_leaves_the_old_version(spark, tmp_path):
    folder = f"file://{tmp_path}/t"
    with pytest.raises(FileNotFoundError):
        publish.current(spark, folder)
    first = spark.range(5).withColumn("x", F.col("id") * 2)
    made = publish.publish(first, folder)
    assert made["rows"] == 5 and rows(publish.current(spark, folder, check=True)) == rows(first)
    broken = spark.range(8).withColumn("x", F.when(F.col("id") == 7, F.raise_error(F.lit("killed")).cast("long")).otherwise(F.col("id")))
    with pytest.raises(Exception, match="killed"):
        publish.publish(broken, folder)
    assert publish.manifest(spark, folder) == made and rows(publish.current(spark, folder, check=True)) == rows(first)
    # Dying between the data and the rename leaves the old version too, and the next writer is not held up by it.
    publish._write(spark, f"{folder}/_current.zzz", "zzz")
    for k in range(3):
        publish.publish(spark.range(k).withColumn("x", F.col("id")), folder)
    assert publish.current(spark, folder, check=True).count() == 2
    assert len([n for n in os.listdir(tmp_path / "t" / "_versions") if n.endswith(".json") and not n.startswith(".")]) == 2


def test_one_writer_at_a_time(spark, tmp_path):
    folder = f"file://{tmp_path}/t"
    with publish.lease(spark, folder):
        with pytest.raises(publish.Busy):
            publish.publish(spark.range(1), folder)
        # A lease of a writer that died is taken over, and its late owner does not give away the new one's.
        with publish.lease(spark, folder, seconds=-1) as owner:
            assert publish._read(spark, f"{folder}/_lease") == owner
    assert publish.publish(spark.range(1), folder)["rows"] == 1


def test_rows_are_held_against_the_manifest(spark, tmp_path):
    folder = f"file://{tmp_path}/t"
    made = publish.publish(spark.range(4), folder)
    again = spark.range(4).orderBy(F.col("id").desc()).repartition(3)
    assert publish.digest(again) == (made["rows"], made["digest"]) != publish.digest(spark.range(1, 5))
    assert publish.digest(spark.range(0))[0] == 0
    spark.range(9, 10).write.mode("append").parquet(f"{folder}/_versions/{made['version']}")
    with pytest.raises(ValueError, match="manifest"):
        publish.current(spark, folder, check=True)


def test_an_unchanged_stage_is_not_made_again(spark, tmp_path):
    folder, calls = f"file://{tmp_path}/s", []

    def make():
        calls.append(1)
        return spark.range(len(calls))

    runs = [publish.stage(spark, folder, "a", inputs, settings, make)[1] for inputs, settings in ((["x", "y"], {"k": 1}), (["y", "x"], {"k": 1}), (["x", "y"], {"k": 2}), (["x", "z"], {"k": 2}), (["x", "z"], {"k": 2}))]
    assert runs == [True, False, True, True, False] and len(calls) == 3
    assert publish.current(spark, folder).count() == 3


def test_differences_of_two_runs(spark):
    rng = random.Random(3)
    old = {f"k{n}": rng.choice(["a", "b", None, f"own{n}", f"own{n}"]) for n in range(60)}
    new = {}
    for n, (k, v) in enumerate(old.items()):
        what = rng.random()
        if what < 0.2:
            continue
        new[f"moved{n}" if what < 0.4 else k] = f"new{n}" if what > 0.8 else v
    new |= {"fresh": "fresh", "other": "a"}
    frame = lambda d: spark.createDataFrame(list(d.items()), "id string, v string").withColumn("w", F.lit(1)).repartition(3)
    got = {r.key: (r.change, r.was) for r in publish.differences(frame(old), frame(new), "id").collect()}
    gone, come = {k: v for k, v in old.items() if k not in new}, {k: v for k, v in new.items() if k not in old}
    want = {k: ("changed", None) for k in old if k in new and old[k] != new[k]}
    for k, v in come.items():
        alike = [g for g, x in gone.items() if x == v]
        want[k] = ("moved", alike[0]) if len(alike) == 1 and list(come.values()).count(v) == 1 else ("added", None)
    taken = {was for change, was in want.values() if change == "moved"}
    want |= {k: ("removed", None) for k in gone if k not in taken}
    assert got == want and {c for c, _ in got.values()} == {"added", "removed", "changed", "moved"}
    assert publish.differences(frame(old), frame(old), "id").count() == 0
