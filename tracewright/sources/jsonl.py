"""JSONL session logs as lines with provenance: scan, format detection, discovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Suffixes of folders that an orchestrator has set aside.
SET_ASIDE = r"\.(?:quarantine|interrupted|crashed[^/]*)(?:/|$)"


def lines(spark: SparkSession, path: str, suffix: str = ".jsonl") -> DataFrame:
    """Path, place, raw for every line of the logs below a path but empty ones.

    Large files are split over tasks. A place orders the lines of a file: the start of the split and the row's number
    in it, both known where the line is read. Folders that were set aside are left out."""
    text = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").text(path)
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), row.alias("row"))
    found = text.select(F.col("_metadata.file_path").alias("path"), place.alias("place"), F.col("value").alias("raw"))
    return found.filter((F.trim("raw") != "") & ~F.col("path").rlike(SET_ASIDE))


def numbered(rows: DataFrame) -> DataFrame:
    """Lines (or what was made of them) with their number in the file, from 1 and without empty ones."""
    return rows.withColumn("line", F.row_number().over(Window.partitionBy("path").orderBy("place")).cast("long"))


def records(spark: SparkSession, path: str) -> DataFrame:
    """lines() with record (variant) and bad; a line that is not a JSON object is bad and has no record."""
    parsed = F.when(F.ltrim("raw").startswith("{"), F.try_parse_json("raw"))
    return lines(spark, path).withColumn("record", parsed).withColumn("bad", F.col("record").isNull())


def distinct_files(rows: DataFrame) -> DataFrame:
    """S3: path, lines, canonical, role of every file of lines(): one file of each content is kept, the others are its
    aliases; a file with whose lines another begins is its older snapshot.

    A file's signature after n lines is the sum of the hashes of its lines with their numbers (two sums, so 128 bits).
    A file is a snapshot if another has its signature after as many lines: an equi join of one row a file with one row
    a line, so no two files are compared and no text is shuffled."""
    of = Window.partitionBy("path").orderBy("place")
    hashed = rows.select("path", "place", *(F.xxhash64(F.lit(k), "raw").alias(f"h{k}") for k in (0, 1))).withColumn("n", F.row_number().over(of).cast("long"))
    wide = lambda c: F.xxhash64("n", c).cast("decimal(38,0)")
    sums = hashed.select("path", "n", *(F.sum(wide(f"h{k}")).over(of).alias(f"s{k}") for k in (0, 1)))
    key = ["n", "s0", "s1"]
    whole = sums.groupBy("path").agg(F.max("n").alias("n"), F.max_by("s0", "n").alias("s0"), F.max_by("s1", "n").alias("s1"))
    first = whole.groupBy(*key).agg(F.min("path").alias("first"))
    sizes = whole.select(F.col("path").alias("longer"), F.col("n").alias("of"))
    later = sums.select(F.col("path").alias("longer"), *key).join(first, key).join(sizes, "longer").filter("of > n")
    newer = later.groupBy("first").agg(F.max_by("longer", F.struct("of", "longer")).alias("newer"))
    found = whole.join(first, key).join(newer, "first", "left")
    role = F.when(F.col("newer").isNotNull(), "snapshot").when(F.col("path") != F.col("first"), "alias").otherwise("kept")
    return found.select("path", F.col("n").alias("lines"), F.coalesce("newer", "first").alias("canonical"), role.alias("role"))


def get(record: str | Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(F.col(record) if isinstance(record, str) else record, path, kind)


def family(record: str = "record") -> Column:
    """Which decoder reads a record, from its own shape."""
    kind = get(record, "$.type")
    return (
        F.when(kind.isin("session_meta", "turn_context", "response_item", "event_msg", "compacted", "token_usage_record"), "rollout")
        .when(kind.rlike(r"^(?:thread|turn|item)\."), "codex_stdout")
        .when(kind.isin("system", "assistant", "user", "result") | get(record, "$.uuid").isNotNull(), "claude")
        .when(kind.isin("session", "message", "message_end", "model_change", "custom") | kind.startswith("tool_execution_"), "pi")
        .otherwise("unknown")
    )


def formats(rows: DataFrame) -> DataFrame:
    """Path and format, from the shape of a file's first good record."""
    first = rows.filter("not bad").groupBy("path").agg(F.min_by("record", "place").alias("r"))
    name = (
        F.when(family("r") == "rollout", "codex_native")
        .when(family("r") == "pi", F.when((get("r", "$.type") == "session") & get("r", "$.cwd").isNotNull(), "pi_native").otherwise("pi_stdout"))
        .when(family("r") == "claude", F.when(get("r", "$.uuid").isNotNull() & get("r", "$.sessionId").isNotNull(), "claude_native").otherwise("claude_stdout"))
        .otherwise(family("r"))
    )
    return first.select("path", name.alias("format"))
