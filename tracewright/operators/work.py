"""What happens within sessions: episodes' facts, runs, stuck stretches, spending by what responses do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions import text as tx

from . import sequence as s
from .errors import impediment
from .facts import is_call, is_read, is_result, is_said, is_user, is_write
from .tails import is_usage, rounds

#: How success and proof of it are put.
SUCCESS, PROOF = r"(?i)\b(?:done|fixed|complete|completed|works|all set|passes|passing)\b", r"(?i)\b(?:tests? pass(?:ed|es)?|verified|confirmed|all green|[0-9]+ passed)\b"


def between(rows: DataFrame, first: int | Column, last: int | Column) -> DataFrame:
    """The events from one idx to another, both included."""
    return rows.filter(F.col("idx").between(first, last))


def eligible(rows: DataFrame) -> DataFrame:
    """What people said: user messages with words that no harness put there."""
    return rows.filter(is_user() & (F.trim(F.coalesce("text", F.lit(""))) != "") & (tx.normalize_request(F.col("text")) != ""))


def episode_facts(rows: DataFrame) -> DataFrame:
    """Facts of each episode (rows of facts() with a column episode, in order of idx): repeated calls, paths
    read, paths read again though unchanged, edits, edits with no test after them, tests and failed tests, whether the
    last result failed, the impediment, whether a compaction came before, success declared and proved."""
    seen = F.row_number().over(Window.partitionBy("session_id", "signature").orderBy("idx"))
    was = F.lag("category").over(Window.partitionBy("session_id", "path").orderBy("idx"))
    touched = rows.filter("touch is not null").select("session_id", "idx", was.alias("was"))
    calls = rows.filter(is_call() & F.col("signature").isNotNull()).select("session_id", "idx", seen.alias("nth"))
    joined = rows.join(touched, ["session_id", "idx"], "left").join(calls, ["session_id", "idx"], "left")
    is_test = F.coalesce(F.col("intent") == "build_test", F.lit(False))
    tested = F.max(F.when(is_test, F.col("idx"))).over(Window.partitionBy("session_id", "episode"))
    joined = joined.withColumn("tested", tested)
    failed = is_result() & (F.col("ok") == F.lit(False))
    found = joined.groupBy("session_id", "episode").agg(
        F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"), F.count_if(F.col("nth") > 1).alias("repeats"),
        F.countDistinct(F.when(is_read(), F.col("path"))).alias("paths_read"), F.count_if(is_read() & (F.col("was") == "read")).alias("reread_unchanged"),
        F.count_if(is_write()).alias("edits"), F.count_if(is_write() & (F.col("idx") > F.coalesce("tested", F.lit(-1)))).alias("edits_untested"),
        F.count_if(is_test).alias("tests"), F.count_if(is_test & F.col("r_failed")).alias("tests_failed"),
        F.max_by("ok", F.when(is_result() & F.col("ok").isNotNull(), F.col("idx"))).alias("last_ok"),
        F.min_by(impediment(F.concat_ws(" ", "text", "error")), F.when(failed & impediment(F.concat_ws(" ", "text", "error")).isNotNull(), F.col("idx"))).alias("impediment"),
        F.max(F.col("compacted").isNotNull()).alias("after_compaction"), F.bool_or(is_said() & F.col("text").rlike(SUCCESS)).alias("declares"),
        F.bool_or((is_said() | is_result()) & F.col("text").rlike(PROOF) | (is_test & F.coalesce("r_ok", F.lit(False)))).alias("proved"),
    )
    yes = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return found.select(*(c for c in found.columns if c not in ("last_ok", "declares", "proved")), (F.col("last_ok") == F.lit(False)).alias("outstanding"), yes("declares"), yes("proved")).withColumn(
        "outstanding", F.coalesce("outstanding", F.lit(False))
    )


def with_episode(rows: DataFrame, bounds: DataFrame) -> DataFrame:
    """Events with the number of the episode (session_id, first_idx, last_idx) that holds them, in order."""
    numbered = bounds.withColumn("episode", F.row_number().over(Window.partitionBy("session_id").orderBy("first_idx")))
    numbered = numbered.select(F.col("session_id").alias("of"), "first_idx", "last_idx", "episode")
    return rows.join(numbered, (rows.session_id == numbered.of) & rows.idx.between(F.col("first_idx"), F.col("last_idx"))).drop("of", "first_idx", "last_idx")


def positions(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """The place of each row among those of its group, as `i of n`."""
    n = F.count("*").over(Window.partitionBy(*by))
    return rows.withColumn("position", F.concat(F.row_number().over(Window.partitionBy(*by).orderBy(order)).cast("string"), F.lit(" of "), n.cast("string")))


def display_runs(rows: DataFrame) -> DataFrame:
    """Calls of one category side by side as one line: session_id, run, category, calls, first_idx, last_idx."""
    calls = rows.filter(is_call())
    changed = ~F.col("category").eqNullSafe(F.lag("category").over(s.session())) | F.lag("idx").over(s.session()).isNull()
    runs = calls.withColumn("changed", changed).withColumn("run", F.sum(s.flag(F.col("changed"))).over(s.upto()))
    return runs.groupBy("session_id", "run").agg(F.first("category").alias("category"), F.count("*").alias("calls"), F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"))


def stuck(rows: DataFrame, k: int = 3) -> DataFrame:
    """The places where the last k calls all failed, the first of each unbroken stretch: session_id, first_idx,
    last_idx, calls."""
    last = s.session().rowsBetween(1 - k, 0)
    calls = rows.filter(is_call()).withColumns({"bad": F.sum(s.flag(F.col("r_failed"))).over(last), "island": F.sum(s.flag(~F.col("r_failed"))).over(s.upto())})
    found = calls.filter("r_failed").groupBy("session_id", "island").agg(F.count("*").alias("calls"), F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"), F.max("bad").alias("bad"))
    return found.filter(F.col("bad") >= k).drop("island", "bad")


def thrashing(rows: DataFrame, turns: int = 2) -> DataFrame:
    """A path that is edited after each of `turns` failed tests in a row: session_id, path, edits, first_idx, last_idx."""
    edits = rows.filter(is_write() & F.col("path").isNotNull() & F.col("test_failed").isNotNull())
    per = edits.groupBy("session_id", "path").agg(F.countDistinct("test_failed").alias("edits"), F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"))
    return per.filter(F.col("edits") >= turns)


def billed(rows: DataFrame) -> DataFrame:
    """The usage of each response once, its first row; usage without a response all counts."""
    first = F.row_number().over(Window.partitionBy("session_id", "response_id").orderBy("idx"))
    return rows.filter(is_usage()).withColumn("nth", F.when(F.col("response_id").isNull(), 1).otherwise(first)).filter("nth = 1").drop("nth")


def tokens_by_model(rows: DataFrame) -> DataFrame:
    """A3: tokens of each session by model."""
    return billed(rows).groupBy("session_id", "model").agg(F.count("*").alias("responses"), *(F.sum(c).alias(c) for c in ("input", "output", "cache_read", "cache_write")))


def phase_spend(rows: DataFrame, cost: Column) -> DataFrame:
    """M6: cost by what the responses do, and what no response can be named for as `unallocated`."""
    named = rounds(rows).select("session_id", "response_id", "category").withColumn("known", F.lit(True))
    spent = billed(rows).withColumn("cost", cost).drop("category").join(named, ["session_id", "response_id"], "left")
    return spent.groupBy(F.coalesce("category", F.lit("unallocated")).alias("phase")).agg(F.count("*").alias("responses"), F.round(F.sum("cost"), 8).alias("cost"))


def expense_context(rows: DataFrame, most: int = 8) -> DataFrame:
    """The requests of a session that took most tokens, with their share of the session's."""
    spent = billed(rows).withColumn("tokens", F.coalesce("input", F.lit(0)) + F.coalesce("output", F.lit(0)))
    per = spent.groupBy("session_id", "scope").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("responses"))
    per = per.withColumn("share", F.round(F.col("tokens") / F.sum("tokens").over(Window.partitionBy("session_id")), 6))
    place = F.row_number().over(Window.partitionBy("session_id").orderBy(F.col("tokens").desc(), "scope"))
    return per.withColumn("place", place.cast("long")).filter(F.col("place") <= most)


def tier(model: Column, effort: Column, tiers: dict[str, int]) -> Column:
    """A model's tier at an effort: exact, then the model at any effort, then the longest pattern (with *) that
    fits, then the default; null if none."""
    name = F.concat_ws(":", model, effort)
    found: Column = F.lit(tiers.get("default")).cast("int")
    patterns = sorted((k for k in tiers if "*" in k and not k.endswith(":*")), key=lambda k: (len(k), k))
    for rule in [*patterns, *sorted(k for k in tiers if k.endswith(":*")), *sorted(k for k in tiers if "*" not in k and k != "default")]:
        parts = ["".join("\\" + c if c in r".^$+?{}[]\|()" else c for c in p) for p in rule.split("*")]
        found = F.when(name.rlike("^" + ".*".join(parts) + "$"), F.lit(tiers[rule])).otherwise(found)
    return found


def fresh_tokens(text: Column, occupancy: Column) -> list[Column]:
    """M8: millions of tokens that a fresh start would have read at least and at most: the request, and a prompt of
    unknown size."""
    request = tx.approx_tokens(F.coalesce(text, F.lit("")))
    system = F.greatest(F.lit(0), F.least(occupancy, F.greatest(occupancy - request, F.floor(occupancy / 5))))
    return [request / 1e6, (request + system) / 1e6]


def baseline(text: Column, occupancy: Column, price: float) -> list[Column]:
    """M8: what a fresh start would have cost at least and at most."""
    return [(tokens * price).alias(name) for tokens, name in zip(fresh_tokens(text, occupancy), ("low", "high"), strict=True)]


def cost_of(record: Column, keys: tuple[str, ...] = ("total_cost_usd", "cost.total", "cost", "usage.cost")) -> Column:
    """The first of the paths under which a record states a cost as a number; true and false are none."""
    found = [F.when(F.schema_of_variant(F.try_variant_get(record, f"$.{k}", "variant")).rlike("^(?:DOUBLE|BIGINT|DECIMAL|FLOAT|INT)"), F.try_variant_get(record, f"$.{k}", "double")) for k in keys]
    return F.coalesce(*found)
