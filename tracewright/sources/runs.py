"""Run folders of a benchmark: run.json, metrics.json and verification.json beside a session's output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _folder() -> F.Column:
    return F.regexp_extract(F.col("_metadata.file_path"), r"^(.*)/[^/]+$", 1)


def runs(spark: SparkSession, path: str) -> DataFrame:
    """A row a folder with run.json: folder, run_id, instance_id, experiment, harness, model, session_id, resolved and
    the tokens and cost that its metrics state. Metrics and verification may be missing."""

    def read(name: str, **fields: str) -> DataFrame:
        text = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", name).text(path, wholetext=True)
        record = F.try_parse_json("value")
        return text.select(_folder().alias("folder"), *(F.try_variant_get(record, f"$.{p}", k).alias(n) for n, (p, k) in {n: v.split() for n, v in fields.items()}.items()))

    run = read("run.json", run_id="run_id string", instance_id="instance_id string", experiment="experiment string", harness="harness string", run_model="model string", run_session="session_id string")
    metrics = read("metrics.json", m_input="tokens.input long", m_output="tokens.output long", m_cache_read="tokens.cache_read long", m_cache_write="tokens.cache_write long", m_cost="cost.total double")
    checked = read("verification.json", resolved="resolved boolean")
    return run.join(metrics, "folder", "left").join(checked, "folder", "left")


def backfill(events: DataFrame, found: DataFrame) -> DataFrame:
    """Events with their run's columns; a session whose usage is missing or all zero gets one usage row at its end
    with the totals of the metrics, and reliable is false for it."""
    counts = [F.coalesce(c, F.lit(0)) for c in ("input", "output", "cache_read", "cache_write")]
    folder = F.regexp_extract("file", r"^(.*)/[^/]+$", 1)
    total = F.sum(F.when(F.col("kind") == "usage", sum(counts[1:], counts[0]))).over(Window.partitionBy("session_id"))
    rows = events.withColumns({"folder": folder, "reliable": F.coalesce(total, F.lit(0)) > 0}).join(found, "folder", "left")
    last = rows.filter(~F.col("reliable") & F.col("m_input").isNotNull()).groupBy("session_id").agg(F.max_by(F.struct(*rows.columns), "idx").alias("e")).select("e.*")
    blank = {c: F.lit(None).cast(rows.schema[c].dataType) for c in ("tool", "category", "call_id", "text", "path", "command", "signature", "ok", "exit_code", "size")}
    added = last.withColumns(blank | {"kind": F.lit("usage"), "idx": F.col("idx") + 1, "cumulative": F.lit(False)} | {c: F.col(f"m_{c}") for c in ("input", "output", "cache_read", "cache_write")})
    return rows.unionByName(added.select(*rows.columns)).drop("m_input", "m_output", "m_cache_read", "m_cache_write")


def bank(spark: SparkSession, text: str) -> DataFrame:
    """A question bank in TOML as a table: feature_id, kind, question, requires, low, high. Kinds are noul (yes
    or no), score and choice; ids are unique and thresholds lie in order, else the bank is refused."""
    import tomllib

    rows, seen = [], set()
    for q in tomllib.loads(text).get("question", []):
        name, kind = q["id"], q.get("kind", "noul")
        low, high = float(q.get("negative", 0.3)), float(q.get("positive", 0.7))
        if name in seen or kind not in ("noul", "score", "choice") or not 0 <= low <= high <= 1 or (kind == "choice" and len(q.get("options", [])) < 2):
            raise ValueError(f"question {name!r} is not valid")
        seen.add(name)
        rows.append((name, kind, q["text"], list(q.get("requires", [])), low, high))
    return spark.createDataFrame(rows, "feature_id string, kind string, question string, requires array<string>, low double, high double")


def askable(bank: DataFrame, capabilities: DataFrame) -> DataFrame:
    """P10, Q3: sessions (session_id, capabilities: map of levels) with the questions all of whose needs they meet."""
    return capabilities.join(bank, F.forall("requires", lambda r: F.coalesce(F.element_at("capabilities", r), F.lit(0)) > 0)).select("session_id", "feature_id")
