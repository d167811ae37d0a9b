"""What reports and audits are assembled from: folds over traces, pages, excerpts, cached answers, retained evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions import text as tx

from .costs import status_name, status_rank
from .facts import is_result
from .ranks import ranked_values

#: Candidates that a comparison takes, pairs that one makes, characters of an excerpt and rows of a page.
MOST_CANDIDATES, MOST_PAIRS, EXCERPT, PAGE = 64, 8192, 600, 100


def trace_fold(sessions: DataFrame, tree: DataFrame, measures: list[str]) -> DataFrame:
    """Measures of sessions added up over their trace (node, root), with the worst pricing status, the number
    of sessions and the notes that any of them has; a session without a tree is its own trace."""
    joined = sessions.join(tree.select(F.col("node").alias("session_id"), "root"), "session_id", "left").withColumn("trace_id", F.coalesce("root", "session_id"))
    found = joined.groupBy("trace_id").agg(
        F.count("*").alias("sessions"), *(F.sum(m).alias(m) for m in measures), F.max(status_rank(F.col("status"))).alias("worst"), F.array_sort(F.collect_set("note")).alias("notes")
    )
    return found.withColumn("status", status_name(F.col("worst"))).drop("worst")


def month_cells(diagnoses: DataFrame, cells: DataFrame) -> DataFrame:
    """Diagnoses (id, task_ids) with every month cell (task_id, month, model) of their tasks; one that no task
    leads to a cell stands under `unknown`."""
    tasks = diagnoses.select("id", F.explode_outer("task_ids").alias("task_id"))
    met = tasks.join(cells.distinct(), "task_id", "left").groupBy("id").agg(F.collect_set(F.when(F.col("month").isNotNull(), F.struct("month", "model"))).alias("cells"))
    unknown = F.array(F.struct(F.lit("unknown").alias("month"), F.lit(None).cast("string").alias("model")))
    return met.select("id", F.inline(F.when(F.size("cells") > 0, F.col("cells")).otherwise(unknown)))


def comparisons(candidates: DataFrame, chunks: DataFrame, most: int = MOST_PAIRS) -> DataFrame:
    """Every candidate (candidate_id, claim) beside every chunk of guidance. Candidates are a list of a stated
    size, which each chunk is given, and more pairs than `most` are refused."""
    listed = candidates.select("candidate_id", "claim").limit(MOST_CANDIDATES + 1).collect()
    if len(listed) > MOST_CANDIDATES or len(listed) * chunks.limit(most + 1).count() > most:
        raise ValueError(f"a comparison has at most {MOST_CANDIDATES} candidates and {most} pairs")
    given = F.array(*(F.struct(F.lit(r.candidate_id).alias("candidate_id"), F.lit(r.claim).alias("claim")) for r in listed))
    return chunks.select("*", F.inline(given)) if listed else chunks.withColumns({"candidate_id": F.lit(None), "claim": F.lit(None)}).limit(0)


def annotated(annotations: DataFrame, evidence: DataFrame) -> DataFrame:
    """Annotations with the evidence of the same source whose text is the same, by its SHA-256."""
    keyed = lambda rows: rows.withColumn("__text", F.sha2("text", 256))
    return keyed(annotations).drop("text").join(keyed(evidence), ["source", "__text"]).drop("__text")


def paged(rows: DataFrame, key: str, page: int = PAGE) -> DataFrame:
    """Rows with the number of the page that they stand on, in order of a key; rows of one key share a page."""
    ranks = ranked_values(rows.withColumn("__all", F.lit(1)), ["__all"], key)
    number = F.floor((F.col("size") - F.col("above") - F.col("n")) / page).alias("page")
    return rows.join(ranks.select(F.col("value").alias(key), number), key)


def excerpts(rows: DataFrame, limit: int = EXCERPT) -> DataFrame:
    """Of paired calls of facts(), what was asked and what came back, redacted and then cut, and whether they were."""
    asked, said = (tx.redact(F.coalesce(c, F.lit(""))) for c in (F.coalesce("command", "path", "text"), F.col("r_text")))
    cut = lambda c, name: [F.left(c, F.lit(limit)).alias(name), (F.length(c) > limit).alias(f"{name}_cut")]
    return rows.filter("paired").select("session_id", "idx", *cut(asked, "asked"), *cut(said, "said"))


def edge_of(identity: Column, corrects: Column, references: Column, together: Column) -> Column:
    """How a task relates to the one before it: the same, a correction, a follow-up, of one component, or new."""
    sure = lambda c: F.coalesce(c >= 0.7, F.lit(False))
    return F.when(sure(corrects), "corrects").when(sure(identity), "same").when(sure(references), "follows").when(sure(together), "sibling").otherwise("new")


#: Words by which a lexical baseline names what a record is.
LEXICAL = {
    "correction": ("user", r"(?i)\b(?:no|wrong|instead|actually|not what|undo|revert|stop)\b"),
    "discovery": ("assistant", r"(?i)\b(?:found|discovered|turns out|root cause|because|actually)\b"),
    "reusable": ("user", r"(?i)\b(?:always|never|from now on|remember|prefer|must|every time)\b"),
}


def lexical_baseline(records: DataFrame) -> DataFrame:
    """Records (role, text) with what a few words by role make of them."""
    return records.withColumns({n: (F.col("role") == role) & F.coalesce(F.col("text").rlike(tx.ascii_words(p)), F.lit(False)) for n, (role, p) in LEXICAL.items()})


def cached_answers(asked: DataFrame, cache: DataFrame) -> DataFrame:
    """Q1: questions (model, state, question) with their answer from a cache of answers by model and SHA-256 of state and
    question; missing says that there is none, which a job without a network must report."""
    keyed = asked.withColumns({"state_hash": F.sha2("state", 256), "question_hash": F.sha2("question", 256)})
    keys = ["model", "state_hash", "question_hash"]
    last = cache.groupBy(*keys).agg(F.max_by("value", "at").alias("value"))
    return keyed.join(last, keys, "left").withColumn("missing", F.col("value").isNull())


def retained_evidence(scores: DataFrame, least: float = 0.5) -> DataFrame:
    """Records whose best screening score (record_id, question, score) reaches the threshold."""
    return scores.groupBy("record_id").agg(F.max("score").alias("score"), F.max_by("question", F.struct("score", "question")).alias("question")).filter(F.col("score") >= least)


def composites(episodes: DataFrame) -> DataFrame:
    """Q9: of episodes' facts: recovered (failed before and not at the end), success declared without proof, and an
    investigation that led to a change."""
    order = Window.partitionBy("session_id").orderBy("episode")
    return episodes.select(
        "session_id", "episode", ((F.col("tests_failed") > 0) & ~F.col("outstanding")).alias("recovered"), (F.col("declares") & ~F.col("proved")).alias("unproved"),
        F.coalesce((F.lag("paths_read").over(order) > 0) & (F.lag("edits").over(order) == 0) & (F.col("edits") > 0), F.lit(False)).alias("investigated"),
    )


def response_charges(rows: DataFrame, bounds: DataFrame, cost: Column) -> DataFrame:
    """The cost of each response with the episode that its usage falls in, null if none does."""
    from .work import billed, with_episode

    spent = billed(rows).withColumn("cost", cost).select("session_id", "idx", "response_id", "model", "cost")
    placed = with_episode(spent, bounds).select("session_id", "idx", "episode")
    return spent.join(placed, ["session_id", "idx"], "left")


def conserved(parts: DataFrame, whole: DataFrame, keys: list[str], amount: str, within: float = 1e-9) -> DataFrame:
    """Keys whose parts do not add up to the whole."""
    sums = parts.groupBy(*keys).agg(F.sum(amount).alias("parts"))
    return whole.select(*keys, F.col(amount).alias("whole")).join(sums, keys, "full").filter(F.abs(F.coalesce("parts", F.lit(0.0)) - F.coalesce("whole", F.lit(0.0))) > within)


def behaviour(findings: DataFrame, sessions: DataFrame, by: str) -> DataFrame:
    """Per agent, how many sessions there are and how many show each finding."""
    n = sessions.groupBy(by).agg(F.count("*").alias("sessions"))
    shown = findings.select("session_id", "detector").distinct().join(sessions.select("session_id", by), "session_id")
    return shown.groupBy(by, "detector").agg(F.count("*").alias("shown")).join(n, by).withColumn("share", F.round(F.col("shown") / F.col("sessions"), 6))


def worst_results(rows: DataFrame) -> DataFrame:
    """What a call's results come to: failed if any failed, unknown if any is, else ok."""
    per = rows.filter(is_result() & F.col("call_id").isNotNull()).groupBy("session_id", "call_id")
    outcome = F.when(F.bool_or(F.col("ok") == F.lit(False)), "failed").when(F.count_if(F.col("ok").isNull()) > 0, "unknown").otherwise("ok")
    return per.agg(F.count("*").alias("results"), outcome.alias("outcome"))
