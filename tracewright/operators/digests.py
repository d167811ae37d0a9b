"""What a classifier is shown of an episode: its calls with their history, messages and counts, under a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import questions
from . import sequence as s
from .facts import is_call, is_read, is_result, is_said, is_user, is_write

#: Calls and messages shown, calls named from before, rows looked back, characters of a text, the mark of
#: a cut one, characters a token, the shortest text, and how often a digest is made smaller before nothing is left.
MOST_OPS, MOST_MESSAGES, LAST_OPS, LOOK_BACK, TEXT_CAP, MARK, CHARS_PER_TOKEN, LEAST_CAP, STAGES = 12, 6, 4, 12, 400, "\n…\n", 4, 8, 16
#: What a digest needs of an event: only these columns are carried and sorted.
SHOWN = (
    "session_id", "idx", "kind", "category", "tool", "command", "path", "text", "ok", "intent", "r_exit", "r_ok", "r_failed", "input", "output", "cache_read", "repeats", "ago", "path_edits", "read_before",
    "exit_before", "edited_before", "last_message", "last_ops",
)


def ends(text: Column, cap: Column | int) -> Column:
    """a text of more than `cap` characters by its first and last ones; null is the empty text."""
    cap = F.lit(cap) if isinstance(cap, int) else cap
    keep = F.greatest(F.lit(1), F.floor((cap - len(MARK)) / 2)).cast("int")
    return F.when(F.length(text) > cap, F.concat(F.left(text, keep), F.lit(MARK), F.right(text, keep))).otherwise(F.coalesce(text, F.lit("")))


def _history(rows: DataFrame) -> DataFrame:
    """The events with what the session had done before each call, and before each event."""
    alone = F.concat(F.lit("\u0000"), F.col("idx").cast("string"))
    keyed = lambda c: Window.partitionBy("session_id", "is_op", F.coalesce(c, alone)).orderBy("idx")
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    said = F.when((is_said() | is_user()) & (F.col("text") != ""), F.col("text"))
    shown = F.concat_ws(" ", F.coalesce("tool", F.lit("op")), F.coalesce("command", "path"), F.when(F.col("r_exit").isNotNull(), F.concat(F.lit("(exit "), F.col("r_exit"), F.lit(")"))))
    back = s.session().rowsBetween(-LOOK_BACK, -1)
    ops = F.filter(F.collect_list(F.when(is_call(), ends(shown, 120))).over(back), lambda x: x.isNotNull())
    return rows.withColumn("is_op", is_call()).withColumns(
        {
            "repeats": F.count("*").over(earlier(keyed(F.col("signature")))), "ago": F.col("idx") - F.lag("idx").over(keyed(F.col("signature"))),
            "path_edits": F.sum(s.flag(is_write())).over(earlier(keyed(F.col("path")))), "read_before": F.max(is_read()).over(earlier(keyed(F.col("path")))),
            "exit_before": F.lag("r_exit").over(keyed(F.col("command"))), "edited_before": F.col("writes") - s.flag(is_write()) > 0,
            "last_message": F.last(said, ignorenulls=True).over(back), "last_ops": F.slice(ops, F.greatest(F.size(ops) - LAST_OPS + 1, F.lit(1)), LAST_OPS),
        }
    )


def digests(rows: DataFrame, episodes: DataFrame, budget: int) -> DataFrame:
    """session_id, episode and digest (a struct) of each episode (session_id, episode, first_idx, last_idx, trigger)
    over facts(); as JSON a digest takes at most `budget` tokens of CHARS_PER_TOKEN characters, see shrink().

    Shown are the first MOST_OPS calls with what the session had done before (the same call, edits and reads of the path,
    the exit of the same command, whether anything was edited), the last MOST_MESSAGES messages, what is left out by
    kind, counts over the whole episode, usage, and what came before it. Calls and messages are numbered before they are
    gathered, so what a row holds is bounded however long an episode is. Events find their episode by
    questions.overlay(). Repeated events are shown as they come.
    """
    named = episodes.select("session_id", F.lit("e").alias("level"), "first_idx", "last_idx", "episode", "trigger")
    found = questions.overlay(_history(rows).select(*SHOWN), named, ["e"], ["episode", "trigger"]).filter("episode is not null")
    own = Window.partitionBy("session_id", "episode")
    message = (is_said() | is_user()) & (F.coalesce("text", F.lit("")) != "")
    number = lambda what, order: F.when(what, F.sum(s.flag(what)).over(own.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
    found = found.withColumns({"op": number(is_call(), F.col("idx").asc()), "from_end": number(message, F.col("idx").desc()), "place": F.row_number().over(own.orderBy("idx"))})
    op = F.struct(
        F.col("idx").alias("idx"), F.coalesce("tool", F.lit("op")).alias("kind"), ends(F.coalesce("command", "path", "text"), TEXT_CAP).alias("text"), F.col("r_exit").alias("exit"), F.col("r_ok").alias("ok"),
        F.col("repeats").cast("long").alias("repeats"), F.col("ago").alias("ago"), F.coalesce("path_edits", F.lit(0)).cast("long").alias("path_edits"), F.coalesce("read_before", F.lit(False)).alias("read_before"),
        F.col("exit_before").alias("exit_before"), F.col("edited_before").alias("edited_before"),
    )
    note = F.struct(F.col("idx").alias("idx"), F.when(is_user(), "user").otherwise("assistant").alias("role"), ends(F.col("text"), TEXT_CAP).alias("text"))
    # Kinds left out are counted beside their rows: events and episodes stay in the tasks that they were dealt to.
    kind = F.coalesce("tool", F.lit("op"))
    omitted = F.coalesce(F.col("op") > MOST_OPS, F.lit(False))
    found = found.withColumn("n_kind", F.when(omitted, F.count("*").over(Window.partitionBy("session_id", "episode", omitted, kind))))
    test = is_call() & F.coalesce(F.col("intent") == "build_test", F.lit(False))
    first = F.col("place") == 1
    per = found.groupBy("session_id", "episode").agg(
        F.max("trigger").alias("trigger"), F.max(F.when(first, F.struct(ends(F.col("last_message"), TEXT_CAP).alias("text"), "last_ops"))).alias("before"),
        F.array_sort(F.collect_list(F.when(F.col("op") <= MOST_OPS, op))).alias("ops"), F.array_sort(F.collect_list(F.when(F.col("from_end") <= MOST_MESSAGES, note))).alias("messages"),
        F.array_sort(F.collect_set(F.when(omitted, F.struct(kind.alias("kind"), F.col("n_kind").alias("n"))))).alias("omitted_kinds"), F.coalesce(F.max("op"), F.lit(0)).alias("n_ops"), F.coalesce(F.max("from_end"), F.lit(0)).alias("n_messages"),
        F.struct(
            F.count_if(is_read()).alias("reads"), F.count_if(is_write()).alias("edits"), F.count_if(test).alias("tests"), F.count_if(test & F.col("r_failed")).alias("tests_failed"),
            F.count_if(is_result() & (F.col("ok") == F.lit(False))).alias("failed"),
        ).alias("counts"),
        F.struct(*(F.sum(F.when(F.col("kind") == "usage", F.col(c))).alias(c) for c in ("input", "output", "cache_read"))).alias("usage"),
    )
    digest = F.struct(
        "trigger", F.col("before.text").alias("last_message"), F.col("before.last_ops").alias("last_ops"), "ops", F.greatest(F.col("n_ops") - MOST_OPS, F.lit(0)).cast("long").alias("omitted_ops"),
        "omitted_kinds", "messages", F.greatest(F.col("n_messages") - MOST_MESSAGES, F.lit(0)).cast("long").alias("omitted_messages"), "counts", "usage",
    )
    return per.select("session_id", "episode", shrink(digest, budget).alias("digest"))


def tokens(digest: Column) -> Column:
    """Tokens that a digest takes as JSON, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(F.to_json(digest)) / CHARS_PER_TOKEN))


def shrink(digest: Column, budget: int) -> Column:
    """the digest, made smaller until it takes at most `budget` tokens.

    Each stage leaves the first call (the others count as omitted) and no message, and cuts all texts to a cap that
    halves from TEXT_CAP down to LEAST_CAP; if that is not enough after STAGES, nothing but the counts is left, and not
    even those where they alone are too long (null).
    """
    caps, cap = [], TEXT_CAP
    for _ in range(STAGES):
        caps.append(cap)
        cap = max(LEAST_CAP, cap // 2)

    def smaller(d: Column, cap: Column) -> Column:
        one = F.transform(F.slice(d["ops"], 1, 1), lambda o: o.withField("text", ends(o["text"], cap)).withField("kind", ends(o["kind"], cap)))
        # Texts cut to nothing but their ends; the trigger is a name of the segmenter's.
        kinds = F.transform(d["omitted_kinds"], lambda k: k.withField("kind", ends(k["kind"], cap)))
        made = d.withField("ops", one).withField("omitted_ops", d["omitted_ops"] + F.greatest(F.size(d["ops"]) - 1, F.lit(0))).withField("messages", F.slice(d["messages"], 1, 0))
        return made.withField("last_message", ends(d["last_message"], cap)).withField("last_ops", F.transform(d["last_ops"], lambda o: ends(o, cap))).withField("omitted_kinds", kinds)

    fitted = F.aggregate(F.array(*map(F.lit, caps)), digest, lambda d, cap: F.when(tokens(d) > budget, smaller(d, cap)).otherwise(d))
    empty = fitted.withField("trigger", F.lit("")).withField("last_message", F.lit("")).withField("last_ops", F.slice(fitted["last_ops"], 1, 0))
    empty = empty.withField("ops", F.slice(fitted["ops"], 1, 0)).withField("omitted_kinds", F.slice(fitted["omitted_kinds"], 1, 0))
    return F.when(tokens(fitted) <= budget, fitted).when(tokens(empty) <= budget, empty)
