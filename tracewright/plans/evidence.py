"""Queries of graphs, texts, errors, labels and evidence (G, F, C, L, R, S)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.config import DEFAULTS
from tracewright.functions import text as tx
from tracewright.operators import errors, graph, labels, memory
from tracewright.operators.facts import facts
from tracewright.sources.driver_tables import sql, table, trace_events, work_events

from .findings import _EDITS


def _edges(spark, d):
    """Customers under nations under regions, as one tree of prefixed names."""
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    low = table(spark, d, "customer").select(name("c", "c_custkey").alias("child"), name("n", "c_nationkey").alias("parent"), F.lit("spawn").alias("kind"))
    high = table(spark, d, "nation").select(name("n", "n_nationkey").alias("child"), name("r", "n_regionkey").alias("parent"), F.lit("fork").alias("kind"))
    return low.unionByName(high)


def root_walk(spark, d):
    return graph.walk(graph.ranked_edges(_edges(spark, d)))


def tree_rollup(spark, d):
    values = table(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node"), F.round("c_acctbal", 2).alias("v"))
    return graph.tree_rollup(values, root_walk(spark, d), "v")


def components(spark, d):
    """G7 over all session-path links."""
    rows = trace_events(spark, d).filter("kind = 'tool_call' and path is not null")
    return graph.families(rows.select(F.concat(F.lit("s"), F.col("session_id").cast("string")).alias("a"), F.col("path").alias("b")))


def _docs(spark, d):
    return table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang", "source")


def redact_text(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(tx.redact(F.col("text"))).alias("digest"), F.length(tx.redact(F.col("text"))).cast("long").alias("chars"))


def secret_scan(spark, d):
    hits = lambda p: F.regexp_count("text", F.lit(p)).cast("long")
    rows = _docs(spark, d).select("doc_id", hits(tx.SECRET).alias("secrets"), hits(tx.EMAIL).alias("emails"), hits(tx.IPV4).alias("addresses"), hits(tx.PHONE).alias("phones"))
    return rows.filter("secrets + emails + addresses + phones > 0")


def lexicon_hits(spark, d):
    return _docs(spark, d).filter(tx.lexicon(F.col("text"), ("was", "des", "und", "que"))).groupBy("lang", "source").agg(F.count("*").alias("n"))


def deliverables(spark, d):
    rows = table(spark, d, "pages").select("page_id", F.explode(tx.deliverables(F.concat_ws(" ", "url", "html"))).alias("item"))
    return rows.groupBy("page_id").agg(F.count("*").alias("items"), F.max(F.length("item")).cast("long").alias("longest"))


def stable_ids(spark, d):
    return _docs(spark, d).select("doc_id", tx.stable_id(F.col("source"), F.col("doc_id"), F.col("lang")).alias("id"))


def output_shapes(spark, d):
    return _docs(spark, d).select("doc_id", *tx.output_shape(F.col("text")), tx.word_count(F.col("text")).alias("words"), tx.approx_tokens(F.col("text")).alias("tokens"))


def text_excerpts(spark, d):
    return _docs(spark, d).select(
        "doc_id", tx.truncate(F.col("text"), 80).alias("cut"), tx.head_tail(F.col("text"), 30, 20).alias("ends"), tx.excerpt(F.col("text"), tx.EMAIL).alias("around"), tx.error_line(F.col("text"), "@").alias("line")
    )


def content_dup_alias(spark, d):
    return memory.aliases(_docs(spark, d), "doc_id", "text")


def command_intents(spark, d):
    rows = work_events(spark, d).filter("command is not null")
    c = F.col("command")
    shown = (tx.command_intent(c).alias("intent"), "command", tx.check_command(c).alias("checks"), tx.edits_file(c).alias("edits"), F.coalesce(tx.exit1_is_answer(c), F.lit(False)).alias("answers"))
    return rows.groupBy(*shown).agg(F.count("*").alias("n"))


def model_classes(spark, d):
    return trace_events(spark, d).groupBy(tx.model_class(F.col("model")).alias("class")).agg(F.count("*").alias("n"), F.round(F.avg("seconds"), 6).alias("mean"))


def failure_signals_tristate(spark, d):
    rows = errors.signals(trace_events(spark, d).filter("kind = 'tool_result'"), F.concat_ws(" ", "error", "call_id"), F.col("k") % 11 == 0)
    return rows.groupBy("signal").agg(*(F.count_if(c).alias(n) for n, c in (("yes", F.col("value")), ("no", ~F.col("value")), ("unknown", F.col("value").isNull()))))


def error_categories(spark, d):
    rows = facts(work_events(spark, d)).filter("kind = 'tool_result' and not ok")
    found = rows.select("session_id", errors.classify(F.col("text"), None, F.col("exit_code"), F.col("c_command")).alias("e"))
    return found.groupBy("e.category", "e.severity", "e.confidence").agg(F.count("*").alias("n"), F.countDistinct("session_id").alias("sessions"))


def impediments(spark, d):
    rows = work_events(spark, d).filter("kind = 'tool_result'")
    return rows.groupBy(errors.impediment(F.concat_ws(" ", "text", "error")).alias("impediment")).agg(F.count("*").alias("n"))


def error_actions(spark, d):
    return errors.action_groups(trace_events(spark, d).filter("error is not null"))


def incident_groups(spark, d):
    return errors.incident_groups(trace_events(spark, d).filter("kind = 'tool_result'"), ["call_id"])


def failure_recovery(spark, d):
    return errors.recovery(trace_events(spark, d).filter("kind = 'tool_result'"), "call_id")


def outcomes(spark, d):
    words = DEFAULTS["lexicons"]
    return errors.outcomes(facts(work_events(spark, d)), tuple(words["correction"]), tuple(words["positive"]))


def label_eval(spark, d):
    return labels.agreement(table(spark, d, "labels").join(_docs(spark, d), "doc_id"), ["lang"], "quality", "toxic")


def evaluator_confusion(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id", "left")
    predicted = F.when(F.col("n_chars") % 7 != 0, F.col("n_chars") > 900)
    return labels.confusion(rows.withColumn("predicted", predicted), ["lang"], F.col("quality") == 1, F.col("predicted"))


def guidance_chunks(spark, d):
    return memory.chunks(table(spark, d, "benchmark"), "item_id", "text", 100, 20).select("item_id", "chunk", F.length("part").cast("long").alias("chars"), F.md5("part").alias("digest"))


def evidence_batches(spark, d):
    return memory.batches(table(spark, d, "benchmark").select("item_id", F.octet_length("text").cast("long").alias("bytes")), "item_id", "bytes", 2000, 40)


def hook_summaries(spark, d):
    hooks = spark.createDataFrame([("tests", r"pytest"), ("git", r"^git\s+(\w+)"), ("writes", r"> *\S+")], "hook string, pattern string")
    return memory.hooks(trace_events(spark, d).filter("command is not null"), hooks)


def evidence_recurrence(spark, d):
    return memory.recurrence(trace_events(spark, d).filter("error is not null"), "error", F.col("session_id") % 7, 2)


QUERIES = {
    f.__name__: f
    for f in (
        root_walk, tree_rollup, components, redact_text, secret_scan, lexicon_hits, deliverables, stable_ids, output_shapes, text_excerpts, content_dup_alias,
        command_intents, model_classes, failure_signals_tristate, error_categories, impediments, error_actions, incident_groups, failure_recovery, outcomes, label_eval,
        evaluator_confusion, guidance_chunks, evidence_batches, hook_summaries, evidence_recurrence,
    )
}

_DOCS = "(SELECT doc_id, coalesce(text, '') AS text, lang, source FROM documents)"
_EDGES = """edges AS (SELECT 'c' || c_custkey AS child, 'n' || c_nationkey AS parent FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation),
walk AS (SELECT DISTINCT parent AS node, parent AS root, 0 AS depth FROM edges WHERE parent NOT IN (SELECT child FROM edges)
    UNION ALL SELECT e.child, w.root, w.depth + 1 FROM walk w JOIN edges e ON e.parent = w.node)"""


def _words(name: str) -> str:
    return "'" + tx.alternation(tuple(DEFAULTS["lexicons"][name])).replace("'", "''") + "'"


def redact_sql(text: str) -> str:
    for pattern, name in ((tx.SECRET, "<secret>"), (tx.EMAIL, "<email>"), (tx.URL, "<url>"), (tx.PHONE, "<phone>"), (tx.IPV4, "<ip>")):
        text = f"regexp_replace({text}, '{pattern.replace(chr(39), chr(39) * 2)}', '{name}', 'g')"
    return text


def _hits_sql(pattern: str) -> str:
    return f"CAST(len(regexp_extract_all(text, '{pattern}')) AS BIGINT)"


_UPTO = "OVER (PARTITION BY session_id ORDER BY idx ROWS UNBOUNDED PRECEDING)"
ORACLE_SQL = {
    "root_walk": f"WITH RECURSIVE {_EDGES} SELECT node, root, CAST(depth AS BIGINT) AS depth FROM walk",
    "tree_rollup": f"WITH RECURSIVE {_EDGES} SELECT root, count(*) AS nodes, round(sum(round(c_acctbal, 2)), 2) AS total FROM walk JOIN customer ON node = 'c' || c_custkey GROUP BY root",
    "components": "WITH RECURSIVE " + sql(
        """AND_WITH links AS (SELECT DISTINCT 's' || session_id AS a, path AS b FROM ev WHERE kind = 'tool_call' AND path IS NOT NULL),
        both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
        reach AS (SELECT a AS node, a AS other FROM both_ways UNION SELECT r.node, e.b FROM reach r JOIN both_ways e ON r.other = e.a)
        SELECT node, min(other) AS label FROM reach GROUP BY node""",
        "ev",
    ).removeprefix("WITH "),
    "redact_text": f"SELECT doc_id, md5({redact_sql('text')}) AS digest, length({redact_sql('text')}) AS chars FROM {_DOCS}",
    "secret_scan": f"""SELECT * FROM (SELECT doc_id, {_hits_sql(tx.SECRET)} AS secrets, {_hits_sql(tx.EMAIL)} AS emails, {_hits_sql(tx.IPV4)} AS addresses,
        {_hits_sql(tx.PHONE)} AS phones FROM {_DOCS}) WHERE secrets + emails + addresses + phones > 0""",
    "lexicon_hits": f"SELECT lang, source, count(*) AS n FROM {_DOCS} WHERE regexp_matches(text, '(?i)(?:^|[^\\p{{L}}\\p{{N}}_])(?:was|des|und|que)(?:[^\\p{{L}}\\p{{N}}_]|$)') GROUP BY lang, source",
    "deliverables": """SELECT page_id, count(*) AS items, max(length(item)) AS longest FROM (SELECT DISTINCT page_id, unnest(list_concat(
        regexp_extract_all(concat_ws(' ', url, html), 'https?://[^\\s"''<>)]+'), regexp_extract_all(concat_ws(' ', url, html), '(?:[A-Za-z0-9_-]+/)+[A-Za-z0-9_.-]+'), regexp_extract_all(concat_ws(' ', url, html), '`[^`\\n]+`'))) AS item FROM pages)
        GROUP BY page_id""",
    "stable_ids": "SELECT doc_id, substr(sha256(concat_ws(chr(31), source, CAST(doc_id AS VARCHAR), lang)), 1, 24) AS id FROM documents",
    "output_shapes": f"""SELECT doc_id, length(text) AS chars, len(string_split(text, chr(10))) AS lines, sha256(text) AS sha256,
        len(regexp_extract_all(text, '\\S+')) AS words, greatest(1, length(text) // 4) AS tokens FROM {_DOCS}""",
    "text_excerpts": f"""SELECT doc_id, CASE WHEN length(text) > 80 THEN left(text, 80) || '… +' || (length(text) - 80) ELSE text END AS cut,
        CASE WHEN length(text) > 50 THEN left(text, 30) || ' … ' || right(text, 20) ELSE text END AS ends,
        CASE WHEN regexp_matches(text, '{tx.EMAIL}') THEN substr(text, greatest(1, strpos(text, regexp_extract(text, '{tx.EMAIL}')) - 20), 60) END AS around,
        left(list_filter(string_split(text, chr(10)), lambda x: contains(lower(x), '@'))[1], 300) AS line FROM {_DOCS}""",
    "content_dup_alias": f"""SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS canonical, count(*) OVER (PARTITION BY text) AS copies FROM {_DOCS}""",
    "command_intents": sql(
        f"""SELECT {errors.intent_sql("command")} AS intent, command, {errors.intent_sql("command")} = 'build_test' AND NOT regexp_matches(command, '^ruff format') AS checks,
        {_EDITS} AS edits, regexp_matches(regexp_replace(trim(string_split_regex(command, '[;|&]+')[-1]), '^\\S*/', ''), '{tx._ANSWERS}') AS answers, count(*) AS n
        FROM work WHERE command IS NOT NULL GROUP BY ALL""",
        "made", "work",
    ),
    "model_classes": sql("SELECT split_part(model, ':', 1) AS class, count(*) AS n, round(avg(seconds), 6) AS mean FROM ev GROUP BY 1", "ev"),
    "failure_signals_tristate": sql(
        "AND_WITH s AS ("
        + " UNION ALL ".join(
            f"SELECT '{n}' AS signal, CASE WHEN regexp_matches(concat_ws(' ', error, call_id), '{p}') THEN true WHEN k % 11 = 0 THEN NULL ELSE false END AS value FROM ev WHERE kind = 'tool_result'"
            for n, p in errors.SIGNALS.items()
        )
        + ") SELECT signal, count(*) FILTER (value) AS yes, count(*) FILTER (NOT value) AS no, count(*) FILTER (value IS NULL) AS unknown FROM s GROUP BY signal",
        "ev",
    ),
    "error_categories": sql(
        f"""SELECT category, severity, confidence, count(*) AS n, count(DISTINCT session_id) AS sessions FROM (
        SELECT session_id, {errors.classify_sql("text", "c_command", "exit_code")} FROM f WHERE kind = 'tool_result' AND NOT ok) GROUP BY category, severity, confidence""",
        "made", "work", "f",
    ),
    "impediments": sql(
        "SELECT CASE WHEN len(hits) = 1 THEN hits[1] END AS impediment, count(*) AS n FROM (SELECT list_filter(["
        + ", ".join(f"CASE WHEN regexp_matches(concat_ws(' ', text, error), '{p}') THEN '{n}' END" for n, p in errors.IMPEDIMENTS.items())
        + "], lambda x: x IS NOT NULL) AS hits FROM work WHERE kind = 'tool_result') GROUP BY 1",
        "made", "work",
    ),
    "evidence_batches": """WITH RECURSIVE o AS (SELECT item_id, CAST(octet_length(encode(text)) AS BIGINT) AS bytes, lane, row_number() OVER (PARTITION BY lane ORDER BY item_id) AS r FROM (
            SELECT *, CAST('0x' || substr(md5(CAST(item_id AS VARCHAR)), 1, 8) AS BIGINT) % (SELECT greatest(1, CAST(ceil(count(*) / 40) AS BIGINT)) FROM benchmark) AS lane FROM benchmark)),
        p AS (SELECT item_id, bytes, lane, r, CAST(0 AS BIGINT) AS batch, bytes AS fill FROM o WHERE r = 1 UNION ALL
            SELECT o.item_id, o.bytes, o.lane, o.r, p.batch + CASE WHEN p.fill + o.bytes > 2000 THEN 1 ELSE 0 END, CASE WHEN p.fill + o.bytes > 2000 THEN o.bytes ELSE p.fill + o.bytes END
            FROM p JOIN o ON o.lane = p.lane AND o.r = p.r + 1)
        SELECT item_id, lane, bytes, batch FROM p""",
    "error_actions": sql(
        f"""AND_WITH acted AS (SELECT *, CASE error {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in errors.ACTIONS.items())} ELSE 'inspect' END AS action FROM ev WHERE error IS NOT NULL),
        placed AS (SELECT *, row_number() OVER (PARTITION BY action ORDER BY session_id, idx) AS r FROM acted)
        SELECT action, count(*) AS n, count(DISTINCT error) AS errors, count(DISTINCT session_id) AS sessions,
        string_agg(session_id || ':' || idx, ', ' ORDER BY session_id, idx) FILTER (r <= 3) AS examples FROM placed GROUP BY action""",
        "ev",
    ),
    "incident_groups": sql(
        """SELECT session_id, call_id, reset, count(*) AS failures, min(idx) AS first_idx, max(idx) AS last_idx FROM (
        SELECT *, CAST(sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY session_id, call_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS BIGINT) AS reset FROM ev WHERE kind = 'tool_result')
        WHERE NOT ok GROUP BY session_id, call_id, reset""",
        "ev",
    ),
    "failure_recovery": sql(
        """AND_WITH r AS (SELECT *, min(CASE WHEN ok THEN idx END) OVER (PARTITION BY session_id, call_id ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS success,
            row_number() OVER (PARTITION BY session_id, call_id ORDER BY idx) AS place, count(*) OVER (PARTITION BY session_id, call_id) AS n FROM ev WHERE kind = 'tool_result')
        SELECT f.session_id, f.call_id, f.idx, f.success AS recovered_idx, coalesce(g.place, f.n) - f.place AS attempts,
        CASE WHEN f.success IS NOT NULL THEN 'success' WHEN f.place = f.n THEN 'terminal_stop' ELSE 'unresolved' END AS outcome
        FROM r f LEFT JOIN r g ON f.session_id = g.session_id AND f.success = g.idx WHERE NOT f.ok""",
        "ev",
    ),
    "outcomes": sql(
        f"""AND_WITH runs AS (SELECT *, lower(command) AS low, is_exec AND command IS NOT NULL AS runs, coalesce(r_ok, ok) AS fine FROM f),
        per AS (SELECT session_id, arg_max(text, idx) FILTER (kind = 'user_msg' AND coalesce(text, '') <> '') AS said, max(idx) FILTER (is_write) AS edit,
            arg_max(fine, idx) FILTER (runs AND fine IS NOT NULL AND (intent = 'build_test' OR {" OR ".join(f"contains(low, '{m}')" for m in errors.TEST_MARKERS)})) AS test,
            max(idx) FILTER (runs AND ({" OR ".join(f"contains(low, '{m}')" for m in errors.REVERTS)})) AS revert, coalesce(bool_or(runs AND contains(low, 'git commit') AND coalesce(fine, true)), false) AS committed FROM runs GROUP BY session_id),
        reasons AS (SELECT session_id, CASE WHEN regexp_matches(said, {_words("correction")}) THEN 'corrected' WHEN NOT test THEN 'test_failed' WHEN revert > edit THEN 'reverted' WHEN regexp_matches(said, {_words("positive")}) THEN 'approved'
            WHEN test THEN 'test_passed' WHEN committed THEN 'committed' ELSE 'no_signal' END AS reason FROM per)
        SELECT session_id, reason, CASE WHEN reason IN ('corrected', 'test_failed', 'reverted') THEN 'negative' WHEN reason = 'no_signal' THEN 'unknown' ELSE 'positive' END AS label FROM reasons""",
        "made", "work", "f",
    ),
    "label_eval": """SELECT lang, count(*) AS n, round(avg(CASE WHEN quality = 1 THEN 1.0 ELSE 0 END), 6) AS first_rate, round(avg(CASE WHEN toxic = 1 THEN 1.0 ELSE 0 END), 6) AS second_rate,
        round(avg(CASE WHEN quality = toxic THEN 1.0 ELSE 0 END), 6) AS agreement FROM labels JOIN documents USING (doc_id) GROUP BY lang""",
    "evaluator_confusion": """AND_WITH""".replace("AND_WITH", "")
    + """SELECT lang, tp, fp, fn, tn, abstained, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall,
        round((tp + tn) / nullif(tp + fp + fn + tn, 0), 6) AS accuracy FROM (
        SELECT lang, count(*) FILTER (g AND p) AS tp, count(*) FILTER (NOT g AND p) AS fp, count(*) FILTER (g AND NOT coalesce(p, false)) AS fn, count(*) FILTER (NOT g AND NOT p) AS tn,
        count(*) FILTER (p IS NULL) AS abstained FROM (SELECT lang, quality = 1 AS g, CASE WHEN n_chars % 7 <> 0 THEN n_chars > 900 END AS p FROM labels LEFT JOIN documents USING (doc_id))
        GROUP BY lang)""",
    "guidance_chunks": """SELECT item_id, chunk, length(part) AS chars, md5(part) AS digest FROM (SELECT item_id, c AS chunk, substr(text, c * 80 + 1, 100) AS part
        FROM benchmark, unnest(range(0, greatest(1, CAST(ceil((length(text) - 20) / 80) AS BIGINT)))) AS u(c))""",
    "hook_summaries": sql(
        """SELECT hook, value, count(*) AS n, count(DISTINCT session_id) AS sessions FROM (
        SELECT session_id, hook, regexp_extract(command, pattern) AS value FROM ev, (VALUES ('tests', 'pytest'), ('git', '^git\\s+(\\w+)'), ('writes', '> *\\S+')) AS h(hook, pattern)
        WHERE command IS NOT NULL AND regexp_matches(command, pattern)) GROUP BY hook, value""",
        "ev",
    ),
    "evidence_recurrence": sql(
        "SELECT error AS item, count(*) AS n, count(DISTINCT session_id % 7) AS groups, count(DISTINCT session_id % 7) >= 2 AS recurs FROM ev WHERE error IS NOT NULL GROUP BY error", "ev"
    ),
}
