"""Queries of question passes, phase labels and priced diagnoses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewright.operators import diagnoses as dg
from tracewright.operators import questions as q
from tracewright.operators import sequence as s
from tracewright.operators import digests, structure, work
from tracewright.operators.facts import facts
from tracewright.sources import publish
from tracewright.sources.driver_tables import sql, table, trace_events, work_events

#: A bank of questions by scope, and which question opens which from what value (null: by choice alone).
BANK = (
    ("task", "identity"), ("task", "same_goal"), ("task", "new_scope"), ("task", "build"), ("task", "build_web"), ("task", "build_web_form"), ("task", "repair"), ("task", "repair_test"), ("task", "breadth"),
    ("failure", "named"), ("failure", "matches"), ("failure", "documented"), ("failure", "followed"), ("failure", "persisted"),
)
GATES = (
    ("same_goal", "identity", None), ("new_scope", "identity", None), ("build_web", "build", 0.5), ("build_web", "repair", 0.9), ("build_web_form", "build_web", 0.5), ("repair_test", "repair", 0.5),
    ("repair_test", "build_web_form", 0.8), ("matches", "named", 0.7), ("followed", "documented", 0.7), ("persisted", "followed", 0.7), ("followed", "persisted", 0.2),
)


def question_passes(spark: SparkSession, d: str) -> DataFrame:
    """`documents` as objects; what a classifier would answer is a number from their id, for all questions."""
    k = F.col("doc_id")
    objects = table(spark, d, "documents").select(F.when(k % 3 == 0, "failure").otherwise("task").alias("scope"), k.alias("object_id"))
    number = {question: n for n, (_, question) in enumerate(BANK)}
    each = F.array(*(F.struct(F.lit(question).alias("question"), F.lit(n).cast("long").alias("n")) for question, n in number.items()))
    mixed = (k * (F.col("n") * 2 + 3) + F.col("n") * 11) % 41
    answers = objects.select("object_id", F.inline(each)).withColumn("doc_id", F.col("object_id")).filter(mixed % 8 != 7).select(
        "object_id", "question", F.when(F.col("question") != "identity", mixed / 40.0).alias("value"),
        F.when(F.col("question") == "identity", F.element_at(F.array(*map(F.lit, ("same", "other", "new", "unclear"))), (mixed % 4 + 1).cast("int"))).alias("choice"),
        F.when(mixed == 5, "low_support").alias("reason"), (mixed % 13 == 6).alias("abstains"),
    )
    barred = objects.filter("object_id % 10 = 3").select("object_id", F.explode(F.array(F.lit("documented"), F.lit("build"))).alias("question"))
    bank = spark.createDataFrame(list(BANK), "scope string, question string")
    gates = spark.createDataFrame(list(GATES), "question string, parent string, least double")
    found = q.ask_passes(objects, bank, gates, answers, barred)
    return found.select("scope", "object_id", "question", "state", F.round("value", 6).alias("value"), "choice")


def _episodes(spark: SparkSession, d: str) -> DataFrame:
    return structure.episodes(trace_events(spark, d), 6 * 3600.0, 6)


def phase_labels(spark, d):
    """Episodes carry a classifier's labels; requests of some sessions a person's; long blocks a rule's."""
    events = trace_events(spark, d)
    pick = lambda key, *names: F.element_at(F.array(*map(F.lit, names)), (key % len(names) + 1).cast("int"))
    labels = lambda level, key, produce: (F.lit(level).alias("level"), pick(key, "read", "edit", "run").alias("activity"), pick(key, "orient", "investigate", "verify", "produce").alias("purpose"), produce.alias("produce"))
    e = _episodes(spark, d).filter("first_idx % 5 <> 4")
    judged = e.select("session_id", "first_idx", "last_idx", *labels("classifier", F.col("first_idx"), F.when(F.col("calls") > 0, F.col("calls") / 6.0)))
    scopes = s.request_scope(events).filter("scope >= 0").groupBy("session_id", F.col("scope").alias("first_idx")).agg(F.max("idx").alias("last_idx")).filter("first_idx % 4 = 1")
    people = scopes.select("session_id", "first_idx", "last_idx", *labels("person", F.col("first_idx") + 1, F.lit(0.0)))
    blocks = events.groupBy("session_id", (F.floor(F.col("idx") / 20) * 20).alias("first_idx")).agg(F.count("*").alias("n")).filter("first_idx % 3 <> 1")
    rules = blocks.select("session_id", "first_idx", (F.col("first_idx") + 30).alias("last_idx"), *labels("rule", F.col("first_idx"), F.lit(None).cast("double")))
    found = q.overlay(events.select("session_id", "idx"), judged.unionByName(people).unionByName(rules), ["person", "classifier", "rule"], ["activity", "purpose", "produce"])
    return found.select("session_id", "idx", "level", "from", "activity", q.purpose(F.col("purpose"), F.col("produce")).alias("purpose"))


def _claims(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Stretches of work_events(): requests with failures, from a read to the next of its path, episodes-like blocks."""
    rows = facts(work_events(spark, d))
    failed = rows.filter("scope >= 0").groupBy("session_id", F.col("scope").alias("first_idx")).agg(F.max("idx").alias("last_idx"), F.count_if(F.col("kind").eqNullSafe("tool_result") & (F.col("ok") == F.lit(False))).alias("n")).filter("n >= 2")
    reads = rows.filter("kind = 'tool_call' and category = 'read' and path is not null")
    again = reads.withColumn("first_idx", F.lag("idx").over(Window.partitionBy("session_id", "path").orderBy("idx"))).filter("first_idx is not null")
    blocks = rows.filter("kind = 'tool_call'").groupBy("session_id", (F.floor(F.col("idx") / 40) * 40).alias("first_idx")).agg(F.max("idx").alias("last_idx"), F.count("*").alias("n")).filter("n >= 8")
    name = lambda what: F.concat(F.lit(what), F.lit(":"), F.col("first_idx"), F.lit("-"), F.col("last_idx"))
    parts = ((failed, "INEFFECTIVE_ITERATION", 1), (again.withColumnRenamed("idx", "last_idx"), "DUPLICATE_WORK", 0), (blocks, "LOW_YIELD_TAIL", 2))
    each = [f.select("session_id", name(what).alias("claim"), F.lit(what).alias("diagnosis"), F.col("first_idx").cast("long").alias("first_idx"), F.col("last_idx").cast("long").alias("last_idx"), F.lit(p).alias("priority")) for f, what, p in parts]
    spend = work.billed(rows).select("session_id", "idx", dg.micros(3, 15).alias("micros"))
    return each[0].unionByName(each[1]).unionByName(each[2]), spend


def diagnosis_prices(spark, d):
    claims, spend = _claims(spark, d)
    return dg.priced_once(claims, spend).select("session_id", "claim", "diagnosis", "raw", "priced")


def diagnosis_conservation(spark, d):
    claims, spend = _claims(spark, d)
    return dg.conserved(dg.priced_once(claims, spend), spend)


def episode_digests(spark, d):
    """Some episodes fit a small budget as they are, some only after several stages."""
    rows = facts(work_events(spark, d))
    named = structure.episodes(rows, 6 * 3600.0, 20).select("session_id", F.col("first_idx").alias("episode"), "first_idx", "last_idx", F.col("reason").alias("trigger"))
    found = digests.digests(rows, named, 260)
    return found.select("session_id", "episode", F.to_json("digest").alias("digest"), digests.tokens(F.col("digest")).cast("long").alias("tokens"))


def run_differences(spark, d):
    """`orders` as the rows of two runs: the second lacks some, has others changed, under a new key, or new ones."""
    k, o = F.col("o_orderkey"), table(spark, d, "orders").select("o_orderkey", "o_custkey", F.round("o_totalprice", 2).cast("decimal(12,2)").cast("string").alias("price"))
    new = o.filter(k % 17 != 0).select(F.when(k % 19 == 0, k + 1_000_000_000).otherwise(k).alias("o_orderkey"), F.when(k % 13 == 0, F.lit(1).cast(o.schema["o_custkey"].dataType)).otherwise(F.col("o_custkey")).alias("o_custkey"), "price")
    extra = o.filter(k % 23 == 0).select((k + 2_000_000_000).alias("o_orderkey"), "o_custkey", F.lit("0").alias("price"))
    return publish.differences(o, new.unionByName(extra), "o_orderkey")


_RATES = {"alpha": (3.0, 0.3, 3.75), "beta:high": (5.0, 0.5, 6.25)}


def _continuations(spark: SparkSession, d: str) -> DataFrame:
    """Each request of work_events() is a task; its relation to the one before goes by its number and place."""
    rows = facts(work_events(spark, d))
    asked = rows.filter("kind = 'user_msg'").select("session_id", F.col("idx").alias("task"), "text")
    model = rows.filter("kind = 'usage'").groupBy("session_id").agg(F.min_by("model", "idx").alias("model"))
    ends = rows.filter("scope >= 0").groupBy("session_id", F.col("scope").alias("task")).agg(F.max("idx").alias("last_idx"))
    edge = F.when(F.col("task") % 8 == 4, "related").otherwise("unrelated")
    tasks = asked.join(ends, ["session_id", "task"]).join(model, "session_id", "left").select("session_id", "task", F.col("task").alias("first_idx"), "last_idx", edge.alias("edge"), "text", "model", (F.col("task") % 28 == 0).alias("abstains"))
    touched = rows.filter("scope >= 0 and kind = 'tool_call' and category = 'write' and path like 'tests/%'").select("session_id", F.col("scope").alias("task"), "path").distinct()
    return dg.continuations(rows, tasks, touched, _RATES, idle_minutes=30.0, window=100_000)


def continuation_burdens(spark, d):
    return _continuations(spark, d).withColumns({c: F.round(c, 8) for c in ("low", "high", "amount")})


def counterfactuals(spark, d):
    found = dg.counterfactual(_continuations(spark, d), "session_id")
    return found.withColumns({c: F.round(c, 8) for c in ("low", "high", "amount")})


QUERIES = {f.__name__: f for f in (question_passes, phase_labels, episode_digests, run_differences, diagnosis_prices, diagnosis_conservation, continuation_burdens, counterfactuals)}

_N = {question: n for n, (_, question) in enumerate(BANK)}
_values = lambda rows: ", ".join("(" + ", ".join("NULL" if x is None else repr(x) for x in r) + ")" for r in rows)
_UPTO = "OVER (PARTITION BY session_id ORDER BY idx ROWS UNBOUNDED PRECEDING)"
_CLAIMS = """spend AS (SELECT session_id, idx, coalesce(input, 0) * 3 + coalesce(output, 0) * 15 AS micros FROM f WHERE kind = 'usage' QUALIFY row_number() OVER (PARTITION BY session_id, response_id ORDER BY idx) = 1),
claims AS (SELECT session_id, 'INEFFECTIVE_ITERATION' AS diagnosis, scope AS first_idx, max(idx) AS last_idx, 1 AS priority FROM f WHERE scope >= 0 GROUP BY session_id, scope HAVING count(*) FILTER (kind = 'tool_result' AND ok = false) >= 2
    UNION ALL SELECT session_id, 'DUPLICATE_WORK', before, idx, 0 FROM (SELECT *, lag(idx) OVER (PARTITION BY session_id, path ORDER BY idx) AS before FROM f WHERE is_read AND path IS NOT NULL) WHERE before IS NOT NULL
    UNION ALL SELECT session_id, 'LOW_YIELD_TAIL', idx // 40 * 40, max(idx), 2 FROM f WHERE is_call GROUP BY session_id, idx // 40 HAVING count(*) >= 8),
named AS (SELECT *, diagnosis || ':' || first_idx || '-' || last_idx AS claim FROM claims),
shares AS (SELECT c.session_id, c.claim, c.diagnosis, s.micros, row_number() OVER (PARTITION BY s.session_id, s.idx ORDER BY c.first_idx, c.priority, c.claim) AS nth FROM named c JOIN spend s ON s.session_id = c.session_id AND s.idx BETWEEN c.first_idx AND c.last_idx),
prices AS (SELECT c.session_id, c.claim, c.diagnosis, CAST(coalesce(sum(micros), 0) AS BIGINT) AS raw, CAST(coalesce(sum(micros) FILTER (nth = 1), 0) AS BIGINT) AS priced FROM named c LEFT JOIN shares s ON s.session_id = c.session_id AND s.claim = c.claim GROUP BY 1, 2, 3)
"""
_BURDENS = """asked AS (SELECT session_id, idx AS task, text FROM f WHERE kind = 'user_msg'), ends AS (SELECT session_id, scope AS task, max(idx) AS last_idx FROM f WHERE scope >= 0 GROUP BY 1, 2),
models AS (SELECT session_id, arg_min(model, idx) AS model FROM f WHERE kind = 'usage' GROUP BY 1),
tasks AS (SELECT a.session_id, a.task, last_idx, CASE WHEN a.task % 8 = 4 THEN 'related' ELSE 'unrelated' END AS edge, text, model FROM asked a JOIN ends USING (session_id, task) LEFT JOIN models USING (session_id) WHERE a.task % 28 <> 0),
timed AS (SELECT session_id, idx, scope, kind, response_id, coalesce(input, 0) AS i, coalesce(cache_read, 0) AS r, coalesce(cache_write, 0) AS w,
    (ts - max(CASE WHEN kind NOT IN ('meta', 'usage') THEN ts END) OVER (PARTITION BY session_id ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) / 60e6 AS gap FROM f),
calls AS (SELECT * FROM timed WHERE kind = 'usage' AND scope >= 0 QUALIFY row_number() OVER (PARTITION BY session_id, response_id ORDER BY idx) = 1),
used AS (SELECT session_id, scope AS task, sum(i) AS i, sum(r) AS r, sum(w) AS w, arg_min(i + r, idx) AS occupancy, arg_min(r, idx) AS first_read, arg_min(coalesce(gap, -1), idx) AS gap FROM calls GROUP BY 1, 2),
squeezed AS (SELECT DISTINCT session_id, scope AS task FROM f WHERE kind = 'compaction'),
touched AS (SELECT DISTINCT session_id, scope AS task, path FROM f WHERE scope >= 0 AND is_write AND path LIKE 'tests/%'),
again AS (SELECT session_id, task, count(*) FILTER (first < task) AS reuse FROM (SELECT *, min(task) OVER (PARTITION BY session_id, path) AS first FROM touched) GROUP BY 1, 2),
joined AS (SELECT t.*, coalesce(occupancy, 0) AS occupancy, q.task IS NOT NULL AS compacted, coalesce(reuse, 0) AS reuse, coalesce(occupancy > 0 AND first_read / occupancy < 0.1, false) AS missed, coalesce(gap > 30, false) AS after_gap,
    CASE model WHEN 'alpha' THEN 3.0 WHEN 'beta:high' THEN 5.0 END AS rate, CASE model WHEN 'alpha' THEN (i * 3.0 + r * 0.3 + w * 3.75) / 1e6 WHEN 'beta:high' THEN (i * 5.0 + r * 0.5 + w * 6.25) / 1e6 END AS spent, u.task IS NOT NULL AS called
    FROM tasks t LEFT JOIN used u ON u.session_id = t.session_id AND u.task = t.task LEFT JOIN squeezed q ON q.session_id = t.session_id AND q.task = t.task LEFT JOIN again g ON g.session_id = t.session_id AND g.task = t.task),
fired AS (SELECT *, edge = 'unrelated' AND reuse = 0 AND ((missed AND after_gap) OR occupancy / 100000 > 0.6 OR compacted) AND rate IS NOT NULL AND called AS fires, greatest(1, length(text) // 4) AS request FROM joined),
ranged AS (SELECT *, CASE WHEN fires THEN greatest(0.0, spent - (request + greatest(0, least(occupancy, greatest(occupancy - request, occupancy // 5)))) / 1e6 * rate) END AS low, CASE WHEN fires THEN greatest(0.0, spent - request / 1e6 * rate) END AS high FROM fired)
"""
ORACLE_SQL = {
    "question_passes": f"""WITH RECURSIVE bank(scope, question) AS (VALUES {_values(BANK)}), gates(question, parent, least) AS (VALUES {_values(GATES)}), numbers(question, n) AS (VALUES {_values(_N.items())}),
objects AS (SELECT CASE WHEN doc_id % 3 = 0 THEN 'failure' ELSE 'task' END AS scope, doc_id AS object_id FROM documents),
mixed AS (SELECT object_id, question, (object_id * (n * 2 + 3) + n * 11) % 41 AS m FROM objects, numbers),
usable AS (SELECT object_id, question, CASE WHEN question <> 'identity' THEN m / 40.0 END AS value, CASE WHEN question = 'identity' THEN (['same', 'other', 'new', 'unclear'])[m % 4 + 1] END AS choice FROM mixed WHERE m % 8 <> 7 AND m <> 5 AND m % 13 <> 6),
pairs AS (SELECT scope, object_id, question, object_id % 10 = 3 AND question IN ('documented', 'build') AS barred FROM objects JOIN bank USING (scope)),
asked AS (SELECT object_id, question FROM pairs WHERE question NOT IN (SELECT question FROM gates)
    UNION SELECT a.object_id, g.question FROM asked a JOIN gates g ON g.parent = a.question JOIN usable u ON u.object_id = a.object_id AND u.question = a.question JOIN pairs p ON p.object_id = a.object_id AND p.question = a.question AND NOT p.barred
        JOIN pairs o ON o.object_id = a.object_id AND o.question = g.question WHERE coalesce(u.value >= g.least, false) OR coalesce(u.choice NOT IN ('other', 'unclear'), false)),
states AS (SELECT p.*, u.value, u.choice, CASE WHEN a.object_id IS NULL THEN 'not_asked' WHEN barred THEN 'insufficient_observability' WHEN u.object_id IS NULL THEN 'unanswered' ELSE 'answered' END AS state
    FROM pairs p LEFT JOIN asked a ON a.object_id = p.object_id AND a.question = p.question LEFT JOIN usable u ON u.object_id = p.object_id AND u.question = p.question)
SELECT scope, object_id, question, state, CASE WHEN state = 'answered' THEN round(value, 6) END AS value, CASE WHEN state = 'answered' THEN choice END AS choice FROM states""",
    "phase_labels": sql(
        f"""AND_WITH gaps AS (SELECT *, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY session_id ORDER BY idx)) / 1e6 AS gap,
            last_value(category IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM ev),
        reasons AS (SELECT *, kind = 'user_msg' OR coalesce(gap > 21600, false) OR coalesce(was = 'write' AND category = 'execute', false) AS cuts FROM gaps),
        parts AS (SELECT *, sum(CASE WHEN cuts THEN 1 ELSE 0 END) {_UPTO} AS part, coalesce(max(CASE WHEN kind = 'user_msg' THEN idx END) {_UPTO}, -1) AS scope FROM reasons),
        splits AS (SELECT *, greatest(sum(CASE WHEN kind = 'tool_call' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id, part ORDER BY idx ROWS UNBOUNDED PRECEDING) - 1, 0) // 6 AS split FROM parts),
        ranges AS (SELECT session_id, 2 AS p, 'classifier' AS level, min(idx) AS first_idx, max(idx) AS last_idx, min(idx) AS key, CASE WHEN count(*) FILTER (kind = 'tool_call') > 0 THEN count(*) FILTER (kind = 'tool_call') / 6.0 END AS produce FROM splits GROUP BY session_id, part, split HAVING min(idx) % 5 <> 4
            UNION ALL SELECT session_id, 1, 'person', scope, max(idx), scope + 1, 0.0 FROM parts WHERE scope >= 0 GROUP BY session_id, scope HAVING scope % 4 = 1
            UNION ALL SELECT session_id, 3, 'rule', idx // 20 * 20, idx // 20 * 20 + 30, idx // 20 * 20, NULL FROM ev GROUP BY session_id, idx // 20 HAVING idx // 20 * 20 % 3 <> 1),
        latest AS (SELECT e.session_id, e.idx, r.p, r.level, r.first_idx, r.last_idx, r.key, r.produce FROM ev e JOIN ranges r ON r.session_id = e.session_id AND r.first_idx <= e.idx QUALIFY row_number() OVER (PARTITION BY e.session_id, e.idx, r.p ORDER BY r.first_idx DESC) = 1),
        best AS (SELECT * FROM latest WHERE last_idx >= idx QUALIFY row_number() OVER (PARTITION BY session_id, idx ORDER BY p) = 1)
        SELECT e.session_id, e.idx, b.level, b.first_idx AS from, (['read', 'edit', 'run'])[key % 3 + 1] AS activity,
            CASE WHEN key % 4 < 2 AND coalesce(produce >= 0.7, false) THEN 'produce' ELSE (['orient', 'investigate', 'verify', 'produce'])[key % 4 + 1] END AS purpose FROM ev e LEFT JOIN best b ON b.session_id = e.session_id AND b.idx = e.idx""",
        "ev",
    ),
    "diagnosis_prices": sql(f"AND_WITH {_CLAIMS} SELECT * FROM prices", "made", "work", "f"),
    "diagnosis_conservation": sql(
        f"""AND_WITH {_CLAIMS}, totals AS (SELECT session_id, CAST(sum(micros) AS BIGINT) AS spent FROM spend GROUP BY 1), claimed AS (SELECT session_id, count(*) AS claims, CAST(sum(raw) AS BIGINT) AS raw FROM prices GROUP BY 1),
        covered AS (SELECT session_id, CAST(sum(micros) AS BIGINT) AS priced FROM spend s WHERE EXISTS (FROM named c WHERE c.session_id = s.session_id AND s.idx BETWEEN c.first_idx AND c.last_idx) GROUP BY 1)
        SELECT session_id, spent, coalesce(claims, 0) AS claims, coalesce(raw, 0) AS raw, coalesce(priced, 0) AS priced, spent - coalesce(priced, 0) AS unclaimed FROM totals LEFT JOIN claimed USING (session_id) LEFT JOIN covered USING (session_id)""",
        "made", "work", "f",
    ),
    "continuation_burdens": sql(
        f"""AND_WITH {_BURDENS} SELECT session_id, task, CASE WHEN fires THEN 'CONTINUATION_BURDEN' ELSE 'CONTEXT_CARRYOVER' END AS diagnosis, round(low, 8) AS low, round(high, 8) AS high, round((low + high) / 2, 8) AS amount,
        CASE WHEN rate IS NULL THEN 'unknown' ELSE 'exact' END AS status, missed, after_gap, compacted, occupancy, reuse FROM ranged""",
        "made", "work", "f",
    ),
    "run_differences": """WITH old AS (SELECT o_orderkey AS key, o_custkey AS c, CAST(CAST(round(o_totalprice, 2) AS DECIMAL(12,2)) AS VARCHAR) AS p FROM orders),
new AS (SELECT CASE WHEN key % 19 = 0 THEN key + 1000000000 ELSE key END AS key, CASE WHEN key % 13 = 0 THEN 1 ELSE c END AS c, p FROM old WHERE key % 17 <> 0 UNION ALL SELECT key + 2000000000, c, '0' FROM old WHERE key % 23 = 0),
met AS (SELECT coalesce(o.key, n.key) AS key, CASE WHEN o.key IS NULL THEN 'added' WHEN n.key IS NULL THEN 'removed' ELSE 'changed' END AS change, coalesce(n.c, o.c) AS c, coalesce(n.p, o.p) AS p FROM old o FULL JOIN new n ON o.key = n.key
    WHERE o.key IS NULL OR n.key IS NULL OR o.c <> n.c OR o.p <> n.p),
moved AS (SELECT max(key) FILTER (change = 'removed') AS was, max(key) FILTER (change = 'added') AS key FROM met WHERE change <> 'changed' GROUP BY c, p HAVING count(*) FILTER (change = 'removed') = 1 AND count(*) FILTER (change = 'added') = 1)
SELECT key, 'moved' AS change, was FROM moved UNION ALL SELECT key, change, NULL FROM met WHERE key NOT IN (SELECT key FROM moved UNION ALL SELECT was FROM moved)""",
    "counterfactuals": sql(
        f"AND_WITH {_BURDENS} SELECT session_id, round(min(low), 8) AS low, round(max(high), 8) AS high, round((min(low) + max(high)) / 2, 8) AS amount, 'exact' AS status, count(*) AS n FROM ranged WHERE fires GROUP BY 1",
        "made", "work", "f",
    ),
}
