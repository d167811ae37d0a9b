"""URL filter: trust and distrust propagated over links between hosts (operator 1). DataFrame functions only."""

from __future__ import annotations

from math import ceil, log

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut_lineage, table

#: Rules (host suffix, path prefix, verdict); the longest that fits wins.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Percent of a score that walks on, percent of all scores that may be left to walk, units that all seeds of a walk share:
#: as many as sums of whole 64-bit numbers have room for, so that one of 10**10 pages starts with 10**8.
DAMPING_PERCENT, LEFT_PERCENT, UNITS = 85, 1, 10**18
#: After this many steps at most LEFT_PERCENT of all scores have not come to rest, whatever the links: 29.
STEPS = ceil(log(LEFT_PERCENT / 100) / log(DAMPING_PERCENT / 100))
#: Hosts with over 1 / HOT_SHARE of all pages, or of a walk's links, are hot: fewer than HOT_SHARE, so they are broadcast.
HOT_SHARE = 1000
_LINK = r"(?i)(?:href|src)\s*=\s*[\"']?([a-z][a-z0-9+.-]*://[^\"'\s>]*)"
#: Second-level labels under which countries register owners.
_SHARED = "ac|co|com|edu|go|gov|ne|net|or|org"
_SITE = rf"[^.]+[.](?:(?:{_SHARED})[.][a-z][a-z]|[^.]+)$"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: F.Column) -> F.Column:
    """From after the first :// to the next /, ?, # or the end, A-Z lower-cased; empty without a ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: F.Column) -> F.Column:
    """From after the host to the next ?, # or the end; empty without a ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: F.Column, path: F.Column, rules=RULES) -> tuple[F.Column, F.Column]:
    """The longest rule that fits, as text, and its verdict; null where none does."""
    rule = verdict = F.lit(None).cast("string")
    for suffix, prefix, says in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == suffix) | host.endswith("." + suffix)) & path.startswith(prefix)
        rule, verdict = F.when(fits, suffix + prefix).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def host_links(pages: DataFrame) -> DataFrame:
    """src, dst, n: links from hosts to other hosts in the pages' html, counted once a page, and for each page
    one link each way between its host and that host's site, which have one owner: its last two labels, or three where
    the last two are a country's shared ones, like co.uk."""
    found = F.explode(F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(_LINK), 1), host_of)))
    links = pages.select(F.col("host").alias("src"), found.alias("dst")).groupBy("src", "dst").agg(F.count("*").alias("n"))
    owned = pages.groupBy("host").agg(F.count("*").alias("n")).withColumn("site", F.regexp_extract("host", _SITE, 0))
    both = F.array(*(F.struct(F.col(a).alias("src"), F.col(b).alias("dst"), "n") for a, b in (("host", "site"), ("site", "host"))))
    owned = owned.select(F.inline(both))
    every = links.unionByName(owned).filter("src <> '' and dst <> '' and src <> dst")
    return every.groupBy("src", "dst").agg(F.sum("n").alias("n"))


def propagate(links: DataFrame, seeds: DataFrame, totals: dict[str, int], steps: int = STEPS, hot_share: int = HOT_SHARE) -> DataFrame:
    """says, host, score: a personalised PageRank for each verdict, from its seeds (says, host, n; n adds up to totals).

    The walk of `allow` follows the links (src, dst, n), those of `block` and `every` go against them. Scores are whole
    units and every division rounds down, so sums do not depend on the order of their terms and reruns agree; what
    rounds off or has nowhere to go is lost. The number of steps follows from the damping and what may be left to walk.

    A step is one shuffle: scores lie by host, as the links do, and what they pass on is added up on the map side
    before it is dealt by host again. Hosts with over 1 / hot_share of a walk's links, fewer than hot_share of them,
    meet their links by a broadcast of their scores instead, so no hub's links come together. Five steps make one plan,
    then a checkpoint.
    """
    share = F.create_map(*(F.lit(x) for k, n in totals.items() for x in (k, UNITS // n)))
    seed = cut_lineage(seeds.select("says", "host", (F.col("n") * share[F.col("says")]).alias("seed")))
    against = F.explode(F.array(F.lit("block"), F.lit("every"))).alias("says")
    ways = links.select(F.lit("allow").alias("says"), F.col("src").alias("host"), "dst", "n").unionByName(
        links.select(against, F.col("dst").alias("host"), F.col("src").alias("dst"), "n")
    )
    nodes = cut_lineage(ways.groupBy("says", "host").agg(F.sum("n").alias("out"), F.count("*").alias("links")))
    most = nodes.groupBy("says").agg((F.sum("links") / hot_share).alias("most"))
    hubs = cut_lineage(nodes.join(F.broadcast(most), "says").filter("links > most").select("says", "host"))
    ways = cut_lineage(ways.join(nodes.drop("links"), ["says", "host"]))
    crowded = not hubs.isEmpty()
    common = ways.join(F.broadcast(hubs), ["says", "host"], "left_anti") if crowded else ways
    of_hubs = cut_lineage(ways.join(F.broadcast(hubs), ["says", "host"], "left_semi")) if crowded else None
    moved = F.expr(f"score div 100 * {DAMPING_PERCENT} div out * n").alias("score")
    kept = seed.select("says", "host", F.expr(f"seed div 100 * {100 - DAMPING_PERCENT}").alias("score"))
    score = seed.select("says", "host", F.col("seed").alias("score"))
    for k in range(steps):
        step = common.join(score, ["says", "host"]).select("says", F.col("dst").alias("host"), moved).unionByName(kept)
        if crowded:
            high = score.join(F.broadcast(hubs), ["says", "host"], "left_semi")
            step = step.unionByName(of_hubs.join(F.broadcast(high), ["says", "host"]).select("says", F.col("dst").alias("host"), moved))
        score = step.groupBy("says", "host").agg(F.sum("score").alias("score"))
        if k % 5 == 4 or k == steps - 1:
            score = cut_lineage(score)
    return score


def judge_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust, usual of every page (page_id, url, html).

    Pages that a rule allows or blocks are seeds. Trust walks from the allowed pages' hosts along links between hosts;
    distrust walks from the blocked pages' hosts against them, since who links to the blocked is suspect. The same walk
    from all pages says what distrust is usual for a host: what sites and dead ends take away, they take from both. A
    host is blocked if its distrust exceeds both its trust and what is usual for it; others are allowed.
    Rules win over that.

    Null urls or urls without :// have an empty host and path and are allowed. Null html has no links, and html of any
    length is read whole. Links are counted a pair of hosts before any step; no step lists more than the links. Repeated
    rows count again as seeds and each gets the same verdict. An empty table gives no rows; other columns, whatever
    their names, are dropped.

    The pages of the hosts with most pages (fewer than HOT_SHARE of them, by their share) meet a broadcast verdict, all
    others are joined by host, so the pages of one host are not gathered in a task.
    """
    url = F.col("url").cast("string")
    rows = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), F.col("html").cast("string").alias("html"))
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "says": says})
    judged = cut_lineage(rows.drop("html"))
    hosts = cut_lineage(judged.groupBy("host", "says").agg(F.count("*").alias("n")))
    totals = {r.says: r.n for r in hosts.filter("host <> ''").groupBy("says").agg(F.sum("n").alias("n")).collect()}
    every = sum(totals.values())
    totals.pop(None, None)
    if totals:
        seeds = hosts.filter("says is not null").unionByName(hosts.withColumn("says", F.lit("every"))).filter("host <> ''")
        scores = propagate(cut_lineage(host_links(rows)), seeds.groupBy("says", "host").agg(F.sum("n").alias("n")), totals | {"every": every})
    else:
        scores = hosts.select("says", "host", F.col("n").alias("score")).limit(0)
    sums = hosts.groupBy("host").agg(F.sum("n").alias("n")).join(
        scores.groupBy("host").agg(*(F.sum(F.when(F.col("says") == v, F.col("score")).otherwise(0)).alias(c) for v, c in (("allow", "trust"), ("block", "distrust"), ("every", "usual")))),
        "host",
        "left",
    )
    trust, distrust, usual = (F.coalesce(c, F.lit(0)) for c in ("trust", "distrust", "usual"))
    blocked = (distrust > trust) & (distrust > usual) & (F.col("host") != "")
    verdicts = sums.select(F.col("host").alias("of"), "n", F.when(blocked, "block").otherwise("allow").alias("method"), trust.alias("trust"), distrust.alias("distrust"), usual.alias("usual"))
    verdicts = cut_lineage(verdicts)
    pages_of_all = verdicts.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(verdicts.filter(F.col("n") * HOT_SHARE > pages_of_all))
    few = judged.join(hot, judged.host == hot.of, "left_anti").join(verdicts.filter(F.col("n") * HOT_SHARE <= pages_of_all), F.col("host") == F.col("of"))
    found = judged.join(hot, judged.host == hot.of).unionByName(few)
    return found.select("page_id", "host", "path", "rule", F.coalesce("says", "method").alias("verdict"), "trust", "distrust", "usual")


def op1_link_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def _steps_sql() -> str:
    """A CTE a step."""
    parts = ["score0 AS (SELECT says, host, seed AS score FROM seed)"]
    for k in range(STEPS):
        parts.append(
            f"score{k + 1} AS MATERIALIZED (SELECT says, host, CAST(sum(score) AS BIGINT) AS score FROM ("
            f"SELECT w.says, dst AS host, score // 100 * {DAMPING_PERCENT} // outgoing * n AS score FROM ways w "
            f"JOIN score{k} s ON w.says = s.says AND w.src = s.host"
            f" UNION ALL SELECT says, host, seed // 100 * {100 - DAMPING_PERCENT} FROM seed) GROUP BY says, host)"
        )
    return ",\n".join(parts)


QUERIES = {"op1_link_trust": op1_link_trust}
_FITS = "(host = '{0}' OR host LIKE '%.{0}') AND starts_with(path, '{1}')"
_CASES = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
ORACLE_SQL = {
    "op1_link_trust": rf"""
WITH judged AS (
    SELECT page_id, html, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{_UPPER}', '{_LOWER}') AS host,
        coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
    FROM pages
), ruled AS (
    SELECT *, CASE {" ".join(f"WHEN {_FITS.format(h, p)} THEN '{h}{p}'" for h, p, _ in _CASES)} END AS rule,
        CASE {" ".join(f"WHEN {_FITS.format(h, p)} THEN '{v}'" for h, p, v in _CASES)} END AS says FROM judged
), found AS (
    SELECT host AS src, unnest(list_distinct(list_transform(
        regexp_extract_all(html, '(?i)(?:href|src)\s*=\s*["'']?([a-z][a-z0-9+.-]*://[^"''\s>]*)', 1),
        lambda u: translate(regexp_extract(u, '(?s)^.*?://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}')))) AS dst FROM ruled
), owned AS (
    SELECT host, regexp_extract(host, '{_SITE}') AS site, count(*) AS n FROM ruled GROUP BY host
), links AS (
    SELECT src, dst, CAST(sum(n) AS BIGINT) AS n FROM (
        SELECT src, dst, 1 AS n FROM found UNION ALL SELECT host, site, n FROM owned UNION ALL SELECT site, host, n FROM owned)
    WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY src, dst
), ways AS (
    SELECT *, CAST(sum(n) OVER (PARTITION BY says, src) AS BIGINT) AS outgoing FROM (
        SELECT 'allow' AS says, src, dst, n FROM links UNION ALL SELECT 'block', dst, src, n FROM links
        UNION ALL SELECT 'every', dst, src, n FROM links)
), seeds AS (
    SELECT says, host FROM ruled WHERE says IS NOT NULL UNION ALL SELECT 'every', host FROM ruled
), seed AS (
    SELECT says, host, count(*) * ({UNITS} // CAST(sum(count(*)) OVER (PARTITION BY says) AS BIGINT)) AS seed
    FROM seeds WHERE host <> '' GROUP BY says, host
),
{_steps_sql()}
SELECT page_id, r.host, path, rule, coalesce(t.score, 0) AS trust, coalesce(d.score, 0) AS distrust, coalesce(e.score, 0) AS usual,
    coalesce(r.says, CASE WHEN coalesce(d.score, 0) > greatest(coalesce(t.score, 0), coalesce(e.score, 0)) AND r.host <> ''
        THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled r LEFT JOIN score{STEPS} t ON r.host = t.host AND t.says = 'allow'
LEFT JOIN score{STEPS} d ON r.host = d.host AND d.says = 'block' LEFT JOIN score{STEPS} e ON r.host = e.host AND e.says = 'every'
"""
}
