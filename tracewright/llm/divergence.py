"""Quality rules: counts, and divergence from language references (operator 5). DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, cut_lineage, table

#: Common words of a language's reference.
COMMON_WORDS = 40
#: Largest Jensen-Shannon distances, and the characters and words from which they count.
MOST_CHAR_DISTANCE, MOST_WORD_DISTANCE, LEAST_CHARS, LEAST_WORDS = 0.3, 0.6, 200, 80
LEAST_BASE_WORDS, MOST_REPEATED_PERCENT = 50, 50
#: Character classes by their members; what is in none of them is the class `other`.
CLASSES = {
    "lower": "abcdefghijklmnopqrstuvwxyz",
    "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": "0123456789",
    "space": " \t\n\x0b\x0c\r",
    "symbol": "#*$%&|<>",
    "mark": ".,;:!?'\"()-",
}


def let(value: F.Column, body) -> F.Column:
    """body(value) with the value worked out once a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(words: F.Column) -> F.Column:
    """Words inside windows of three that occur twice or more in the array; windows are compared by hashes of the
    words' hashes, of 64 bits each."""
    last = F.size(words) - 3

    def windows(h: F.Column) -> F.Column:
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2)))

    def cover(hashes: F.Column) -> F.Column:
        """Only texts in which a window comes again need their windows in order."""
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(F.aggregate(let(placed, again), zero, widen, lambda a: a["n"]))

    def again(s: F.Column) -> F.Column:
        key = lambda p: F.get(s, p)["h"]
        twice = lambda p: key(p).eqNullSafe(key(p - 1)) | key(p).eqNullSafe(key(p + 1))
        places = F.filter(F.sequence(F.lit(0), F.size(s) - 1), twice)
        return F.sort_array(F.transform(places, lambda p: F.get(s, p)["i"]))

    def widen(acc: F.Column, i: F.Column) -> F.Column:
        return F.struct((acc["n"] + i + 3 - F.greatest(acc["end"], i)).alias("n"), (i + 3).alias("end"))

    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(last >= 0, let(hashes, lambda h: let(windows(h), cover))).otherwise(0).cast("long")


def repeated_lines(lines: F.Column) -> F.Column:
    """Lines with a word that equal an earlier line."""
    worded = F.filter(lines, lambda x: x.rlike(WORD))
    return let(worded, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def word_counts(words: F.Column, common: F.Column, longest: F.Column) -> F.Column:
    """Structs (which, n): how often each of the `common` words comes, by its place from 1. No word of more than
    `longest` bytes, those of the longest common one, can be any of them."""
    near = F.filter(words, lambda w: F.octet_length(w) <= longest)
    found = F.sort_array(F.filter(F.transform(near, lambda w: F.array_position(common, w)), lambda i: i > 0))
    starts = lambda s: F.transform(F.array_distinct(s), lambda i: F.struct(i.cast("int").alias("which"), F.array_position(s, i).alias("at")))
    sized = lambda s, t: F.transform(
        t, lambda x, k: F.struct(x["which"].alias("which"), (F.coalesce(F.get(t, k + 1)["at"], F.size(s) + 1) - x["at"]).cast("int").alias("n"))
    )
    return let(found, lambda s: let(starts(s), lambda t: sized(s, t)))


def features(docs: DataFrame, common: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """id, lang, the base counts, n_<class> and common_counts (see word_counts) of every row; null text is empty.

    `common` has a row (of_lang, common, longest) a language; it is broadcast. Each text is cut into words once.
    """
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )
    rows = rows.join(F.broadcast(common), F.col("lang").eqNullSafe(F.col("of_lang")), "left")
    # Letters first: what is left of a text is short, so the other classes cost little.
    lower = F.length(F.translate("text", CLASSES["lower"], ""))
    rest = let(
        F.translate("text", CLASSES["lower"], ""),
        lambda t: F.struct(*((F.length(t) - F.length(F.translate(t, v, ""))).cast("long").alias(f"n_{k}") for k, v in CLASSES.items() if k != "lower")),
    )
    counted = let(
        F.regexp_extract_all("text", F.lit(WORD), 0),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words"),
            word_counts(w, F.col("common"), F.col("longest")).alias("common_counts"),
        ),
    )
    found = rows.select(
        "id", "lang", F.length("text").cast("long").alias("n_chars"), lower.alias("n_not_lower"),
        rest.alias("c"), counted.alias("w"), repeated_lines(F.split("text", "\n")).alias("n_dup_lines"),
    )
    found = found.withColumn("n_lower", F.col("n_chars") - F.col("n_not_lower"))
    seen = sum((F.col(f"c.n_{k}") for k in CLASSES if k != "lower"), F.col("n_lower"))
    return found.select(
        "id", "lang", "n_chars", "w.n_words", (F.col("n_chars") - F.col("c.n_space")).alias("word_chars"), F.col("c.n_symbol").alias("n_symbols"),
        "n_dup_lines", "w.n_repeat_words", "w.common_counts", "n_lower", "c.*", (F.col("n_chars") - seen).alias("n_other"),
    )


def common_words(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """of_lang, common, shares, longest, all_words of each language: its COMMON_WORDS commonest words (by their order
    on ties), which share of its words each is, the bytes of the longest and the number of all words. Words are counted
    on the map side before they are shuffled."""
    lang = F.col(lang_col).cast("string").alias("lang")
    words = F.explode(F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(WORD), 0)).alias("word")
    counts = cut_lineage(docs.select(lang, words).groupBy("lang", "word").agg(F.count("*").alias("n")))
    totals = counts.groupBy(F.col("lang").alias("of_lang")).agg(F.sum("n").alias("all_words"))
    # A language is dealt over many tasks, each of which keeps its best, before the best of all are chosen.
    part = F.pmod(F.xxhash64("word"), F.lit(64)).alias("part")
    best = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.col("n").desc(), "word"))
    first = counts.withColumn("part", part).withColumn("r", best("lang", "part")).filter(F.col("r") <= COMMON_WORDS)
    first = first.withColumn("r", best("lang")).filter(F.col("r") <= COMMON_WORDS)
    listed = first.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("word", "n"))).alias("top"), F.max(F.octet_length("word")).alias("longest"))
    found = listed.join(totals, F.col("lang").eqNullSafe(F.col("of_lang")))
    shares = F.transform("top", lambda x: x["n"] / F.col("all_words"))
    return cut_lineage(found.select("of_lang", F.transform("top", lambda x: x["word"]).alias("common"), shares.alias("shares"), "longest", "all_words"))


def _part(p: F.Column, q: F.Column) -> F.Column:
    """One value's share of the Jensen-Shannon divergence in bits."""
    m = (p + q) / 2
    term = lambda x: F.when(x > 0, x / 2 * F.log2(x / m)).otherwise(0.0)
    return term(p) + term(q)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """id, the base counts, base_failed, char_distance, word_distance, kept of every row.

    A reference is learnt from all rows of a language (null is one of its own, and so is the empty string): the shares
    of its character classes, and of its commonest words, all other words being one value. The square root of the
    Jensen-Shannon divergence (in bits, so from 0 to 1) between a row's shares and its language's is its distance; a
    row whose base did not fail is kept unless a distance is over its limit. Texts under LEAST_CHARS characters or
    LEAST_WORDS words are too short for the one or the other distance and are not held to it.

    Two passes over the texts: one counts words by language, the other makes all counts of a row in the row, so no
    text and no row's histogram is shuffled. What is broadcast is one row a language, with COMMON_WORDS words each:
    the number of languages bounds it. Null text is empty; long texts are counted whole; repeated rows each get the
    same result; an empty table gives no rows; other columns are not read.
    """
    common = common_words(docs, text_col, lang_col)
    base = cut_lineage(features(docs, common.select("of_lang", "common", "longest"), id_col, text_col, lang_col))
    classes = [f"n_{k}" for k in (*CLASSES, "other")]
    by_lang = base.groupBy(F.col("lang").alias("for_lang")).agg(F.sum("n_chars").alias("all_chars"), *(F.sum(c).alias(f"all_{c}") for c in classes))
    reference = by_lang.join(common.select("of_lang", "shares"), F.col("for_lang").eqNullSafe(F.col("of_lang")), "left")
    rows = base.join(F.broadcast(reference), F.col("lang").eqNullSafe(F.col("for_lang")))
    zero = F.lit(0.0)
    seen = F.transform("common_counts", lambda c: F.struct((c["n"] / F.col("n_words")).alias("p"), F.get("shares", c["which"] - 1).alias("q")))
    added = lambda acc, x: F.struct((acc["bits"] + _part(x["p"], x["q"])).alias("bits"), (acc["p"] + x["p"]).alias("p"), (acc["q"] + x["q"]).alias("q"))
    sums = F.aggregate("seen", F.struct(zero.alias("bits"), zero.alias("p"), zero.alias("q")), added)
    q_common = F.coalesce(F.aggregate("shares", zero, lambda a, x: a + x), zero)
    rows = rows.withColumn("seen", seen).withColumn("sums", sums).withColumn("q_common", q_common)
    matched = [F.coalesce(f"sums.{c}", zero) for c in ("bits", "p", "q")]
    word = matched[0] + _part(1 - matched[1], 1 - F.col("q_common")) + (F.col("q_common") - matched[2]) / 2
    char = sum((_part(F.col(c) / F.col("n_chars"), F.col(f"all_{c}") / F.col("all_chars")) for c in classes), zero)
    distance = lambda x, held: F.when(held, F.sqrt(F.greatest(x, zero)))
    failed = (F.col("n_words") < LEAST_BASE_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    rows = rows.select(
        "id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        distance(char, F.col("n_chars") >= LEAST_CHARS).alias("char_distance"), distance(word, F.col("n_words") >= LEAST_WORDS).alias("word_distance"),
    )
    fits = (F.coalesce("char_distance", zero) <= MOST_CHAR_DISTANCE) & (F.coalesce("word_distance", zero) <= MOST_WORD_DISTANCE)
    return rows.withColumn("kept", ~F.col("base_failed") & fits)


def op5_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return found.withColumnRenamed("id", "doc_id").drop("char_distance", "word_distance")


QUERIES = {"op5_divergence": op5_divergence}


def _part_sql(p: str, q: str) -> str:
    m = f"(({p}) + ({q})) / 2"
    return " + ".join(f"CASE WHEN ({x}) > 0 THEN ({x}) / 2 * log2(({x}) / ({m})) ELSE 0 END" for x in (p, q))


def _class_sql(members: str) -> str:
    escaped = "".join(f"\\x{ord(c):02x}" for c in members)
    return f"length(text) - length(regexp_replace(text, '[{escaped}]', '', 'g'))"


_NAMES = [*CLASSES, "other"]
ORACLE_SQL = {
    "op5_divergence": rf"""
WITH rows AS (
    SELECT doc_id, coalesce('=' || lang, '') AS lang, coalesce(text, '') AS text,
        regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), windows AS (
    SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i], words[i + 1], words[i + 2]) AS n
    FROM rows, unnest(range(1, len(words) - 1)) AS u(i)
), repeats AS (
    SELECT doc_id, count(DISTINCT i + k) AS n FROM windows, unnest([0, 1, 2]) AS u(k) WHERE n > 1 GROUP BY doc_id
), lines AS (
    SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM rows)
    WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), classed AS (
    SELECT *, length(text) AS n_chars, len(words) AS n_words, {", ".join(f"{_class_sql(v)} AS n_{k}" for k, v in CLASSES.items())} FROM rows
), counted AS (
    SELECT *, n_chars - {" - ".join(f"n_{k}" for k in CLASSES)} AS n_other FROM classed
), langs AS (
    SELECT lang, sum(n_words) AS all_words, sum(n_chars) AS all_chars, {", ".join(f"sum(n_{k}) AS all_{k}" for k in _NAMES)} FROM counted GROUP BY lang
), every AS (
    SELECT doc_id, lang, unnest(words) AS word FROM rows
), common AS (
    SELECT lang, word, n / all_words AS q FROM (
        SELECT lang, word, count(*) AS n, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, word) AS r FROM every GROUP BY lang, word)
    JOIN langs USING (lang) WHERE r <= {COMMON_WORDS}
), shares AS (
    SELECT lang, sum(q) AS q_common FROM common GROUP BY lang
), matched AS (
    SELECT doc_id, sum({_part_sql("p", "q")}) AS parts, sum(p) AS p_common, sum(q) AS q_seen FROM (
        SELECT s.doc_id, q, count(*) / any_value(c.n_words) AS p FROM every s JOIN common USING (lang, word) JOIN counted c ON s.doc_id = c.doc_id
        GROUP BY s.doc_id, word, q)
    GROUP BY doc_id
), distances AS (
    SELECT doc_id, n_words, n_chars - n_space AS word_chars, n_symbol AS n_symbols,
        {" + ".join(_part_sql(f"n_{k} / n_chars", f"all_{k} / all_chars") for k in _NAMES)} AS char_bits, n_chars,
        coalesce(parts, 0) + {_part_sql("1 - coalesce(p_common, 0)", "1 - coalesce(q_common, 0)")}
            + (coalesce(q_common, 0) - coalesce(q_seen, 0)) / 2 AS word_bits
    FROM counted JOIN langs USING (lang) LEFT JOIN shares USING (lang) LEFT JOIN matched USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, coalesce(l.n, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
    n_words < {LEAST_BASE_WORDS} OR 100 * coalesce(r.n, 0) > {MOST_REPEATED_PERCENT} * n_words AS base_failed,
    NOT (n_words < {LEAST_BASE_WORDS} OR 100 * coalesce(r.n, 0) > {MOST_REPEATED_PERCENT} * n_words)
        AND (n_chars < {LEAST_CHARS} OR sqrt(greatest(char_bits, 0)) <= {MOST_CHAR_DISTANCE})
        AND (n_words < {LEAST_WORDS} OR sqrt(greatest(word_bits, 0)) <= {MOST_WORD_DISTANCE}) AS kept
FROM distances d LEFT JOIN repeats r USING (doc_id) LEFT JOIN lines l USING (doc_id)
"""
}
