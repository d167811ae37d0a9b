"""Fill-in-the-middle by relational units: cuts at unit ordinals become character offsets by running sums (operator 11)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

#: A unit: a word with the white space before it, or white space at the end.
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def units(text: F.Column) -> F.Column:
    return F.regexp_extract_all(text, F.lit(UNIT), F.lit(0))


def draws(id: F.Column, seed: int) -> list[F.Column]:
    """h1 to h4: the first four 8-digit groups of the sha256 of `seed:id` as numbers; a null id counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def offsets(texts: DataFrame, seed: int = 42) -> DataFrame:
    """k1, k2, n, prefix_end, middle_end (code points) for rows (k1, k2, id, text) that lie together by (k1, k2).

    Units are posexploded, their lengths summed up by a window, and the cut requests, which are unit ordinals, joined
    to the sums. A cut before the first unit has no unit and lies at 0. Wholly equal rows are one document: `row` keeps
    their units apart in the window. Everything keeps the partitioning by (k1, k2), so nothing is shuffled here.
    """
    rows = texts.select("k1", "k2", "id", "text", F.monotonically_increasing_id().alias("row"))
    exploded = rows.select("k1", "k2", "id", "row", F.posexplode(units(F.col("text"))).alias("pos", "unit"))
    lengths = exploded.select("k1", "k2", "id", "row", "pos", F.length("unit").alias("chars"))
    run = Window.partitionBy("k1", "k2", "id", "row").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    ends = lengths.select("k1", "k2", (F.col("pos") + 1).alias("ordinal"), F.sum("chars").over(run).alias("end"))
    h1, h2, *_ = draws(F.col("id"), seed)
    counted = texts.select("k1", "k2", "id", F.size(units(F.col("text"))).cast("long").alias("n"))
    drawn = counted.select("k1", "k2", "n", (h1 % (F.col("n") + 1)).alias("c1"), (h2 % (F.col("n") + 1)).alias("c2"))
    asked = drawn.groupBy("k1", "k2").agg(F.max("n").alias("n"), F.max(F.least("c1", "c2")).alias("first"), F.max(F.greatest("c1", "c2")).alias("last"))
    # The last unit is asked for as well, so that a document has a row even if both cuts lie before the first unit.
    hit = (F.col("ordinal") == F.col("first")) | (F.col("ordinal") == F.col("last")) | (F.col("ordinal") == F.col("n"))
    met = ends.join(asked, ["k1", "k2"]).filter(hit)
    at = lambda cut: F.coalesce(F.max(F.when(F.col("ordinal") == F.col(cut), F.col("end"))), F.lit(0))
    return met.groupBy("k1", "k2").agg(F.max("n").alias("n"), at("first").alias("prefix_end"), at("last").alias("middle_end"))


def fill_in_middle(docs: DataFrame, seed: int = 42, fim_percent: int = 50, spm_percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text, n (units), form (plain, psm, spm), prefix_chars, middle_chars (code points; null if plain), output.

    A text with one of the markers and an empty one are plain. Plain texts are never shuffled. The others are dealt
    once by two hashes of id and text; units, cut requests and the final substring all read that one exchange. A null
    text is an empty one without units. A long text is cut whole; its units are one window group. Rows with the same
    id and different texts are documents of their own, with the same draws; repeated rows get equal results, one each.
    A null id is drawn like an empty one. An empty table gives no rows. Columns other than the two are not read, so
    their names cannot clash.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    text, (_, _, h3, h4) = F.col("text"), draws(F.col("id"), seed)
    stays = (text == "") | text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE) | (h3 % 100 >= fim_percent)
    none = F.lit(None).cast("long")
    plain = rows.filter(stays).select(
        "id", "text", F.size(units(text)).cast("long").alias("n"), F.lit("plain").alias("form"), none.alias("prefix_chars"), none.alias("middle_chars"), text.alias("output")
    )
    keys = (F.xxhash64("id", "text").alias("k1"), F.xxhash64("text", F.lit(seed), "id").alias("k2"))
    texts = rows.filter(~stays).select(*keys, "id", "text").repartition("k1", "k2")
    cut = texts.join(offsets(texts, seed), ["k1", "k2"]).withColumn("form", F.when(h4 % 100 < spm_percent, "spm").otherwise("psm"))
    prefix = F.substring("text", F.lit(1), F.col("prefix_end").cast("int"))
    middle = F.substring("text", (F.col("prefix_end") + 1).cast("int"), (F.col("middle_end") - F.col("prefix_end")).cast("int"))
    suffix = F.substring("text", (F.col("middle_end") + 1).cast("int"), F.lit(2**31 - 1))
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    made = cut.select(
        "id", "text", "n", "form", F.col("prefix_end").alias("prefix_chars"), (F.col("middle_end") - F.col("prefix_end")).alias("middle_chars"),
        F.when(F.col("form") == "psm", psm).otherwise(spm).alias("output"),
    )
    return plain.unionByName(made)


def restored(output: F.Column, form: F.Column) -> F.Column:
    """The text behind an output, from the output and its form alone.

    A text with a marker is plain, and no marker can arise where a text meets one, so the first of each is the real one.
    """
    whole = F.lit(2**31 - 1)
    after = lambda text, mark: F.substring(text, F.instr(text, mark) + len(mark), whole)
    before = lambda text, mark: F.substring(text, F.lit(1), F.instr(text, mark) - 1)
    body = F.substring(output, F.lit(4), whole)
    inner = {"psm": SUFFIX, "spm": PREFIX}
    psm = F.concat(before(body, inner["psm"]), after(body, MIDDLE), before(after(body, inner["psm"]), MIDDLE))
    spm = F.concat(before(after(body, inner["spm"]), MIDDLE), after(body, MIDDLE), before(body, inner["spm"]))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    return made.select(
        F.col("id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


QUERIES = {"op11_fill_in_middle": op11_fill_in_middle}
ORACLE_SQL = {
    "op11_fill_in_middle": r"""
WITH drawn AS (
    SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || CAST(doc_id AS VARCHAR)) AS d,
        regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units
    FROM documents
), numbers AS (
    SELECT doc_id, text, units, CAST(len(units) AS BIGINT) AS n, CAST('0x' || substr(d, 1, 8) AS BIGINT) AS h1,
        CAST('0x' || substr(d, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(d, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(d, 25, 8) AS BIGINT) AS h4
    FROM drawn
), cuts AS (
    SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
        CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
             WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
    FROM numbers
), parts AS (
    SELECT doc_id, text, n, form, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:n], '') AS suffix
    FROM cuts
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
    CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
    sha256(text) AS restored_sha256
FROM parts
"""
}
