"""Mixing sources to target weights by systematic sampling (operator 3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, cut_lineage, table

#: Weights of the sources in order, again and again; most copies of a document; seed of the offsets.
WEIGHTS, MOST, SEED = (5, 2, 1), 3, 20240229
#: Rows of one source and size that are ordered together.
RUN_ROWS = 500


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, target for rows (source, source_size), one a source.

    Sources in order of their UTF-8 bytes (which is code point order), null last, take the weights in turn and share
    the sum of all sizes. A target stops at `most` times its source's size; what is over goes to the others by weight.
    The outcome has a closed form: in order of most * size / weight, sources stop until the next one's share fits.
    No row, or only empty sources: targets are 0.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(order) - 1) % len(weights) + 1)
    before = Window.orderBy("room", "place").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    stopped = F.lit(most) * F.col("source_size")
    shares = (
        sizes.withColumn("place", F.row_number().over(order))
        .withColumn("weight", weight.cast("long"))
        .withColumn("room", stopped / F.col("weight"))
        .withColumn("left_size", F.sum("source_size").over(whole) - F.coalesce(F.sum(stopped).over(before), F.lit(0)))
        .withColumn("left_weight", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("level", F.col("left_size") / F.col("left_weight"))
    )
    # The first source whose share fits sets the level for itself and all after it; those before it stop.
    fitting = F.when(F.col("room") >= F.col("level"), F.struct("room", "place", "level"))
    shares = shares.withColumn("first", F.min(fitting).over(whole))
    stops = F.struct("room", "place") < F.struct("first.room", "first.place")
    target = F.when(stops, stopped.cast("double")).otherwise(F.col("first.level") * F.col("weight"))
    return shares.select("source", "source_size", target.alias("target"))


def offset(source: F.Column, seed: int) -> F.Column:
    """A number from 0 to below 1 that the seed and the source's name fix."""
    name = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.concat(F.lit("s"), source), F.lit("")))
    return F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))


def place_hash(id_col: F.Column, seed: int) -> F.Column:
    """32 hexadecimal digits that the seed and the id fix; documents of one size stand in their order."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(id_col.cast("string"), F.lit(""))))


def mix(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = SEED,
    run_rows: int = RUN_ROWS, key: F.Column | None = None,
) -> DataFrame:
    """id, source, size, source_size, target, copies (0 to MOST), key: how often the mix takes each document.

    Every document of a source has the same expected copies, target / source_size. Documents of a source stand in
    order of size, then of place_hash(id), then of `key` (any column of the documents; by default a digest of the
    text); their expected copies are added up from one random offset, and a document is taken once for each whole
    number that its own share crosses. Because neighbours in that order have nearly equal sizes, the words taken miss
    the target by no more than the source's largest document has.

    The running count has no window over a whole source: rows are counted by (source, size, slice), a slice being a
    range of place hashes, the counts (pre-aggregated on the map side) are added up, and only the rows of one slice are
    ordered by themselves. A source and size has a slice for each `run_rows` rows. Slices are ranges of one order, so
    their number changes no result. Sources are one row each where targets are set. Rows that are equal in all of this
    get neighbouring places, so reruns agree. Null text has size 0; documents of size 0 are taken or not, to no effect.
    An empty table gives no rows.
    """
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    key = F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit(""))) if key is None else key
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"),
        place_hash(F.col(id_col), seed).alias("hash"), key.alias("key"),
    )
    rows = cut_lineage(rows)
    groups = rows.groupBy("source", "size").agg(F.count("*").alias("n"))
    groups = cut_lineage(groups.withColumn("slices", F.greatest(F.lit(1), F.ceil(F.col("n") / run_rows)).cast("long")))
    sizes = groups.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    targets = source_targets(sizes)
    # Only sources and sizes of more rows than a run has slices are joined; of these there are n / run_rows at most.
    sized = groups.filter("slices > 1").select(F.col("source").alias("of_source"), F.col("size").alias("of_size"), "slices")
    in_group = F.col("source").eqNullSafe(F.col("of_source")) & (F.col("size") == F.col("of_size"))
    part = F.floor(F.conv(F.substring("hash", 1, 8), 16, 10).cast("long") * F.coalesce("slices", F.lit(1)) / F.lit(1 << 32))
    sliced = rows.join(sized, in_group, "left").select("id", "source", "size", "hash", "key", part.alias("slice"))
    counts = sliced.groupBy("source", "size", "slice").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("source").orderBy("size", "slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("start", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
    targets = targets.withColumnRenamed("source", "for_source")
    starts = counts.join(targets, F.col("source").eqNullSafe(F.col("for_source"))).select(
        F.col("source").alias("of_source"), F.col("size").alias("of_size"), F.col("slice").alias("of_slice"), "start", "source_size", "target"
    )
    placed = sliced.join(starts, in_group & (F.col("slice") == F.col("of_slice")))
    place = F.col("start") + F.row_number().over(Window.partitionBy("source", "size", "slice").orderBy("hash", "key"))
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    crossed = lambda at: F.floor(expected * at + offset(F.col("source"), seed))
    copies = (crossed(F.col("place")) - crossed(F.col("place") - 1)).cast("long")
    return placed.withColumn("place", place).select("id", "source", "size", "source_size", "target", copies.alias("copies"), "key")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents of the mix, each as often as mix() takes it, with the columns they have.

    Rows are told apart by a digest of all their columns, so rows that share an id, or have none, each get their own
    copies; wholly equal rows are one row, which gets the copies of all of them. An empty table gives no rows.
    """
    whole = F.struct(*docs.columns)
    key = F.md5(F.to_json(whole))
    copies = mix(docs, id_col, key=key, **options).groupBy("key").agg(F.sum("copies").alias("copies")).filter("copies > 0")
    rows = docs.select(key.alias("key"), whole.alias("doc")).groupBy("key").agg(F.first("doc").alias("doc"))
    found = rows.join(copies, "key").select("doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return found.select("doc.*")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies"
    )


QUERIES = {"op3_mixing": op3_mixing}
ORACLE_SQL = {
    "op3_mixing": r"""
WITH rows AS (
    SELECT doc_id, source, md5('20240229:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS hash, md5(coalesce(text, '')) AS key,
        CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), sizes AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM rows GROUP BY source
), weighted AS (
    SELECT *, CASE (place - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM sizes
), levels AS (
    SELECT *, 3 * source_size / weight AS room,
        (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER before, 0))
        / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
    FROM weighted WINDOW before AS (ORDER BY 3 * source_size / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), first_fit AS (
    SELECT room, place, level FROM levels WHERE room >= level ORDER BY room, place LIMIT 1
), targets AS (
    SELECT l.source, l.source_size,
        CASE WHEN l.room < f.room OR (l.room = f.room AND l.place < f.place) THEN CAST(3 * l.source_size AS DOUBLE)
             ELSE f.level * l.weight END AS target
    FROM levels l, first_fit f
), placed AS (
    SELECT r.*, t.source_size, t.target,
        row_number() OVER (PARTITION BY r.source ORDER BY r.size, r.hash, r.key) AS place,
        CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS expected,
        CAST('0x' || substr(md5('20240229:' || coalesce('s' || r.source, '')), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS start
    FROM rows r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, source, size, source_size, target,
    CAST(floor(expected * place + start) - floor(expected * (place - 1) + start) AS BIGINT) AS copies,
    CAST(floor(expected * place + start) - floor(expected * (place - 1) + start) AS BIGINT) * size AS taken
FROM placed
"""
}
