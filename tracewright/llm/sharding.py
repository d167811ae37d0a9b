"""Shards of nearly equal bytes by a minimax contiguous partition (operator 4). DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut_lineage, table

#: Leading bits of a group's hash that make the first blocks, and bits by which blocks are split further.
FIRST_BITS, MORE_BITS = 13, 5


def _fill(blocks: F.Column, capacity: F.Column, shards: int, loose: bool) -> F.Column:
    """Greedy check of a capacity: struct (n, fill, ends) for blocks (bytes, top, many, start) taken in order.

    A shard takes blocks while they fit; a single group over the capacity is a shard by itself. `ends` are the bytes
    behind which shards close, n their number, fill what the last one holds. A block of many groups is one piece, or
    with `loose` can be cut anywhere, so that no true partition needs more shards (a block with a group over the
    capacity is even passed over). Loose counts bound the true one from below, others from above.
    """
    none = F.array().cast("array<long>")

    def step(acc: F.Column, x: F.Column) -> F.Column:
        large = x["bytes"] > capacity
        over = acc["fill"] + x["bytes"] > capacity
        begun = F.when(acc["fill"] > 0, F.array(x["start"])).otherwise(none)
        piece = F.struct(
            (acc["n"] + F.when(over & (acc["fill"] > 0), 1).otherwise(0) + F.when(large, F.when(x["many"], shards + 1).otherwise(1)).otherwise(0)).alias("n"),
            F.when(large, F.lit(0).cast("long")).when(over, x["bytes"]).otherwise(acc["fill"] + x["bytes"]).alias("fill"),
            F.when(~over, acc["ends"]).otherwise(F.concat(acc["ends"], begun, F.when(large, F.array(x["start"] + x["bytes"])).otherwise(none))).alias("ends"),
        )
        if not loose:
            return piece
        closed = F.ceil((acc["fill"] + x["bytes"]) / capacity).cast("long") - 1
        cuts = F.transform(F.sequence(F.lit(1).cast("long"), F.least(closed, F.lit(shards))), lambda i: x["start"] - acc["fill"] + i * capacity)
        poured = F.struct(
            (acc["n"] + closed).alias("n"),
            (acc["fill"] + x["bytes"] - closed * capacity).alias("fill"),
            F.when(closed > 0, F.concat(acc["ends"], cuts)).otherwise(acc["ends"]).alias("ends"),
        )
        poured = F.when(x["top"] > capacity, acc).when(acc["fill"] + x["bytes"] > 0, poured).otherwise(acc)
        return F.when(x["many"], poured).otherwise(piece)

    zero = F.lit(0).cast("long")
    return F.aggregate(blocks, F.struct(zero.alias("n"), zero.alias("fill"), none.alias("ends")), step)


def _smallest(blocks: F.Column, bounds: F.Column, shards: int, loose: bool) -> F.Column:
    """Binary search for the smallest capacity within bounds (lo, hi) that the greedy check finds enough; hi is."""

    def halve(acc: F.Column, _: F.Column) -> F.Column:
        middle = F.floor((acc["lo"] + acc["hi"]) / 2).cast("long")
        used = _fill(blocks, middle, shards, loose)
        enough = F.aggregate(F.array(used), F.lit(False), lambda a, u: u["n"] + F.when(u["fill"] > 0, 1).otherwise(0) <= shards)
        halved = F.when(enough, F.struct(acc["lo"].alias("lo"), middle.alias("hi"))).otherwise(F.struct((middle + 1).alias("lo"), acc["hi"].alias("hi")))
        return F.when(acc["lo"] < acc["hi"], halved).otherwise(acc)

    return F.aggregate(F.sequence(F.lit(1), F.lit(62)), bounds, halve, lambda a: a["hi"])


def _blocks(groups: DataFrame, bits: int) -> DataFrame:
    """place (the least hash), bits, bytes, top (of one group), many: blocks of groups that share their first bits."""
    place = F.shiftleft(F.shiftright("group", 64 - bits), 64 - bits)
    found = groups.groupBy(place.alias("place")).agg(F.sum("bytes").alias("bytes"), F.max("bytes").alias("top"), F.count("*").alias("n"))
    return found.select("place", F.lit(bits).alias("bits"), "bytes", "top", (F.col("n") > 1).alias("many"))


def minimax_cuts(groups: DataFrame, shards: int, first_bits: int = FIRST_BITS, more_bits: int = MORE_BITS) -> list[int]:
    """Groups (rows group, bytes; in order of group) at which shards 1, 2 ... begin: contiguous, none cut.

    The capacity is the smallest for which `shards` shards are enough if a single group over it is a shard by itself;
    so the largest shard is the smallest possible, and where one group alone makes it so, the others are as even as
    they can be. It is found exactly, though the groups never come together: blocks of groups bound it from both sides
    (_fill), the blocks in which a cut can fall for a capacity between the bounds are split by more bits of the hash,
    and so on until the bounds meet. There are 2**first_bits blocks at first; a few for each cut are split, so the
    blocks fit one row, in which SQL higher-order functions work, at any number of groups.

    Of the partitions with that capacity the cuts are those nearest to even shares: each lies between the first place
    from which the rest still fits (greedy from the end) and the last that the shard can reach. Only the bounds and the
    cuts come to the driver. How blocks are split does not change the capacity.
    """
    bounds = None
    blocks = cut_lineage(_blocks(groups, first_bits))
    columns = ("place", "bits", "bytes", "top", "many")
    start = (F.sum("bytes").over(Window.orderBy("place")) - F.col("bytes")).alias("start")
    while True:
        row = blocks.select(*columns, start).agg(F.array_sort(F.collect_list(F.struct(*columns, "start"))).alias("blocks"))
        total = F.aggregate("blocks", F.lit(0).cast("long"), lambda a, x: a + x["bytes"])
        row = cut_lineage(row.withColumn("total", total))
        if bounds is None:
            bounds = (1, row.first().total)
            if not bounds[1]:
                return []
        lo, hi = (F.lit(x).cast("long") for x in bounds)
        row = row.withColumn("lo", _smallest(F.col("blocks"), F.struct(lo.alias("lo"), hi.alias("hi")), shards, True))
        row = cut_lineage(row)
        row = cut_lineage(row.withColumn("hi", _smallest(F.col("blocks"), F.struct(F.col("lo"), hi.alias("hi")), shards, False)))
        bounds = tuple(row.select("lo", "hi").first())
        if bounds[0] == bounds[1]:
            break
        # The j-th cut of any capacity between the bounds lies between these two.
        first, last = (F.concat(_fill(F.col("blocks"), F.col(c), shards, c == "hi")["ends"], F.array("total")).alias(n) for c, n in (("lo", "first"), ("hi", "last")))
        large = F.exists("blocks", lambda x: x["many"] & (x["bytes"] > F.col("lo"))).alias("large")
        spans = cut_lineage(row.select("blocks", "lo", first, last, large))
        spans = spans.select("blocks", "lo", "large", F.filter(F.arrays_zip("first", "last"), lambda s: s["first"].isNotNull()).alias("spans"))
        within = lambda x, s: (x["start"] < F.coalesce(s["last"], x["start"] + 1)) & (x["start"] + x["bytes"] > s["first"])
        reached = lambda x: F.exists("spans", lambda s: within(x, s))
        # Blocks over the lower bound are split first, as the two positions say nothing beyond one.
        split = lambda x: x["many"] & F.when(F.col("large"), x["bytes"] > F.col("lo")).otherwise(reached(x))
        marked = spans.select(F.explode("blocks").alias("x"), "lo", "spans", "large")
        marked = cut_lineage(marked.select(*(f"x.{c}" for c in columns), split(F.col("x")).alias("split"), "large"))
        # After that no cut for a capacity between the bounds falls inside the others: they stay one piece.
        rest = marked.filter("not split").select("place", "bits", "bytes", "top", (F.col("many") & F.col("large")).alias("many"))
        for (depth,) in marked.filter("split").select("bits").distinct().collect():
            chosen = marked.filter(F.col("split") & (F.col("bits") == depth)).select(F.shiftright("place", 64 - depth).alias("prefix"))
            inside = groups.join(F.broadcast(chosen), F.shiftright("group", 64 - depth) == F.col("prefix"), "left_semi")
            rest = rest.unionByName(_blocks(inside, min(64, depth + more_bits)))
        blocks = cut_lineage(rest)
    return _even_cuts(row, shards)


def _even_cuts(row: DataFrame, shards: int) -> list[int]:
    """Places at which shards begin, for one row (blocks, total, hi): see minimax_cuts()."""
    capacity, zero = F.col("hi"), F.lit(0).cast("long")
    turned = F.transform(F.reverse("blocks"), lambda x: F.struct(x["bytes"].alias("bytes"), x["top"].alias("top"), F.lit(False).alias("many"), (F.col("total") - x["start"] - x["bytes"]).alias("start")))
    ordinary = F.aggregate("blocks", zero, lambda a, x: a + F.when(x["bytes"] <= capacity, x["bytes"]).otherwise(0))
    large = F.aggregate("blocks", zero, lambda a, x: a + F.when(x["bytes"] > capacity, 1).otherwise(0))
    row = cut_lineage(row.select("blocks", "total", "hi", F.transform(_fill(turned, capacity, shards, False)["ends"], lambda e: F.col("total") - e).alias("earliest"), ordinary.alias("ordinary"), large.alias("large")))

    def cut(acc: F.Column, x: F.Column) -> F.Column:
        """Close the running shard before this block if its end is nearer to an even share than the block's end, or must be."""
        over, after = x["bytes"] > capacity, x["start"] + x["bytes"]
        left = shards - 1 - acc["n"]
        even = acc["begun"] + (F.col("ordinary") - acc["past"]) / F.greatest(F.lit(1), shards - acc["n"] - acc["large"])
        floor = F.when((left > 0) & (F.size("earliest") >= left), F.get(F.col("earliest"), (left - 1).cast("int"))).otherwise(zero)
        near = (left > 0) & (x["start"] >= floor) & (F.abs(x["start"] - even) <= F.abs(after - even))
        closes = (x["start"] > acc["begun"]) & (over | (after - acc["begun"] > capacity) | near)
        ends = over & (after < F.col("total"))
        done = acc["done"] + F.when(over, zero).otherwise(x["bytes"])
        return F.struct(
            (acc["n"] + F.when(closes, 1).otherwise(0) + F.when(ends, 1).otherwise(0)).cast("long").alias("n"),
            F.when(over, after).when(closes, x["start"]).otherwise(acc["begun"]).alias("begun"),
            F.when(closes | over, acc["done"]).otherwise(acc["past"]).alias("past"),
            done.alias("done"),
            (acc["large"] - F.when(over, 1).otherwise(0)).cast("long").alias("large"),
            F.when(closes | ends, F.concat(acc["cuts"], F.when(closes, F.array(x["start"])).otherwise(none), F.when(ends, F.array(after)).otherwise(none))).otherwise(acc["cuts"]).alias("cuts"),
        )

    none = F.array().cast("array<long>")
    begin = F.struct(*(zero.alias(n) for n in ("n", "begun", "past", "done")), F.col("large").alias("large"), none.alias("cuts"))
    cuts = cut_lineage(row.select("blocks", F.aggregate("blocks", begin, cut, lambda a: a["cuts"]).alias("cuts")))
    places = F.transform(F.filter("blocks", lambda x: F.array_contains("cuts", x["start"])), lambda x: x["place"])
    return sorted(cuts.select(places.alias("places")).first().places)


def shard(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", run_rows: int = 50_000) -> DataFrame:
    """id, size (UTF-8 bytes of the text plus 16), text_crc32, shard, slot: equal texts in one shard, sizes near equal.

    A group is all rows of one text; null is a text of its own with no bytes. Groups stand in order of a hash of their
    text, and minimax_cuts() cuts that order; a group too large for an even share is a shard by itself. Slots count
    each shard's rows from 0 without gaps, in order of a hash of the id and the text: rows are counted by ranges of
    that hash first (of about `run_rows` rows, which change no slot), so no shard is numbered in one task. Long texts
    count by their bytes alone. Fewer groups than shards leave shards empty; repeated rows get slots of their own; an
    empty table gives no rows; other columns are not read.
    """
    text = F.col(text_col).cast("string")
    group = F.xxhash64(text.isNull(), text)
    rows = docs.select(
        F.col(id_col).alias("id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"),
        F.when(text.isNull(), F.crc32(F.lit(""))).otherwise(F.crc32(text)).alias("text_crc32"),
        group.alias("group"),
        F.xxhash64(group, F.col(id_col)).alias("order"),
    )
    rows = cut_lineage(rows)
    groups = cut_lineage(rows.groupBy("group").agg(F.sum("size").alias("bytes")))
    cuts = minimax_cuts(groups, shards)
    number = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col("group"))) if cuts else F.lit(0)
    slices = max(1, -(-rows.count() // run_rows))
    # A shard's rows are dealt by ranges of `order`, so the slices only say which rows are ordered together.
    part = F.floor((F.shiftright("order", 32) + (1 << 31)) * slices / F.lit(1 << 32))
    rows = rows.withColumn("shard", number).withColumn("slice", part)
    counts = rows.groupBy("shard", "slice").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "slice", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("start"))
    within = F.row_number().over(Window.partitionBy("shard", "slice").orderBy("order", "id", "group"))
    return rows.join(starts, ["shard", "slice"]).select("id", "size", "text_crc32", "shard", (F.col("start") + within - 1).alias("slot"))


def op4_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"), 40).select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


QUERIES = {"op4_minimax_shards": op4_minimax_shards}
ORACLE_SQL: dict[str, str] = {}
