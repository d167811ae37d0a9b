"""SimHash near-duplicates: fingerprints, pigeonring candidates, components (operator 10)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut_lineage, pieces, table, tidy
from .components import connected_components

#: Buckets of candidates over this size are split by the ring of their free bits before pairs are listed; 16 or more.
PAIR_BUCKET = 48
_LANES = np.uint64(0x0101010101010101)


def _bit_majority(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 64-bit word a row: the bits set in over half of its hashes. Byte lanes count up to 255 hashes at once."""
    out = np.zeros(len(sizes), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    n = sizes[full]
    runs = -(-n // 255)
    first_run = np.cumsum(runs) - runs
    starts = np.repeat(np.cumsum(n) - n, runs) + 255 * (np.arange(runs.sum()) - np.repeat(first_run, runs))
    for bit in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(bit)) & _LANES, starts)
        counts = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), first_run, axis=0)
        ones = (2 * counts > n[:, None]).astype(np.uint64)
        out[full] |= (ones << (np.arange(8, dtype=np.uint64) * np.uint64(8) + np.uint64(bit))).sum(axis=1, dtype=np.uint64)
    return out


def fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42
) -> DataFrame:
    """id, fingerprint (long): SimHash of the shingles of lower-cased (A-Z) words, repeats included.

    Fewer words than a shingle has: the whole sequence is one. No word, empty or null text: fingerprint 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in pieces(batches, "text"):
            sizes, hashes = [], []
            for text in batch.column(1).to_pylist():
                w = text.encode().lower().split() if text else []
                if len(w) > shingle:
                    grams = map(b" ".join, zip(*(w[j:] for j in range(shingle)), strict=False))
                    hashes += [xxh64_intdigest(g, seed) for g in grams]
                    sizes.append(len(w) - shingle + 1)
                elif w:
                    hashes.append(xxh64_intdigest(b" ".join(w), seed))
                    sizes.append(1)
                else:
                    sizes.append(0)
            bits = _bit_majority(np.array(hashes, np.uint64), np.array(sizes, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits.view(np.int64))], ["id", "fingerprint"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(tidy(run), "id long, fingerprint long")


def _segments(fp: F.Column, m: int) -> list:
    edges = [64 * i // m for i in range(m + 1)]
    return [
        F.shiftrightunsigned(fp, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)) for lo, hi in zip(edges, edges[1:], strict=False)
    ]


def pigeonring(a: F.Column, b: F.Column, distance: int, m: int) -> F.Column:
    """True where some chain of m segments round the ring keeps its cumulative differences within
    distance * length / m at every length: necessary for a Hamming distance of at most `distance`."""
    diffs = [F.bit_count(s) for s in _segments(a.bitwiseXOR(b), m)]
    fits = F.lit(False)
    for start in range(m):
        chain, total = F.lit(True), F.lit(0)
        for length in range(1, m):
            total = total + diffs[(start + length - 1) % m]
            chain = chain & (total <= distance * length // m)
        fits = fits | chain
    return fits


def _buckets(members: DataFrame, width: int) -> DataFrame:
    """Each class (fingerprint, rep, path, shared, free) under the six keys of its `width` free bits.

    The free bits are four segments on a ring. A chain within the budgets 0, 1, 1 starts with an equal segment, followed
    by an equal one or by one that differs in a bit and then an equal one; so two classes can only link if they agree on
    segments (i, i + 1) or (i, i + 2). These two join the `shared` bits, the other two stay free.
    """
    part = width // 4
    seg = [F.shiftrightunsigned("free", part * i).bitwiseAND(F.lit((1 << part) - 1)) for i in range(4)]
    kinds = sorted({tuple(sorted((i, (i + step) % 4))) for i in range(4) for step in (1, 2)})

    def joined(i: int, j: int) -> F.Column:
        return F.shiftleft(seg[j], part).bitwiseOR(seg[i])

    def kind(k: int, i: int, j: int) -> F.Column:
        left = joined(*(x for x in range(4) if x not in (i, j)))
        shared = F.shiftleft("shared", 2 * part).bitwiseOR(joined(i, j))
        return F.struct((F.col("path") * len(kinds) + k).alias("path"), shared.alias("shared"), left.alias("free"))

    return members.select("fingerprint", "rep", F.inline(F.array(*(kind(k, i, j) for k, (i, j) in enumerate(kinds)))))


def links(classes: DataFrame, pair_bucket: int = PAIR_BUCKET) -> DataFrame:
    """a, b (reps): all classes (fingerprint long, rep long) at a Hamming distance of 2 or less.

    Candidates share a key of _buckets(): 32 equal bits. The pairs of a bucket of at most `pair_bucket` classes (16 or
    more) pass the pigeonring test, then the full Hamming test. A larger bucket lists no pairs but is split in the same
    way by its 32 free bits, and again by 16, 8 and 4: the classes that are left share 60 bits, so they are 16 at most.
    Two classes that link agree on two segments of whatever bits are free, so they meet at every level, and which
    bucket is split changes no link. Rows: six a class and level, pairs only within small buckets.
    """
    members = classes.select("fingerprint", "rep", F.lit(0).alias("path"), F.lit(0).cast("long").alias("shared"), F.col("fingerprint").alias("free"))
    found = None
    for width in (64, 32, 16, 8):
        keyed = _buckets(members, width)
        sizes = keyed.groupBy("path", "shared").agg(F.count("*").alias("size")).filter("size > 1")
        keyed = cut_lineage(keyed.join(sizes, ["path", "shared"]))
        small = keyed if width == 8 else keyed.filter(F.col("size") <= pair_bucket)
        bucket = small.groupBy("path", "shared").agg(F.collect_list(F.struct("rep", "fingerprint")).alias("members"))
        one = bucket.select(F.col("members").alias("of"), F.posexplode("members").alias("at", "x"))
        pairs = one.select("x", F.explode(F.slice("of", F.col("at") + 2, F.size("of"))).alias("y"))
        fa, fb = F.col("x.fingerprint"), F.col("y.fingerprint")
        near = pairs.filter(pigeonring(fa, fb, 2, 4)).filter(F.bit_count(fa.bitwiseXOR(fb)) <= 2)
        near = near.select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b"))
        found = near if found is None else found.unionByName(near)
        members = keyed.filter(F.col("size") > pair_bucket).drop("size")
        if width == 8 or members.isEmpty():
            return found.distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fingerprint (long), component_id: the smallest id reachable over fingerprints 2 or fewer bits apart.

    Equal fingerprints are one class, so copies are never paired. Repeated rows stay, each with its result; a row
    without an id gets its class's component (null if its class has no id and no link). An empty table gives no rows.
    """
    prints = cut_lineage(fingerprints(docs, id_col, text_col))
    classes = cut_lineage(prints.groupBy("fingerprint").agg(F.min("id").alias("rep")))
    found = connected_components(links(classes.filter("rep is not null")))
    named = classes.join(found, classes.rep == found.node, "left").select(
        F.col("fingerprint").alias("fp"), F.coalesce("component", "rep").alias("component_id")
    )
    return prints.join(named, prints.fingerprint == named.fp).select("id", "fingerprint", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that are the smallest id of their component; other columns as they are.

    Rows that repeat an id are one document, of which one row stays: the least by text (null first), then by the other
    columns as JSON. Rows without an id stay. An empty table gives no rows.
    """
    firsts = near_duplicates(docs, id_col, text_col).filter("id = component_id").select(F.col("id").alias("_id")).distinct()
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.struct(*docs.columns).alias("_doc")).join(firsts, "_id", "left_semi")
    others = F.struct(*(F.col(f"_doc.{c}") for c in docs.columns if c != text_col))
    order = F.struct(F.col(f"_doc.{text_col}").cast("string").alias("text"), F.to_json(others).alias("others"))
    one = rows.groupBy("_id").agg(F.min_by("_doc", order).alias("_doc")).select("_doc.*")
    return one.unionByName(docs.filter(F.col(id_col).isNull()))


def op10_pigeonring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"),
        "component_id",
    )


QUERIES = {"op10_pigeonring": op10_pigeonring}
ORACLE_SQL: dict[str, str] = {}
