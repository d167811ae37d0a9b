"""SpotSigs fingerprints: chains of content words behind common-word anchors (operator 6)."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import cut_lineage, pieces, table

#: Common words of English, French, German and Spanish that anchor signatures.
ANCHORS = frozenset(
    """
    a an and are as at be but by for from had has have he her his in is it its not of on or she that the their there
    they this to was were which will with you
    au aux avec ce ces dans de des du elle en est et il la le les leur mais ne nous ou par pas pour qui sa se ses son
    sont sur un une vous à était
    aber als am auch auf aus bei das dem den der des die ein eine einem einer er es für hat ich im ist mit nach nicht
    sich sie sind so um und von war wie zu zum über
    al como con cuando del el ella era es ese esta está fue ha han hay las lo los más me mi muy no para pero por que
    sin sobre su también una y ya
    """.split()
)
#: Content words in a chain, and the step from one to the next.
CHAIN, STEP = 2, 1
#: Blocks of neighbouring documents at most; their heads are broadcast (40 bytes each).
MOST_BLOCKS = 100_000
_STRIP = b".,;:!?\"'()[]{}*_<>#"
_ANCHOR_BYTES = frozenset(w.encode() for w in ANCHORS)


class Signer:
    """Signature sets of texts; remembers each word's bare form, up to a bound."""

    def __init__(self, chain: int = CHAIN, step: int = STEP):
        self.chain, self.step, self.bare = chain, step, {}

    def _word(self, word: bytes) -> bytes:
        if (found := self.bare.get(word)) is None:
            if len(self.bare) > 200_000:
                self.bare.clear()
            found = self.bare[word] = word.decode("utf-8", "replace").lower().encode().strip(_STRIP)
        return found

    def signatures(self, text: str | None) -> np.ndarray:
        """Sorted hashes of the text's signatures, each once: an anchor and the next `chain` content words after it,
        `step` content words apart. A text without any has its whole word sequence as its one signature, so that only
        texts of equal words are alike; a text without words has the empty sequence."""
        bare = [b for w in (text or "").encode().split() if (b := self._word(w))]
        content = [w for w in bare if w not in _ANCHOR_BYTES]
        reach, found, before = self.chain * self.step, set(), 0
        for w in bare:
            if w not in _ANCHOR_BYTES:
                before += 1
            elif before + reach <= len(content):
                found.add((w, *content[before + self.step - 1 : before + reach : self.step]))
        keys = {xxh64_intdigest(b" ".join(f), 7) >> 1 for f in found or [(b"", *bare)]}
        return np.array(sorted(keys), np.int64)


def fingerprint_name(signatures: np.ndarray) -> str:
    """Number of signatures (its length partition) and a digest of their set: equal sets, equal fingerprints."""
    return f"{len(signatures)}-{blake2b(signatures.astype('>i8').tobytes(), digest_size=16).hexdigest()}"


def jaccard(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard likeness of two sorted sets, or 0 if it is below `least`: the ratio of their sizes bounds it, so
    sets of too different length are not compared."""
    small, large = sorted((len(a), len(b)))
    if small < least * large:
        return 0.0
    common = len(np.intersect1d(a, b, assume_unique=True))
    alike = common / (len(a) + len(b) - common)
    return alike if alike >= least else 0.0


def signature_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fingerprint, signatures (sorted array of long). Null is the empty text; repeated rows stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer()
        for batch in pieces(batches, "text"):
            sets = [signer.signatures(t) for t in batch.column(1).to_pylist()]
            names = pa.array([fingerprint_name(s) for s in sets], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), names, pa.array(sets, pa.list_(pa.int64()))], ["id", "fingerprint", "signatures"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, fingerprint string, signatures array<long>")


def similar_pairs(docs: DataFrame, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(fingerprint, id) membership, and pairs (a, b, likeness) of different fingerprints alike to `least` or more.

    Rows of one fingerprint are one class and are not paired. Classes are partitioned by set length, the lengths of a
    partition within a factor of `least`, so a class can only match in its own partition or the one below. Within
    them, classes meet at signatures of the prefix that any match must share (all but least * length of them, rarest
    first), and a meeting counts only at the first signature that both prefixes have; the exact Jaccard follows.
    Null and empty texts are one class; repeated rows and rows without an id are members like others; an empty table
    gives no rows. The pairs of a group of near copies are listed one by one: a group of k different texts has up to
    k * (k - 1) / 2 links, each of which is a row.
    """
    sets = cut_lineage(signature_sets(docs, id_col, text_col))
    members = sets.select("fingerprint", "id")
    classes = sets.groupBy("fingerprint").agg(F.first("signatures").alias("signatures"))
    tokens = classes.select("fingerprint", F.size("signatures").alias("n"), F.explode("signatures").alias("s"))
    often = tokens.groupBy("s").agg(F.count("*").alias("often"))
    ordered = tokens.join(often, "s").groupBy("fingerprint", "n").agg(F.array_sort(F.collect_list(F.struct("often", "s"))).alias("o"))
    kept = F.col("n") - F.ceil(F.col("n") * least).cast("int") + 1
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(-np.log(least) if least < 1 else 1.0)).cast("int")
    prefix = ordered.select("fingerprint", "n", band.alias("band"), F.transform(F.slice("o", F.lit(1), kept), lambda x: x["s"]).alias("prefix"))
    meet = prefix.select("fingerprint", "n", "band", "prefix", F.explode("prefix").alias("s"))
    down = [meet.select(*(F.col(c).alias(f"b_{c}") for c in meet.columns), (F.col("band") + k).alias("at")) for k in (0, 1)]
    b = down[0].unionByName(down[1])
    fits = (F.least("n", "b_n") >= least * F.greatest("n", "b_n")) & ((F.col("band") != F.col("b_band")) | (F.col("fingerprint") < F.col("b_fingerprint")))
    first = F.col("s") == F.get(F.filter("prefix", lambda x: F.array_contains("b_prefix", x)), F.lit(0))
    found = meet.join(b, (meet.s == b.b_s) & (meet.band == b["at"])).filter(fits & first).select("fingerprint", "b_fingerprint")
    left, right = (classes.select(F.col("fingerprint").alias(f), F.col("signatures").alias(s)) for f, s in (("fingerprint", "x"), ("b_fingerprint", "y")))
    both = found.join(left, "fingerprint").join(right, "b_fingerprint")
    common = F.size(F.array_intersect("x", "y"))
    alike = common / (F.size("x") + F.size("y") - common)
    pairs = both.select(F.least("fingerprint", "b_fingerprint").alias("a"), F.greatest("fingerprint", "b_fingerprint").alias("b"), alike.alias("likeness"))
    return members, pairs.filter(F.col("likeness") >= least)


def beside_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_rows: int = 4000) -> DataFrame:
    """block, id, text, lead: every row, in blocks of neighbouring ids, so that each row's next one (ids descending,
    after the last the first) follows it in its block: rows with `lead` true are copies of the next block's first row.

    At most MOST_BLOCKS blocks of about `block_rows` rows or more: up to 100 quantiles of the ids, each cut evenly. One
    row a block is copied (its head is found through a broadcast of one id a block) and the texts are shuffled once.
    Rows without an id come last. Rows of one id go by text.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    hundredths = F.percentile_approx("id", [k / 100 for k in range(1, 100)], 2000)
    n, least, most, among = rows.agg(F.count("*"), F.min("id"), F.max("id"), hundredths).first()
    blocks = min(MOST_BLOCKS, max(1, n // block_rows))
    step = -(-100 // min(blocks, 100))
    tops = sorted({most or 0, *(among or [])[step - 1 :: step]}, reverse=True) if blocks > 1 else [most or 0]
    parts = -(-blocks // len(tops))
    ends = [*tops[1:], (least or 0) - 1]
    # Interval i holds the ids from above ends[i] to tops[i].
    i = F.size(F.filter(F.array(*map(F.lit, ends)), lambda e: e >= F.col("id")))
    top, width = (F.element_at(F.array(*map(F.lit, x)), i + 1) for x in (tops, [t - e for t, e in zip(tops, ends, strict=True)]))
    block = F.when(F.col("id").isNull(), len(tops) * parts).otherwise(i * parts + F.floor((top - F.col("id")) * parts / width))
    rows = rows.withColumn("block", block.cast("long"))
    heads = rows.groupBy("block").agg(F.max(F.struct(F.coalesce("id", F.lit(0)), F.xxhash64("text"))).alias("head"))
    order = Window.orderBy("block")
    last = F.last("block").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    heads = heads.select(F.col("block").alias("of"), "head", F.coalesce(F.lag("block").over(order), last).alias("to"))
    is_head = (F.col("block") == F.col("of")) & (F.struct(F.coalesce("id", F.lit(0)), F.xxhash64("text")) == F.col("head"))
    copies = rows.join(F.broadcast(heads), is_head).dropDuplicates(["of"])
    every = rows.withColumn("lead", F.lit(False)).unionByName(copies.select("id", "text", F.col("to").alias("block"), F.lit(True).alias("lead")))
    in_order = ("block", "lead", F.col("id").desc_nulls_last(), F.xxhash64("text").desc())
    return every.repartitionByRange(blocks, "block").sortWithinPartitions(*in_order)


def edit(text: str, following: str) -> str:
    """The text with its last third replaced by as many of the following text's first characters, or all."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row: see edit().

    The next document of the last is the first; a lone document is its own next. Null text is empty. Each row is read
    once and held only until its next one has come, however long the texts are. Likeness is the Jaccard of the two
    signature sets, whole: nothing is cut off below a bound here. Rows that repeat an id follow each other in order of
    a hash of their text, rows without an id come after all others in the same order; an empty table gives no rows;
    other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer, held = Signer(), None
        names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        for batch in pieces(batches, "text"):
            out = []
            for block, doc, text, lead in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                text = text or ""
                own = signer.signatures(text)
                if held is not None and held[0] == block:
                    _, held_doc, held_text, held_own = held
                    changed = edit(held_text, text)
                    theirs = signer.signatures(changed)
                    out.append((held_doc, len(held_text), sha256(changed.encode()).hexdigest(), fingerprint_name(held_own), fingerprint_name(theirs), jaccard(held_own, theirs), jaccard(held_own, own)))
                held = None if lead else (block, doc, text, own)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    schema = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return beside_next(docs, id_col, text_col).select("block", "id", "text", "lead").mapInArrow(run, schema)


def op6_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


QUERIES = {"op6_spotsigs": op6_spotsigs}
ORACLE_SQL: dict[str, str] = {}
