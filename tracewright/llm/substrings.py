"""Removal of word windows that earlier documents have, by seed and extend (operator 7)."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from itertools import compress

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import gram_hashes, mix, pieces, table, tidy, words

#: Words of the shortest repeat, and of the grams that anchors are chosen from.
LENGTH, GRAM = 13, 5
#: Bits of a gram's hash that are compared: one that only seems shared costs work, not results.
GRAM_BITS = 48
#: A place is a word's number in its row, with the row's mark in so many bits above it.
PLACE_BITS, MARK_BITS = 32, 31
_START = (1 << PLACE_BITS) - 1
#: Anchors or windows that a worker holds at once; repeats among them are found without a shuffle.
HELD_ROWS = 1_000_000
#: Texts are hashed in pieces of about this many bytes; what numpy holds meanwhile is some fifty times that.
PIECE_BYTES = 1 << 19
_SEED = "known boolean, gram long, route long, doc long"
_MATCH = "known boolean, n int, src long, src_place long, more array<long>, route long, doc long, place long"
_RUN = "doc long, place long, n int, src long, src_place long"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, body, ...) with each text as a zstd frame, a third less to shuffle than what the shuffle makes of it."""
    packer = zstandard.ZstdCompressor(level=1)
    for batch in pieces(batches, "body", PIECE_BYTES):
        frames = [None if t is None else packer.compress(t) for t in batch.column(1).cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(frames, pa.binary()), *batch.columns[2:]], batch.schema.names)


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of _pack() with their texts, in pieces of about PIECE_BYTES of text (one row at least)."""
    opener = zstandard.ZstdDecompressor()
    for batch in batches:
        texts, size, at = [], 0, 0
        for i in range(batch.num_rows):
            frame = batch.column(1)[i].as_py()
            texts.append(None if frame is None else opener.decompress(frame))
            size += len(texts[-1] or b"")
            if size >= PIECE_BYTES or i == batch.num_rows - 1:
                part = batch.slice(at, i + 1 - at)
                body = pa.array(texts, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), body, *part.columns[2:]], batch.schema.names)
                texts, size, at = [], 0, i + 1


def anchor_places(hashes: np.ndarray, first: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of `length` words within rows: their starts, the place of each one's anchor and that place's gram hash.

    The anchor is the gram with the least hash in the window, the first on a tie (winnowing), so windows with equal
    words have the same anchor at the same offset.
    """
    count = len(hashes) - length + 1
    if count <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams = gram_hashes(hashes, gram, 1)
    best, at = grams[:count].copy(), np.arange(count)
    for j in range(1, length - gram + 1):
        lower = grams[j : j + count] < best
        best[lower] = grams[j : j + count][lower]
        at[lower] = np.flatnonzero(lower) + j
    inside = np.ones(count, bool)
    for edge in first[1:-1]:
        inside[max(0, edge - length + 1) : edge] = False
    starts = np.flatnonzero(inside)
    return starts, at[starts], grams[at[starts]]


def _by_key(keys: np.ndarray, docs: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the rows by key, doc and place; in that order, where each key begins and each row's key's beginning."""
    order = np.lexsort((places, docs, keys))
    k = keys[order]
    new = np.concatenate([[True], k[1:] != k[:-1]]) if len(k) else np.zeros(0, bool)
    begins = np.flatnonzero(new)
    return order, begins, begins[np.cumsum(new) - 1] if len(k) else begins


def _column(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.array(values.data, kind, mask=np.ma.getmaskarray(values)) if isinstance(values, np.ma.MaskedArray) else pa.array(values, kind)


def _emit(schema: str, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    kinds = {"boolean": pa.bool_(), "int": pa.int32(), "long": pa.int64(), "array<long>": pa.list_(pa.int64())}
    fields = [f.split() for f in schema.split(", ")]
    for at in range(0, len(columns[0]), 200_000):
        arrays = [_column(c[at : at + 200_000], kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)]
        yield pa.RecordBatch.from_arrays(arrays, [n for n, _ in fields])


def _spread(doc: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A route for rows that need not meet any other."""
    return mix(doc.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + place.view(np.uint64)).view(np.int64)


def _of_row(row: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A key of one row of a batch; that two are equal by chance costs work, not results."""
    return mix(key + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class _Held:
    """Columns of rows, gathered until there are HELD_ROWS of them."""

    def __init__(self, answer):
        self.answer, self.parts, self.size = answer, [], 0

    def add(self, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.parts.append(columns)
        self.size += len(columns[0])
        if self.size >= HELD_ROWS:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.size:
            columns = [np.concatenate(c) for c in zip(*self.parts, strict=True)]
            self.parts, self.size = [], 0
            yield from self.answer(*columns)


def _seeds(length: int, gram: int):
    """Grams that documents' anchors are, once a document. What the rows held at once show to be shared is known; such
    a gram is also asked for once, without a document, so a frequent gram has a row for each HELD_ROWS."""

    def answer(keys: np.ndarray, doc: np.ndarray) -> Iterator[pa.RecordBatch]:
        order, begins, begin = _by_key(keys, doc, np.zeros(len(doc), np.int8))
        keys, doc = keys[order].view(np.int64), doc[order]
        last = np.concatenate([begins[1:], [len(doc)]]) - 1
        shared = np.repeat(doc[begins] != doc[last], last - begins + 1)
        once = np.ones(len(doc), bool)
        once[1:] = (np.diff(keys) != 0) | (np.diff(doc) != 0)
        alone, held = once & ~shared, once & shared
        none = np.zeros(len(doc), np.int64)
        yield from _emit(_SEED, none[alone] > 0, none[alone], keys[alone], doc[alone])
        yield from _emit(_SEED, none[held] == 0, keys[held], _spread(doc[held], keys[held]), doc[held])
        told = begins[shared[begins]]
        yield from _emit(_SEED, none[told] > 0, none[told], keys[told], np.ma.masked_all(len(told), np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held(answer)
        for batch in pieces(batches, "body", PIECE_BYTES):
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            hashes, _, first = words(batch.column(1))
            _, at, keys = anchor_places(hashes, first, length, gram)
            at, own = np.unique(at, return_index=True)
            row = np.searchsorted(first, at, side="right") - 1
            yield from held.add(keys[own] >> np.uint64(64 - GRAM_BITS), ids[row].astype(np.int64))
        yield from held.flush()

    return run


def _windows(length: int, gram: int):
    """Windows round shared anchors of documents. Those of which the rows held at once have an earlier document are
    matched with it, run by run; for the others, the earliest of each text among them, the window's hash is asked for."""

    def answer(keys: np.ndarray, doc: np.ndarray, place: np.ndarray) -> Iterator[pa.RecordBatch]:
        order, _, begin = _by_key(keys, doc, place)
        keys, doc, place = keys[order].view(np.int64), doc[order], place[order]
        src, src_place = doc[begin], place[begin]
        asked = doc == src
        # A document that says the same again asks once, with its other places.
        ours, own, at = keys[asked], doc[asked], place[asked]
        first = np.ones(len(ours), bool)
        first[1:] = (np.diff(ours) != 0) | (np.diff(own) != 0)
        ends = np.append(np.flatnonzero(first), len(ours))
        more = np.full(len(ends) - 1, None, object)
        for i in np.flatnonzero(np.diff(ends) > 1):
            more[i] = at[ends[i] + 1 : ends[i + 1]]
        none = np.zeros(len(more), np.int64)
        yield from _emit(_MATCH, none > 0, none + 1, none, none, more, ours[first], own[first], at[first])
        doc, place, src, src_place = (c[~asked] for c in (doc, place, src, src_place))
        n, doc, place, src, src_place = _extend(np.ones(len(doc), np.int64), doc, place, src, src_place)
        yield from _emit(_MATCH, n > 0, n, src, src_place, np.full(len(n), None, object), _spread(doc, place), doc, place)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held(answer)
        for batch in _unpacked(batches):
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            marks = batch.column(2).to_numpy(zero_copy_only=False)
            seeds = batch.column(3)
            hashes, _, first = words(batch.column(1))
            starts, _, keys = anchor_places(hashes, first, length, gram)
            if not len(starts):
                continue
            row = np.searchsorted(first, starts, side="right") - 1
            seed_row = np.repeat(np.arange(len(ids)), np.diff(seeds.offsets.to_numpy()))
            shared = _of_row(seed_row, seeds.flatten().to_numpy(zero_copy_only=False).view(np.uint64))
            near = np.isin(_of_row(row, keys >> np.uint64(64 - GRAM_BITS)), shared)
            starts, row = starts[near], row[near]
            place = marks[row] << PLACE_BITS | (starts - first[row])
            yield from held.add(gram_hashes(hashes, length, 101)[starts], ids[row], place)
        yield from held.flush()

    return run


def _extend(n: np.ndarray, doc: np.ndarray, place: np.ndarray, src: np.ndarray, src_place: np.ndarray) -> tuple:
    """Matches (n windows from a place of doc equal those from a place of src) put together while both sides go on
    without a gap: each match is extended both ways as far as it goes with this source. Repeated rows count once."""
    order = np.lexsort((-n, place, doc))
    again = np.zeros(len(doc), bool)
    again[1:] = (np.diff(doc[order]) == 0) & (np.diff(place[order]) == 0)
    order = order[~again]
    n, doc, place, src, src_place = (c[order] for c in (n, doc, place, src, src_place))
    new = np.ones(len(doc), bool)
    new[1:] = (np.diff(doc) != 0) | (np.diff(src) != 0) | (np.diff(place) != n[:-1]) | (np.diff(src_place) != n[:-1])
    begins = np.flatnonzero(new)
    total = np.add.reduceat(n, begins) if len(n) else n
    return total, *(c[begins] for c in (doc, place, src, src_place))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The extended matches of documents with a source (doc, mark, src, shift, other, places: start and n in one)."""
    for batch in batches:
        row = np.repeat(np.arange(batch.num_rows), np.diff(batch.column(5).offsets.to_numpy()))
        doc, mark, src, shift, other = (batch.column(i).to_numpy(zero_copy_only=False)[row] for i in range(5))
        both = batch.column(5).flatten().to_numpy(zero_copy_only=False)
        start, n = both & _START, both >> PLACE_BITS
        place, src_place = mark << PLACE_BITS | start, (mark ^ other) << PLACE_BITS | (start + shift)
        n, doc, place, src, src_place = _extend(n, doc, place, src, src_place)
        yield from _emit(_RUN, doc, place, n, src, src_place)


def _texts(batch: pa.RecordBatch) -> list[list[bytes]]:
    """The words of each row: bytes between ASCII white space, as WORD has it."""
    return [(t or b"").split() for t in batch.column(1).cast(pa.binary()).to_pylist()]


def _digest(words: list[bytes]) -> bytes:
    """Of the words themselves, so that equal digests are equal words."""
    return blake2b(b" ".join(words), digest_size=16).digest()


def _digests(length: int):
    """Digests of the words of asked runs (id, body, mark, asked: place and n), once each: rows that share an id follow
    each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, told = None, set()
        for batch in _unpacked(batches):
            out: tuple[list, ...] = ([], [], [], [])
            for doc, words, mark, asked in zip(batch.column(0).to_pylist(), _texts(batch), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                last, told = doc, told if doc == last else set()
                for run in asked:
                    place, n = run["src_place"], run["n"]
                    if place >> PLACE_BITS == mark and (place, n) not in told:
                        told.add((place, n))
                        at = place & _START
                        for column, value in zip(out, (doc, place, n, _digest(words[at : at + n + length - 1])), strict=True):
                            column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["src", "src_place", "n", "digest"])

    return run


def _verified(words: list[bytes], mark: int, runs: list[dict] | None, length: int) -> list[tuple[int, int, dict]]:
    """First word, number of words and run of those runs of a row whose words are their source's."""
    found = [(r["place"] & _START, r["n"] + length - 1, r) for r in runs or () if r["place"] >> PLACE_BITS == mark]
    return [(at, size, r) for at, size, r in found if _digest(words[at : at + size]) == r["digest"]]


def verified_runs(
    docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()
) -> DataFrame:
    """id, body (the text, packed), mark, rest (the columns `keep`), runs: of each row the maximal runs of words that its
    windows' least documents have, as place, n (windows), digest of the source's words, src, src_place; null for none.

    Seed: each window of `length` words has one anchor, its gram with the least hash (winnowing: any shared window
    makes both documents choose the same anchor). Anchors that only one document has are dropped. The windows that
    reach both ways round a shared anchor and have it as theirs are hashed, and each distinct window is linked to its
    least document's first one. Extend: linked windows are put together while document and source go on side by side,
    so a run ends where the words, or the least document, change. Each source gives a digest of each run's words, with
    which the caller compares the document's own words: windows whose hashes only happened to be equal stay.

    No documents are paired, and each worker answers repeats among the rows it holds first, so a gram or window that
    many documents have costs a row for each HELD_ROWS. A run that many documents share is asked of its source once.

    Documents are told apart by id; rows that share one never remove from each other (MARK_BITS of their texts' hashes,
    the mark of such rows, keep their windows apart; other rows' mark is 0). Rows without an id neither remove nor lose anything. Null, empty and short texts have
    no windows; long texts are cut into windows whole. Repeats within one document stay. An empty table gives no rows.
    """
    text = F.col(text_col).cast("string")
    hashed = F.xxhash64("body").bitwiseAND(F.lit((1 << MARK_BITS) - 1)).alias("mark")
    rest = F.struct(*keep) if keep else F.lit(0)
    every = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("body"), rest.alias("rest"))
    marked = every.select("id", "body", hashed, "rest")
    as_packed = T.StructType([T.StructField("body", T.BinaryType()) if f.name == "body" else f for f in marked.schema.fields])
    # The joins below take these same rows by id, all columns of them and with the filter that inner joins would add, so
    # the texts are shuffled once and the exchange is reused.
    alone = F.count("*").over(Window.partitionBy("id")) == 1
    rows = marked.filter("id is not null").mapInArrow(tidy(_pack), as_packed).filter("id is not null").withColumn("mark", F.when(alone, 0).otherwise(F.col("mark")))
    seeds = every.filter("id is not null").select("id", "body").mapInArrow(tidy(_seeds(length, gram)), _SEED)
    gram_rows = Window.partitionBy("known", "route")
    shared = F.col("known") | (F.count("doc").over(gram_rows) < F.count("*").over(gram_rows)) | (F.min("doc").over(gram_rows) < F.max("doc").over(gram_rows))
    seeds = seeds.withColumn("shared", shared).filter("shared and doc is not null")
    seeds = seeds.groupBy("doc").agg(F.collect_list(F.when(F.col("known"), F.col("gram")).otherwise(F.col("route"))).alias("seeds"))
    found = rows.join(seeds, rows.id == seeds.doc).select("id", "body", "mark", "seeds", "rest").mapInArrow(tidy(_windows(length, gram)), _MATCH)
    earliest = Window.partitionBy("known", "route").orderBy("doc", "place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    linked = found.withColumns({"least": F.first("doc").over(earliest), "least_place": F.first("place").over(earliest)}).filter("known or doc > least")
    each = F.explode(F.when(F.col("more").isNull(), F.array("place")).otherwise(F.concat(F.array("place"), F.col("more")))).alias("place")
    linked = linked.select("known", "n", "src", "src_place", "least", "least_place", "doc", each)
    start_of = lambda place: place.bitwiseAND(F.lit(_START))
    mark_of = lambda place: F.shiftright(place, PLACE_BITS)
    src, src_place = (F.when(F.col("known"), F.col(a)).otherwise(F.col(b)) for a, b in (("src", "least"), ("src_place", "least_place")))
    # A document's matches with one source, side by side, share all but their places.
    shift, other = (start_of(src_place) - start_of(F.col("place"))).alias("shift"), mark_of(src_place).bitwiseXOR(mark_of(F.col("place"))).alias("other")
    both = F.shiftleft(F.col("n").cast("long"), PLACE_BITS).bitwiseOR(start_of(F.col("place")))
    matches = linked.groupBy("doc", mark_of(F.col("place")).alias("mark"), src.alias("src"), shift, other).agg(F.collect_list(both).alias("places"))
    runs = matches.mapInArrow(tidy(_runs), _RUN)
    asked = runs.groupBy("src").agg(F.collect_set(F.struct("src_place", "n")).alias("asked"))
    digests = rows.join(asked, rows.id == asked.src).select("id", "body", "mark", "asked", "rest").mapInArrow(tidy(_digests(length)), "src long, src_place long, n int, digest binary")
    # A run that many documents have is one key of this join, whose sides are both dealt for it alone, so that adaptive
    # execution splits it.
    told = runs.join(digests, ["src", "src_place", "n"]).groupBy("doc").agg(F.collect_list(F.struct("place", "n", "digest", "src", "src_place")).alias("runs"))
    whole = rows.join(told, rows.id == told.doc, "left").select("id", "body", "mark", "rest", "runs")
    none = F.lit(None).cast(whole.schema["runs"].dataType).alias("runs")
    return whole.unionByName(marked.filter("id is null").mapInArrow(tidy(_pack), as_packed).select("id", "body", "mark", "rest", none))


def maximal_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, start, n_words, src, src_start: the runs of verified_runs() whose words equal the source's, in words from 0."""
    schema = "id long, start long, n_words long, src long, src_start long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _unpacked(batches):
            rows = zip(batch.column(0).to_pylist(), _texts(batch), batch.column(2).to_pylist(), batch.column(4).to_pylist(), strict=True)
            found = [(i, at, size, r["src"], r["src_place"] & _START) for i, words, mark, runs in rows for at, size, r in _verified(words, mark, runs, length)]
            yield from _emit(schema, *np.array(found, np.int64).reshape(-1, 5).T)

    return verified_runs(docs.filter(F.col(id_col).isNotNull()), length, gram, id_col, text_col).mapInArrow(tidy(run), schema)


def remove_repeats(
    docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text",
    keep: tuple[str, ...] = (), as_is: bool = False,
) -> DataFrame:
    """id, n_words, n_removed, kept_text, rest (a struct of the columns `keep`): the words that no run of
    verified_runs() with its source's words covers, joined by a space; with `as_is`, a text that loses nothing stays
    as it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _unpacked(batches):
            whole, n_words, removed, texts = batch.column(1).cast(pa.binary()), [], [], []
            for i, (words, mark, runs) in enumerate(zip(_texts(batch), batch.column(2).to_pylist(), batch.column(4).to_pylist(), strict=True)):
                kept = words
                if runs:
                    stays = bytearray(b"\1" * len(words))
                    for at, size, _ in _verified(words, mark, runs, length):
                        stays[at : at + size] = bytes(size)
                    kept = list(compress(words, stays))
                n_words.append(len(words))
                removed.append(len(words) - len(kept))
                texts.append(whole[i].as_py() or b"" if as_is and not removed[-1] else b" ".join(kept))
            columns = [batch.column(0), pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string()), batch.column(3)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_words", "n_removed", "kept_text", "rest"])

    found = verified_runs(docs, length, gram, id_col, text_col, keep)
    return found.mapInArrow(tidy(run), f"id long, n_words long, n_removed long, kept_text string, rest {found.schema['rest'].dataType.simpleString()}")


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


QUERIES = {"op7_substrings": op7_substrings}
ORACLE_SQL = {
    "op7_substrings": r"""
WITH split AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), windows AS (
    SELECT doc_id, s AS start, array_to_string(words[s : s + 12], ' ') AS run
    FROM split, unnest(range(1, len(words) - 11)) AS u(s)
), earlier AS (
    SELECT doc_id, start FROM (SELECT doc_id, start, min(doc_id) OVER (PARTITION BY run) AS least FROM windows) WHERE least < doc_id
), gone AS (
    SELECT DISTINCT doc_id, start + k AS place FROM earlier, unnest(range(0, 13)) AS u(k)
), placed AS (
    SELECT s.doc_id, p AS place, words[p] AS word FROM split s, unnest(range(1, len(words) + 1)) AS u(p)
), kept AS (
    SELECT p.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY place) AS text
    FROM placed p ANTI JOIN gone g ON p.doc_id = g.doc_id AND p.place = g.place GROUP BY p.doc_id
)
SELECT s.doc_id, len(words) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM split s LEFT JOIN kept k ON s.doc_id = k.doc_id
"""
}
