"""Packing along a space-filling curve: hashed vectors, few dimensions, Hilbert order, one cut every length (operator 12)."""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut_lineage, pieces, table

#: Places of a hashed document vector, dimensions it is projected to, and bits a dimension has on the curve.
PLACES, DIMENSIONS, BITS = 256, 6, 10
#: Words up to this many bytes are remembered, as many as CACHE_ENTRIES a worker.
CACHED_LENGTH, CACHE_ENTRIES = 48, 600_000
#: Vectors that are held at a time.
VECTOR_ROWS = 4096


class WordCodec(dict):
    """Ids of words, for a tokenizer under which white space parts words that do not depend on each other.

    A new word is encoded by the tokenizers library. Words of printable ASCII and the letters from U+00C0 to U+00FF,
    under the one normaliser and splitting pattern below, have a quicker way: their merges, written as bytes, are
    those of a tiktoken vocabulary in which the last byte of a piece has a code of its own for the end-of-word mark.
    The first text of every batch is encoded whole by the library as well; a difference stops the job.
    """

    NORMAL = ["NFC", "Replace", "Lowercase"]
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    LETTERS = "a-z\u00df-\u00f6\u00f8-\u00ff"
    SUFFIX = "</w>"

    def __init__(self, definition: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(definition)
        self.size = self.library.get_vocab_size(with_added_tokens=True)
        self.quick = self._quick(json.loads(definition))

    def _quick(self, parts: dict):
        """A function from a word to its ids, or None if it is not of the quick kind; None for other tokenizers."""
        model, steps = parts["model"], (parts.get("normalizer") or {}).get("normalizers", [])
        first, last = ((parts.get("pre_tokenizer") or {}).get("pretokenizers", []) + [{}, {}])[:2]
        same = [x["type"] for x in steps] == self.NORMAL and first.get("pattern") == {"Regex": self.PATTERN} and last.get("type") == "ByteLevel"
        vocabulary, merges = model.get("vocab", {}), [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model.get("merges", [])]
        ids = [vocabulary[a + b] for a, b in merges] if same else []
        if not same or model.get("end_of_word_suffix") != self.SUFFIX or any(x >= y for x, y in zip(ids, ids[1:], strict=False)):
            return None
        import tiktoken

        middle = {*range(0x21, 0x7F), *range(0x80, 0xC0), 0xC3} - {*range(0x41, 0x5B)}
        last_bytes = sorted({*range(0x21, 0x7F), 0x9F, *range(0xA0, 0xC0)} - {*range(0x41, 0x5B), 0xB7})
        end = dict(zip(last_bytes, sorted(set(range(256)) - middle), strict=False))
        # The letters that stand for bytes in such vocabularies: printable ones for themselves, the rest from U+0100 on.
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        byte_of = {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}

        def form(token: str) -> bytes | None:
            raw = [byte_of[c] for c in token.removesuffix(self.SUFFIX)]
            if any(b not in middle for b in raw[:-1]) or raw[-1] not in (end if token.endswith(self.SUFFIX) else middle):
                return None
            return bytes(raw[:-1]) + bytes([end[raw[-1]] if token.endswith(self.SUFFIX) else raw[-1]])

        ranks = {f: i for i, (a, b) in zip(ids, merges, strict=True) if (f := form(a + b))}
        singles = {form(t): i for t, i in vocabulary.items() if i < ids[0] and form(t)}
        unused = iter(range(self.size, self.size + 256))
        ranks |= {bytes([b]): singles[bytes([b])] if bytes([b]) in singles else next(unused) for b in range(256)}
        encode = tiktoken.Encoding("words", pat_str=".", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        kind = re.compile(r"[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
        cut = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{self.LETTERS}]+|[0-9]|[^{self.LETTERS}0-9]+")
        added = [re.escape(t["content"]) for t in parts.get("added_tokens", [])]
        marks = re.compile("|".join(added)) if added else re.compile(r"(?!)")

        closing = [bytes([end[b]]) if b in end else None for b in range(256)]

        def ids_of(word: bytes) -> list[int] | None:
            if word.isalpha():  # ASCII letters alone
                low = word.lower()
                return encode(low[:-1] + closing[low[-1]])
            text = word.decode()
            if not kind.fullmatch(text) or marks.search(text):
                return None
            out: list[int] = []
            for piece in cut.findall(text.lower()):
                raw = piece.encode()
                out += encode(raw[:-1] + closing[raw[-1]])
            return out

        return ids_of

    def __missing__(self, word: bytes) -> bytes:
        if len(word) > CACHED_LENGTH:
            return self.whole(word)
        ids = self.quick(word) if self.quick else None
        self[word] = found = self.whole(word) if ids is None else array("I", ids).tobytes()
        return found

    def whole(self, text: bytes) -> bytes:
        return array("I", self.library.encode(text.decode(), add_special_tokens=False).ids).tobytes()

    def encode_batch(self, texts: list[bytes | None]) -> list[bytes]:
        """The ids of each text as unsigned 32-bit numbers (little-endian machines)."""
        if len(self) > CACHE_ENTRIES:
            self.clear()
        ids = self.__getitem__
        out = [b"".join(map(ids, t.split())) if t else b"" for t in texts]  # bytes are split at ASCII white space
        shown = next((i for i, t in enumerate(texts) if t and len(t) < 10_000), None)
        if shown is not None and self.whole(texts[shown]) != out[shown]:
            raise RuntimeError("encoding by words differs from the library's")
        return out


@cache
def codec_of(definition: str) -> WordCodec:
    """One codec a worker process, so that its words are known to the next task."""
    return WordCodec(definition)


def hilbert_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places of points (rows of unsigned coordinates below 2**bits) on the Hilbert curve, by Skilling's transform."""
    x = points.T.astype(np.int64).copy()
    n = len(x)
    for q in (1 << k for k in range(bits - 1, 0, -1)):
        low = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            if i:
                x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for q in (1 << k for k in range(bits - 1, 0, -1)):
        turn ^= np.where((x[-1] & q) != 0, q - 1, 0)
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> b & 1)
    return key


class Projection:
    """Documents' token ids to curve keys. All tables come from a fixed seed, so every worker has the same."""

    def __init__(self, size: int):
        draw = np.random.default_rng(20240229)
        self.place = draw.integers(0, PLACES, size)
        self.sign = draw.choice([-1.0, 1.0], size)
        self.axes = draw.standard_normal((PLACES, DIMENSIONS))

    def keys(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """One key a document: signed hashed counts, damped by a logarithm, scaled to length 1 and projected."""
        out = np.zeros(len(counts), np.int64)
        ends = np.concatenate([[0], np.cumsum(counts)])
        for a in range(0, len(counts), VECTOR_ROWS):
            b = min(len(counts), a + VECTOR_ROWS)
            own = ids[ends[a] : ends[b]]
            at = np.repeat(np.arange(b - a), counts[a:b]) * PLACES + self.place[own]
            vectors = np.bincount(at, self.sign[own], (b - a) * PLACES).reshape(b - a, PLACES)
            vectors = np.sign(vectors) * np.log1p(np.abs(vectors))
            length = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
            spread = (vectors / np.where(length > 0, length, 1)) @ self.axes
            share = 1 / (1 + np.exp(-1.702 * spread))  # near the normal distribution function
            out[a:b] = hilbert_keys(np.minimum((share * (1 << BITS)).astype(np.int64), (1 << BITS) - 1))
        return out


def encoded(docs: DataFrame, tokenizer_path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row, id, curve, n, ids for each document: its token ids and end_id, compressed, and its place on the curve."""
    with open(tokenizer_path, encoding="utf-8") as f:
        definition = f.read()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    fields = [T.StructField("id", rows.schema["id"].dataType), T.StructField("curve", T.LongType()), T.StructField("n", T.LongType()), T.StructField("ids", T.BinaryType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        codec = codec_of(definition)
        projection, pack = Projection(max(codec.size, end_id + 1)), zstandard.ZstdCompressor(level=1, write_content_size=True).compress
        end = np.array([end_id], "<u4").tobytes()
        for batch in pieces(batches, "text"):
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            coded = [c + end for c in codec.encode_batch(texts)]
            counts = np.array([len(c) // 4 for c in coded], np.int64)
            every = np.frombuffer(b"".join(coded), "<u4")
            curve = projection.keys(every, counts)
            if codec.size <= 1 << 16:
                small = every.astype("<u2").tobytes()
                ends = np.concatenate([[0], np.cumsum(2 * counts)]).tolist()
                coded = [small[a:b] for a, b in zip(ends, ends[1:], strict=False)]
            ids = pa.array([pack(c) for c in coded], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(curve), pa.array(counts), ids], names=["id", "curve", "n", "ids"])

    made = rows.mapInArrow(run, T.StructType(fields))
    return made.withColumn("row", F.monotonically_increasing_id())


def _ahead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the number of the task's partition, and the tokens in it before each row."""
    part, total = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.column(1).to_numpy()
        ends = total + np.cumsum(n)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(n), part, np.int64)), batch.column(1), pa.array(ends - n)], names=["row", "part", "n", "ahead"])
        total = int(ends[-1]) if len(n) else total


def starts(rows: DataFrame) -> DataFrame:
    """row, start: the tokens before each document, documents in order of curve, then of a hash, all in one long line.

    Rows (row, id, curve, n, ids) are range-sorted without their ids' bytes; copies share a key of the curve, but the
    hash of id and text parts them, so no range is larger than another. The sorted rows are a checkpoint, as sampled
    bounds must not be drawn twice. The tokens before a partition are a running sum over one row a partition, which is
    broadcast.
    """
    tied = rows.select("row", "n", "curve", F.xxhash64("id", "ids").alias("tie"))
    ordered = tied.repartitionByRange("curve", "tie", "row").sortWithinPartitions("curve", "tie", "row").select("row", "n")
    placed = cut_lineage(ordered.mapInArrow(_ahead, "row long, part long, n long, ahead long"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("part").agg(F.sum("n").alias("tokens"))
    bases = totals.select("part", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))
    return placed.join(F.broadcast(bases), "part").select("row", (F.col("base") + F.col("ahead")).alias("start"))


def pack(docs: DataFrame, tokenizer_path: str, length: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a piece: id, start (the document's ids before it), length, ids, doc_tokens, sequence_id, offset.

    `ids` are little-endian unsigned 32-bit numbers. A document is its ids and end_id. Documents stand in one line in
    order of the Hilbert curve, and sequence k is the line from k * length on; so neighbours on the curve share
    sequences, a document is cut only where a sequence ends, and only the last sequence of all can need padding. A
    null or empty text is end_id alone. A long text is encoded whole and takes as many sequences as it needs. Rows
    with the same id are documents of their own; wholly equal rows stand side by side. An empty table gives no rows.
    Columns other than the two are not read, so their names cannot clash. Texts are encoded once, into a checkpoint.
    """
    rows = cut_lineage(encoded(docs, tokenizer_path, end_id, id_col, text_col))
    placed = rows.select("row", "id", "n", "ids").join(starts(rows), "row").select("id", "n", "ids", F.col("start").alias("at"))
    whole, size = T.LongType(), length
    fields = [T.StructField("id", rows.schema["id"].dataType), T.StructField("start", whole), T.StructField("length", whole), T.StructField("ids", T.BinaryType())]
    fields += [T.StructField(c, whole) for c in ("doc_tokens", "sequence_id", "offset")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for batch in pieces(batches, "ids"):
            taken, columns, chunks = [], [], []
            for k, (n, at, packed) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("n", "at", "ids")), strict=True)):
                raw = unpack(packed)
                raw = raw if len(raw) == 4 * n else np.frombuffer(raw, "<u2").astype("<u4").tobytes()
                begun = 0
                while begun < n:
                    own = min(n - begun, size - (at + begun) % size)
                    taken.append(k)
                    columns.append((begun, own, n, (at + begun) // size, (at + begun) % size))
                    chunks.append(raw[4 * begun : 4 * (begun + own)])
                    begun += own
            start, own, n, sequence, offset = (pa.array(c, pa.int64()) for c in zip(*columns, strict=True))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(taken)), start, own, pa.array(chunks, pa.binary()), n, sequence, offset], names=[f.name for f in fields])

    return placed.mapInArrow(cut, T.StructType(fields))


def sequences(packed: DataFrame, length: int = 2048, pad_id: int = 0) -> DataFrame:
    """sequence_id, ids, used for the pieces of pack(): pieces put together, padded to `length` with pad_id unless the
    number of ids used is a power of two. No sequence has more than `length` pieces, so none is a large group."""
    put = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    whole = packed.groupBy("sequence_id").agg(put.alias("pieces"), F.sum("length").alias("used"))
    joined = F.aggregate("pieces", F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    missing = F.when(F.bit_count("used") == 1, 0).otherwise(length - F.col("used")).cast("int")
    padding = F.unhex(F.repeat(F.lit(int(pad_id).to_bytes(4, "little").hex()), missing))
    return whole.select("sequence_id", F.concat(joined, padding).alias("ids"), "used")


def op12_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    packed = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packed.select(
        F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


QUERIES = {"op12_curve_packing": op12_curve_packing}
ORACLE_SQL: dict[str, str] = {}
