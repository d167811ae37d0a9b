"""What the training-data operators share: tables, lineage cuts and Arrow helpers."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: A word: a longest run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows of Arrow data are handled in pieces of about this many bytes of text.
CHUNK_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which every executor can read.

    Where the session names none a local folder serves a local master (tests, a laptop); a cluster is refused.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp(prefix="tracewright-")


def cut_lineage(df: DataFrame) -> DataFrame:
    """A checkpoint in shared_folder()."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def pieces(batches: Iterator[pa.RecordBatch], column: str, size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Zero-copy slices of the batches that hold about `size` bytes of the string column each (one row at least)."""
    for batch in batches:
        text = batch.column(batch.schema.get_field_index(column))
        ends = np.cumsum(text_lengths(text))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            upto = max(at + 1, int(np.searchsorted(ends, before + size, side="right")))
            yield batch.slice(at, upto - at)
            at = upto


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`run`, with what it freed given back to the system when it ends: Python workers are used again, and idle ones
    stand beside those of the stage that runs, so each would keep the most that any task of it held."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        pa.system_memory_pool().release_unused()  # the C library's heap, where numpy's arrays and Python's objects are

    return tidied


def text_buffer(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array and the n + 1 offsets of its rows in them; null rows are empty."""
    if text.null_count:
        text = text.fill_null("")
    kind = np.int64 if pa.types.is_large_string(text.type) else np.int32
    if not len(text):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(text.buffers()[1], kind)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    data = text.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def text_lengths(text: pa.Array) -> np.ndarray:
    return np.diff(text_buffer(text)[1])


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A random number for each byte at each place of a word; beyond these places they are multiplied by the block's number.
_PLACES = 256
_CODES = np.random.default_rng(20240229).integers(0, 2**64, (_PLACES, 256), dtype=np.uint64)
_MASK = (1 << 64) - 1


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that every output bit depends on every input bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def words(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash (uint64), start and end byte of every word, and where each row's words begin (n + 1 numbers).

    Returns (hashes, spans, first) with spans of shape (words, 2) into the bytes of text_buffer().
    """
    raw, offsets = text_buffer(text)
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros((0, 2), np.int64), np.zeros(len(offsets), np.int64)
    solid = ~_SPACE[raw]
    row_edge = np.zeros(len(raw) + 1, bool)
    row_edge[offsets] = True
    before = np.concatenate([[False], solid[:-1]])
    after = np.concatenate([solid[1:], [False]])
    starts = np.flatnonzero(solid & (~before | row_edge[:-1]))
    ends = np.flatnonzero(solid & (~after | row_edge[1:])) + 1
    at = np.arange(len(raw))
    place = at - np.maximum.accumulate(np.where(solid & (~before | row_edge[:-1]), at, 0))
    codes = _CODES[place & (_PLACES - 1), raw]
    if len(starts) and (ends - starts).max() > _PLACES:
        codes *= mix((place // _PLACES).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) << np.uint64(1) | np.uint64(1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes, dtype=np.uint64)])
    hashes = mix(total[ends] - total[starts] + (ends - starts).astype(np.uint64))
    return hashes, np.stack([starts, ends], axis=1), np.searchsorted(starts, offsets)


def gram_hashes(hashes: np.ndarray, n: int, salt: int) -> np.ndarray:
    """Hash of the n words from each word on; the last n - 1 places, which have fewer, are left out."""
    count = max(0, len(hashes) - n + 1)
    out = np.zeros(count, np.uint64)
    for j in range(n):
        out += hashes[j : j + count] * np.uint64(((salt + j) * 0xD6E8FEB86659FD93 * 2 + 1) & _MASK)
    return mix(out)
