"""Language identification by rank-order n-gram profiles and the out-of-place distance (operator 8)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import pieces, table, tidy

#: Grams a profile holds, documents a language is learnt from at most (about), and the label of texts without letters.
PROFILE_GRAMS, LEARNT_DOCUMENTS, UNDETERMINED = 300, 4000, "und"
_EDGE = 1


class _Letters:
    """Which code points are letters, found once a worker."""

    table: np.ndarray | None = None

    @classmethod
    def of(cls, points: np.ndarray) -> np.ndarray:
        if cls.table is None:
            cls.table = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
        return cls.table[points]


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of the 1- to 3-grams of a lower-cased text's letter runs, with an edge mark round each run."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    letter = np.concatenate([[False], _Letters.of(points), [False]])
    marked = np.where(letter, np.concatenate([[0], points, [0]]), _EDGE).astype(np.uint64)
    c = marked[letter | np.concatenate([[True], letter[:-1]])]
    two = c[:-1] << np.uint64(21) | c[1:]
    three = (two[:-1] << np.uint64(21) | c[2:])[c[1:-1] != _EDGE]
    return np.unique(np.concatenate([c[c != _EDGE], two, three]), return_counts=True)


def ranked(keys: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent keys first; equal counts by key."""
    return keys[np.lexsort((keys, -counts))[:size]]


def learn_profiles(
    docs: DataFrame, text_col: str = "text", label_col: str = "lang", size: int = PROFILE_GRAMS, learnt: int = LEARNT_DOCUMENTS
) -> dict[str, list[int]]:
    """label: its most frequent grams, best first. About `learnt` documents of each label are used, chosen by a hash
    of the text: the bound of this classifier's sample. Rows without a label or text are left out. What comes to the
    driver is `size` grams a label."""
    rows = docs.select(F.col(label_col).cast("string").alias("label"), F.col(text_col).cast("string").alias("text"))
    rows = rows.filter("label is not null and text is not null")
    counts = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    share = F.create_map(*(F.lit(x) for k, n in counts.items() for x in (k, min(1.0, learnt / n))))
    drawn = F.pmod(F.xxhash64("text"), F.lit(1_000_003)) < share[F.col("label")] * 1_000_003

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            by: dict[str, list] = {}
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by.setdefault(label, []).append(gram_counts(text))
            for label, found in by.items():
                keys, at = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
                n = np.bincount(at, np.concatenate([c for _, c in found])).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([label] * len(keys)), pa.array(keys.view(np.int64)), pa.array(n)], ["label", "gram", "n"]
                )

    grams = rows.filter(drawn).mapInArrow(tidy(run), "label string, gram long, n long").groupBy("label", "gram").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("label").orderBy(F.col("n").desc(), "gram")
    top = grams.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= size).collect()
    out: dict[str, list[int]] = {}
    for r in sorted(top, key=lambda r: (r.label, r["rank"])):
        out.setdefault(r.label, []).append(r.gram)
    return out


class Profiles:
    """Ranks of all profiles' grams, for the out-of-place distance."""

    def __init__(self, profiles: dict[str, list[int]], size: int):
        self.labels, self.size = sorted(profiles), size
        self.keys = np.unique(np.array([g for p in profiles.values() for g in p], np.int64).view(np.uint64))
        self.rank = np.full((len(self.labels), len(self.keys)), -1, np.int64)
        for i, label in enumerate(self.labels):
            own = np.array(profiles[label], np.int64).view(np.uint64)
            self.rank[i, np.searchsorted(self.keys, own)] = np.arange(len(own))

    def predict(self, text: str | None) -> tuple[str, float]:
        keys, counts = gram_counts(text) if text else (np.zeros(0, np.uint64), None)
        if not len(keys) or not self.labels or keys[-1] == (_EDGE << 21 | _EDGE):
            return UNDETERMINED, 0.0
        own = ranked(keys, counts, self.size)
        at = np.minimum(np.searchsorted(self.keys, own), len(self.keys) - 1)
        ranks = np.where(self.keys[at] == own, self.rank[:, at], -1)
        apart = np.where(ranks < 0, self.size, np.abs(ranks - np.arange(len(own)))).sum(axis=1)
        best = int(np.argmin(apart))
        return self.labels[best], float(1 - apart[best] / (self.size * len(own)))


def predict_language(docs: DataFrame, profiles: dict[str, list[int]], text_col: str = "text", size: int = PROFILE_GRAMS) -> DataFrame:
    """The rows of `docs` with lang_pred (string) and score (double, 0 to 1) appended.

    The label with the smallest out-of-place distance wins, the first in order on a tie; the score is 1 less that
    distance as a share of the largest possible. Null text, or none of its characters a letter: `und`, score 0.
    Long texts are counted whole. Repeated rows get equal results; an empty table gives no rows; columns of these names
    in the input are replaced, others stay.
    """
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    schema = docs.select(*kept).schema.add("lang_pred", "string").add("score", "double")
    # A text column that goes through anyway is not sent twice.
    own = text_col in kept and docs.schema[text_col].dataType == T.StringType()
    rows = docs.select(*kept) if own else docs.select(*kept, F.col(text_col).cast("string").alias("__language_text"))
    read = text_col if own else "__language_text"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Profiles(profiles, size)
        for batch in pieces(batches, read):
            found = [known.predict(t) for t in batch.column(batch.schema.get_field_index(read)).to_pylist()]
            added = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *added], names=[*kept, "lang_pred", "score"])

    return rows.mapInArrow(tidy(run), schema)


def held_out(id_col: str = "doc_id") -> F.Column:
    """Rows that a classifier must not learn from: the checksum of the id as text is 2 modulo 4, or there is no id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(True))


def op8_rank_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out().alias("held_out"))
    profiles = learn_profiles(docs.filter("not held_out"))
    return predict_language(docs.select("doc_id", "text", "held_out"), profiles).select("doc_id", "held_out", "lang_pred", "score")


QUERIES = {"op8_rank_order": op8_rank_order}
ORACLE_SQL: dict[str, str] = {}
