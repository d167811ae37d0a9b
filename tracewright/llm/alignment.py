"""Cross-tokenizer alignment: groups of tokens that end together, links, and corpus-wide counts of linked ids (operator 13)."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut_lineage, shared_folder, table

#: A pair of ids is one number: the A id above SIDE_BITS bits, the B id below.
SIDE_BITS = 32
#: Up to so many links of a group are listed as they are; of a larger one the distinct ids are paired, with their numbers.
LISTED_LINKS = 256
#: A pair held by at least one in HOT_PAIRS of all (document, pair) rows is hot, so no more than HOT_PAIRS are.
HOT_PAIRS = 65_536
_BLOCK_BITS = 20
#: Characters of the texts that are aligned at once. What the numbers of a block take is some 60 times that, and a worker
#: keeps it while the executor goes on, so blocks are small beside the tokenizers.
BLOCK_CHARS = 1 << 18


class PairCodec:
    """Both tokenizers and the bytes of their tokens.

    A is a byte-level merge vocabulary; texts whose characters all come before U+0370, for which every engine knows the
    same letters, are encoded by tiktoken with the vocabulary of the same file, others by the tokenizers library.
    """

    def __init__(self, a_definition: str, b_model: bytes):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        parts = json.loads(a_definition)
        self.a = Tokenizer.from_str(a_definition)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        # The letters that stand for bytes: printable ones for themselves, the rest from U+0100 on.
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        byte_of = {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
        added = {t["content"] for t in parts.get("added_tokens", [])}
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = token.encode() if token in added else bytes(byte_of[c] for c in token)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_length, self.b_length = (np.array([len(x) for x in side], np.int64) for side in (self.a_bytes, self.b_bytes))
        if max(len(self.a_bytes), len(self.b_bytes)) > 1 << _BLOCK_BITS:
            raise ValueError(f"a vocabulary of at most 2**{_BLOCK_BITS} ids is needed")
        special = {vocabulary[t] for t in added}
        self.quick = self._quick(parts, {b: i for i, b in enumerate(self.a_bytes) if b and i not in special}, tiktoken)
        self.beyond = re.compile("[^\x00-ͯ]").search
        # Texts of ids with what follows them: a comma within a side, | between the sides of a group, ; behind it.
        self.shown = [f"{i}{end}" for i in range(len(self.a_bytes)) for end in ",|"] + [f"{i}{end}" for i in range(len(self.b_bytes)) for end in ",;"]

    @staticmethod
    def _quick(parts: dict, ranks: dict[bytes, int], tiktoken):
        """tiktoken's encoder if ids go in order of merges and the splitting is the usual one, else None."""
        model, vocabulary = parts["model"], parts["model"].get("vocab", {})
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model.get("merges", [])]
        ids = [vocabulary[a + b] for a, b in merges]
        usual = parts.get("pre_tokenizer") == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        if not usual or parts.get("normalizer") or model.get("end_of_word_suffix") or any(x >= y for x, y in zip(ids, ids[1:], strict=False)):
            return None
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        return tiktoken.Encoding("pairs", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode_a(self, text: str) -> list[int]:
        if self.quick and not self.beyond(text):
            return self.quick(text)
        return self.a.encode(text, add_special_tokens=False).ids

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both sides; none for an empty text and one whose bytes a side does not give back."""
        of_a = [self.encode_a(" " + t) if t else [] for t in texts]
        of_b = self.b.encode(texts, num_threads=1)
        shown = next((i for i, t in enumerate(texts) if t and len(t) < 10_000), None)
        if shown is not None and self.a.encode(" " + texts[shown], add_special_tokens=False).ids != of_a[shown]:
            raise RuntimeError("encoding differs from the library's")
        for i, t in enumerate(texts):
            raw = b" " + t.encode()
            if not t or any(b"".join(map(side.__getitem__, ids)) != raw for side, ids in ((self.a_bytes, of_a[i]), (self.b_bytes, of_b[i]))):
                of_a[i], of_b[i] = [], []
        return of_a, of_b


@cache
def codec_of(a_definition: str, b_model: bytes) -> PairCodec:
    return PairCodec(a_definition, b_model)


def flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All numbers in one array, and which list each is of."""
    counts = np.array([len(x) for x in lists], np.int64)
    return np.fromiter(chain.from_iterable(lists), np.int64, int(counts.sum())), np.repeat(np.arange(len(lists)), counts)


def merge_ends(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each side, whether a token ends where one of the other side does.

    The two sorted sequences of ends are merged with one pointer into each; both move for a whole block of documents at
    once, as a stable sort of two sorted runs is their merge.
    """
    every = np.concatenate([a_ends, b_ends])
    order = np.argsort(every, kind="stable")
    met = np.flatnonzero(every[order][1:] == every[order][:-1])
    a_met, b_met = np.zeros(len(a_ends), bool), np.zeros(len(b_ends), bool)
    a_met[order[met]] = True
    b_met[order[met + 1] - len(a_ends)] = True
    return a_met, b_met


def blocks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """First and last place (behind it) of runs of texts of about BLOCK_CHARS characters, one text at least."""
    number = np.cumsum([len(t or "") for t in texts]) // BLOCK_CHARS
    for block in np.unique(number):
        at = np.flatnonzero(number == block)
        yield int(at[0]), int(at[-1]) + 1


def align_block(codec: PairCodec, texts: list[str | None]) -> dict[str, list]:
    """n_a, n_b, n_groups, n_links, groups, pairs, times for each of the texts, worked out for all of them at once."""
    of_a, of_b = codec.encode([t or "" for t in texts])
    (a, a_doc), (b, b_doc), size = flat(of_a), flat(of_b), len(texts)
    # A document's bytes are the same on both sides, so the ends of a whole block line up, and each document ends a group.
    a_met, b_met = merge_ends(np.cumsum(codec.a_length[a]), np.cumsum(codec.b_length[b]))
    a_group, b_group = np.cumsum(a_met) - a_met, np.cumsum(b_met) - b_met
    groups = int(a_met.sum())
    a_many, b_many = np.bincount(a_group, minlength=groups), np.bincount(b_group, minlength=groups)
    a_first, b_first = np.cumsum(a_many) - a_many, np.cumsum(b_many) - b_many
    group_doc, links = a_doc[a_met], a_many * b_many

    listed = links <= LISTED_LINKS
    own = np.flatnonzero(listed[a_group])
    each = b_many[a_group[own]]
    left = np.repeat(own, each)
    right = np.repeat(b_first[a_group[own]], each) + np.arange(len(left)) - np.repeat(np.cumsum(each) - each, each)
    keys = [(a_doc[left] << 2 * _BLOCK_BITS) | (a[left] << _BLOCK_BITS) | b[right]]
    many = [np.ones(len(left), np.int64)]
    for g in np.flatnonzero(~listed):
        ids_a, n_a = np.unique(a[a_first[g] : a_first[g] + a_many[g]], return_counts=True)
        ids_b, n_b = np.unique(b[b_first[g] : b_first[g] + b_many[g]], return_counts=True)
        keys.append((group_doc[g] << 2 * _BLOCK_BITS) | ((ids_a << _BLOCK_BITS)[:, None] | ids_b[None, :]).ravel())
        many.append((n_a[:, None] * n_b[None, :]).ravel())
    keys, many = np.concatenate(keys), np.concatenate(many)
    if listed.all():
        keys.sort()
    else:
        order = np.argsort(keys)
        keys, many = keys[order], many[order]
    begins = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    times = np.add.reduceat(many, begins) if len(keys) else many
    distinct = keys[begins]
    side = (1 << _BLOCK_BITS) - 1
    pairs = ((distinct >> _BLOCK_BITS & side) << SIDE_BITS) | (distinct & side)
    cuts = np.searchsorted(distinct >> 2 * _BLOCK_BITS, np.arange(1, size))

    shown = np.empty(len(a) + len(b), np.int64)
    shown[np.arange(len(a)) + b_first[a_group]] = 2 * a + np.concatenate([a_group[1:] != a_group[:-1], [True]])[: len(a)]
    b_last = np.concatenate([b_group[1:] != b_group[:-1], [True]])[: len(b)]
    shown[np.arange(len(b)) + (a_first + a_many)[b_group]] = 2 * len(codec.a_bytes) + 2 * b + b_last
    n_a, n_b = np.bincount(a_doc, minlength=size), np.bincount(b_doc, minlength=size)
    ends = np.cumsum(n_a + n_b).tolist()
    texts_of, begun = [], 0
    for end in ends:
        texts_of.append("".join(map(codec.shown.__getitem__, shown[begun:end].tolist()))[:-1])
        begun = end
    n_links = np.zeros(size, np.int64)
    np.add.at(n_links, group_doc, links)
    return {
        "n_a": n_a, "n_b": n_b, "n_groups": np.bincount(group_doc, minlength=size), "n_links": n_links, "groups": texts_of,
        "pairs": np.split(pairs, cuts) if size else [], "times": np.split(times, cuts) if size else [],
    }


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, groups, pairs, times: one row a document.

    A encodes a space and the text, B the text, special tokens' strings being plain text; byte ends that both sides
    share cut them into groups. `groups` is `a1,a2|b1;a3|b2,b3`: ids of A, ids of B, in order. `pairs` are the distinct
    pairs of an A and a B id that share a group, as one number (see SIDE_BITS), `times` how many pairs of occurrences
    each stands for; n_links is their sum. A text that is null, empty or not given back by the bytes of both sides has
    no tokens: zeros and empty values. Long texts are aligned whole; of a large group only the distinct ids are paired.
    Repeated rows get equal results; an empty table gives no rows. Columns other than the two are not read.
    """
    with open(a_path, encoding="utf-8") as f:
        a_definition = f.read()
    with open(b_path, "rb") as f:
        b_model = f.read()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    numbers = ("n_a", "n_b", "n_groups", "n_links")
    fields = [T.StructField("id", rows.schema["id"].dataType), *(T.StructField(c, T.LongType()) for c in numbers), T.StructField("groups", T.StringType())]
    fields += [T.StructField(c, T.ArrayType(T.LongType())) for c in ("pairs", "times")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = codec_of(a_definition, b_model)
        for frame in frames:
            texts = [t if isinstance(t, str) else None for t in frame["text"]]
            for first, end in blocks(texts):
                made = pd.DataFrame(align_block(codec, texts[first:end]))
                made.insert(0, "id", frame["id"].iloc[first:end].to_numpy())
                yield made

    return rows.mapInPandas(run, T.StructType(fields))


def pair_counts(links: DataFrame) -> DataFrame:
    """pair, count (documents that hold the pair), a_best, b_best (the largest count of its A id, of its B id).

    For rows (pair), one for each document and pair. Counted with partial sums before the shuffle, so a pair that all
    documents hold costs a row a task; an id has at most as many pairs as the other side has ids.
    """
    counts = links.groupBy("pair").agg(F.count("*").alias("count"))
    sides = counts.select("*", F.shiftright("pair", SIDE_BITS).alias("a"), F.col("pair").bitwiseAND((1 << SIDE_BITS) - 1).alias("b"))
    a_best = counts.groupBy(F.shiftright("pair", SIDE_BITS).alias("a")).agg(F.max("count").alias("a_best"))
    b_best = counts.groupBy(F.col("pair").bitwiseAND((1 << SIDE_BITS) - 1).alias("b")).agg(F.max("count").alias("b_best"))
    return sides.join(a_best, "a").join(b_best, "b").select("pair", "count", "a_best", "b_best")


def with_counts(aligned: DataFrame, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """row, n_best_a, n_best_b, count_sum for rows (row, pairs, times) with a distinct `row` each; those with pairs only.

    Sums over a document's links of the pair's count, and of 1 where that is its A (B) id's largest. Counts come back
    to the links in two ways that leave no hot key: a pair with at least one in `hot_pairs` of all rows is hot, so they
    are no more than that and are broadcast; the others are joined by shuffle, and none of them has more rows than that.
    """
    links = aligned.select("row", F.inline(F.arrays_zip(F.col("pairs").alias("pair"), F.col("times").alias("times"))))
    counts = cut_lineage(pair_counts(links))
    total = counts.agg(F.sum("count")).first()[0] or 0
    is_hot = F.col("count") * hot_pairs >= total
    hot = F.broadcast(counts.filter(is_hot))
    cold = links.join(hot.select("pair"), "pair", "left_anti").join(counts.filter(~is_hot), "pair")
    both = links.join(hot, "pair").unionByName(cold)
    best = lambda side: F.sum(F.when(F.col("count") == F.col(side), F.col("times")).otherwise(0))
    return both.groupBy("row").agg(best("a_best").alias("n_best_a"), best("b_best").alias("n_best_b"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))


def align_corpus(docs: DataFrame, a_path: str, b_path: str, digest_groups: bool = False, **columns: str) -> DataFrame:
    """align() with n_best_a, n_best_b and count_sum of with_counts(), without pairs and times.

    With digest_groups the sha256 of groups stands in its place ('' without tokens). Texts are encoded once: what
    align() gives is written as Parquet to the shared folder and read again for counting, joining and the result. The
    folder stays there, as the returned rows are read from it.
    """
    rows = align(docs, a_path, b_path, **columns)
    if digest_groups:
        rows = rows.withColumn("groups", F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise(""))
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/aligned-{uuid.uuid4().hex}"
    rows.withColumn("row", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(folder)
    aligned = spark.read.parquet(folder)
    sums = with_counts(aligned.select("row", "pairs", "times"))
    counted = ("n_best_a", "n_best_b", "count_sum")
    joined = aligned.drop("pairs", "times").join(sums, "row", "left")
    return joined.select("id", "n_a", "n_b", "n_groups", "n_links", "groups", *(F.coalesce(c, F.lit(0)).alias(c) for c in counted))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    found = align_corpus(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), digest_groups=True)
    return found.select(
        F.col("id").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", F.col("n_best_a").alias("n_best"), "count_sum", F.col("groups").alias("groups_sha256"), "n_best_b"
    )


QUERIES = {"op13_alignment": op13_alignment}
ORACLE_SQL: dict[str, str] = {}
