"""SentencePiece merge-type encoding and decoding by a score-ordered agenda (operator 2)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import pieces, table, tidy

SPACE = "▁"
#: Segments up to this many characters are remembered, as many as CACHE_ENTRIES a worker.
CACHED_LENGTH, CACHE_ENTRIES = 48, 150_000
#: Texts are handled in pieces of about this many bytes.
PIECE_BYTES = 1 << 19
_PLACE_BITS = 40
#: No rank of a pair: the two symbols do not merge.
_APART = 1 << 62


class MergeCodec:
    """Encoder and decoder of one merge-type model with byte fallback, identity normalisation and a space prefix."""

    def __init__(self, model: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(model)
        norm, kind = proto.normalizer_spec, proto.trainer_spec
        if kind.model_type != pb.TrainerSpec.BPE or not kind.byte_fallback or norm.precompiled_charsmap:
            raise ValueError("a merge-type model with byte fallback and identity normalisation is needed")
        if not norm.add_dummy_prefix or norm.remove_extra_whitespaces or kind.treat_whitespace_as_suffix:
            raise ValueError("a model with a space prefix that keeps white space is needed")
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        normal = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == pb.ModelProto.SentencePiece.NORMAL}
        self.byte_ids = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == pb.ModelProto.SentencePiece.BYTE}
        scores = sorted({proto.pieces[i].score for i in normal.values()}, reverse=True)
        order = {s: k for k, s in enumerate(scores)}
        self.order = {p: order[proto.pieces[i].score] for p, i in normal.items()}
        self.ids = normal
        self.text_of: dict[int, bytes] = {i: p.replace(SPACE, " ").encode() for p, i in normal.items()}
        self.text_of |= {i: bytes([b]) for b, i in self.byte_ids.items()}
        # No merge reaches over a place whose two characters are never side by side in a piece.
        beside = {(a, b) for p in normal for a, b in zip(p, p[1:], strict=False)}
        if any(b == SPACE and a != SPACE for a, b in beside):
            self.segments = re.compile(r"(?s).+")
        else:
            marks = {c for pair in beside for c in pair if not c.isalpha() and c != SPACE} | {"\n"}
            while apart := {a if a in marks else b for a, b in beside if a != SPACE and (a in marks) != (b in marks)}:
                marks -= apart
            own = "".join(map(re.escape, sorted(marks))) or SPACE
            self.segments = re.compile(f"{SPACE}*(?:[^{SPACE}{own}]+|[{own}]+)|{SPACE}+")
        self._pairs(len(proto.pieces))
        self.known: dict[str, int] = {}
        self._forget()

    def _pairs(self, n: int) -> None:
        """Symbols as numbers: pieces by their id, characters that are no piece behind them, all others as one; and what
        each pair of symbols that merges becomes, as a sorted array."""
        symbols = dict(self.ids)
        for c in sorted({c for p in self.ids for c in p} - set(symbols)):
            symbols[c] = n + len(symbols) - len(self.ids)
        self.n_ids, self.n_symbols = n, n + len(symbols) - len(self.ids) + 1
        self.of_char = np.full(0x110000, self.n_symbols - 1, np.int32)
        self.of_char[[ord(s) for s in symbols if len(s) == 1]] = [i for s, i in symbols.items() if len(s) == 1]
        self.rank = np.full(self.n_symbols + 1, _APART, np.int64)
        self.rank[list(self.ids.values())] = [self.order[p] for p in self.ids]
        splits = ((symbols.get(p[:k]), symbols.get(p[k:]), i) for p, i in self.ids.items() for k in range(1, len(p)))
        made = np.array([x for x in splits if x[0] is not None and x[1] is not None], np.int64).reshape(-1, 3)
        keys = made[:, 0] * self.n_symbols + made[:, 1]
        by_key = np.argsort(keys)
        self.pair_keys, self.pair_makes = np.append(keys[by_key], _APART), np.append(made[by_key, 2], self.n_symbols)

    def _forget(self) -> None:
        self.known.clear()
        self.store, self.ends = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _makes(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The symbol that each pair becomes; n_symbols, which has no rank, for pairs that stay apart."""
        keys = left.astype(np.int64) * self.n_symbols + right
        found = np.searchsorted(self.pair_keys, keys)
        return np.where(self.pair_keys[found] == keys, self.pair_makes[found], self.n_symbols)

    def merge_all(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all segments in a row, and how many each has.

        One agenda holds the adjacent pairs of all segments; a round takes each segment's best entry, by score, then
        place from the left, merges it, and puts the pairs on its two sides on the agenda anew.
        """
        codes = np.frombuffer("".join(segments).encode("utf-32-le"), np.uint32)
        owner = np.repeat(np.arange(len(segments)), np.fromiter(map(len, segments), np.int64, len(segments)))
        left, at, seg = np.full(len(codes), -1, np.int64), np.arange(len(codes)), owner
        symbol = self.of_char[codes].astype(np.int64)
        makes = np.full(len(codes), self.n_symbols, np.int64)
        beside = np.flatnonzero(seg[1:] == seg[:-1])
        makes[beside] = self._makes(symbol[beside], symbol[beside + 1])
        while len(seg):
            begins = np.flatnonzero(np.append(True, seg[1:] != seg[:-1]))
            rank = self.rank[makes]
            best = np.minimum.reduceat(np.where(rank == _APART, _APART, (rank << _PLACE_BITS) | np.arange(len(seg))), begins)
            done = np.repeat(best == _APART, np.diff(np.append(begins, len(seg))))
            left[at[done]] = symbol[done]
            place = best[best != _APART] & ((1 << _PLACE_BITS) - 1)
            symbol[place] = makes[place]
            keep = ~done
            keep[place + 1] = False
            place = (np.cumsum(keep) - 1)[place]
            symbol, makes, at, seg = symbol[keep], makes[keep], at[keep], seg[keep]
            anew = np.concatenate([place, place[place > 0] - 1])
            inner = anew[anew + 1 < len(seg)]
            inner = inner[seg[inner] == seg[inner + 1]]
            makes[anew] = self.n_symbols
            makes[inner] = self._makes(symbol[inner], symbol[inner + 1])
        kept = np.flatnonzero(left >= 0)
        ids, owner, codes = left[kept], owner[kept], codes[kept]
        odd = np.flatnonzero(ids >= self.n_ids)
        if len(odd):
            raw = [chr(c).encode() for c in codes[odd]]
            times = np.ones(len(ids), np.int64)
            times[odd] = [len(b) for b in raw]
            of_bytes = np.repeat(ids >= self.n_ids, times)
            ids, owner = np.repeat(ids, times), np.repeat(owner, times)
            ids[of_bytes] = [self.byte_ids[x] for x in b"".join(raw)]
        return ids.astype(np.int32), np.bincount(owner, minlength=len(segments))

    def merge(self, text: str) -> list[str]:
        """The symbols that are left of one long segment when the best-scored adjacent pair has been merged, again and
        again. The agenda is a heap, where an entry whose symbols have changed is passed over."""
        n, order = len(text), self.order.get
        symbols, after, before = list(text), list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [(rank << _PLACE_BITS) | i for i in range(n - 1) if (rank := order(text[i : i + 2])) is not None]
        heapify(agenda)
        low = (1 << _PLACE_BITS) - 1
        while agenda:
            entry = heappop(agenda)
            i = entry & low
            j = after[i]
            if j >= n or not symbols[i]:
                continue
            merged = symbols[i] + symbols[j]
            if order(merged) != entry >> _PLACE_BITS:
                continue
            symbols[i], symbols[j] = merged, ""
            k, h = after[j], before[i]
            after[i] = k
            if k < n:
                before[k] = i
                if (rank := order(merged + symbols[k])) is not None:
                    heappush(agenda, (rank << _PLACE_BITS) | i)
            if h >= 0 and (rank := order(symbols[h] + merged)) is not None:
                heappush(agenda, (rank << _PLACE_BITS) | h)
        return [s for s in symbols if s]

    def segment_ids(self, segment: str) -> list[int]:
        out: list[int] = []
        for s in self.merge(segment):
            i = self.ids.get(s)
            out += [i] if i is not None else [self.byte_ids[b] for b in s.encode()]
        return out

    def _remember(self, segments: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        self.known.update(zip(segments, range(len(self.known), len(self.known) + len(segments)), strict=True))
        self.store, self.ends = np.concatenate([self.store, ids]), np.concatenate([self.ends, self.ends[-1] + np.cumsum(counts)])

    def learn(self, segments: set[str]) -> None:
        """Encodes segments that are not known yet and holds those that begin with a space mark against the library."""
        new = [s for s in segments if s not in self.known]
        if len(self.known) + len(new) > CACHE_ENTRIES:
            self._forget()
            new = list(segments)
        # The library puts a space in front: a segment that has one loses it first, any other is compared behind it.
        new.sort(key=lambda s: s[0] != SPACE or len(s) == 1)
        ids, counts = self.merge_all(new)
        led = [s[1:] for s in new if s[0] == SPACE and len(s) > 1]
        theirs = self.library.encode(led, num_threads=1)
        if list(map(len, theirs)) != counts[: len(led)].tolist() or list(chain.from_iterable(theirs)) != ids[: counts[: len(led)].sum()].tolist():
            ours = np.split(ids, np.cumsum(counts)[: len(led)])
            s = next(s for s, mine, their in zip(led, ours, theirs, strict=False) if mine.tolist() != their)
            raise RuntimeError(f"encoding differs from the library's for {SPACE + s!r}")
        self._remember(new, ids, counts)

    def encode_batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's begin (n + 1 numbers)."""
        cut = [self.segments.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        distinct = set(chain.from_iterable(cut))
        long = [s for s in distinct if len(s) > CACHED_LENGTH]
        self.learn(distinct.difference(long))
        n_known = len(self.known)
        if long:
            coded = [self.segment_ids(s) for s in long]
            self._remember(long, np.array(list(chain.from_iterable(coded)), np.int32), np.array(list(map(len, coded))))
        n = np.array(list(map(len, cut)), np.int64)
        number = np.fromiter(map(self.known.__getitem__, chain.from_iterable(cut)), np.int64, int(n.sum()))
        begin, size = self.ends[number], self.ends[number + 1] - self.ends[number]
        upto = np.concatenate([np.zeros(1, np.int64), np.cumsum(size)])
        ids = self.store[np.arange(upto[-1]) + np.repeat(begin - upto[:-1], size)]
        if long:
            for s in long:
                del self.known[s]
            self.store, self.ends = self.store[: self.ends[n_known]].copy(), self.ends[: n_known + 1].copy()
        return ids, upto[np.concatenate([np.zeros(1, np.int64), np.cumsum(n)])]

    def decode_batch(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """Texts of the ids: spaces for their marks, the first one dropped, bytes put together."""
        text_of, out = self.text_of.__getitem__, []
        for begin, end in zip(offsets[:-1], offsets[1:], strict=True):
            raw = b"".join(map(text_of, ids[begin:end].tolist()))
            out.append((raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace"))
        return out


def encode_decode(docs: DataFrame, model_path: str, text_col: str = "text") -> DataFrame:
    """The rows of `docs` with ids (array of int) and decoded (string) appended; no begin or end ids.

    The texts travel in Arrow batches. New segments that begin with a space mark, up to CACHED_LENGTH characters, and
    one whole text a piece of each batch are encoded by the sentencepiece library as well; a difference stops the job. Null and empty texts: no ids, decoded
    is empty. Long texts are encoded whole. Repeated rows get equal results; an empty table gives no rows. Columns called
    ids or decoded in the input are replaced, others stay.
    """
    with open(model_path, "rb") as f:
        model = f.read()
    kept = [c for c in docs.columns if c not in ("ids", "decoded")]
    # A text column that goes through anyway is not sent twice.
    own = text_col in kept and docs.schema[text_col].dataType == T.StringType()
    rows = docs.select(*kept) if own else docs.select(*kept, F.col(text_col).cast("string").alias("__codec_text"))
    read = text_col if own else "__codec_text"
    schema = T.StructType(
        [f for f in docs.schema.fields if f.name in kept]
        + [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = MergeCodec(model)
        for batch in pieces(batches, read, PIECE_BYTES):
            texts = batch.column(batch.schema.get_field_index(read)).to_pylist()
            ids, offsets = codec.encode_batch(texts)
            decoded = codec.decode_batch(ids, offsets)
            shown = min((i for i, t in enumerate(texts) if t), key=lambda i: -min(len(texts[i]), 10_000), default=None)
            if shown is not None:
                theirs = codec.library.encode(texts[shown], num_threads=1)
                if theirs != ids[offsets[shown] : offsets[shown + 1]].tolist() or codec.library.decode(theirs) != decoded[shown]:
                    raise RuntimeError("encoding or decoding of a whole text differs from the library's")
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
            columns = [*batch.columns[: len(kept)], lists, pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "ids", "decoded"])

    return rows.mapInArrow(tidy(run), schema)


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


QUERIES = {"op2_sentencepiece": op2_sentencepiece}
ORACLE_SQL: dict[str, str] = {}
