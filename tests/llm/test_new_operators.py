"""Operators 11 to 13 against brute force on small fixtures: nulls, empty and long texts, ties, repeats, empty tables."""

import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tracewright.llm import alignment, curve_packing, fill_in_middle

from .test_operators import corpus, docs

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def odd_rows():
    rng = random.Random(11)
    odd = ["a<P>b c", "<S>", "x <M", "  lead", "trail  \n", "  nbsp   wide", "\U0001f600 \U0001f601x é ß", "<", "<P <S <M", "a\x00b c", "▁ mark", "\x85 next"]
    rows = [(2000 + i, t) for i, t in enumerate(odd * 6)]
    rows += [(None, "null id one"), (None, "null id two"), (None, None), (7000, "same twice here"), (7000, "same twice here"), (7000, "same id, other text")]
    rows += [(8000 + i, " ".join(rng.choices(["<", "S>", "P", "ab", "c\n", "\td"], k=rng.randint(1, 30)))) for i in range(60)]
    return corpus(11) + rows


def fim(doc_id, text, seed=42, share=50, spm=80):
    text = text or ""
    cut = UNIT.findall(text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(cut)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= share:
        return text, n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = ("".join(cut[i:j]) for i, j in ((0, a), (a, b), (b, n)))
    if h4 % 100 < spm:
        return text, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return text, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_fill_in_middle_cuts_at_units_and_can_be_undone(spark):
    for share, spm in ((50, 80), (100, 50)):
        rows = odd_rows()
        made = fill_in_middle.fill_in_middle(docs(spark, rows), fim_percent=share, spm_percent=spm).repartition(3)
        got = made.withColumn("back", fill_in_middle.restored(F.col("output"), F.col("form"))).collect()
        want = Counter((i, *fim(i, t, 42, share, spm)) for i, t, *_ in rows)
        assert Counter((r.id, r.text, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got) == want
        assert all(r.back == r.text for r in got)
        assert {r.form for r in got} == {"plain", "psm", "spm"}
        if share == 100:
            assert any(r.prefix_chars == 0 for r in got) and any(r.middle_chars == 0 for r in got)
    assert fill_in_middle.fill_in_middle(docs(spark, [])).count() == 0


def test_fill_in_middle_shuffles_only_the_texts_it_cuts(spark, sf_dir):
    made = fill_in_middle.fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    made.collect()
    plan = made._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("ReusedExchange") == 2 and plan.count("Exchange hashpartitioning") - plan.count("ReusedExchange") == 1


WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def test_hilbert_keys_walk_the_grid_step_by_step():
    for n, bits in ((2, 4), (3, 3), (4, 2)):
        points = np.array(list(itertools.product(range(1 << bits), repeat=n)))
        keys = curve_packing.hilbert_keys(points, bits)
        assert sorted(keys.tolist()) == list(range(len(points)))
        assert set(np.abs(np.diff(points[np.argsort(keys)], axis=0)).sum(axis=1).tolist()) == {1}


def test_word_codec_equals_the_library():
    with open(WORD_BPE, encoding="utf-8") as f:
        codec = curve_packing.WordCodec(f.read())
    assert codec.quick is not None
    rng = random.Random(3)
    parts = ["a", "B", "'s", "'ll", "'", "\u00c9", "e\u0301", "\u00df", "\u00d7", "\u00f7", "\u03a3", "\u03c2", "\u0130", "1", "\u0662", "\u00bd", "<|endoftext|>", "<|", "\u0345", "\u200b", "\x85", "\u00a0", "\x00", "\x1c", "\u00aa", "\ufb01", "\u6c49", "\U0001f600", "W\u030a", "\u00ff", "\u0178", " ", "\n"]
    texts = ["".join(rng.choices(parts, k=rng.randint(1, 30))).encode() for _ in range(3000)]
    texts += ["".join(map(chr, rng.choices([*range(0x21, 0x7F), *range(0xC0, 0x100)], k=rng.randint(1, 12)))).encode() for _ in range(3000)]
    assert codec.encode_batch(texts) == [codec.whole(t) for t in texts]
    assert codec.encode_batch([None, b"", b" \n"]) == [b"", b"", b""]


@pytest.mark.parametrize("length", [2048, 64])
def test_curve_packing_tiles_every_document(spark, length):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORD_BPE)
    rows = odd_rows()
    packed = curve_packing.pack(docs(spark, rows).repartition(5), WORD_BPE, length).collect()
    want = Counter((i, tuple([*library.encode(t or "", add_special_tokens=False).ids, 1])) for i, t, *_ in rows)
    line = sorted(packed, key=lambda r: (r.sequence_id, r.offset))
    at, found, current = 0, Counter(), []
    for r in line:  # gapless in sequences; a document's pieces follow each other
        assert r.sequence_id * length + r.offset == at and r.offset + r.length <= length and r.start == len(current)
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length > 0
        at, current = at + r.length, current + ids
        if len(current) == r.doc_tokens:
            found[r.id, tuple(current)] += 1
            current = []
    assert not current and found == want
    whole = {r.sequence_id: r for r in curve_packing.sequences(spark.createDataFrame(packed), length).collect()}
    assert set(whole) == set(range(-(-at // length)))
    assert all(w.used == length for k, w in whole.items() if k < len(whole) - 1)
    stream = [x for k in sorted(whole) for x in np.frombuffer(whole[k].ids, "<u4").tolist()[: whole[k].used]]
    assert stream == [x for r in line for x in np.frombuffer(r.ids, "<u4").tolist()]
    last = whole[len(whole) - 1]
    assert len(last.ids) == 4 * (last.used if last.used.bit_count() == 1 else length)
    again = curve_packing.pack(docs(spark, rows[::-1]).repartition(3), WORD_BPE, length).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, packed))
    assert curve_packing.pack(docs(spark, []), WORD_BPE, length).count() == 0


def test_curve_puts_like_documents_together(spark):
    rng = random.Random(4)
    topics = [["".join(rng.choices("abcdefghij", k=6)) for _ in range(40)] for _ in range(8)]
    rows = [(k, " ".join(rng.choices(topics[k % 8], k=80))) for k in range(400)]
    packed = curve_packing.pack(docs(spark, rows), WORD_BPE).collect()
    order = [r.id % 8 for r in sorted(packed, key=lambda r: (r.sequence_id, r.offset)) if r.start == 0]
    same = sum(a == b for a, b in zip(order, order[1:], strict=False)) / len(order)
    assert same > 0.5, same  # at random: one in eight


def test_sequence_of_a_power_of_two_is_not_padded(spark):
    packed = spark.createDataFrame([(0, 0, 3, bytes(12)), (0, 3, 1, bytes(4)), (1, 0, 3, bytes(12))], "sequence_id long, offset long, length long, ids binary")
    assert {r.sequence_id: len(r.ids) // 4 for r in curve_packing.sequences(packed, 16).collect()} == {0: 4, 1: 16}


BYTE_BPE, PIECE_BPE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def both_sides():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(BYTE_BPE)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)
    letters = {c: k for k, c in enumerate([*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)])}
    others = [k for k in range(256) if k not in letters]
    byte_of = {chr(k): k for k in letters} | {chr(0x100 + n): k for n, k in enumerate(others)}

    def a_bytes(i):
        return bytes(byte_of[c] for c in a.id_to_token(i))

    def b_bytes(i):
        piece = b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("\u2581", " ").encode()

    return (lambda t: a.encode(" " + t, add_special_tokens=False).ids), (lambda t: b.encode(t)), a_bytes, b_bytes


def aligned_by_pointers(text, sides):
    """(ids of A, ids of B) for each group, by one pointer into each side."""
    a, b, a_bytes, b_bytes = sides
    if not text:
        return []
    of_a, of_b = a(text), b(text)
    raw = (" " + text).encode()
    if any(b"".join(map(f, ids)) != raw for f, ids in ((a_bytes, of_a), (b_bytes, of_b))):
        return []
    groups, i, j, a_end, b_end, here = [], 0, 0, 0, 0, ([], [])
    while i < len(of_a) or j < len(of_b):
        if a_end <= b_end and i < len(of_a):
            here[0].append(of_a[i])
            a_end += len(a_bytes(of_a[i]))
            i += 1
        else:
            here[1].append(of_b[j])
            b_end += len(b_bytes(of_b[j]))
            j += 1
        if a_end == b_end:
            groups.append(here)
            here = ([], [])
    return groups


def alignment_rows():
    rng = random.Random(9)
    parts = ["a", "=", "-", "=-", "  ", "\n", "\u00e9", "\u6c49", "\U0001f600", "\u2581", "\x00", "<|endoftext|>", "</s>", "<0x41>", "The", " the", "ing", "zz", "1", "\u03a9", "\u0301"]
    rows = [(5000 + k, "".join(rng.choices(parts[: rng.choice([9, 21])], k=rng.randint(0, 40)))) for k in range(150)]
    return odd_rows() + rows + [(6000, "=-" * 3000 + "=" * 777), (6001, "y" * 9000), (6002, " " * 2000)]


def test_alignment_against_two_pointers_and_counts(spark, both_sides):
    rows = alignment_rows()
    groups = [(i, aligned_by_pointers(t, both_sides)) for i, t, *_ in rows]
    held, links = Counter(), []
    for _, found in groups:
        own = Counter((x, y) for a, b in found for x in a for y in b)
        links.append(own)
        held.update(own.keys())
    best_a, best_b = Counter(), Counter()
    for (x, y), n in held.items():
        best_a[x], best_b[y] = max(best_a[x], n), max(best_b[y], n)
    want = Counter()
    for (i, found), own in zip(groups, links, strict=True):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in found)
        digest = hashlib.sha256(text.encode()).hexdigest() if found else ""
        numbers = (sum(len(a) for a, _ in found), sum(len(b) for _, b in found), len(found), sum(own.values()))
        sums = (sum(n for p, n in own.items() if held[p] == best_a[p[0]]), sum(n * held[p] for p, n in own.items()), digest)
        want[i, *numbers, *sums, sum(n for p, n in own.items() if held[p] == best_b[p[1]])] += 1
    given = docs(spark, rows).repartition(4)
    columns = ("id", "n_a", "n_b", "n_groups", "n_links", "n_best_a", "count_sum", "groups", "n_best_b")
    assert Counter(map(tuple, alignment.align_corpus(given, BYTE_BPE, PIECE_BPE, digest_groups=True).select(*columns).collect())) == want
    # Each way of bringing counts back, alone and together, gives the same sums.
    aligned = alignment.align(given, BYTE_BPE, PIECE_BPE).coalesce(1).withColumn("row", F.monotonically_increasing_id()).cache()
    sums = [sorted(map(tuple, alignment.with_counts(aligned.select("row", "pairs", "times"), hot).collect())) for hot in (1, 60, 10**9)]
    assert sums[0] == sums[1] == sums[2] and len(sums[0]) == sum(bool(f) for _, f in groups)
    aligned.unpersist()
    nothing = alignment.align_corpus(docs(spark, []), BYTE_BPE, PIECE_BPE)
    assert nothing.count() == 0


def test_merge_of_ends_and_large_groups(both_sides, monkeypatch):
    with open(BYTE_BPE, encoding="utf-8") as f, open(PIECE_BPE, "rb") as g:
        codec = alignment.codec_of(f.read(), g.read())
    texts = [t for _, t, *_ in alignment_rows()]
    whole = alignment.align_block(codec, texts)
    for listed in (0, 3, 10**9):  # distinct ids of every group, of the larger, of none
        monkeypatch.setattr(alignment, "LISTED_LINKS", listed)
        again = alignment.align_block(codec, texts)
        assert again["groups"] == whole["groups"]
        assert all((x == y).all() for c in ("pairs", "times") for x, y in zip(again[c], whole[c], strict=True))
    for k, t in enumerate(texts):
        assert len(aligned_by_pointers(t, both_sides)) == whole["n_groups"][k]
    assert alignment.align_block(codec, [None, ""])["groups"] == ["", ""]


def test_a_block_is_small_beside_the_tokenizers():
    """op13: blocks hold the texts in order, none left out, and but for a single long text about BLOCK_CHARS characters."""
    from tracewright.llm.alignment import BLOCK_CHARS, blocks

    texts = ["a" * (k % 900) if k % 7 else None for k in range(3000)] + ["b" * 700_000, "c", None, ""]
    runs = list(blocks(texts))
    assert [p for run in runs for p in range(*run)] == list(range(len(texts)))
    assert all(sum(len(t or "") for t in texts[a:b][1:]) <= BLOCK_CHARS <= 1 << 18 for a, b in runs) and len(runs) > 4
    assert list(blocks([])) == []
