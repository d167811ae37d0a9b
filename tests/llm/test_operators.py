"""Each operator against brute force on small fixtures: nulls, empty and long texts, ties, repeats, empty tables."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tracewright.llm import chat_format, divergence, language_id, link_trust, mixing, sentencepiece_codec, sharding, simhash, spotsigs, substrings

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, fingerprint string, size int, label string, rest int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, rows):
    """Documents (doc_id, text[, lang[, source]]) with more columns whose names clash with the operators' own."""
    full = [(*r, *(None,) * (4 - len(r)), None, "x", "y", 7, "z", 1) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    vocab = ["the", "of", "and", "was", *("".join(rng.choices("abcdefgh", k=rng.randint(2, 6))) for _ in range(60))]
    rows, texts = [], []
    for i in range(n):
        if texts and rng.random() < 0.3:
            words = rng.choice(texts).split()
            at = rng.randrange(len(words) + 1)
            words = words[:at] + rng.choices(vocab, k=rng.randint(0, 3)) + words[at:]
        else:
            words = rng.choices(vocab, k=rng.randint(1, 120))
        texts.append(" ".join(words))
        rows.append((i * 3 - 20, texts[-1], rng.choice(["en", "fr", None]), rng.choice(["a", "b", "ü", None])))
    rows += [(1000, None), (1001, ""), (1002, " \n\t "), (1003, "x " * 5000), (1004, texts[0]), (1005, texts[0]), (1006, "y" * 20000), (None, texts[1])]
    return rows


def words_of(text):
    return WORD.findall(text or "")


@pytest.mark.parametrize("bucket", [16, 48])
def test_simhash_components(spark, bucket, monkeypatch):
    from xxhash import xxh64_intdigest

    monkeypatch.setattr(simhash, "PAIR_BUCKET", bucket)
    monkeypatch.setattr(simhash.links, "__defaults__", (bucket,))
    rows = corpus(2)
    got = {(r.id): (r.fingerprint & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(docs(spark, rows)).collect()}
    want = {}
    for i, text, *_ in rows:
        w = (text or "").encode().lower().split()
        grams = [b" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
        h = [xxh64_intdigest(g, 42) for g in grams]
        want[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    assert {k: v[0] for k, v in got.items()} == want
    parent = {k: k for k in want if k is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(parent), 2):
        if (want[a] ^ want[b]).bit_count() <= 2:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    assert {k: got[k][1] for k in parent} == {k: find(k) for k in parent}


def test_simhash_links_are_exact_for_close_fingerprints(spark):
    rng = random.Random(5)
    centres = [rng.getrandbits(64) for _ in range(6)]
    prints = list({c ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for c in centres for _ in range(60)})
    signed = [(p - (1 << 64) if p >> 63 else p, i) for i, p in enumerate(prints)]
    classes = spark.createDataFrame(signed, "fingerprint long, rep long")
    from tracewright.llm.components import connected_components

    for bucket in (16, 1000):
        assert {(r.a, r.b) for r in simhash.links(classes, bucket).collect()} == {(a, b) for a, b in itertools.combinations(range(len(prints)), 2) if (prints[a] ^ prints[b]).bit_count() <= 2}
        got = {r.node: r.component for r in connected_components(simhash.links(classes, bucket)).collect()}
        parent = list(range(len(prints)))

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in itertools.combinations(range(len(prints)), 2):
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
        assert {k: got.get(k, k) for k in range(len(prints))} == {k: find(k) for k in range(len(prints))}


def test_simhash_splits_crowded_buckets_down_to_the_last_level(spark):
    rng = random.Random(6)
    bits = [3, 4, 20, 21, 33, 40, 41, 50, 62, 63]
    prints = sorted({sum(1 << b for b in bits if rng.random() < 0.5) for _ in range(700)})
    classes = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p, i) for i, p in enumerate(prints)], "fingerprint long, rep long")
    got = simhash.links(classes, 16).collect()
    want = {(a, b) for a, b in itertools.combinations(range(len(prints)), 2) if (prints[a] ^ prints[b]).bit_count() <= 2}
    assert {(r.a, r.b) for r in got} == want and len(got) == len(want)
    assert simhash.links(classes.limit(0)).count() == 0


def test_keep_one_takes_a_stated_row(spark):
    rows = [(1, "b b", "en", "x"), (1, "a a", "fr", "y"), (1, "a a", "de", "z"), (2, None), (2, ""), (None, "q")]
    for parts in (1, 5):
        kept = simhash.keep_one(docs(spark, rows).repartition(parts)).collect()
        assert sorted((r.doc_id or 0, r.text or "-", r.source or "") for r in kept) == [(0, "q", ""), (1, "a a", "z"), (2, "-", "")]
    assert simhash.keep_one(docs(spark, [])).count() == 0 and simhash.near_duplicates(docs(spark, [])).count() == 0


def test_keep_one_keeps_columns(spark):
    kept = simhash.keep_one(docs(spark, [(2, "a b c d"), (1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (3, "q r s t u")]))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.source, r["size"]) for r in kept.collect()) == [(False, 1, None, 7), (False, 3, None, 7), (True, 0, None, 7)]


def test_pieces_match_library(spark):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(3)
    odd = ["".join(rng.choices("ab the ▁\n\t  é日本語ß<s></s>[INST]0123\u0000🙂", k=rng.randint(0, 60))) for _ in range(300)]
    rows = [(i, t) for i, t in enumerate([*odd, None, "", "   ", "x" * 3000, " " * 700, "ab " * 9000])]
    for r in sentencepiece_codec.encode_decode(docs(spark, rows), path).collect():
        assert r.ids == library.encode(r.text or "") and r.decoded == library.decode(r.ids)


def brute_mix(rows, seed=mixing.SEED, weights=mixing.WEIGHTS, most=mixing.MOST):
    sizes = defaultdict(list)
    for i, text, _, source in ((*r, None, None)[:4] for r in rows):
        sizes[source].append((len(words_of(text)), i))
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    size = {s: sum(x for x, _ in sizes[s]) for s in names}
    stopped, total = set(), sum(size.values())
    while True:
        free = [s for s in names if s not in stopped]
        level = (total - sum(most * size[s] for s in stopped)) / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > most * size[s]}
        if not over:
            return {s: most * size[s] if s in stopped else level * weight[s] for s in names}, size
        stopped |= over


def test_mixing(spark):
    rows = corpus(4)
    got = mixing.mix(docs(spark, rows), run_rows=5).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(docs(spark, rows), run_rows=5).collect()), key=str)
    targets, size = brute_mix(rows)
    taken, largest = Counter(), Counter()
    for r in got:
        assert r.target == pytest.approx(targets[r.source]) and r.source_size == size[r.source] and 0 <= r.copies <= 3
        taken[r.source] += r.copies * r["size"]
        largest[r.source] = max(largest[r.source], r["size"])
    assert len(got) == len(rows)
    for s, target in targets.items():
        assert abs(taken[s] - target) <= largest[s]
    assert sum(targets.values()) == pytest.approx(sum(size.values()))


def test_mixing_is_the_same_for_any_number_of_slices(spark):
    rows = [*corpus(4), *((5000 + i, "same size here", None, "a") for i in range(300))]
    found = [sorted(map(tuple, mixing.mix(docs(spark, rows).repartition(parts), run_rows=n).collect()), key=str) for parts, n in ((1, 10**6), (5, 7), (3, 500))]
    assert found[0] == found[1] == found[2] and len(found[0]) == len(rows)


def test_mixed_documents_follow_mix(spark):
    rows = [*corpus(4), *((1, f"word {i} " * 3, "en", "a") for i in range(20)), *((None, f"none {i}", "en", "ü") for i in range(9)), *((7, "equal rows", None, "b"),) * 5]
    frame = docs(spark, rows)
    got = mixing.mixed_documents(frame)
    assert got.columns == frame.columns
    found = [tuple(r) for r in got.collect()]
    assert sorted(found, key=str) == sorted(map(tuple, mixing.mixed_documents(frame.repartition(3)).collect()), key=str)
    words = Counter()
    for r in found:
        words[r[3]] += len(words_of(r[1]))
    targets, sizes = brute_mix(rows)
    for s, target in targets.items():
        assert abs(words[s] - target) <= max(len(words_of(r[1])) for r in rows if (*r, None, None)[3] == s)
    assert mixing.mixed_documents(docs(spark, [])).count() == 0


def test_mixing_of_nothing(spark):
    assert mixing.mix(docs(spark, [])).count() == 0
    assert [r.copies for r in mixing.mix(docs(spark, [(1, None), (2, "")])).collect()] == [0, 0]


def minimax(sizes, shards):
    best = {0: 0}
    total = [0, *itertools.accumulate(sizes)]
    best = [[None] * (len(sizes) + 1) for _ in range(shards + 1)]
    for n in range(len(sizes) + 1):
        best[1][n] = total[n]
    for k in range(2, shards + 1):
        for n in range(len(sizes) + 1):
            best[k][n] = min(max(best[k - 1][m], total[n] - total[m]) for m in range(n + 1))
    return best[shards][len(sizes)]


@pytest.mark.parametrize("shards,first_bits", [(1, 3), (4, 3), (7, 8), (40, 5)])
def test_minimax_cuts(spark, shards, first_bits):
    rng = random.Random(shards)
    for n, sizes in ((1, [9]), (30, [1, 2, 3, 7]), (400, [1, 2, 3, 7, 30]), (400, [5, 6, 5000])):
        keys = sorted({rng.randrange(-(2**63), 2**63) for _ in range(n)})
        groups = [(k, rng.choice(sizes[:2]) if rng.random() < 0.9 else rng.choice(sizes)) for k in keys]
        cuts = sharding.minimax_cuts(spark.createDataFrame(groups, "group long, bytes long"), shards, first_bits)
        assert len(cuts) < shards and sorted(set(cuts)) == cuts
        parts = [[s for k, s in groups if sum(c <= k for c in cuts) == j] for j in range(shards)]
        assert max(map(sum, parts)) == minimax([s for _, s in groups], shards)
        # But for single large groups, no shard is over the smallest capacity that does.
        def needs(capacity):
            used, fill = 0, 0
            for _, s in groups:
                if s > capacity or fill + s > capacity:
                    used, fill = used + (fill > 0) + (s > capacity), 0 if s > capacity else s
                else:
                    fill += s
            return used + (fill > 0)

        least = next(c for c in range(1, sum(s for _, s in groups) + 1) if needs(c) <= shards)
        assert max((sum(p) for p in parts if len(p) > 1), default=0) <= least


def test_shards(spark):
    rows = corpus(6) + [(2000 + i, "copy of one text") for i in range(150)]
    got = sharding.shard(docs(spark, rows), 5, run_rows=7).collect()
    assert sorted(map(str, got)) == sorted(map(str, sharding.shard(docs(spark, rows).repartition(3), 5).collect()))
    text = {i: t for i, t, *_ in rows}
    by_text, slots = defaultdict(set), defaultdict(list)
    import zlib

    for r in got:
        by_text[text[r.id]].add(r.shard)
        slots[r.shard].append(r.slot)
        raw = (text[r.id] or "").encode()
        assert (r["size"], r.text_crc32) == (len(raw) + 16, zlib.crc32(raw))
    assert all(len(s) == 1 for s in by_text.values()) and len(got) == len(rows)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(5))
    assert sharding.shard(docs(spark, []), 5).count() == 0


def test_base_counts_and_short_texts(spark):
    rows = corpus(8) + [(3000, "a b\n\na b\nc\nc\nc " + "$#|" * 5), (3001, "z\n" * 60)]
    got = {r.id: r for r in divergence.judge(docs(spark, rows)).collect()}
    assert len(got) == len(rows)
    for i, text, *_ in rows:
        text = text or ""
        w = words_of(text)
        grams = list(zip(w, w[1:], w[2:], strict=False))
        n = Counter(grams)
        lines = [x for x in text.split("\n") if words_of(x)]
        repeat = len({k + j for k, g in enumerate(grams) if n[g] > 1 for j in range(3)})
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), repeat)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(w) < 50 or 100 * repeat > 50 * len(w))
        assert not (r.base_failed and r.kept)
    assert divergence.judge(docs(spark, [])).count() == 0


def test_divergence_drops_symbol_junk_and_keeps_prose(spark):
    rng = random.Random(9)
    vocab = ["the", "of", "and", *("".join(rng.choices("abcdefgh", k=5)) for _ in range(300))]
    rows = [(i, " ".join(rng.choices(vocab, weights=[60, 30, 20, *[1] * 300], k=150)), "en") for i in range(40)]
    rows.append((99, " ".join(w + "$$##" for w in rng.choices(vocab, k=150)), "en"))
    kept = {r.id: r.kept for r in divergence.judge(docs(spark, rows)).collect()}
    assert [k for k, v in kept.items() if not v] == [99]


def brute_repeats(rows, length):
    least, out = {}, {}
    split = [(i, words_of(t)) for i, t, *_ in rows]
    for i, w in split:
        for k in range(len(w) - length + 1):
            key = tuple(w[k : k + length])
            if i is not None:
                least[key] = min(least.get(key, i), i)
    for n, (i, w) in enumerate(split):
        gone = {k + j for k in range(len(w) - length + 1) if i is not None and least[tuple(w[k : k + length])] < i for j in range(length)}
        out[n] = (i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return sorted(out.values(), key=str)


@pytest.mark.parametrize("length,gram", [(13, 5), (6, 3)])
def test_substrings(spark, length, gram):
    twice = " ".join(f"t{i}" for i in range(40))
    rows = corpus(10, 80) + [(500, "p q r s t u v w x y z a b c d"), (500, "other text under the same id"), (501, twice), (501, twice), (600, "q " + twice), (601, twice + " q")]
    for parts in (1, 7):
        found = substrings.remove_repeats(docs(spark, rows).repartition(parts), length, gram, keep=("source", "id"))
        assert sorted(((r.id, r.n_words, r.n_removed, r.kept_text) for r in found.collect()), key=str) == brute_repeats(rows, length)
    assert substrings.remove_repeats(docs(spark, [])).count() == 0


def test_maximal_repeats_extend_and_cover(spark):
    rows = corpus(10, 80)
    split = {i: words_of(t) for i, t, *_ in rows if i is not None}
    found = substrings.maximal_repeats(docs(spark, rows).repartition(5), 6, 3).collect()
    gone = defaultdict(set)
    for r in found:
        own, theirs = split[r.id], split[r.src]
        assert r.src < r.id and r.n_words >= 6 and own[r.start : r.start + r.n_words] == theirs[r.src_start : r.src_start + r.n_words]
        gone[r.id] |= set(range(r.start, r.start + r.n_words))
    want = {i: n for i, _, n, _ in brute_repeats(rows, 6)}
    assert {i: len(g) for i, g in gone.items()} == {i: n for i, n in want.items() if n}
    copy, first = 1005, min(i for i, t in split.items() if t == split[1005])
    assert any(r.id == copy and r.src == first and (r.start, r.n_words) == (0, len(split[copy])) for r in found) or len(split[copy]) < 6
    assert substrings.maximal_repeats(docs(spark, [])).count() == 0


def test_seeds_hold_little_beside_the_batch():
    """pipeline: texts are hashed in small pieces, and rows are answered long before they take hundreds of MB."""
    import tracemalloc

    import pyarrow as pa

    texts = [" ".join(f"w{i}x{k}" for k in range(250)) for i in range(2000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(2000)), pa.array(texts)], ["id", "body"])
    tracemalloc.start()
    try:
        n_rows = sum(b.num_rows for b in substrings.tidy(substrings._seeds(13, 5))(iter([batch])))
        held = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert n_rows > 20_000
    assert held < 60 << 20 and substrings.HELD_ROWS <= 1_000_000


def test_lines_that_one_document_repeats(spark):
    line = "one two three four five six seven "
    rows = [(1, line * 50), (2, "x y " + line * 30 + "z"), (3, line * 3), (0, "a b c one two three"), (4, "w " * 200), (5, "v " + "w " * 300)]
    for parts in (1, 4):
        found = substrings.remove_repeats(docs(spark, rows).repartition(parts), 6, 3)
        assert sorted(((r.id, r.n_words, r.n_removed, r.kept_text) for r in found.collect()), key=str) == brute_repeats(rows, 6)


def test_substrings_compare_words_not_hashes(spark, monkeypatch):
    """All windows hash alike: then only runs whose words are truly the source's may go."""
    import numpy as np

    monkeypatch.setattr(substrings, "gram_hashes", lambda hashes, n, salt: np.zeros(max(0, len(hashes) - n + 1), np.uint64))
    text = {0: "a b c d e f g", 1: "h i j k l m n", 2: "a b c d e f g", 3: "o p a b c d e f"}
    found = {r.id: r.kept_text for r in substrings.remove_repeats(docs(spark, text.items()), 6, 3).collect()}
    assert found[0] == text[0] and found[1] == text[1]
    assert all(found[k] == text[k] or set(text[k].split()) - set(found[k].split()) <= set("abcdefg") for k in (2, 3))


def test_words_of_any_length_hash_by_their_bytes():
    import numpy as np
    import pyarrow as pa

    from tracewright.llm.common import words

    long = ["x" * 600, "x" * 601, "x" * 300 + "y" + "x" * 299, "ab" * 400, "ba" * 400]
    texts = ["a b a", None, "", " \t", *long, " ".join(long), "ab ba aab"]
    hashes, spans, first = words(pa.array(texts))
    seen = {}
    for text, a, b in zip(texts, first, first[1:], strict=False):
        w = words_of(text)
        assert len(w) == b - a
        for word, h in zip(w, hashes[a:b].tolist(), strict=True):
            assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen) and len(spans) == len(hashes) and hashes.dtype == np.uint64


def brute_signatures(text):
    bare = [b for w in (text or "").encode().split() if (b := w.decode().lower().encode().strip(spotsigs._STRIP))]
    out = set()
    for i, w in enumerate(bare):
        if w.decode() in spotsigs.ANCHORS:
            chain = [x for x in bare[i + 1 :] if x.decode() not in spotsigs.ANCHORS][: spotsigs.CHAIN]
            if len(chain) == spotsigs.CHAIN:
                out.add((w, *chain))
    return out


def test_spotsigs(spark):
    rows = [r for r in corpus(11) if r[0] is not None]
    order = sorted(rows, key=lambda r: -r[0])
    for block_rows in (7, 4000):
        beside = spotsigs.beside_next(docs(spark, rows), block_rows=block_rows)
        assert beside.filter("not lead").count() == len(rows)
    got = {r.id: r for r in spotsigs.compare_with_next(docs(spark, rows)).collect()}
    for k, (i, text, *_) in enumerate(order):
        text, following = text or "", order[(k + 1) % len(order)][1] or ""
        edited = text[: len(text) - len(text) // 3] + following[: len(text) // 3]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        a, b = brute_signatures(text), brute_signatures(following)
        if a and b:
            assert r.near_next == pytest.approx(len(a & b) / len(a | b))
    assert got[1004].fingerprint == got[1005].fingerprint and spotsigs.compare_with_next(docs(spark, [])).count() == 0


def brute_sets(text):
    """The signature set of a text, or its word sequence where it has no signature."""
    bare = [b for w in (text or "").encode().split() if (b := w.decode().lower().encode().strip(spotsigs._STRIP))]
    return frozenset(brute_signatures(text)) or frozenset([(b"", *bare)])


def test_spotsigs_fingerprints_and_edits_against_brute_force(spark):
    rows = [*(r for r in corpus(15) if r[0] is not None), (2000, "the cat sat. The dog"), (2001, "THE cat, sat the dog!"), (2002, "the the the"), (2003, "é" * 7)]
    order = sorted(rows, key=lambda r: -r[0])
    got = {r.id: r for r in spotsigs.compare_with_next(docs(spark, rows)).collect()}
    named = {}
    for k, (i, text, *_) in enumerate(order):
        text, following = text or "", order[(k + 1) % len(order)][1] or ""
        edited = text[: len(text) - len(text) // 3] + following[: len(text) // 3]
        own, changed, after = map(brute_sets, (text, edited, following))
        r = got[i]
        assert r.near_edited == pytest.approx(len(own & changed) / len(own | changed))
        assert r.near_next == pytest.approx(len(own & after) / len(own | after))
        for name, found in ((r.fingerprint, own), (r.edited_fingerprint, changed)):
            assert named.setdefault(name, found) == found and name.startswith(f"{len(found)}-")
    assert len(set(named.values())) == len(named)


def test_spotsigs_of_rows_without_or_with_equal_ids(spark):
    rows = [(None, "the cat sat down"), (None, None), (5, "the dog ran off"), (5, "the dog ran off"), (9, "")]
    one, two = (sorted(map(str, spotsigs.compare_with_next(docs(spark, rows).repartition(n)).collect())) for n in (1, 4))
    assert one == two and len(one) == len(rows)
    _, pairs = spotsigs.similar_pairs(docs(spark, rows))
    members, none = spotsigs.similar_pairs(docs(spark, []))
    assert pairs.count() == members.count() == none.count() == 0


def test_spotsigs_pairs(spark):
    rows = [r for r in corpus(12, 80) if r[0] is not None]
    _, pairs = spotsigs.similar_pairs(docs(spark, rows), 0.5)
    sets = {r.fingerprint: set(r.signatures) for r in spotsigs.signature_sets(docs(spark, rows)).collect()}
    want = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if 2 * len(sets[a] & sets[b]) >= len(sets[a] | sets[b])}
    found = [(r.a, r.b) for r in pairs.collect()]
    assert set(found) == want and len(found) == len(want)


def test_language_profiles(spark, sf_dir):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    profiles = language_id.learn_profiles(table.filter(~language_id.held_out()))
    assert {k: len(v) for k, v in profiles.items()} == dict.fromkeys(("de", "en", "es", "fr"), 300)
    held = language_id.predict_language(table.filter(language_id.held_out()), profiles)
    assert held.filter("lang = lang_pred").count() / held.count() > 0.98
    odd = docs(spark, [(1, None), (2, ""), (3, "123 !?"), (4, "the"), (5, "the")])
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict_language(odd, profiles).collect()}
    assert [got[k] for k in (1, 2, 3)] == [("und", 0.0)] * 3 and got[4] == got[5] and got[4][0] != "und"
    assert language_id.learn_profiles(docs(spark, [])) == {}
    assert language_id.predict_language(docs(spark, [(1, "the")]), {}).first().lang_pred == "und"


def brute_grams(text):
    runs, grams = "".join(c if c.isalpha() else " " for c in text.lower()).split(), Counter()
    if not runs:
        return grams
    marked = "\x01" + "\x01".join(runs) + "\x01"
    for n in (1, 2, 3):
        for g in (marked[i : i + n] for i in range(len(marked) - n + 1)):
            if not (n == 1 and g == "\x01") and not (n == 3 and g[1] == "\x01"):
                grams[g] += 1
    return grams


def brute_key(gram):
    return sum(ord(c) << 21 * k for k, c in enumerate(reversed(gram)))


def test_language_query_against_brute_force(spark, sf_dir):
    import zlib

    table = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").collect()
    counts = defaultdict(Counter)
    for r in table:
        if r.lang is not None and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2:
            counts[r.lang].update(brute_grams(r.text))
    best = lambda c: sorted(c, key=lambda g: (-c[g], brute_key(g)))[: language_id.PROFILE_GRAMS]
    profiles = {k: {g: i for i, g in enumerate(best(c))} for k, c in counts.items()}
    got = {r.doc_id: r for r in language_id.op8_rank_order(spark, sf_dir).collect()}
    assert len(got) == len(table)
    for r in table:
        own, found = best(brute_grams(r.text or "")), got[r.doc_id]
        assert found.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        if not own:
            assert (found.lang_pred, found.score) == ("und", 0.0)
            continue
        far = {k: sum(abs(p[g] - i) if g in p else language_id.PROFILE_GRAMS for i, g in enumerate(own)) for k, p in profiles.items()}
        least = min(far, key=lambda k: (far[k], k))
        assert found.lang_pred == least and found.score == pytest.approx(1 - far[least] / (language_id.PROFILE_GRAMS * len(own)))


def test_texts_are_sent_to_the_profiles_once(spark):
    """pipeline: the text column that stays in the rows is the one that is read."""
    rows = docs(spark, [(1, "a b c", "en", "web"), (2, None, None, None)])
    known = language_id.learn_profiles(spark.createDataFrame([("the cat and the dog", "en")], "text string, lang string"))
    found = language_id.predict_language(rows, known)
    assert "__language_text" not in found._jdf.queryExecution().optimizedPlan().toString()
    other = language_id.predict_language(rows.select("doc_id", F.col("text").alias("body")), known, "body")
    assert sorted(map(tuple, found.select("doc_id", "lang_pred", "score").collect())) == sorted(map(tuple, other.select("doc_id", "lang_pred", "score").collect()))
    assert {r.body for r in other.collect()} == {"a b c", None}


def test_language_of_long_texts_and_empty_tables(spark):
    frame = docs(spark, [(1, "the cat and the dog " * 20_000, "en"), (2, "der hund und die katze " * 50, "de"), (2, "der hund und die katze " * 50, "de")])
    profiles = language_id.learn_profiles(frame)
    assert [r.lang_pred for r in language_id.predict_language(frame, profiles).orderBy("doc_id").collect()] == ["en", "de", "de"]
    none = language_id.predict_language(frame.limit(0), profiles)
    assert none.count() == 0 and none.columns == [*frame.columns, "lang_pred", "score"]


def test_out_of_place_distance_by_hand():
    profiles = {"x": [ord("a"), ord("b")], "y": [ord("b"), ord("c")]}
    found = language_id.Profiles(profiles, 4).predict("aa b")
    keys, counts = language_id.gram_counts("aa b")
    own = list(language_id.ranked(keys, counts, 4))
    far = {k: sum(abs(p.index(g) - r) if g in p else 4 for r, g in enumerate(own)) for k, p in profiles.items()}
    assert found == (min(far, key=lambda k: (far[k], k)), 1 - min(far.values()) / 16)


def test_chat_round_trip(spark):
    rng = random.Random(13)
    controls = chat_format.Template().controls
    text = lambda: "".join(rng.choices([*controls, "\\", "\n", "<", "[", "s>", "é🙂", "word "], k=rng.randint(0, 9)))
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool", None, "odd\nrole\\<s>"]), rng.choice([text(), None])) for c in [*range(40), None] for t in range(rng.randint(1, 6))]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, loss string")
    segments = chat_format.format_chat(frame)
    got = {r.conv_id: r for r in chat_format.read_back(segments).collect()}
    whole = defaultdict(str)
    for s in sorted(segments.collect(), key=lambda s: (s.conv_id is not None, s.conv_id or 0, s.turn_no, s.segment)):
        whole[s.conv_id] += s.text
    for conv, turns in itertools.groupby(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])), key=lambda r: r[0]):
        turns = list(turns)
        joined = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in turns)
        learnt = "".join(t or "" for _, _, r, t in turns if r == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256(joined.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
        assert r.formatted_chars == len(whole[conv])
        roles = [x or "" for _, _, x, _ in turns]
        allowed = chat_format.Template().follow
        assert r.in_order == all(b in allowed.get(a, ()) for a, b in zip(["", *roles], roles, strict=False))


def test_chat_of_nothing_and_of_clashing_columns(spark):
    schema = "conv_id long, turn long, role string, text string, segment string, loss int, in_order string, turn_no int, id long"
    frame = spark.createDataFrame([(1, 0, "user", "hi", "a", 1, "b", 2, 3), (1, 1, "assistant", "x" * 100_000, "a", 1, "b", 2, 3)], schema)
    got = chat_format.read_back(chat_format.format_chat(frame)).collect()
    assert [(r.n_turns, r.loss_chars, r.in_order) for r in got] == [(2, 100_000, True)]
    assert chat_format.read_back(chat_format.format_chat(frame.limit(0))).count() == 0


def test_pieces_of_repeated_rows_and_empty_tables(spark):
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    frame = docs(spark, [(1, "same words here"), (1, "same words here"), (2, None)])
    found = sentencepiece_codec.encode_decode(frame, path)
    assert found.columns == [*frame.columns, "ids", "decoded"]
    rows = found.orderBy("doc_id").collect()
    assert rows[0] == rows[1] and rows[2].ids == [] and rows[2].decoded == ""
    assert sentencepiece_codec.encode_decode(frame.limit(0), path).count() == 0


def test_pieces_of_a_batch_share_one_agenda(monkeypatch):
    """op2: the segments of a batch are merged together, as the library does, however few of them are remembered."""
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    with open(path, "rb") as f:
        codec = sentencepiece_codec.MergeCodec(f.read())
    rng = random.Random(5)
    words = ["".join(rng.choices("etaoinsé日🙂.,\n", k=rng.randint(1, 70))) for _ in range(400)]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 30))) for _ in range(60)] + [None, "", "x" * 500]
    monkeypatch.setattr(sentencepiece_codec, "CACHE_ENTRIES", 300)
    for some in (texts[:20], texts[20:], texts):
        ids, begins = codec.encode_batch(some)
        assert [ids[a:b].tolist() for a, b in zip(begins, begins[1:], strict=False)] == [library.encode(t or "") for t in some]
        assert codec.decode_batch(ids, begins) == [t or "" for t in some]
        assert max(map(len, codec.known)) <= sentencepiece_codec.CACHED_LENGTH and len(codec.ends) == len(codec.known) + 1
    assert codec.merge_all([])[0].size == 0


def test_texts_are_sent_to_the_codec_once(spark):
    """pipeline: a text column that stays in the rows is not copied beside itself on its way to Python."""
    import public_tokenizers

    frame = docs(spark, [(1, "same words here")])
    found = sentencepiece_codec.encode_decode(frame, public_tokenizers.path("piece_bpe_32k.model"))
    assert "__codec_text" not in found._jdf.queryExecution().analyzed().toString()
    ids = found.first().ids
    other = sentencepiece_codec.encode_decode(frame.withColumn("ids", F.col("text")), public_tokenizers.path("piece_bpe_32k.model"), "ids")
    assert other.columns == [*frame.columns, "ids", "decoded"] and other.first().ids == ids


def test_link_trust(spark):
    page = lambda i, url, *to: (i, url, "".join(f'<a href="{t}">x</a>' for t in to))
    rows = [
        page(1, "https://good.example.net/en/x?q", "https://friend.com/a"),
        page(2, "http://BAD.net/y", "http://other.com/"),
        page(3, "https://friend.com/z"),
        page(4, "https://suspect.io/z#f", "http://bad.net/1", "http://bad.net/2", "http://bad.net/1"),
        page(5, "https://lonely.io"),
        page(6, "no url"),
        (7, None, None),
        page(8, "https://a.example.com/de/x"),
        page(9, "https://notexample.com/de/x"),
        page(10, "https://x.org/fr/"),
        *(page(100 + i, f"https://plain{i}.io/") for i in range(30)),
    ]
    frame = spark.createDataFrame([(*r, "q") for r in rows], "page_id long, url string, html string, host string")
    got = {r.page_id: r for r in link_trust.judge_urls(frame).collect()}
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("good.example.net", "/en/x", "example.net/en/", "allow")
    assert (got[2].host, got[2].rule, got[2].verdict) == ("bad.net", "net/", "block")
    assert got[3].verdict == "allow" and got[3].trust > 0
    assert got[4].verdict == "block" and got[4].distrust > 0 and got[4].rule is None
    assert [(got[k].host, got[k].path, got[k].verdict) for k in (5, 6, 7)] == [("lonely.io", "", "allow"), ("", "", "allow"), ("", "", "allow")]
    assert got[8].rule == "example.com/de/" and got[9].rule is None and got[10].rule == "org/fr/"
    assert link_trust.judge_urls(frame.limit(0)).count() == 0


def test_link_trust_does_not_depend_on_how_links_are_dealt(spark):
    rng = random.Random(21)
    links = [(f"h{a}", f"h{b}", rng.randint(1, 3)) for a, b in {(rng.choice([0, 0, rng.randrange(30)]), rng.randrange(30)) for _ in range(120)} if a != b]
    seeds = [("allow", "h1", 2), ("allow", "h2", 1), ("block", "h3", 4), ("every", "h1", 1), ("every", "h0", 5)]
    totals = {"allow": 3, "block": 4, "every": 6}
    frames = spark.createDataFrame(links, "src string, dst string, n long"), spark.createDataFrame(seeds, "says string, host string, n long")
    found = [sorted(map(tuple, link_trust.propagate(*frames, totals, 6, run).filter("score > 0").collect())) for run in (4, 10, 1000)]
    want = defaultdict(int)
    for says, host, n in seeds:
        want[says, host] = n * (link_trust.UNITS // totals[says])
    first = dict(want)
    for _ in range(6):
        step = defaultdict(int, {k: v // 100 * 15 for k, v in first.items()})
        for says in totals:
            ways = [(a, b, n) if says == "allow" else (b, a, n) for a, b, n in links]
            out = Counter()
            for a, _, n in ways:
                out[a] += n
            for a, b, n in ways:
                step[says, b] += want[says, a] // 100 * 85 // out[a] * n
        want = step
    assert found[0] == found[1] == found[2]
    assert {(r[0], r[1]): r[2] for r in found[0] if r[2]} == {k: v for k, v in want.items() if v}


def test_link_trust_at_several_distances(spark):
    """Hosts one to four links away from a blocked one, beside a hub with more links than a small score has units of a
    few digits, against the same walks over whole numbers in Python."""
    page = lambda i, url, *to: (i, url, "".join(f'<a href="{t}">x</a>' for t in to))
    chain = [f"far{k}.io" for k in range(5)]
    rows = [page(1, "http://far0.net/"), page(2, f"http://{chain[1]}/", "http://far0.net/")]
    rows += [page(2 + k, f"http://{chain[k]}/", f"http://{chain[k - 1]}/") for k in range(2, 5)]
    rows += [page(50, "http://hub.io/", *(f"http://leaf{k}.io/" for k in range(300)), "http://far0.net/"), page(60, "http://x.example.net/en/", "http://far2.io/")]
    rows += [page(100 + k, f"http://leaf{k}.io/") for k in range(300)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.host: r for r in link_trust.judge_urls(frame).collect()}
    hosts = frame.select("page_id", link_trust.host_of(F.col("url")).alias("host"), "html")
    links = [(r.src, r.dst, r.n) for r in link_trust.host_links(hosts).collect()]
    names = [r.host for r in hosts.collect()]
    scores = {}
    for says, seeds in (("allow", ["x.example.net"]), ("block", ["far0.net"]), ("every", names)):
        ways = [(a, b, n) if says == "allow" else (b, a, n) for a, b, n in links]
        out, seed = Counter(), Counter({h: seeds.count(h) * (link_trust.UNITS // len(seeds)) for h in set(seeds)})
        for a, _, n in ways:
            out[a] += n
        score = Counter(seed)
        for _ in range(link_trust.STEPS):
            step = Counter({h: v // 100 * 15 for h, v in seed.items()})
            for a, b, n in ways:
                step[b] += score[a] // 100 * 85 // out[a] * n
            score = step
        scores[says] = score
    for host, r in got.items():
        t, d, e = (scores[says][host] for says in ("allow", "block", "every"))
        assert (r.trust, r.distrust, r.usual) == (t, d, e)
        assert r.rule or r.verdict == ("block" if d > t and d > e else "allow")
    assert got["far1.io"].distrust > got["far2.io"].distrust > got["far3.io"].distrust > got["far4.io"].distrust > 0
    # far2 is trusted, and so is what it links to; those that link to it are not.
    assert {k: got[f"far{k}.io"].verdict for k in range(1, 5)} == {1: "allow", 2: "allow", 3: "block", 4: "block"}
    assert got["leaf7.io"].verdict == "allow"


def test_owners_of_hosts(spark):
    rows = spark.createDataFrame([(i, f"http://{h}/", None) for i, h in enumerate(["a.b.co.uk", "b.co.uk", "c.co.uk", "x.y.com", "z.com.br.io"])], "page_id long, url string, html string")
    pages = rows.select("page_id", link_trust.host_of(F.col("url")).alias("host"), "html")
    found = {(r.src, r.dst) for r in link_trust.host_links(pages).collect()}
    assert found == {("a.b.co.uk", "b.co.uk"), ("b.co.uk", "a.b.co.uk"), ("x.y.com", "y.com"), ("y.com", "x.y.com"), ("z.com.br.io", "br.io"), ("br.io", "z.com.br.io")}


def test_link_trust_of_repeated_rows_and_long_pages(spark):
    long = "x" * 300_000 + '<a href="http://bad.net/">' + "y" * 300_000
    rows = [(1, "http://bad.net/a", None), (1, "http://bad.net/a", None), (2, "http://fan.io/", long), *((10 + i, f"http://p{i}.io/", "") for i in range(40))]
    got = link_trust.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == len(rows) and {r.verdict for r in got if r.page_id in (1, 2)} == {"block"}


def test_link_trust_blocks_an_unruled_page_among_blocked_ones(spark):
    urls = [*("http://bad.net/x",) * 30, "http://bets.example.com/de/1", "http://bets.example.com/de/2", "http://bets.example.com/en/3"]
    urls += [*("http://clean.example.com/",) * 5, *(f"http://plain{i}.io/" for i in range(60))]
    frame = spark.createDataFrame([(i, u, "") for i, u in enumerate(urls)], "page_id long, url string, html string")
    got = {r.page_id: (r.rule, r.verdict) for r in link_trust.judge_urls(frame).collect()}
    assert got[32] == (None, "block")
    assert {got[i] for i in range(33, len(urls))} == {(None, "allow")}


def test_pipeline(spark, sf_dir, monkeypatch):
    import corpus_pipeline

    rows = [r for r in corpus(14, 40) if r[0] is not None]
    frame = docs(spark, rows)
    out = corpus_pipeline.drop_near_duplicates(spark, frame, sf_dir)
    assert out.columns == list(corpus_pipeline.COLUMNS)
    ids = simhash.near_duplicates(frame).filter("id = component_id").select("id").distinct().count()
    assert out.count() == ids
    kept = corpus_pipeline.drop_repeats(spark, frame, sf_dir).collect()
    want = {i: (n, gone, text) for i, n, gone, text in brute_repeats(rows, 13)}
    text = {r[0]: r[1] for r in rows}
    assert {r.doc_id: r.text for r in kept} == {i: (t if gone else text[i] or "") for i, (n, gone, t) in want.items() if not gone or gone < n}
    final = corpus_pipeline.run(spark, sf_dir)
    assert final.filter("not round_trip").count() == 0 and final.count() > 0 and "ids" in final.columns
    copies = Counter(r.doc_id for r in final.select("doc_id").collect())
    assert max(copies.values()) <= 3


def edge_rows():
    return [
        (None, "the cat sat on the mat and ran", "en", "a"), (None, None, None, None), (1, None, "en", "a"), (2, "", "en", "b"), (3, "the cat and the dog were here", None, None),
        (3, "the cat and the dog were here", None, None), (3, "another text under one id", "en", "a"), (4, "the cat and the dog " * 8000, "en", "b"), (5, "12 34 !?", "en", "a"),
    ]


@pytest.mark.parametrize("stage", range(5))
def test_pipeline_stages_of_odd_rows(spark, sf_dir, stage, monkeypatch):
    import corpus_pipeline

    name, run = corpus_pipeline.STAGES[stage]
    monkeypatch.setattr(corpus_pipeline, "LEAST_LANGUAGE_SCORE", 0.0)
    frame = docs(spark, edge_rows())
    got = run(spark, frame, sf_dir).collect()
    again = run(spark, frame.repartition(5), sf_dir).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    texts = Counter((r.doc_id, r.text) for r in got)
    every = Counter((i, t) for i, t, *_ in edge_rows())
    if name == "language_id":
        assert texts == Counter({k: n for k, n in every.items() if k[1] and any(c.isalpha() for c in k[1])})
    elif name == "near_duplicates":
        assert sum(n for (i, _), n in texts.items() if i is None) == 2 and texts[1, None] == 1 and sum(n for (i, _), n in texts.items() if i == 3) == 1
    elif name == "substring_dedup":
        assert sum(texts.values()) == len(edge_rows()) and texts[3, "another text under one id"] == 1
    elif name == "mixing":
        assert max(texts.values()) <= 6 and set(texts) <= set(every)
    else:
        assert texts == every and all(r.round_trip for r in got)
    empty = run(spark, frame.limit(0), sf_dir)
    assert empty.count() == 0 and [f.name for f in empty.schema][:5] == list(corpus_pipeline.COLUMNS)


def test_pipeline_leaves_one_folder(spark, sf_dir):
    import os

    import corpus_pipeline

    folder = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(folder))
    out = corpus_pipeline.run(spark, sf_dir)
    new = [x for x in set(os.listdir(folder)) - before if x.startswith("corpus-pipeline")]
    assert len(new) == 1 and os.listdir(f"{folder}/{new[0]}") == ["3-mixing"] and out.count() > 0


def test_queries_match_their_sql(spark, sf_dir):
    import duckdb

    import tracewright.llm as llm

    con = duckdb.connect()
    for name in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    for name, sql in llm.oracle_sql().items():
        frame = llm.queries()[name](spark, sf_dir)
        result = con.execute(sql)
        columns = [d[0] for d in result.description]
        assert sorted(columns) == sorted(frame.columns)
        show = lambda rows: sorted(str([round(x, 6) if isinstance(x, float) else x for x in r]) for r in rows)
        assert show(frame.select(*columns).collect()) == show(result.fetchall()), name


def test_queries_have_the_stated_columns(spark, sf_dir):
    import tracewright.llm as llm

    want = {
        "op2": "doc_id n_tokens ids_sha256 decoded_sha256", "op6": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
        "op8": "doc_id held_out lang_pred score", "op10": "doc_id fingerprint component_id", "op4": "doc_id size text_crc32 law shard slot grown_shard",
        "op11": "doc_id n form prefix_chars middle_chars output_sha256 restored_sha256", "op12": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
        "op13": "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256",
    }
    queries = {k.split("_")[0]: v for k, v in llm.queries().items()}
    assert set(queries) == {f"op{i}" for i in range(1, 14)}
    for k, columns in want.items():
        assert set(columns.split()) <= set(queries[k](spark, sf_dir).columns)
    assert queries["op10"](spark, sf_dir).filter(F.length("fingerprint") != 16).count() == 0
