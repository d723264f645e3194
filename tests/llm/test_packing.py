import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from gridweave.llm.packing import SegmentTree, best_fit_plan, encoder, pack


def brute_best_fit(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = [r for r in rooms if r >= n]
        if fit:
            rooms.remove(min(fit))
            rooms.append(min(fit) - n)
        else:
            rooms.append(capacity - n)
    return sorted(rooms)


def test_segment_tree_finds_the_tightest():
    tree, rng, have = SegmentTree(50), random.Random(1), Counter()
    for _ in range(500):
        c = rng.randint(0, 50)
        if have[c] and rng.random() < 0.5:
            have[c] -= 1
            tree.add(c, -1)
        else:
            have[c] += 1
            tree.add(c, 1)
        least = rng.randint(0, 50)
        assert tree.tightest(least) == min((x for x in have if have[x] and x >= least), default=-1)


def test_plan_equals_piece_by_piece_best_fit():
    rng = random.Random(2)
    for _ in range(60):
        capacity = rng.randint(1, 60)
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 200))]
        runs, sequences = best_fit_plan(Counter(lengths), capacity)
        used = Counter()
        for length, _, n, first, each, _ in runs.tolist():
            for i in range(n):
                used[first + i // each] += length
        assert sorted(capacity - v for v in used.values()) == brute_best_fit(lengths, capacity)
        assert sequences == len(used)


def test_cached_encoding_equals_the_tokenizer():
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    fast = encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    for text in ("", " ", "a", " a b", "a  b", "a \n b\n\nc ", "it's 12 o'clock -- née x　y", "x\x1cy z\x85 w", "tab\tb c"):
        assert np.frombuffer(fast(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, text


def test_pack_is_whole_and_gapless(spark):
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [None, "", "a b", "a b", "é" * 40, "word " * 300 + "end"] + [f"document {i} " * (i % 9) for i in range(60)]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, piece int").repartition(3)
    rows = pack(df, 64).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(range(len(texts)))
    for i, t in enumerate(texts):
        ids = whole.encode(t or "", add_special_tokens=False).ids + [0]
        parts = sorted(by_doc[i], key=lambda r: r.piece)
        assert [p.piece for p in parts] == list(range(-(-len(ids) // 64)))
        at = 0
        for p in parts:
            assert p.start == at and p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids) and all(p.length == 64 for p in parts[1:])
    for seq in by_seq.values():
        at = 0
        for r in sorted(seq, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64
    assert sorted(64 - sum(r.length for r in s) for s in by_seq.values()) == brute_best_fit([r.length for r in rows], 64)


def test_pack_of_nothing(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_added_tokens_equal_the_tokenizer(spark):
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    end = "<|endoftext|>"
    texts = [end, f"a{end}b", f"a {end} b", f"{end}{end} x", f"one two{end}\n\nthree  four {end}", "<|endoftext| >", f"x\t{end}{end}y z"]
    rows = pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 64).collect()
    got = {r.doc_id: (r.length, r.ids_crc32) for r in rows}
    for i, t in enumerate(texts):
        ids = whole.encode(t, add_special_tokens=False).ids + [0]
        assert got[i] == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), t
