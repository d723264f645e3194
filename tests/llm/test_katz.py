import math
import random
import tracemalloc
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pandas as pd

from gridweave.llm import katz


def brute(docs, held):
    """The same model by dictionaries."""
    words = {i: [*(x.decode() for x in (t or "").encode().lower().split()), None] for i, t in enumerate(x[1] for x in docs)}
    train = [i for i, (d, _) in enumerate(docs) if not held(d)]
    uni = Counter(w for i in train for w in words[i])
    bi = Counter(p for i in train for p in zip(["<s>", *words[i]], words[i]))
    hist = Counter(v for v, _ in bi.elements())
    e = katz.Estimates({(g, r): n for g, c in (("w", uni), ("p", bi)) for r, n in [*Counter(c.values()).items()] if r <= katz.K + 1} | {("w", 0): sum(uni.values()), ("w", -1): len(uni)})
    disc = lambda c, d: c * (d[c] if c <= katz.K else 1)
    p1 = lambda w: disc(uni[w], e.dw) / (e.total + e.pseudo) if uni[w] else e.unknown
    seen = {}
    for (v, w), c in bi.items():
        seen.setdefault(v, []).append((w, c))

    def p2(v, w):
        if v not in seen:
            return p1(w)
        mass = sum(disc(c, e.dp) for _, c in seen[v])
        total = hist[v] + (mass >= hist[v])
        if bi[v, w]:
            return disc(bi[v, w], e.dp) / total
        return (total - mass) / total / (1 - sum(p1(x) for x, _ in seen[v])) * p1(w)

    return words, uni, p1, p2, e


def test_against_dictionaries_and_normalisation(spark, monkeypatch):
    monkeypatch.setattr(katz, "BATCH_TOKENS", 150)
    rng = random.Random(6)
    docs = [(i, " ".join(rng.choice("the The of a b c d e f".split() + [f"w{rng.randrange(60)}"]) for _ in range(rng.randint(0, 25)))) for i in range(120)]
    docs += [(500, None), (501, ""), (502, "unseen words only"), (503, "Q q\xa0q É \t\x0b x"), (503, "a"), (None, "a b")]
    held = lambda i: i is not None and i % 5 == 2
    df = spark.createDataFrame([(*d, 1.0) for d in docs], "doc_id long, text string, score double").repartition(3)
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 9), round(r.score, 9)) for r in katz.katz_scores(df, held).collect()), key=str)
    words, uni, p1, p2, e = brute(docs, held)
    want = []
    for i, (d, _) in enumerate(docs):
        w = words[i]
        base = sum(math.log10((uni[x] + 1) / (e.total + len(uni) + 1)) for x in w)
        want.append((d, held(d), len(w), sum(uni[x] > 0 for x in w), e.total, round(base, 9), round(sum(math.log10(p2(v, x)) for v, x in zip(["<s>", *w], w)), 9)))
    assert got == sorted(want, key=str)
    for v in ["<s>", "the", "w1", "never"]:
        assert abs(sum(p2(v, w) for w in uni) + p2(v, "?unknown?") - 1) < 1e-9
    assert abs(sum(map(p1, uni)) + e.unknown - 1) < 1e-9


def test_of_nothing(spark):
    assert katz.katz_scores(spark.createDataFrame([], "doc_id long, text string"), lambda i: False).count() == 0
    rows = katz.katz_scores(spark.createDataFrame([(2, "a b")], "doc_id long, text string"), lambda i: True).collect()
    assert rows[0].n_known == 0 and rows[0].train_tokens == 0 and rows[0].score == 0


def test_a_full_batch_and_its_blocks_are_small(spark):
    """An executor holds one for each core: the memory of a batch's n-grams, and the bytes of a key however many the buckets."""
    n = 100_000
    text = " ".join(map(str, np.random.default_rng(1).zipf(1.3, n - 1) % 50_000))
    df = spark.createDataFrame(pd.DataFrame({"doc_id": [1], "text": [text]}))
    r = SimpleNamespace(**katz.encode(df, lambda i: False).collect()[0].asDict())
    tracemalloc.start()
    b = katz.Batch(r, 1000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(b.tokens) == n and peak / n * katz.BATCH_TOKENS < 100e6
    blocks = list(b.places("p"))
    assert sorted(np.concatenate([at for _, at in blocks]).tolist()) == list(range(len(b.v)))
    # the upper bytes of the differences are empty
    assert sum((np.diff(b.keys["p"][at]) >> np.uint64(48) > 12).sum() for _, at in blocks) < len(b.v) / 100
    keys = np.sort(b.keys["p"])
    assert (katz.keys_of(katz.pack_keys(keys)) == keys).all() and len(katz.pack_keys(keys)) < 6.7 * len(keys)
