"""The pipeline against plain Python on a small corpus: who stays after each stage, and what is packed."""

import random

import corpus_pipeline as cp
import public_tokenizers
from test_decontaminate import brute as leaks
from test_neardup import brute as classes
from tokenizers import Tokenizer


def test_stages(spark, tmp_path):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdeiourst") for _ in range(rng.randint(2, 8)))
    texts, labels = [], []
    for i in range(360):
        w, bad, toxic = [word() for _ in range(rng.randint(30, 70))], rng.random() < 0.2, rng.random() < 0.2
        if toxic:
            w[rng.randrange(len(w))] = rng.choice(["grumph", "zorkling"])
        if bad:
            w = [x.upper() + "!!" for x in w]
        texts.append(" ".join(w))
        labels.append((i, int(not bad), int(toxic)))
    items = [(k, " ".join(word() for _ in range(14))) for k in range(4)]
    for k in range(40):  # copies, near copies and leaks of clean texts
        base = texts[k].split()
        texts.append(" ".join(base[:-1] + ["other"]) if k % 2 else texts[k])
        texts.append(" ".join([word() for _ in range(30)] + items[k % 4][1].split()[: 14 if k % 3 else 9]))
    docs = [(i, t, rng.choice(["en", "de"]), f"src{i % 5}", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    sf = str(tmp_path)
    now = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = now.columns, []
    for k, (_, stage) in enumerate(cp.STAGES[:4]):
        out = stage(spark, now, sf)
        assert out.columns == columns
        out.write.parquet(f"{sf}/stage-{k}")
        now = spark.read.parquet(f"{sf}/stage-{k}")
        kept.append({r.doc_id for r in now.collect()})
    every = {i for i, *_ in docs}
    truth = {i: (q, t) for i, q, t in labels}
    assert sum((i in kept[0]) == truth[i][0] for i in truth) / len(truth) > 0.97
    after = [i for i in truth if i in kept[0]]
    assert sum((i in kept[1]) != truth[i][1] for i in after) / len(after) > 0.95
    left = [(i, texts[i]) for i in sorted(kept[1])]
    assert kept[2] == {c for _, _, c in classes(left, 5, 80)}
    assert kept[3] == {i for i in kept[2] if not leaks([(i, texts[i])], items, 10)[i][0][4]}
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    packed = cp.STAGES[4][1](spark, now, sf).collect()
    assert {r.doc_id for r in packed} == kept[3] and every > kept[3]
    assert sum(r.length for r in packed) == sum(len(whole.encode(texts[i], add_special_tokens=False).ids) + 1 for i in kept[3])
