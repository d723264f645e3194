import hashlib
import random
import re

from gridweave.llm.decontaminate import decontaminate, proximity_matches

BREAK = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(t):
    return BREAK.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items, size):
    out = {}
    for d, t in docs:
        w, hit, ids = words(t), set(), set()
        for i, x in items:
            v = words(x)
            for p in [v[k : k + size] for k in range(max(len(v) - size, 0) + 1)] if v else []:
                for s in range(len(w) - len(p) + 1):
                    if w[s : s + len(p)] == p:
                        hit |= set(range(s, s + len(p)))
                        ids.add(str(i))
        out.setdefault(d, []).append((len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return out


def test_against_brute_force(spark):
    rng = random.Random(5)
    vocabulary = ["a", "b", "C", "É", "d1", "e"]
    text = lambda n: rng.choice([" ", ". ", "-"]).join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.randint(1, 7))) for i in range(12)] + [(99, None), (98, "..."), (97, "zzz a"), (3, "a a a a")]
    docs = [(i, text(rng.randint(0, 60))) for i in range(60)] + [(100, None), (101, ""), (102, "a b " * 2000), (102, "a b " * 2000), (None, items[0][1])]
    got = {}
    for r in decontaminate(spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, n int").repartition(3), spark.createDataFrame(items, "item_id long, text string"), 5).collect():
        got.setdefault(r.doc_id, []).append(tuple(r)[1:])
    assert got == brute(docs, items, 5)


def test_no_items_and_no_documents(spark):
    docs, items = "doc_id long, text string", "item_id long, text string"
    assert decontaminate(spark.createDataFrame([], docs), spark.createDataFrame([(1, "a b")], items)).count() == 0
    assert [tuple(r)[1:4] for r in decontaminate(spark.createDataFrame([(1, "a b")], docs), spark.createDataFrame([], items)).collect()] == [(2, 0, 0)]


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "x the quick y brown fox z"), (2, "fox z z z brown z z quick"), (3, "brown quick fox"), (4, None)], "doc_id long, text string")
    items = spark.createDataFrame([(7, "quick brown fox")], "item_id long, text string")
    assert sorted(r.doc_id for r in proximity_matches(docs, items, 1).collect()) == [1, 3]
