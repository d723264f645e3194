import random

from gridweave.llm import neardup
from gridweave.llm.components import components


def shingles(t, width):
    w = (t or "").encode().lower().split()
    return {tuple(w[i : i + width]) for i in range(max(len(w) - width, 0) + 1)} if w else set()


def brute(docs, width, percent):
    sets = [shingles(t, width) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(docs, sets, strict=True))), key=str)


def test_classes_equal_brute_force(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    docs, n = [], 0
    for size in [1] * 20 + [2] * 8 + [5, 9, 70]:
        base = [word() for _ in range(rng.randint(40, 90))]
        for _ in range(size):
            t = list(base)
            for _ in range(rng.randint(0, 3)):
                t[rng.randrange(len(t))] = word()
            docs.append((n, " ".join(t)))
            n += 1
    passage = " ".join(word() for _ in range(50))
    docs += [(n + i, passage + " " + " ".join(word() for _ in range(40))) for i in range(30)]
    docs += [(1000, None), (1001, ""), (1002, "a b"), (1003, "A  b"), (1004, "same text here again now"), (1004, "same text here again now"), (None, docs[0][1])]
    rng.shuffle(docs)
    got = neardup.classes(spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, sid string, n int").repartition(3), 4, 80).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(docs, 4, 80)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)


def test_of_nothing(spark):
    assert neardup.classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(100 + rng.randrange(60), 100 + rng.randrange(60)) for _ in range(40)] + [(None, 1), (7, 7)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        if a is not None:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}


def test_few_edges_take_one_task_and_many_the_same_result(spark, monkeypatch):
    from gridweave.llm import components as module, neardup as user

    rng, writes, stored = random.Random(5), [], module.stored
    edges = [(i, i + 1) for i in range(300)] + [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(250)] + [(2**62 - i, -i) for i in range(5)] + [(None, 3)]
    edges = [tuple(rng.sample(e, 2)) for e in edges]
    frame = spark.createDataFrame(edges, "a long, b long")
    monkeypatch.setattr(module, "stored", lambda df, path, *by: writes.append(path) or stored(df, path, *by))
    here = {(r.node, r.root) for r in components(frame).collect()}
    assert len(writes) == 2  # the edges and the result, not two tables a round
    monkeypatch.setattr(module, "FEW", -1)
    assert here == {(r.node, r.root) for r in components(frame).collect()} and len(writes) > 8
    monkeypatch.setattr(module, "FEW", 400)  # rounds until so few are left
    assert here == {(r.node, r.root) for r in user.components(frame).collect()}


def test_no_edges_no_components(spark):
    assert components(spark.createDataFrame([(1, 1), (None, 2)], "a long, b long")).count() == 0


def test_rechecked_finds_every_link_across_classes(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(neardup, "BLOCK", 7)
    rng = random.Random(12)
    base = rng.sample(range(1, 10**6), 60)
    sets = {}
    for i in range(60):
        s = set(base)
        for _ in range(rng.randint(0, 14)):
            s.discard(rng.choice(base))
            s.add(rng.randrange(10**6, 10**7))
        sets[i] = s
    main = {i: 0 for i in range(40)}
    odd = [(0, i, i) for i in range(40, 60)]
    table = spark.createDataFrame([(i, bytearray(np.array(sorted(s), np.uint64).tobytes())) for i, s in sets.items()], "sid long, s binary")
    labels = spark.createDataFrame([(i, 0) for i in main if i], "node long, root long")
    got = {(r.a, r.b) for r in neardup.rechecked(spark.createDataFrame(odd, "main long, a long, root long"), labels, table, 80).collect()}
    close = lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    want = {(0, i) for _, i, _ in odd if any(close(i, j) for j in main)} | {(i, j) for _, i, _ in odd for _, j, _ in odd if i < j and close(i, j)}
    assert got == want and want


def test_large_regions_reach_over_partition_borders(spark, tmp_path):
    sig = bytes(range(128)) * 4
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n, partitions in ((30, 7), (22, 9), (40, 5)):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            reps = spark.createDataFrame([(i, i, bytearray(sig)) for i in range(n)], "sid long, doc_id long, sig binary")
            _, large = neardup.candidates(reps, f"{tmp_path}/{n}")
            assert large.count() == neardup.TREES * n
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_the_driver_gives_free_memory_back_after_each_stored_table(spark, monkeypatch, tmp_path):
    from gridweave.llm import common

    said, trim = [], common.trim
    monkeypatch.setattr(common, "trim", lambda s: said.append(trim(s)))
    assert common.stored(spark.range(3), str(tmp_path / "t")).count() == 3
    assert len(said) == 1 and (said[0] is None or "rim" in said[0])
