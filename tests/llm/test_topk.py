import random

import numpy as np

from gridweave.llm.topk import Index, top_k


def test_search_is_a_superset_of_the_best():
    rng = np.random.default_rng(1)
    for n, wide, top in ((400, 8, 300), (200, 3, 4), (1, 2, 50), (300, 16, 2000)):
        rows = rng.integers(-top, top, (n, wide))
        rows[: n // 3] = rows[0]
        index = Index(np.arange(n), rows)
        for i in range(0, n, 7):
            places, scores = index.search(rows[i], i, 5)
            want = sorted((-int(s), j) for j, s in enumerate(rows @ rows[i]) if j != i)[:5]
            assert sorted(zip((-scores).tolist(), places.tolist(), strict=True))[:5] == want


def test_against_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(6)]) for i in range(150)] + [(i, [0.5] * 6) for i in range(150, 220)]
    rows += [(1000, None), (1050, [1.0, float("nan")]), (1100, [float("inf")] * 6), (1150, [None] * 6), (1200, []), (1250, [2.0]), (None, [1.0] * 6)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<double>, score int").repartition(4)
    got = [tuple(r) for r in top_k(df, df.where("vec_id % 50 = 0"), 5, 64).orderBy("query_id", "rank").collect()]
    vec = {i: [int(np.floor(256 * x)) for x in v] + [0] * (6 - len(v)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    want = []
    for q in sorted(i for i in vec if i % 50 == 0):
        best = sorted((-sum(a * b for a, b in zip(vec[q], vec[i], strict=True)), i) for i in vec if i != q)[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == want


def test_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert top_k(df, df).count() == 0


def test_rows_of_a_segment_lie_side_by_side():
    rng = np.random.default_rng(3)
    rows = rng.integers(-100, 100, (500, 7))
    index = Index(np.arange(500), rows)
    assert index.order.flags.c_contiguous
    for d, level, s, e in zip(index.dims, index.levels, index.starts, index.stops, strict=True):
        assert sorted(index.order[d, s:e]) == np.flatnonzero(rows[:, d] >> 3 == level).tolist()
