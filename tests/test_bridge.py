"""Bridging by search gives the lines that all pairs give."""

import numpy as np
import pytest

from gridweave.operators import graph


@pytest.mark.parametrize("seed", [1, 2])
def test_search_equals_all_pairs(spark, seed):
    rng = np.random.default_rng(seed)
    # on a coarse grid, so that many distances are equal; some places are unknown
    buses = [(int(i * 3), None if i % 17 == 0 else 33 + float(rng.integers(0, 40)) / 10, 130 + float(rng.integers(0, 40)) / 10) for i in range(160)]
    edges = [(int(a) * 3, int(b) * 3) for a, b in rng.integers(0, 160, (90, 2))]
    b, e = spark.createDataFrame(buses, "id long, lat double, lon double"), spark.createDataFrame(edges, "a long, b long")
    for km in (12.0, 150.0):
        assert sorted(graph.bridge(b, e, km).collect()) == sorted(graph._bridge_pairs(b, e, km).collect())


def test_no_pair_is_stored(spark, monkeypatch):
    from gridweave.operators import spatial

    monkeypatch.setattr(spatial, "within_km", lambda *a, **k: pytest.fail("all pairs"))
    b = spark.createDataFrame([(i, 35.0 + i * 0.1, 135.0) for i in range(8)], "id long, lat double, lon double")
    e = spark.createDataFrame([(0, 1)], "a long, b long")
    assert graph.bridge(b, e, 50.0).count() == 6
    assert graph.bridge(b.limit(0), e, 50.0).columns == ["a", "b", "km"]
