"""Searches around points: the same as brute force, without meeting every pair."""

import os

import numpy as np
import pytest

from gridweave.kernels import places as K
from gridweave.operators import spatial
from gridweave.plans import catalogue

SF = "/root/testdata/sf0.001"
#: Queries whose rows must not be multiplied by the cells around them.
SEARCHED = ["nearest_haversine_50km", "line_endpoint_matching", "endpoint_graph", "endpoint_naming", "voltage_infer_range_max", "capacity_by_region_voltage", "fill_from_nearest", "nearest_planar"]


def points(kind, rng, n):
    if kind == "land":
        return rng.uniform(33, 37, n), rng.uniform(130, 134, n)
    if kind == "globe":
        return rng.uniform(-90, 90, n), rng.uniform(-180, 180, n)
    if kind == "dateline":
        return rng.normal(0, 0.01, n), np.abs(rng.normal(0, 0.5, n)) * rng.choice([-1, 1], n) + 180 * rng.choice([-1, 1], n)
    if kind == "grid":  # many ties
        return 33 + rng.integers(0, 30, n) / 1e3, 130 + rng.integers(0, 30, n) / 1e3
    return np.where(rng.random(n) < 0.1, np.nan, rng.uniform(33, 34, n)), rng.uniform(130, 131, n)


@pytest.mark.parametrize("kind", ["land", "globe", "dateline", "grid", "nulls"])
@pytest.mark.parametrize("metric", ["haversine", "planar"])
def test_search_equals_brute_force(kind, metric):
    rng = np.random.default_rng(3)
    p = K.Places(*points(kind, rng, 400), metric)
    lat, lon = points(kind, rng, 300)
    for km in (5.0, 50.0, 1500.0):
        d = K.distance(metric, lat[:, None], lon[:, None], p.lat, p.lon)
        near = d <= km
        d[~near] = np.inf
        assert (p.nearest(lat, lon, km)[0] == np.where(near.any(1), d.argmin(1), -1)).all()
        assert (p.largest(lat, lon, km) == np.where(near.any(1), near.argmax(1), -1)).all()


def test_few_pairs_among_many_places(monkeypatch):
    """Nearest within 50 km among 60 000 places: tens of pairs a row, where its cells hold thousands."""
    met, plain = [], K.distance
    monkeypatch.setattr(K, "distance", lambda m, a, b, c, d: met.append(len(a)) or plain(m, a, b, c, d))
    rng = np.random.default_rng(4)
    p = K.Places(*points("land", rng, 60_000))
    p.nearest(*points("land", rng, 5_000), 50.0)
    assert sum(met) < 60 * 5_000


@pytest.mark.parametrize("metric", ["haversine", "planar"])
def test_too_many_places_for_a_task_are_dealt(spark, monkeypatch, metric):
    rng = np.random.default_rng(5)
    left = spark.createDataFrame([(int(i), float(a), float(b)) for i, (a, b) in enumerate(zip(*points("land", rng, 300), strict=True))], "k long, llat double, llon double")
    right = spark.createDataFrame([(int(i), float(i % 7), float(a), float(b)) for i, (a, b) in enumerate(zip(*points("land", rng, 250), strict=True))], "o long, kv double, rlat double, rlon double")
    run = lambda: (sorted(spatial.nearest(left, "k", right, "o", 30.0, metric).collect()), sorted(spatial.largest_within(left, "k", right, "kv", 30.0, metric).collect()))
    want = run()
    monkeypatch.setattr(spatial, "PLACES", 60)
    monkeypatch.setattr(spatial, "GROUP", 40)
    assert run() == want and all(want)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", SEARCHED)
def test_no_row_is_repeated_for_its_cells(spark, name):
    assert "Generate" not in catalogue.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
