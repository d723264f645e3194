import math
import random

from pyspark.sql import functions as F

from gridweave.functions import geo, scalars as S
from gridweave.operators import commitment as C, graph, relational as R
from gridweave.operators.spatial import nearest
from gridweave.sources import readers, sinks


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x"))).first()[0]


def test_voltages_and_capacities(spark):
    assert [one(spark, v, S.voltage_first) for v in ("500000", "275000;66000", "yes", "", None, "66", "-1")] == [500.0, 275.0, None, None, None, 66.0, None]
    assert [one(spark, v, S.voltage_max) for v in ("77000,6600", "dc250000", "x", "66")] == [77.0, 250.0, None, 0.066]
    assert [one(spark, v, S.capacity_mw) for v in ("1.5 GW", "20MW", "500 kW", "2000000", "12", "n/a")] == [1500.0, 20.0, 0.5, 2.0, 12.0, None]
    assert [one(spark, v, S.exact_class, "double") for v in (66.5, 154.2, 0.0)] == [66, 154, 0]


def test_nearest_equals_brute_force(spark):
    rng = random.Random(1)
    a = [(i, rng.uniform(30, 45), rng.uniform(130, 145)) for i in range(120)]
    b = [(i, rng.uniform(30, 45), rng.uniform(130, 145)) for i in range(80)]
    left, right = spark.createDataFrame(a, "k long, llat double, llon double"), spark.createDataFrame(b, "o long, rlat double, rlon double")
    got = {r.k: (r.o, r.km) for r in nearest(left, "k", right, "o", 90.0).collect()}

    def km(p, q):
        f1, f2 = math.radians(p[1]), math.radians(q[1])
        h = math.sin((f2 - f1) / 2) ** 2 + math.cos(f1) * math.cos(f2) * math.sin(math.radians(q[2] - p[2]) / 2) ** 2
        return round(2 * 6371 * math.atan2(math.sqrt(h), math.sqrt(1 - h)), 6)

    want = {}
    for p in a:
        d, o = min((km(p, q), q[0]) for q in b)
        if d <= 90:
            want[p[0]] = o
    assert {k: v[0] for k, v in got.items()} == want


def test_simplify_keeps_corners():
    assert geo.simplify([(0, 0), (1, 0.00001), (2, 0), (2, 5)], 0.01) == [0, 2, 3]
    assert geo.simplify([], 1) == [] and geo.simplify([(0, 0)], 1) == [0]


def test_components_and_bridge(spark):
    buses = spark.createDataFrame([(i, 35.0 + i * 0.1, 135.0) for i in range(8)], "id long, lat double, lon double")
    edges = spark.createDataFrame([(0, 1), (1, 2), (4, 5), (6, 6)], "a long, b long")
    c = graph.connected_components(buses.select("id"), edges)
    assert {r.id: r.component for r in c.collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 5: 4, 6: 6, 7: 7}
    new = graph.bridge(buses, edges, 50.0).select("a", "b")
    joined = graph.connected_components(buses.select("id"), edges.union(new))
    assert {r.component for r in joined.collect()} == {0}


def test_upsert_and_delete(spark):
    t = spark.createDataFrame([(1, 5.0, "a"), (2, 6.0, "b")], "id long, kv double, zone string")
    n = spark.createDataFrame([(2, None, "z", True, False), (3, 7.0, "c", True, True)], "id long, kv double, zone string, has_kv boolean, has_zone boolean")
    got = sorted(tuple(r) for r in R.upserted(t, n, "id", {"kv": "has_kv", "zone": "has_zone"}).collect())
    assert got == [(1, 5.0, "a"), (2, None, "b"), (3, 7.0, "c")]
    assert R.deleted(t, n, "id").count() == 1


def test_solved_schedules_pass_the_checks(spark):
    units = [(0, i, 50.0 + 10 * i, 5.0, 10.0 + i, 2.0, 30.0, 5.0, 3, 2, 4 if i == 2 else 99, 7 if i == 2 else 99) for i in range(6)]
    u = spark.createDataFrame(units, "region long, unit long, mw double, p_min double, cost double, fixed double, startup double, shutdown double, min_up int, min_down int, off_from long, off_to long")
    d = spark.createDataFrame([(0, t, 120.0 + 5 * t) for t in range(12)], "region long, t long, demand double")
    out = C.solve(u, d).cache()
    first = out.first()
    assert first.status in ("Optimal", "Feasible") and first.bound <= first.cost + 1e-6
    s = out.join(u, ["region", "unit"]).select("unit", "t", "u", "p", "mw", "p_min", "min_up", "min_down")
    assert C.capacity_violations(s).count() == 0 and C.min_time_violations(s).count() == 0
    b = C.balance(s, d.select("t", "demand"), 0.05)
    assert b.where("short or reserve_short").count() == 0
    assert out.where("unit = 2 and t >= 4 and t < 7 and u = 1").count() == 0


def test_sources_and_store(spark, tmp_path):
    (tmp_path / "north_lines.geojson").write_text('{"type":"FeatureCollection","features":[{"type":"Feature","geometry":{"type":"LineString","coordinates":[[135,35],[136,35]]},"properties":{"voltage":"66000"}},{"type":"Feature","geometry":{"type":"Point","coordinates":[1,2]},"properties":{}}]}')
    f = readers.points(readers.features(spark, str(tmp_path / "north_lines.geojson"))).orderBy("pos").collect()
    assert [(r.region, r.layer, r.kind, len(r.coords)) for r in f] == [("north", "lines", "LineString", 2), ("north", "lines", "Point", 1)]
    assert f[1].coords[0].lat == 2.0
    store = sinks.Store(spark, str(tmp_path / "store"))
    assert store.write("gen", spark.range(3)) == 1 and store.add_column("gen", "kv", "double") == 2
    assert store.read("gen").columns == ["id", "kv"] and store.read("gen", 1).columns == ["id"]
