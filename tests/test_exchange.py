from pyspark.sql import functions as F

from gridweave.operators import matpower
from gridweave.sources import readers, sinks

ELEMENT = "type string, id long, lat double, lon double, center struct<lat:double,lon:double>, tags map<string,string>"


def test_elements_take_the_first_tag_that_is_set(spark):
    rows = [
        ("node", 1, 35.12345678, 139.0, None, {"name": "", "name:ja": "J", "voltage": "66000"}),
        ("way", 2, 1.0, 1.0, (36.0, 140.0), {"name:en": "E", "generator:source": "solar", "source": "x"}),
        ("way", 3, 1.0, 1.0, None, {}),
        ("node", 4, None, 1.0, (36.0, 140.0), None),
        ("relation", 5, None, None, (36.0, 140.0), None),
    ]
    got = {r.osm_id: r for r in readers.elements(spark.createDataFrame(rows, ELEMENT)).collect()}
    assert sorted(got) == [1, 2, 5]
    assert (got[1].lat, got[1].name, got[1].display_name, got[1].voltage) == (35.123457, "", "plant_1", "66000")
    assert (got[2].lat, got[2].name, got[2].source) == (36.0, "E", "solar")
    assert (got[5].name, got[5].source, got[5].display_name) == ("", "", "plant_5")


def test_gml_references_and_capacities(spark, tmp_path):
    body = """<ksj:Dataset xmlns:ksj="urn:ksj" xmlns:gml="urn:gml" xmlns:xlink="urn:xlink">
<gml:Point gml:id="a"><gml:pos> 35.5  139.5 </gml:pos></gml:Point>
<gml:Point gml:id="b"><gml:pos>35.5</gml:pos></gml:Point>
<ksj:Thermal gml:id="p1"><ksj:position xlink:href="#a"/><ksj:nameOfPlant> T1 </ksj:nameOfPlant><ksj:generatingPower>12.5</ksj:generatingPower><ksj:burningType>LNG</ksj:burningType></ksj:Thermal>
<ksj:Thermal gml:id="p2"><ksj:position xlink:href="#b"/></ksj:Thermal>
<ksj:Wind gml:id="p3"><ksj:position xlink:href="#a"/><ksj:generatingPower>-</ksj:generatingPower></ksj:Wind>
<ksj:Wind gml:id="p4"></ksj:Wind>
</ksj:Dataset>"""
    (tmp_path / "p.xml").write_text(body)
    got = {r.plant_id: r.asDict() for r in readers.gml_plants(spark, str(tmp_path / "p.xml"), {"Thermal": "thermal", "Wind": "wind"}).collect()}
    assert sorted(got) == ["p1", "p3"]
    assert got["p1"] == {"plant_id": "p1", "name": "T1", "owner": "", "mw": 12.5, "burning": "LNG", "fuel": "thermal", "lat": 35.5, "lon": 139.5}
    assert got["p3"]["mw"] is None and got["p3"]["fuel"] == "wind"


def test_csv_leaves_out_hidden_columns(spark, tmp_path):
    at = str(tmp_path / "c")
    sinks.write_csv(spark.createDataFrame([('a "q", b', 1, None)], "z string, a long, _x string").coalesce(1), at)
    assert [r.value for r in spark.read.text(at).collect()] == ["a,z", '1,"a ""q"", b"']


def test_features_with_and_without_properties(spark, tmp_path):
    at = str(tmp_path / "f")
    df = spark.createDataFrame([(1, None, [(35.0, 139.0)]), (2, 'x "y"', [(35.0, 139.0), (36.0, 140.0)])], "id long, name string, coords array<struct<lat:double,lon:double>>")
    sinks.write_features(df, at)
    got = {r.id: (r.name, [tuple(p) for p in r.coords]) for r in readers.feature_lines(spark, at, "id long, name string").collect()}
    assert got == {1: (None, [(35.0, 139.0)]), 2: ('x "y"', [(35.0, 139.0), (36.0, 140.0)])}


def test_case_tables(spark):
    buses = spark.createDataFrame([(1, "r", 500.0, 10.0, 2.0), (2, "r", 154.0, None, None), (3, "r", 66.0, 5.0, 1.0), (4, "r", 110.0, 0.0, 0.0)], "bus long, region string, kv double, pd double, qd double")
    gens = spark.createDataFrame([(3, "r", 100.0), (3, "r", 50.0)], "bus long, region string, mw double")
    slacks = spark.createDataFrame([(1,)], "bus long")
    types = {r.bus: (r.type, r.pd, round(r.bs, 6)) for r in matpower.bus_table(buses, gens, slacks).collect()}
    assert types == {1: (3, 10.0, 3.5), 2: (2, 0.0, 0.0), 3: (2, 5.0, 1.75), 4: (2, 0.0, 0.0)}
    peaks = spark.createDataFrame([("r", 60.0), ("empty", 5.0)], "region string, peak_mw double")
    factors = {r.region: round(r.factor, 6) for r in matpower.dispatch_factors(gens, peaks, 0.5, 0.05).collect()}
    assert factors == {"r": 0.21, "empty": 0.5}
    table = matpower.gen_table(buses, gens, slacks, matpower.dispatch_factors(gens, peaks, 0.5, 0.05))
    got = sorted((r.bus, r.kind, round(r.pg, 3), r.qmax, r.pmax) for r in table.collect())
    assert got == [(1, "slack", 0.0, 9999.0, 9999.0), (2, "condenser", 0.0, 200.0, 0.0), (3, "unit", 10.5, 30.0, 50.0), (3, "unit", 21.0, 60.0, 100.0), (4, "condenser", 0.0, 100.0, 0.0)]
    assert table.where(F.col("qmin") >= 0).count() == 0


def test_units_without_attributes_get_the_defaults(spark, tmp_path):
    (tmp_path / "u.xml").write_text(
        '<Grid><Region id="north"><Generators><Generator id="a"/><Generator id="b" capacity_mw="10" fuel_type="hydro" startup_cost="1" min_down_time_h="2.9"><Location latitude="43" longitude="141"/>'
        '<MaintenancePlan><Window start="2000-01-01T01:00:00"/></MaintenancePlan><RebuildPlan planned_date=""/><DisasterRisk risk_score="0.5"/></Generator></Generators></Region><Region id="empty"></Region></Grid>'
    )
    from gridweave.sources.units import unit_rows

    got = {r.id: r for r in unit_rows(spark, str(tmp_path / "u.xml"), {"no_load_cost": None}).collect()}
    a, b = got["a"], got["b"]
    assert (a.region, a.capacity_mw, a.fuel_type, a.status, a.startup_cost, a.min_up_time_h, a.fuel_cost_per_mwh, a.no_load_cost, a.ramp_up_mw_per_h, a.maintenance) == ("north", 0.0, "unknown", "active", 5000.0, 4, 5000.0, 0.0, None, [])
    assert (b.latitude, b.longitude, b.startup_cost, b.min_down_time_h, b.fuel_cost_per_mwh, b.maintenance, b.rebuild_planned_date, b.risk_score) == (43.0, 141.0, 1.0, 2, 0.0, [], None, 0.5)
