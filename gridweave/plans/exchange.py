"""Queries through sources and sinks: what is written is what is read back, and tables for exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import graph, matpower
from ..operators.spatial import within_km
from ..sources import readers, sinks, units
from .attributes import hav
from .bridge import sql_with, view
from .registry import query


@query("feature_roundtrip", sql_with("sub") + " SELECT sub_id, name, voltage, kv, lat, lon FROM sub")
def feature_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Substations written as GeoJSON features and read back."""
    at = graph.shared_path(spark)
    place = F.array(F.struct("lat", "lon")).alias("coords")
    sinks.write_features(view(spark, sf, "sub").select("sub_id", "name", "voltage", "kv", place), at)
    back = readers.feature_lines(spark, at, "sub_id bigint, name string, voltage string, kv double")
    return back.select("sub_id", "name", "voltage", "kv", F.col("coords")[0]["lat"].alias("lat"), F.col("coords")[0]["lon"].alias("lon"))


@query("line_feature_roundtrip", sql_with("way") + " SELECT way_id, kv, lat1, lon1, lat2, lon2 FROM way")
def line_feature_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Lines written as GeoJSON features and read back."""
    at = graph.shared_path(spark)
    ends = F.array(*(F.struct(F.col(f"lat{i}").alias("lat"), F.col(f"lon{i}").alias("lon")) for i in (1, 2))).alias("coords")
    sinks.write_features(view(spark, sf, "way").select("way_id", "kv", ends), at)
    back = readers.feature_lines(spark, at, "way_id bigint, kv double")
    return back.select("way_id", "kv", *(F.col("coords")[i - 1][c].alias(f"{c}{i}") for i in (1, 2) for c in ("lat", "lon")))


@query("csv_roundtrip", sql_with("gen") + " SELECT gen_id, label || ', \"' || coalesce(fuel, '') || '\"' AS label, mw FROM gen")
def csv_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Units with commas and quotes in their labels, through CSV; the underscored column is not written."""
    at = graph.shared_path(spark)
    label = F.concat("label", F.lit(', "'), F.coalesce("fuel", F.lit("")), F.lit('"')).alias("label")
    sinks.write_csv(view(spark, sf, "gen").select("mw", label, "gen_id", F.lit(1).alias("_hidden")), at)
    return spark.read.schema("gen_id bigint, label string, mw double").option("header", True).option("escape", '"').option("enforceSchema", False).csv(at)


@query("tier_counts", sql_with("way") + ", t AS (SELECT 'all' AS tier, kv FROM way UNION ALL SELECT '154', kv FROM way WHERE kv >= 154 UNION ALL SELECT '275', kv FROM way WHERE kv >= 275) SELECT tier, count(*) AS ways, min(kv) AS min_kv FROM t GROUP BY tier")
def tier_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Rows and the smallest voltage of each stored tier."""
    at = graph.shared_path(spark)
    sinks.write_tiers(view(spark, sf, "way").select("way_id", "kv"), at)
    return spark.read.schema("way_id bigint, kv double, tier string").parquet(at).groupBy("tier").agg(F.count("*").alias("ways"), F.min("kv").alias("min_kv"))


TABLES = ("sub", "gen", "way")


@query("table_report", sql_with(*TABLES) + " " + " UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS \"rows\", count(*) > 0 AS filled FROM {t}" for t in TABLES))
def table_report(spark: SparkSession, sf: str) -> DataFrame:
    return sinks.report({t: view(spark, sf, t) for t in TABLES})


ELEMENTS = "SELECT gen_id AS osm_id, CASE WHEN gen_id % 4 = 0 THEN 'node' ELSE 'way' END AS osm_type, round(lon, 6) AS lon, round(lat, 6) AS lat, CASE gen_id % 3 WHEN 0 THEN '' WHEN 1 THEN name ELSE label END AS name, coalesce(fuel, 'none') AS source, capacity AS output, '' AS operator, '' AS voltage, CASE gen_id % 3 WHEN 0 THEN 'plant_' || CAST(gen_id AS VARCHAR) WHEN 1 THEN name ELSE label END AS display_name FROM gen WHERE gen_id % 4 <> 3"


@query("elements_to_plants", sql_with("gen") + " " + ELEMENTS)
def elements_to_plants(spark: SparkSession, sf: str) -> DataFrame:
    """Map elements as plants: a quarter are nodes, a quarter have no centre, names sit under several tags."""
    g = view(spark, sf, "gen")
    node = F.col("gen_id") % 4 == 0
    tags = F.map_filter(
        F.create_map(
            F.lit("name"), F.when(F.col("gen_id") % 3 == 1, F.col("name")), F.lit("name:ja"), F.when(F.col("gen_id") % 3 == 2, F.col("label")), F.lit("name:en"), F.when(F.col("gen_id") % 3 == 2, F.lit("unused")),
            F.lit("generator:source"), F.col("fuel"), F.lit("source"), F.lit("none"), F.lit("plant:output:electricity"), F.col("capacity"),
        ), lambda _, v: v.isNotNull(),
    )
    center = F.when(~node & (F.col("gen_id") % 4 != 3), F.struct("lat", "lon"))
    raw = g.select(F.col("gen_id").alias("id"), F.when(node, "node").otherwise("way").alias("type"), F.when(node, F.col("lat")).alias("lat"), F.when(node, F.col("lon")).alias("lon"), center.alias("center"), tags.alias("tags"))
    return readers.elements(raw)


GML = {"HydroelectricPowerPlant": "hydro", "NuclearPowerPlant": "nuclear"}


@query("gml_plants", sql_with("gen") + " SELECT 'P' || CAST(gen_id AS VARCHAR) AS plant_id, label AS name, 'Owner & Co' AS owner, CASE WHEN gen_id % 7 > 0 THEN mw END AS mw, '' AS burning, CASE gen_id % 2 WHEN 0 THEN 'hydro' ELSE 'nuclear' END AS fuel, lat, lon FROM gen WHERE gen_id % 5 > 0")
def gml_plants(spark: SparkSession, sf: str) -> DataFrame:
    """Plants written as GML and read back: one in five refers to no point, one in seven has no numeric capacity."""
    at = graph.shared_path(spark)
    kind = F.when(F.col("gen_id") % 2 == 0, "HydroelectricPowerPlant").otherwise("NuclearPowerPlant")
    point = F.when(F.col("gen_id") % 5 > 0, F.format_string('<gml:Point gml:id="pt%d"><gml:pos>%s %s</gml:pos></gml:Point>', F.col("gen_id"), F.col("lat").cast("string"), F.col("lon").cast("string"))).otherwise("")
    power = F.when(F.col("gen_id") % 7 > 0, F.col("mw").cast("string")).otherwise("unknown")
    plant = F.format_string('<ksj:%s gml:id="P%d"><ksj:position xlink:href="#pt%d"/><ksj:nameOfPlant>%s</ksj:nameOfPlant><ksj:nameOfOwner>Owner &amp; Co</ksj:nameOfOwner><ksj:generatingPower>%s</ksj:generatingPower></ksj:%s>', kind, F.col("gen_id"), F.col("gen_id"), F.col("label"), power, kind)
    head = '<ksj:Dataset xmlns:ksj="urn:ksj" xmlns:gml="http://www.opengis.net/gml/3.2" xmlns:xlink="http://www.w3.org/1999/xlink">'
    # A document for every thousand ids, so that files stay whole documents of a bounded size.
    docs = view(spark, sf, "gen").groupBy(F.floor(F.col("gen_id") / 1000).alias("part")).agg(F.array_join(F.collect_list(F.concat(point, F.lit("\n"), plant)), "\n").alias("body"))
    docs.select("part", F.concat(F.lit(head + "\n"), "body", F.lit("\n</ksj:Dataset>")).alias("value")).write.partitionBy("part").text(at)
    return readers.gml_plants(spark, f"{at}/part=*", GML)


SLACKS = "sub_id % 97 = 5"
MPC = ", b AS (SELECT sub_id AS bus, region, kv, greatest(CAST(balance AS DOUBLE), 0) / 100 AS pd FROM sub), g AS (SELECT sub_id AS bus, region, mw FROM gen WHERE sub_id IN (SELECT sub_id FROM sub)), s AS (SELECT sub_id AS bus FROM sub WHERE " + SLACKS + ")"


def _case(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    pd = F.greatest(F.col("balance").cast("double"), F.lit(0.0)) / 100
    s = view(spark, sf, "sub")
    buses = s.select(F.col("sub_id").alias("bus"), "region", "kv", pd.alias("pd"), (pd * 0.25).alias("qd"))
    gens = view(spark, sf, "gen").select(F.col("sub_id").alias("bus"), "region", "mw").join(buses.select("bus"), "bus", "left_semi")
    return buses, gens, s.where(SLACKS).select(F.col("sub_id").alias("bus"))


@query("mpc_bus_table", sql_with("sub", "gen") + MPC + " SELECT bus, CASE WHEN bus IN (SELECT bus FROM s) THEN 3 WHEN bus IN (SELECT bus FROM g) OR kv >= 110 THEN 2 ELSE 1 END AS type, round(pd, 6) AS pd, round(pd * 0.25e0, 6) AS qd, round(CASE WHEN pd > 0 THEN pd * 0.35e0 ELSE 0e0 END, 6) AS bs, kv AS base_kv FROM b")
def mpc_bus_table(spark: SparkSession, sf: str) -> DataFrame:
    return matpower.bus_table(*_case(spark, sf)).withColumns({c: F.round(c, 6) for c in ("pd", "qd", "bs")})


@query("mpc_gen_table", sql_with("sub", "gen") + MPC + ", f AS (SELECT region, least(least(sum(mw) * 2 * 0.65e0, sum(mw) * 0.8e0) * 1.05e0 / sum(mw), 0.9e0) AS factor FROM g GROUP BY region) SELECT bus, 'unit' AS kind, round(mw * factor, 6) AS pg, round(mw * 0.6e0, 6) AS qmax, round(mw * -0.3e0, 6) AS qmin, mw AS pmax FROM g JOIN f USING (region) UNION ALL SELECT bus, 'slack', 0, 9999, -9999, 9999 FROM s UNION ALL SELECT bus, 'condenser', 0, q, round(q * -0.4e0, 6), 0 FROM (SELECT bus, CASE WHEN kv >= 275 THEN 500e0 WHEN kv >= 154 THEN 200e0 ELSE 100e0 END AS q FROM b WHERE kv >= 110 AND bus NOT IN (SELECT bus FROM g) AND bus NOT IN (SELECT bus FROM s))")
def mpc_gen_table(spark: SparkSession, sf: str) -> DataFrame:
    """Units, slack sources and condensers; the peak of a region is twice its capacity."""
    buses, gens, slacks = _case(spark, sf)
    peaks = gens.groupBy("region").agg((F.sum("mw") * 2).alias("peak_mw"))
    rows = matpower.gen_table(buses, gens, slacks, matpower.dispatch_factors(gens, peaks, 0.65, 0.05))
    return rows.withColumns({c: F.round(c, 6) for c in ("pg", "qmax", "qmin")})


@query("ybus_health", sql_with("line", "sub") + ", d AS (SELECT i, abs(sum(v)) AS v FROM (SELECT from_sub AS i, 1e0 / (km * 0.4e0) AS v FROM line WHERE km > 0 UNION ALL SELECT to_sub, 1e0 / (km * 0.4e0) FROM line WHERE km > 0) GROUP BY i) SELECT count(*) AS buses, count(*) FILTER (v IS NULL OR v < 1e-12) AS weak FROM sub LEFT JOIN d ON d.i = sub.sub_id")
def ybus_health(spark: SparkSession, sf: str) -> DataFrame:
    """How many buses have no diagonal admittance to speak of, buses without branches included."""
    x = view(spark, sf, "line").select(F.col("from_sub").alias("a"), F.col("to_sub").alias("b"), F.lit(0.0).alias("r"), (F.col("km") * 0.4).alias("x"))
    y = graph.ybus(x).where("i = j")
    buses = view(spark, sf, "sub").select(F.col("sub_id").alias("i")).join(y, "i", "left").fillna(0.0, ["g", "b"]).withColumn("j", F.col("i"))
    weak = graph.weak_diagonal(buses).withColumn("weak", F.lit(True))
    return buses.join(weak, "i", "left").agg(F.count("*").alias("buses"), F.count("weak").alias("weak"))


@query("geocoded_names", sql_with("sub") + ", c AS (SELECT printf('%.6f,%.6f', lat, lon) AS key, 'Place ' || CAST(min(sub_id) AS VARCHAR) AS place FROM sub WHERE sub_id % 3 > 0 GROUP BY 1) SELECT sub_id, CASE WHEN trim(name) <> '' THEN name ELSE coalesce(place, 'substation_' || CAST(sub_id AS VARCHAR)) END AS name, place IS NOT NULL AS cached FROM sub LEFT JOIN c ON c.key = printf('%.6f,%.6f', sub.lat, sub.lon)")
def geocoded_names(spark: SparkSession, sf: str) -> DataFrame:
    """Names of unnamed substations from a cache by place, else from their ids."""
    s = view(spark, sf, "sub").select("sub_id", "name", "lat", "lon")
    cache = s.where("sub_id % 3 > 0").groupBy(F.format_string("%.6f,%.6f", "lat", "lon").alias("key")).agg(F.concat(F.lit("Place "), F.min("sub_id").cast("string")).alias("place"))
    found = readers.cached_lookup(s, cache)
    name = F.when(F.trim("name") != "", F.col("name")).otherwise(F.coalesce("place", F.concat(F.lit("substation_"), F.col("sub_id").cast("string"))))
    return found.select("sub_id", name.alias("name"), F.col("place").isNotNull().alias("cached"))


UNITS = "SELECT CAST(gen_id AS VARCHAR) AS id, CAST(region AS VARCHAR) AS region, mw AS capacity_mw, CASE gen_id % 3 WHEN 0 THEN 'coal' WHEN 1 THEN 'lng' ELSE 'unlisted' END AS fuel_type, CASE WHEN gen_id % 3 = 0 THEN mw * 10 ELSE 5000e0 END AS startup_cost, CASE WHEN gen_id % 4 = 0 THEN 3 ELSE 4 END AS min_up_time_h, CASE WHEN gen_id % 2 = 0 THEN 12.5e0 WHEN gen_id % 3 = 0 THEN 4500e0 WHEN gen_id % 3 = 1 THEN 7000e0 ELSE 5000e0 END AS fuel_cost_per_mwh, CASE WHEN gen_id % 5 = 0 THEN mw / 2 END AS ramp_up_mw_per_h, CASE WHEN gen_id % 6 = 0 THEN 1 ELSE 0 END AS windows, CASE WHEN gen_id % 6 = 0 THEN 30 END AS start_h, CASE WHEN gen_id % 6 = 0 THEN 48 END AS end_h FROM gen"


@query("unit_xml_roundtrip", sql_with("gen") + " " + UNITS)
def unit_xml_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Units written as XML regions and read back with defaults for what was left out; one of three windows is valid."""
    at = graph.shared_path(spark)
    given = lambda every, name, value: F.when(F.col("gen_id") % every == 0, F.concat(F.lit(f' {name}="'), value, F.lit('"'))).otherwise("")
    fuel = F.when(F.col("gen_id") % 3 == 0, "coal").when(F.col("gen_id") % 3 == 1, "lng").otherwise("unlisted")
    windows = '<MaintenancePlan><Window start="2000-01-02T06:00:00" end="2000-01-03T00:30:00"/><Window start="2000-01-03T00:00:00" end="2000-01-02T00:00:00"/><Window start="soon" end="2000-01-02T00:00:00"/></MaintenancePlan>'
    unit = F.concat(
        F.lit('<Generator id="'), F.col("gen_id").cast("string"), F.lit('" fuel_type="'), fuel, F.lit('" capacity_mw="'), F.col("mw").cast("string"), F.lit('"'),
        given(3, "startup_cost", (F.col("mw") * 10).cast("string")), given(4, "min_up_time_h", F.lit("3.7")), given(2, "fuel_cost_per_mwh", F.lit("12.5")), F.lit(">"),
        F.when(F.col("gen_id") % 5 == 0, F.concat(F.lit('<RampRates ramp_up_mw_per_h="'), (F.col("mw") / 2).cast("string"), F.lit('"/>'))).otherwise(""),
        F.when(F.col("gen_id") % 6 == 0, windows).otherwise(""), F.lit("</Generator>"),
    )
    # One element of a thousand ids at most a file: documents have one root, and no row grows with the table.
    docs = view(spark, sf, "gen").groupBy("region", F.floor(F.col("gen_id") / 1000).alias("part")).agg(F.array_join(F.collect_list(unit), "\n").alias("body"))
    docs.select(F.concat_ws("-", "region", "part").alias("file"), F.concat(F.lit('<Region id="'), F.col("region").cast("string"), F.lit('"><Generators>\n'), "body", F.lit("\n</Generators></Region>")).alias("value")).write.partitionBy("file").text(at)
    first = F.get("maintenance", F.lit(0))
    return units.unit_rows(spark, f"{at}/file=*").select("id", "region", "capacity_mw", "fuel_type", "startup_cost", "min_up_time_h", "fuel_cost_per_mwh", "ramp_up_mw_per_h", F.size("maintenance").alias("windows"), first["start_h"].alias("start_h"), first["end_h"].alias("end_h"))


TYPES = {"transmission": 154.0, "distribution": 66.0, "traction": 25.0, "industrial": 66.0, "generation": 154.0, "converter": 275.0, "transition": 66.0, "switching": 154.0}
KIND = "CASE sub_id % 5 WHEN 0 THEN 'transmission' WHEN 1 THEN 'traction' WHEN 2 THEN 'converter' ELSE '' END"


@query("substation_export", sql_with("sub", "way") + f", p AS (SELECT lat1 AS lat, lon1 AS lon, kv FROM way UNION ALL SELECT lat2, lon2, kv FROM way), n AS (SELECT sub_id, max(p.kv) AS kv FROM sub JOIN p ON abs(p.lat - sub.lat) <= 0.02 AND abs(p.lon - sub.lon) <= 0.02 WHERE {hav('sub.lat', 'sub.lon', 'p.lat', 'p.lon')} <= 1 GROUP BY sub_id), t AS (SELECT sub_id, CASE {KIND} " + " ".join(f"WHEN '{k}' THEN {v}e0" for k, v in TYPES.items()) + " END AS kv FROM sub) SELECT sub.sub_id, CASE WHEN sub.kv > 0 THEN sub.kv ELSE coalesce(n.kv, t.kv) END AS kv, CASE WHEN sub.kv > 0 THEN 'osm' WHEN n.kv IS NOT NULL THEN 'inferred_from_lines' WHEN t.kv IS NOT NULL THEN 'inferred_from_type' END AS voltage_source FROM sub LEFT JOIN n USING (sub_id) LEFT JOIN t USING (sub_id)")
def substation_export(spark: SparkSession, sf: str) -> DataFrame:
    """A substation's voltage and where it is from: its own, the highest of line ends within a kilometre, its type."""
    s, w = view(spark, sf, "sub"), view(spark, sf, "way")
    lacking = s.where("kv <= 0").select("sub_id", F.col("lat").alias("llat"), F.col("lon").alias("llon"))
    end = lambda i: w.select(F.col("kv").alias("line_kv"), F.col(f"lat{i}").alias("rlat"), F.col(f"lon{i}").alias("rlon"))
    near = within_km(lacking, end(1).union(end(2)), 1.0).groupBy("sub_id").agg(F.max("line_kv").alias("line_kv"))
    kind = F.expr(KIND)
    by_type = F.coalesce(*(F.when(kind == k, v) for k, v in TYPES.items()))
    own = F.when(F.col("kv") > 0, F.col("kv"))
    source = F.when(own.isNotNull(), "osm").when(F.col("line_kv").isNotNull(), "inferred_from_lines").when(by_type.isNotNull(), "inferred_from_type")
    return s.select("sub_id", "kv").join(near, "sub_id", "left").select("sub_id", F.coalesce(own, "line_kv", by_type).alias("kv"), source.alias("voltage_source"))
