"""Queries over the network model: real line ends, parameters by class, results joined back, lists and totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import geo, scalars as S
from ..operators import parameters as M
from ..operators.spatial import attached, nearest, places
from .attributes import hav
from .bridge import sql_with, view
from .registry import query

KM = hav("a.lat", "a.lon", "b.lat", "b.lon")
ENDS = f", p AS (SELECT way_id, 1 AS side, lat1 AS lat, lon1 AS lon FROM way UNION ALL SELECT way_id, 2, lat2, lon2 FROM way), x AS (SELECT a.way_id, a.side, b.sub_id, {KM} AS km FROM p a, sub b), n AS (SELECT way_id, side, sub_id, row_number() OVER (PARTITION BY way_id, side ORDER BY km, sub_id) AS k FROM x WHERE km <= 50), m AS (SELECT f.way_id, f.sub_id AS from_sub, t.sub_id AS to_sub FROM n f JOIN n t ON t.way_id = f.way_id AND f.k = 1 AND t.k = 1 AND f.side = 1 AND t.side = 2 WHERE f.sub_id <> t.sub_id)"


def matched(spark: SparkSession, sf: str) -> DataFrame:
    """way_id, from_sub, to_sub, km, region, kv, name: both ends at their nearest substations within 50 km, different ones."""
    way = view(spark, sf, "way").where("way_id IS NOT NULL")
    sub = view(spark, sf, "sub").select("sub_id", F.col("lat").alias("rlat"), F.col("lon").alias("rlon"))
    length = geo.haversine(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"))
    out = ["way_id", "region", "kv", "name", F.round(F.when(length > 0, length).otherwise(1.0), 2).alias("km")]
    held = places(sub, "sub_id")
    if held is not None and way.groupBy("way_id").count().where("count > 1").isEmpty():
        both = attached(way, held, [("lat1", "lon1", "from_sub", "_km1"), ("lat2", "lon2", "to_sub", "_km2")], 50.0)
        return both.where("from_sub <> to_sub").select(*out, "from_sub", "to_sub")
    # ways of equal numbers share the ends that lie nearest
    end = lambda i, to: nearest(way.select("way_id", F.col(f"lat{i}").alias("llat"), F.col(f"lon{i}").alias("llon")), "way_id", sub, "sub_id", 50.0).select("way_id", F.col("sub_id").alias(to))
    return way.select(*out).join(end(1, "from_sub"), "way_id").join(end(2, "to_sub"), "way_id").where("from_sub <> to_sub")


WAYS = ENDS + f", w AS (SELECT m.*, a.region, a.kv, a.name, round(CASE WHEN {hav('a.lat1', 'a.lon1', 'a.lat2', 'a.lon2')} > 0 THEN {hav('a.lat1', 'a.lon1', 'a.lat2', 'a.lon2').removeprefix('round(').rsplit(', 6)', 1)[0]} ELSE 1e0 END, 2) AS km FROM m JOIN way a ON a.way_id = m.way_id)"


@query("line_endpoint_matching", sql_with("way", "sub") + WAYS + " SELECT way_id, from_sub, to_sub, km, region FROM w")
def line_endpoint_matching(spark: SparkSession, sf: str) -> DataFrame:
    return matched(spark, sf).select("way_id", "from_sub", "to_sub", "km", "region")


@query("endpoint_graph", sql_with("way", "sub") + WAYS + " SELECT least(from_sub, to_sub) AS a, greatest(from_sub, to_sub) AS b, count(*) AS ways, min(way_id) AS first, max(kv) AS kv, round(sum(km), 2) AS km FROM w GROUP BY 1, 2")
def endpoint_graph(spark: SparkSession, sf: str) -> DataFrame:
    """The edges of the network that line ends make."""
    m = matched(spark, sf)
    return m.groupBy(F.least("from_sub", "to_sub").alias("a"), F.greatest("from_sub", "to_sub").alias("b")).agg(F.count("*").alias("ways"), F.min("way_id").alias("first"), F.max("kv").alias("kv"), F.round(F.sum("km"), 2).alias("km"))


@query("endpoint_naming", sql_with("way", "sub") + WAYS + ", s AS (SELECT sub_id, nullif(trim(name), '') AS name FROM sub) SELECT way_id, f.name || '-' || t.name || ' line' AS name FROM w JOIN s f ON f.sub_id = from_sub JOIN s t ON t.sub_id = to_sub WHERE trim(w.name) = '' AND f.name IS NOT NULL AND t.name IS NOT NULL AND f.name <> t.name")
def endpoint_naming(spark: SparkSession, sf: str) -> DataFrame:
    """Names for unnamed lines, from the substations at both ends."""
    s = view(spark, sf, "sub").select("sub_id", S.blank_to_null(F.col("name")).alias("n")).where("n IS NOT NULL")
    m = matched(spark, sf).where(F.trim("name") == "").select("way_id", "from_sub", "to_sub")
    both = m.join(s.select(F.col("sub_id").alias("from_sub"), F.trim("n").alias("f")), "from_sub").join(s.select(F.col("sub_id").alias("to_sub"), F.trim("n").alias("t")), "to_sub")
    return both.where("f <> t").select("way_id", F.concat("f", F.lit("-"), "t", F.lit(" line")).alias("name"))


CLASSES = "(VALUES " + ", ".join(f"({i}, {c[0]}, {c[1]}e0, {c[2]}e0, {c[3]}, {c[4]}e0)" for i, c in enumerate(M.LINE_CLASSES)) + ") c(o, class, r, x, b, i)"
BY_CLASS = f", q AS (SELECT way_id, kv, CAST(round_even(kv, 0) AS INTEGER) AS k FROM way), c AS (SELECT * FROM {CLASSES}), lp AS (SELECT way_id, kv, class, k = class AS exact, r, x, b / (2 * pi() * 50) * 1e9 AS c, i, row_number() OVER (PARTITION BY way_id ORDER BY abs(class - k), o) AS n FROM q, c)"


@query("line_parameters", sql_with("way") + BY_CLASS + " SELECT way_id, class, exact, r, x, round(c, 6) AS c_nf, i AS max_i_ka FROM lp WHERE n = 1")
def line_parameters(spark: SparkSession, sf: str) -> DataFrame:
    """The class of a line's voltage, else the nearest one (the first listed on ties), with its parameters at 50 Hz."""
    return M.with_line_parameters(view(spark, sf, "way").select("way_id", "kv"), 50.0).select("way_id", "class", "exact", "r", "x", F.round("c", 6).alias("c_nf"), F.col("i").alias("max_i_ka"))


PEAK = "(VALUES (0, 4500e0), (1, 13000e0), (2, 55000e0), (3, 25000e0), (4, 5000e0), (5, 27000e0), (6, 10500e0)) d(region, peak)"


@query("demand_by_region", sql_with("sub", "load") + f", e AS (SELECT region, sum(mw) AS have FROM load JOIN sub ON sub.sub_id = load.sub_id GROUP BY region), r AS (SELECT DISTINCT region FROM sub) SELECT r.region, coalesce(peak, 0e0) AS peak, round(greatest(coalesce(peak, 0e0) * 0.6e0 - coalesce(have, 0e0), 0e0), 3) AS target FROM r LEFT JOIN {PEAK} ON d.region = r.region LEFT JOIN e ON e.region = r.region")
def demand_by_region(spark: SparkSession, sf: str) -> DataFrame:
    """Configured peak demand of each region (0 where there is none) and what of it the present loads leave."""
    peaks = F.broadcast(spark.createDataFrame([(0, 4500.0), (1, 13000.0), (2, 55000.0), (3, 25000.0), (4, 5000.0), (5, 27000.0), (6, 10500.0)], "region int, peak double"))  # seven rows
    sub = view(spark, sf, "sub").select("sub_id", F.col("region").cast("int").alias("region"))
    have = view(spark, sf, "load").join(sub, "sub_id").groupBy("region").agg(F.sum("mw").alias("have"))
    out = sub.select("region").distinct().join(peaks, "region", "left").join(have, "region", "left")
    peak = F.coalesce("peak", F.lit(0.0))
    return out.select("region", peak.alias("peak"), F.round(F.greatest(peak * 0.6 - F.coalesce("have", F.lit(0.0)), F.lit(0.0)), 3).alias("target"))


COSTS = {"coal": 4500.0, "lng": 7000.0, "oil": 12000.0, "nuclear": 1500.0, "hydro": 0.0, "unknown": 8000.0}


@query("fuel_cost_default", sql_with("gen") + ", g AS (SELECT gen_id, CASE WHEN gen_id % 5 = 0 THEN CAST(gen_id % 100 AS DOUBLE) END AS own, lower(coalesce(nullif(split_part(trim(fuel), ';', 1), ''), 'unknown')) AS fuel FROM gen) SELECT gen_id, coalesce(own, CASE fuel " + " ".join(f"WHEN '{k}' THEN {v}e0" for k, v in COSTS.items()) + f" END, {COSTS['unknown']}e0, 0e0) AS cost FROM g")
def fuel_cost_default(spark: SparkSession, sf: str) -> DataFrame:
    """A unit's own fuel cost, else its fuel's, else that of unknown fuels, else 0."""
    fuel = F.lower(F.coalesce(F.nullif(F.split(F.trim("fuel"), ";")[0], F.lit("")), F.lit("unknown")))
    own = F.when(F.col("gen_id") % 5 == 0, (F.col("gen_id") % 100).cast("double"))
    return view(spark, sf, "gen").select("gen_id", M.defaulted(own, fuel, COSTS).alias("cost"))


@query("derived_unit_parameters", sql_with("gen") + ", f AS (SELECT gen_id, mw, lower(trim(coalesce(fuel, 'unknown'))) AS fuel, lat, lon FROM gen), d AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', {v[0]}e0, {v[1]}e0, {v[2]}e0, {v[3]}e0, {v[4]}e0)" for k, v in M.UNIT_FRACTIONS.items()) + ") d(fuel, up, down, low, start, stop)) SELECT gen_id, round(mw * coalesce(up, 0.05e0), 2) AS ramp_up, round(mw * coalesce(down, 0.05e0), 2) AS ramp_down, round(mw * coalesce(low, 0.3e0), 2) AS p_min, round(mw * coalesce(start, 10e0), 0) AS startup_cost, round(mw * coalesce(stop, 3e0), 0) AS shutdown_cost FROM f LEFT JOIN d ON d.fuel = f.fuel WHERE NOT (lat = 0 AND lon = 0)")
def derived_unit_parameters(spark: SparkSession, sf: str) -> DataFrame:
    """Ramps, least output and costs from the capacity and the fractions of the fuel; units without a place are left out."""
    return M.with_unit_parameters(view(spark, sf, "gen").where("NOT (lat = 0 AND lon = 0)").withColumn("fuel", F.lower(F.trim(F.coalesce("fuel", F.lit("unknown"))))))


@query("derived_flags", sql_with("gen", "line") + ", g AS (SELECT gen_id, lower(trim(coalesce(fuel, ''))) AS f, lat, lon, sub_id FROM gen) SELECT 'gen' AS kind, gen_id AS id, f IN ('solar', 'wind', 'hydro', 'geothermal', 'biomass') AS first, f IN ('pumped_hydro', 'battery') AS second, lat <> 0 OR lon <> 0 AS located, sub_id IS NOT NULL AS connected FROM g UNION ALL SELECT 'line', line_id, kv >= 275, km > 0, true, true FROM line")
def derived_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Units: renewable, storage, located, connected.  Lines: backbone, with electrical parameters."""
    f = F.lower(F.trim(F.coalesce("fuel", F.lit(""))))
    g = view(spark, sf, "gen").select(F.lit("gen").alias("kind"), F.col("gen_id").alias("id"), f.isin("solar", "wind", "hydro", "geothermal", "biomass").alias("first"), f.isin("pumped_hydro", "battery").alias("second"), ((F.col("lat") != 0) | (F.col("lon") != 0)).alias("located"), F.col("sub_id").isNotNull().alias("connected"))
    ln = view(spark, sf, "line").select(F.lit("line"), "line_id", F.col("kv") >= 275, F.col("km") > 0, F.lit(True), F.lit(True))
    return g.union(ln)


@query("calendar_multiplier", "WITH h AS (SELECT CAST(range AS BIGINT) AS h, TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 HOUR * range AS ts FROM range(8760)), c AS (SELECT h, CAST(month(ts) AS INTEGER) AS month, CAST(hour(ts) AS INTEGER) AS hour, isodow(ts) < 6 AS weekday FROM h) SELECT h, month, hour, weekday, round(greatest((CASE WHEN weekday THEN 0.6e0 + 0.02e0 * hour - 0.0004e0 * hour * hour ELSE 0.5e0 + 0.015e0 * hour - 0.0003e0 * hour * hour END) * (0.7e0 + 0.05e0 * abs(month - 6)) / 0.85e0, 0.01e0), 6) AS multiplier FROM c")
def calendar_multiplier(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly factors of a year: curve of the day type times the month's factor over the reference point, at least 0.01."""
    weekday = [0.6 + 0.02 * h - 0.0004 * h * h for h in range(24)]
    weekend = [0.5 + 0.015 * h - 0.0003 * h * h for h in range(24)]
    monthly = [0.7 + 0.05 * abs(m - 6) for m in range(1, 13)]
    return M.calendar_multipliers(spark, 2024, weekday, weekend, monthly, 0.85)


@query("interconnection_slack", sql_with("sub") + ", s AS (SELECT region, min(sub_id) AS slack FROM sub WHERE kv >= 275 GROUP BY region), i AS (SELECT CAST(r AS INTEGER) AS a, CAST((r * 3 + 1) % 12 AS INTEGER) AS b FROM range(10) t(r)) SELECT a, b, f.slack AS from_bus, t.slack AS to_bus FROM i JOIN s f ON f.region = a JOIN s t ON t.region = b")
def interconnection_slack(spark: SparkSession, sf: str) -> DataFrame:
    """Ties between regions at their slack buses; a tie with a missing side is dropped."""
    s = view(spark, sf, "sub").where("kv >= 275").groupBy("region").agg(F.min("sub_id").alias("slack"))
    ties = spark.range(10).select(F.col("id").cast("int").alias("a"), ((F.col("id") * 3 + 1) % 12).cast("int").alias("b"))
    return ties.join(s.select(F.col("region").alias("a"), F.col("slack").alias("from_bus")), "a").join(s.select(F.col("region").alias("b"), F.col("slack").alias("to_bus")), "b").select("a", "b", "from_bus", "to_bus")


@query("bus_results", sql_with("sub") + ", r AS (SELECT row_number() OVER (ORDER BY sub_id) - 1 AS bus, sub_id FROM sub WHERE kv > 0) SELECT sub.sub_id, name, kv, round(1e0 + CAST(bus % 21 - 10 AS DOUBLE) / 200e0, 6) AS vm_pu, round(CAST(bus % 61 - 30 AS DOUBLE) / 4e0, 6) AS va_deg FROM r JOIN sub ON sub.sub_id = r.sub_id")
def bus_results(spark: SparkSession, sf: str) -> DataFrame:
    """Results by bus number joined back to substations through the bus map."""
    from ..operators.relational import stacked

    sub = view(spark, sf, "sub")
    buses = stacked(sub.where("kv > 0").select("sub_id", F.lit(0).alias("one")), "one", "sub_id").select("bus", "sub_id")
    result = buses.select("bus", F.round(1.0 + (F.col("bus") % 21 - 10) / 200.0, 6).alias("vm_pu"), F.round((F.col("bus") % 61 - 30) / 4.0, 6).alias("va_deg"))
    return result.join(buses, "bus").join(sub, "sub_id").select("sub_id", "name", "kv", "vm_pu", "va_deg")


@query("line_results", sql_with("line", "sub") + " SELECT line_id, least(mva, 200e0) AS loading_pct, coalesce(f.lat, 0e0) AS lat1, coalesce(f.lon, 0e0) AS lon1, coalesce(t.lat, 0e0) AS lat2, coalesce(t.lon, 0e0) AS lon2 FROM line JOIN sub f ON f.sub_id = from_sub JOIN sub t ON t.sub_id = to_sub WHERE mva > 0")
def line_results(spark: SparkSession, sf: str) -> DataFrame:
    """Loading (200 at most) of lines in service, with the places of both ends."""
    s = view(spark, sf, "sub")
    at = lambda i, k: s.select(F.col("sub_id").alias(k), F.col("lat").alias(f"lat{i}"), F.col("lon").alias(f"lon{i}"))
    x = view(spark, sf, "line").where("mva > 0").join(at(1, "from_sub"), "from_sub").join(at(2, "to_sub"), "to_sub")
    return x.select("line_id", F.least("mva", F.lit(200.0)).alias("loading_pct"), "lat1", "lon1", "lat2", "lon2")


@query("loss_and_loading", sql_with("line") + " SELECT region, round(sum(km * 0.05e0 * mva / 100), 4) AS loss_mw, max(CASE WHEN mva > 0 THEN mva END) AS max_loading FROM line GROUP BY region")
def loss_and_loading(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "line").groupBy("region").agg(F.round(F.sum(F.col("km") * 0.05 * F.col("mva") / 100), 4).alias("loss_mw"), F.max(F.when(F.col("mva") > 0, F.col("mva"))).alias("max_loading"))


@query("multi_region_totals", sql_with("line") + ", r AS (SELECT region, sum(mva) AS mva, sum(km) AS km, min(mva) >= 0 AS ok FROM line GROUP BY region) SELECT count(*) AS regions, bool_and(ok) AS converged, round(sum(mva), 3) AS mva, round(sum(km), 3) AS km FROM r")
def multi_region_totals(spark: SparkSession, sf: str) -> DataFrame:
    r = view(spark, sf, "line").groupBy("region").agg(F.sum("mva").alias("mva"), F.sum("km").alias("km"), (F.min("mva") >= 0).alias("ok"))
    return r.agg(F.count("*").alias("regions"), F.every("ok").alias("converged"), F.round(F.sum("mva"), 3).alias("mva"), F.round(F.sum("km"), 3).alias("km"))


@query("complement_counts", sql_with("gen") + ", c AS (SELECT region, fuel IS NULL AS f, capacity = 'unknown' AS c, sub_id IS NULL AS s FROM gen) SELECT coalesce(CAST(region AS VARCHAR), 'total') AS region, count(*) AS n, count(*) FILTER (WHERE f) AS fuel, count(*) FILTER (WHERE c) AS capacity, count(*) FILTER (WHERE s) AS place FROM c GROUP BY ROLLUP (region)")
def complement_counts(spark: SparkSession, sf: str) -> DataFrame:
    """What complementary data could fill in, by region and in all."""
    r = view(spark, sf, "gen").rollup("region").agg(F.count("*").alias("n"), F.count_if(F.col("fuel").isNull()).alias("fuel"), F.count_if(F.col("capacity") == "unknown").alias("capacity"), F.count_if(F.col("sub_id").isNull()).alias("place"))
    return r.withColumn("region", F.coalesce(F.col("region").cast("string"), F.lit("total")))


@query("sorted_list_truncated", sql_with("gen") + ", k AS (SELECT count(*) > 1500 AS truncated FROM gen WHERE mw > 1) SELECT gen_id, label, mw, truncated FROM gen, k WHERE mw > 1 ORDER BY mw DESC, label, gen_id LIMIT 1500")
def sorted_list_truncated(spark: SparkSession, sf: str) -> DataFrame:
    """The list as it is shown: at most 1500 rows, and whether that cut it."""
    g = view(spark, sf, "gen").where("mw > 1").select("gen_id", "label", "mw")
    more = F.broadcast(g.agg((F.count("*") > 1500).alias("truncated")))  # one row
    return g.orderBy(F.desc("mw"), "label", "gen_id").limit(1500).crossJoin(more)


@query("max_voltage_bus", sql_with("sub") + " SELECT region, arg_min(sub_id, struct_pack(v := -kv, i := sub_id)) AS sub_id, max(kv) AS kv FROM sub GROUP BY region")
def max_voltage_bus(spark: SparkSession, sf: str) -> DataFrame:
    """The bus of the highest voltage of each region, the first one on ties."""
    return view(spark, sf, "sub").groupBy("region").agg(F.min_by("sub_id", F.struct(-F.col("kv"), F.col("sub_id"))).alias("sub_id"), F.max("kv").alias("kv"))


@query("top_duplicates", sql_with("sub", "run") + ", d AS (SELECT name, count(*) AS n FROM sub GROUP BY name HAVING count(*) > 1), f AS (SELECT method, count(*) AS n FROM run WHERE NOT ok GROUP BY method) SELECT 'name' AS list, name AS entry, n FROM (SELECT * FROM d ORDER BY n DESC, name LIMIT 10) UNION ALL SELECT 'failure', method, n FROM (SELECT * FROM f ORDER BY n DESC, method LIMIT 5)")
def top_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    """Reports: the ten names used most, the five methods that fail most."""
    d = view(spark, sf, "sub").groupBy("name").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), "name").limit(10)
    f = view(spark, sf, "run").where("NOT ok").groupBy("method").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "method").limit(5)
    return d.select(F.lit("name").alias("list"), F.col("name").alias("entry"), "n").union(f.select(F.lit("failure"), "method", "n"))


CATEGORY = "CASE WHEN gen_id % 4 = 0 THEN 'ipp' WHEN gen_id % 4 = 1 THEN 'utility' WHEN gen_id % 4 = 2 THEN 'unknown' ELSE NULL END"


@query("plants_split", sql_with("gen") + f", c AS (SELECT gen_id, coalesce({CATEGORY}, '') AS c FROM gen) SELECT gen_id, 'all' AS tier FROM c UNION ALL SELECT gen_id, CASE WHEN c = 'ipp' THEN 'ipp' ELSE 'utility' END FROM c UNION ALL SELECT gen_id, 'exact' FROM c WHERE c = 'utility'")
def plants_split(spark: SparkSession, sf: str) -> DataFrame:
    """Both partitions of plants: whatever is not ipp as utility, and exactly those marked utility."""
    c = view(spark, sf, "gen").select("gen_id", F.coalesce(F.expr(CATEGORY), F.lit("")).alias("c"))
    each: Column = F.array_compact(F.array(F.lit("all"), F.when(F.col("c") == "ipp", "ipp").otherwise("utility"), F.when(F.col("c") == "utility", "exact")))
    return c.select("gen_id", F.explode(each).alias("tier"))


@query("ipp_major", sql_with("gen") + f", c AS (SELECT gen_id, coalesce({CATEGORY}, '') AS c, coalesce(fuel, '') AS f, CASE WHEN gen_id % 11 = 0 THEN NULL ELSE mw END AS mw FROM gen) SELECT gen_id, mw FROM c WHERE c = 'ipp' AND NOT (f = 'solar' AND (mw IS NULL OR mw < 10))")
def ipp_major(spark: SparkSession, sf: str) -> DataFrame:
    """Independent producers but for solar of unknown size or under 10 MW."""
    c = view(spark, sf, "gen").withColumns({"c": F.coalesce(F.expr(CATEGORY), F.lit("")), "mw": F.expr("CASE WHEN gen_id % 11 = 0 THEN NULL ELSE mw END")})
    small = (F.coalesce("fuel", F.lit("")) == "solar") & (F.col("mw").isNull() | (F.col("mw") < 10))
    return c.where((F.col("c") == "ipp") & ~small).select("gen_id", "mw")


@query("promoted_names", sql_with("sub") + ", s AS (SELECT sub_id, CASE WHEN sub_id % 3 = 0 THEN name ELSE '' END AS have, concat('Town ', CAST(sub_id % 7 AS VARCHAR)) AS town FROM sub), h AS (SELECT have, count(*) AS n FROM s WHERE have <> '' GROUP BY have), t AS (SELECT town, count(*) AS n FROM s WHERE have = '' GROUP BY town) SELECT sub_id, CASE WHEN s.have <> '' THEN s.have WHEN t.n + coalesce(h.n, 0) > 1 THEN s.town || '_' || CAST(coalesce(h.n, 0) + row_number() OVER (PARTITION BY s.town, s.have = '' ORDER BY sub_id) AS VARCHAR) ELSE s.town END AS name FROM s LEFT JOIN t ON t.town = s.town LEFT JOIN h ON h.have = s.town")
def promoted_names(spark: SparkSession, sf: str) -> DataFrame:
    """Place names for the unnamed; a name used more than once is numbered, counting rows that bear it already first."""
    s = view(spark, sf, "sub").select("sub_id", F.when(F.col("sub_id") % 3 == 0, F.col("name")).otherwise("").alias("have"), F.concat(F.lit("Town "), (F.col("sub_id") % 7).cast("string")).alias("town"))
    h = s.where("have <> ''").groupBy(F.col("have").alias("town")).agg(F.count("*").alias("taken"))
    free = s.where("have = ''")
    t = free.groupBy("town").agg(F.count("*").alias("n"))
    place = F.coalesce("taken", F.lit(0)) + F.row_number().over(Window.partitionBy("town").orderBy("sub_id"))
    named = free.join(t, "town").join(h, "town", "left").select("sub_id", F.when(F.col("n") + F.coalesce("taken", F.lit(0)) > 1, F.concat("town", F.lit("_"), place.cast("string"))).otherwise(F.col("town")).alias("name"))
    return s.where("have <> ''").select("sub_id", F.col("have").alias("name")).union(named)
