"""Queries over attributes: parsing, normalising, naming, geometry and distance joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import geo, scalars as S
from ..operators.spatial import largest_within, nearest
from .bridge import sql_with, view
from .registry import query

NUM = "regexp_full_match(trim({0}), '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?')"
OPERATORS = [("East Power Grid", "East Grid Co"), ("East", "East Power"), ("West", "West Power")]


def num(x: str) -> str:
    return f"CASE WHEN {NUM.format(x)} THEN CAST(trim({x}) AS DOUBLE) END"


HAV = "round(2 * 6371e0 * atan2(sqrt({a}), sqrt(1 - {a})), 6)"


def hav(a: str, b: str, c: str, d: str) -> str:
    x = f"(pow(sin((radians({c}) - radians({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2))"
    return HAV.format(a=x)


@query("voltage_parse_first", sql_with("sub") + f", v AS (SELECT sub_id, {num("split_part(replace(trim(voltage), ',', ''), ';', 1)")} AS v FROM sub) SELECT sub_id, CASE WHEN v > 1000 THEN round(v / 1000, 1) WHEN v > 0 THEN round(v, 1) END AS kv FROM v")
def voltage_parse_first(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "sub").select("sub_id", S.voltage_first(F.col("voltage")).alias("kv"))


@query("voltage_parse_zero", sql_with("sub") + f", v AS (SELECT sub_id, {num("split_part(replace(trim(voltage), ',', ''), ';', 1)")} AS v FROM sub) SELECT sub_id, coalesce(CASE WHEN v > 1000 THEN round(v / 1000, 1) WHEN v > 0 THEN round(v, 1) END, 0e0) AS kv FROM v")
def voltage_parse_zero(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "sub").select("sub_id", S.voltage_first(F.col("voltage"), 0.0).alias("kv"))


@query("voltage_parse_max", sql_with("sub") + f", p AS (SELECT sub_id, regexp_replace(trim(unnest(string_split_regex(regexp_replace(lower(trim(voltage)), '^dc', ''), '[;,]'))), '^dc', '') AS p FROM sub WHERE voltage IS NOT NULL), v AS (SELECT sub_id, max(v) AS v FROM (SELECT sub_id, {num('p')} AS v FROM p) WHERE v > 0 GROUP BY sub_id) SELECT sub.sub_id, CASE WHEN v >= 1000 THEN round(v / 1000, 1) ELSE round(v / 1000, 3) END AS kv FROM sub LEFT JOIN v ON v.sub_id = sub.sub_id")
def voltage_parse_max(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "sub").select("sub_id", S.voltage_max(F.col("voltage")).alias("kv"))


CLASSES = "(VALUES (500e0), (275e0), (220e0), (187e0), (154e0), (132e0), (110e0), (77e0), (66e0)) c(c)"


@query("voltage_snap", sql_with("line") + f", v AS (SELECT line_id, kv + km - 100 AS kv, CASE WHEN kv + km - 100 > 600 THEN 500e0 ELSE kv + km - 100 END AS v FROM line) SELECT line_id, CASE WHEN kv > 0 THEN (SELECT c FROM {CLASSES} ORDER BY abs(v - c), c LIMIT 1) ELSE 66e0 END AS class FROM v")
def voltage_snap(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "line").select("line_id", S.nearest_class(F.col("kv") + F.col("km") - 100).alias("class"))


@query("voltage_tolerance_class", sql_with("line") + ", b AS (SELECT unnest([500e0, 275e0, 220e0, 187e0, 154e0, 132e0, 110e0, 77e0, 66e0, 33e0, 22e0, 6.6e0]) AS b), v AS (SELECT line_id, kv + km AS kv FROM line), r AS (SELECT line_id, kv, b, row_number() OVER (PARTITION BY line_id ORDER BY abs(kv - b), b DESC) AS k FROM v, b) SELECT line_id, CASE WHEN abs(kv - b) / b < 0.15e0 THEN b ELSE round(kv, 1) END AS class FROM r WHERE k = 1")
def voltage_tolerance_class(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "line").select("line_id", S.tolerant_class(F.col("kv") + F.col("km")).alias("class"))


STEPS = "CASE " + " ".join(f"WHEN kv + km >= {c} THEN {c}e0" for c in (500, 275, 220, 187, 154, 132, 110, 77, 66)) + " ELSE 0e0 END"


@query("voltage_bracket", sql_with("line") + f" SELECT line_id, {STEPS} AS step, CASE WHEN round_even(kv, 0) IN (500, 275, 220, 187, 154, 132, 110, 77, 66) THEN CAST(round_even(kv, 0) AS INTEGER) ELSE 0 END AS exact FROM line")
def voltage_bracket(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "line").select("line_id", S.step_bracket(F.col("kv") + F.col("km")).alias("step"), S.exact_class(F.col("kv")).alias("exact"))


CAP = ", c AS (SELECT gen_id, lower(replace(replace(trim(capacity), ',', ''), ' ', '')) AS t FROM gen), u AS (SELECT gen_id, CASE WHEN regexp_full_match(t, '[0-9.]+(gw|mw|kw|w)?') THEN CAST(regexp_extract(t, '^([0-9.]+)(gw|mw|kw|w)?$', 1) AS DOUBLE) END AS v, regexp_extract(t, '^([0-9.]+)(gw|mw|kw|w)?$', 2) AS u FROM c)"
UNITS = "CASE u WHEN 'gw' THEN round(v * 1000, 1) WHEN 'mw' THEN round(v, 1) WHEN 'kw' THEN round(v / 1000, 2) WHEN 'w' THEN round(v / 1e6, 3) ELSE {0} END"


@query("capacity_parse_w", sql_with("gen") + CAP + f" SELECT gen_id, {UNITS.format('CASE WHEN v >= 1000 THEN round(v / 1e6, 2) ELSE round(v, 1) END')} AS mw FROM u")
def capacity_parse_w(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "gen").select("gen_id", S.capacity_mw(F.col("capacity")).alias("mw"))


@query("capacity_parse_kw", sql_with("gen") + ", x AS (SELECT gen_id, regexp_extract(capacity, '(?i)([0-9.]+)\\s*(kW|MW|GW)?', 1) AS v, upper(regexp_extract(capacity, '(?i)([0-9.]+)\\s*(kW|MW|GW)?', 2)) AS u FROM (SELECT gen_id, concat('about ', capacity, ' peak') AS capacity FROM gen)), n AS (SELECT gen_id, u, " + num("v") + " AS v FROM x) SELECT gen_id, coalesce(round(CASE u WHEN 'GW' THEN v * 1000 WHEN 'MW' THEN v ELSE v / 1000 END, 3), -1e0) AS mw FROM n")
def capacity_parse_kw(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat(F.lit("about "), F.col("capacity"), F.lit(" peak"))
    return view(spark, sf, "gen").select("gen_id", S.capacity_found(text).alias("mw"))


@query("capacity_parse_plain", sql_with("gen") + ", x AS (SELECT gen_id, replace(replace(capacity, ' MW', ''), ',', '') AS t FROM gen), n AS (SELECT gen_id, " + num("t") + " AS v FROM x) SELECT gen_id, v AS mw FROM n WHERE v > 0")
def capacity_parse_plain(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "gen").select("gen_id", S.capacity_plain(F.col("capacity")).alias("mw")).where("mw IS NOT NULL")


@query("capacity_repair", sql_with("gen") + ", r AS (SELECT gen_id, CASE gen_id % 4 WHEN 0 THEN -1e0 WHEN 1 THEN mw * 1e6 WHEN 2 THEN mw * 1e4 ELSE mw END AS x FROM gen) SELECT gen_id, CASE WHEN x < 0 THEN NULL WHEN x > 1e6 THEN round(x / 1e6, 2) WHEN x > 10000 THEN round(x / 1000, 2) ELSE round(x, 2) END AS mw FROM r")
def capacity_repair(spark: SparkSession, sf: str) -> DataFrame:
    x = F.expr("CASE gen_id % 4 WHEN 0 THEN -1e0 WHEN 1 THEN mw * 1e6 WHEN 2 THEN mw * 1e4 ELSE mw END")
    return view(spark, sf, "gen").select("gen_id", S.capacity_repaired(x).alias("mw"))


def case(pairs: dict[str, str], of: str) -> str:
    return f"CASE {of} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in pairs.items()) + " END"


@query("fuel_normalize", sql_with("gen") + f", k AS (SELECT gen_id, fuel, lower(trim(split_part(fuel, ';', 1))) AS k, lower(trim(coalesce(fuel, ''))) AS w FROM gen) SELECT gen_id, CASE WHEN coalesce(k, '') = '' THEN 'unknown' ELSE coalesce({case(S.FUEL_TAGS, 'k')}, k) END AS tag, coalesce({case(S.FUEL_LISTS, 'w')}, '') AS listed, coalesce({case(S.FUEL_LISTS, 'w')}, 'unknown') AS restored, coalesce({case(S.FUEL_LISTS, 'w')}, w) AS compared, coalesce({case(S.FUEL_MODEL, 'w')}, fuel, 'unknown') AS model FROM k")
def fuel_normalize(spark: SparkSession, sf: str) -> DataFrame:
    """The three normalisations, the second with its three defaults."""
    c = F.col("fuel")
    return view(spark, sf, "gen").select("gen_id", S.fuel_of_tag(c).alias("tag"), S.fuel_of_list(c, "").alias("listed"), S.fuel_of_list(c).alias("restored"), S.fuel_of_list(c, None).alias("compared"), S.fuel_of_model(c).alias("model"))


@query("fuel_type_labels", sql_with("gen") + f", l AS (SELECT gen_id, CASE gen_id % 8 WHEN 0 THEN '石炭' WHEN 1 THEN ' LNG ' WHEN 2 THEN 'LNG' WHEN 3 THEN '揚水' WHEN 4 THEN 'Solar' WHEN 5 THEN '液化天然ガス' WHEN 6 THEN '火力' ELSE 'mixed' END AS l FROM gen) SELECT gen_id, CASE WHEN lower(trim(l)) IN ({', '.join(repr(t) for t in S.FUEL_TYPES)}) THEN lower(trim(l)) ELSE coalesce({case(S.FUEL_LABELS, 'l')}, 'unknown') END AS fuel FROM l")
def fuel_type_labels(spark: SparkSession, sf: str) -> DataFrame:
    label = F.expr("CASE gen_id % 8 WHEN 0 THEN '石炭' WHEN 1 THEN ' LNG ' WHEN 2 THEN 'LNG' WHEN 3 THEN '揚水' WHEN 4 THEN 'Solar' WHEN 5 THEN '液化天然ガス' WHEN 6 THEN '火力' ELSE 'mixed' END")
    return view(spark, sf, "gen").select("gen_id", S.fuel_type(label).alias("fuel"))


THERMAL = "CASE " + " ".join(f"WHEN contains(n, '{w}') THEN '{k}'" for k, ws in S.THERMAL_NAMES for w in ws) + " " + " ".join(f"WHEN contains(b, '{w}') OR contains(n, '{w}') THEN '{k}'" for w, k in S.BURNING.items()) + " ELSE 'gas' END"


@query("thermal_subclass", sql_with("gen") + f", t AS (SELECT gen_id, CASE gen_id % 6 WHEN 0 THEN '石炭専焼' WHEN 1 THEN '混焼' WHEN 2 THEN '天然ガス' WHEN 3 THEN '軽油' WHEN 4 THEN '重油' ELSE '' END AS b, CASE gen_id % 5 WHEN 0 THEN 'Coal One' WHEN 1 THEN '新LNG発電所' WHEN 2 THEN '石油火力' ELSE label END AS n FROM gen) SELECT gen_id, {THERMAL} AS fuel FROM t")
def thermal_subclass(spark: SparkSession, sf: str) -> DataFrame:
    b = F.expr("CASE gen_id % 6 WHEN 0 THEN '石炭専焼' WHEN 1 THEN '混焼' WHEN 2 THEN '天然ガス' WHEN 3 THEN '軽油' WHEN 4 THEN '重油' ELSE '' END")
    n = F.expr("CASE gen_id % 5 WHEN 0 THEN 'Coal One' WHEN 1 THEN '新LNG発電所' WHEN 2 THEN '石油火力' ELSE label END")
    return view(spark, sf, "gen").select("gen_id", S.thermal_fuel(b, n).alias("fuel"))


@query("fuel_by_keyword", sql_with("gen") + ", l AS (SELECT gen_id, lower(label) AS l FROM gen) SELECT gen_id, CASE " + " ".join("WHEN " + " OR ".join(f"contains(l, '{w}')" for w in ws) + f" THEN '{c}'" for c, ws in S.FUEL_KEYWORDS) + " ELSE 'unknown' END AS fuel FROM l")
def fuel_by_keyword(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "gen").select("gen_id", S.fuel_by_keyword(F.col("label")).alias("fuel"))


@query("operator_normalize", sql_with("sub") + " SELECT sub_id, CASE WHEN trim(o) = '' THEN NULL ELSE o END AS operator FROM (SELECT sub_id, CASE " + " ".join(f"WHEN operator = '{b}' THEN '{b}'" for _, b in OPERATORS) + " " + " ".join(f"WHEN starts_with(operator, '{a}') THEN '{b}'" for a, b in OPERATORS) + " ELSE operator END AS o FROM sub)")
def operator_normalize(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "sub").select("sub_id", S.operator_name(F.col("operator"), OPERATORS + [(b, b) for _, b in OPERATORS]).alias("operator"))


@query("display_name", sql_with("sub") + " SELECT sub_id, coalesce(CASE WHEN trim(name) <> '' THEN name END, CASE WHEN trim(operator) <> '' THEN operator END, concat('sub_', CAST(sub_id AS STRING))) AS shown, name IS NULL OR trim(name) = '' OR regexp_matches(name, '^(plant|sub|line)_[0-9]+$') AS synthetic FROM sub")
def display_name(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "sub").select("sub_id", S.display_name(F.col("name"), F.col("operator"), F.concat(F.lit("sub_"), F.col("sub_id").cast("string"))).alias("shown"), S.is_synthetic(F.col("name")).alias("synthetic"))


@query("name_builder", sql_with("sub") + ", p AS (SELECT sub_id, lat, lon, CASE WHEN trim(name) <> '' THEN name END AS a, CASE WHEN trim(operator) <> '' THEN operator END AS t FROM sub) SELECT sub_id, coalesce(CASE WHEN a IS NOT NULL AND t IS NOT NULL AND a <> t THEN t || a ELSE coalesce(a, t) END || ' substation', 'place_' || printf('%.4f', lat) || '_' || printf('%.4f', lon)) AS name FROM p")
def name_builder(spark: SparkSession, sf: str) -> DataFrame:
    fallback = F.format_string("place_%.4f_%.4f", "lat", "lon")
    return view(spark, sf, "sub").select("sub_id", S.place_name(F.col("name"), F.col("operator"), " substation", fallback).alias("name"))


@query("scan_min_kv", sql_with("line") + " SELECT line_id, region, kv FROM line WHERE kv >= 154 AND region = 7")
def scan_min_kv(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "line").where("kv >= 154 AND region = 7").select("line_id", "region", "kv")


@query("bbox_filter", sql_with("sub") + " SELECT sub_id FROM sub WHERE lat BETWEEN 33.5e0 AND 36e0 AND lon BETWEEN 131e0 AND 133e0")
def bbox_filter(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "sub").where(geo.within(F.col("lat"), F.col("lon"), (33.5, 36.0, 131.0, 133.0))).select("sub_id")


@query("bbox_tiles", sql_with("sub") + ", b AS (SELECT region, min(lat) AS a, max(lat) AS b, min(lon) AS c, max(lon) AS d FROM sub GROUP BY region) SELECT region, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(c + (d - c) / 3 * j, 6) AS lon_min, round(a + (b - a) / 2 * i, 6) AS lat_min FROM b, range(2) r(i), range(3) s(j)")
def bbox_tiles(spark: SparkSession, sf: str) -> DataFrame:
    b = view(spark, sf, "sub").groupBy("region").agg(F.min("lat").alias("a"), F.max("lat").alias("b"), F.min("lon").alias("c"), F.max("lon").alias("d"))
    t = b.select("region", F.explode(geo.tiles(F.col("a"), F.col("b"), F.col("c"), F.col("d"), 2, 3)).alias("t"))
    return t.select("region", F.col("t.row").alias("i"), F.col("t.col").alias("j"), F.round("t.lon_min", 6).alias("lon_min"), F.round("t.lat_min", 6).alias("lat_min"))


@query("viable_generators", sql_with("gen") + " SELECT gen_id, mw FROM gen WHERE mw >= 10 AND NOT (coalesce(fuel, '') = 'solar' AND mw < 30)")
def viable_generators(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "gen").where((F.col("mw") >= 10) & ~((F.coalesce("fuel", F.lit("")) == "solar") & (F.col("mw") < 30))).select("gen_id", "mw")


@query("text_search", sql_with("gen") + " SELECT gen_id, label FROM gen WHERE contains(lower(label), 'dam 1')")
def text_search(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "gen").where(F.contains(F.lower("label"), F.lit("dam 1"))).select("gen_id", "label")


@query("validation_violations", sql_with("gen", "sub") + " SELECT 'gen' AS kind, gen_id AS id, 'capacity_unparsed' AS rule FROM gen WHERE capacity = 'unknown' UNION ALL SELECT 'gen', gen_id, 'no_substation' FROM gen WHERE sub_id IS NULL UNION ALL SELECT 'gen', gen_id, 'no_fuel' FROM gen WHERE coalesce(fuel, '') = '' UNION ALL SELECT 'sub', sub_id, 'no_name' FROM sub WHERE name = '' UNION ALL SELECT 'sub', sub_id, 'no_voltage' FROM sub WHERE kv <= 0")
def validation_violations(spark: SparkSession, sf: str) -> DataFrame:
    def broken(df: DataFrame, kind: str, key: str, rules: dict[str, str]) -> DataFrame:
        names = F.array_compact(F.array(*(F.when(F.expr(e), r) for r, e in rules.items())))
        return df.select(F.lit(kind).alias("kind"), F.col(key).alias("id"), F.explode(names).alias("rule"))

    g = broken(view(spark, sf, "gen"), "gen", "gen_id", {"capacity_unparsed": "capacity = 'unknown'", "no_substation": "sub_id IS NULL", "no_fuel": "coalesce(fuel, '') = ''"})
    return g.union(broken(view(spark, sf, "sub"), "sub", "sub_id", {"no_name": "name = ''", "no_voltage": "kv <= 0"}))


def _points(left: DataFrame, key: str, side: str) -> DataFrame:
    return left.select(F.col(key), F.col("lat").alias(f"{side}lat"), F.col("lon").alias(f"{side}lon"))


def _sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return _points(view(spark, sf, "gen"), "gen_id", "l"), _points(view(spark, sf, "sub"), "sub_id", "r")


NEAR = ", p AS (SELECT gen_id, sub.sub_id, {d} AS km FROM gen, sub), r AS (SELECT *, row_number() OVER (PARTITION BY gen_id ORDER BY km, sub_id) AS k FROM p WHERE km <= {m}) SELECT gen_id, sub_id, km FROM r WHERE k = 1"
PLANAR = "round(sqrt(pow(gen.lat - sub.lat, 2) + pow(gen.lon - sub.lon, 2)) * 111e0, 6)"


@query("nearest_haversine_50km", sql_with("gen", "sub") + NEAR.format(d=hav("gen.lat", "gen.lon", "sub.lat", "sub.lon"), m=50))
def nearest_haversine_50km(spark: SparkSession, sf: str) -> DataFrame:
    left, right = _sides(spark, sf)
    return nearest(left, "gen_id", right, "sub_id", 50.0)


@query("nearest_planar", sql_with("gen", "sub") + NEAR.format(d=PLANAR, m=30))
def nearest_planar(spark: SparkSession, sf: str) -> DataFrame:
    left, right = _sides(spark, sf)
    return nearest(left, "gen_id", right, "sub_id", 30.0, "planar")


@query("voltage_infer_range_max", sql_with("gen", "sub") + f" SELECT gen_id, max(kv) AS kv FROM (SELECT gen_id, sub.kv, {hav('gen.lat', 'gen.lon', 'sub.lat', 'sub.lon')} AS km FROM gen, sub WHERE kv >= 10) WHERE km <= 20 GROUP BY gen_id")
def voltage_infer_range_max(spark: SparkSession, sf: str) -> DataFrame:
    left, _ = _sides(spark, sf)
    right = view(spark, sf, "sub").where("kv >= 10").select("kv", F.col("lat").alias("rlat"), F.col("lon").alias("rlon"))
    return largest_within(left, "gen_id", right, "kv", 20.0)


@query("fill_from_nearest", sql_with("gen", "sub") + f", p AS (SELECT gen_id, sub.sub_id, sub.operator, {hav('gen.lat', 'gen.lon', 'sub.lat', 'sub.lon')} AS km FROM gen, sub), r AS (SELECT *, row_number() OVER (PARTITION BY gen_id ORDER BY km, sub_id) AS k FROM p WHERE km <= 15) SELECT gen.gen_id, coalesce(CASE WHEN trim(fuel) <> '' THEN fuel END, operator) AS filled, round(km, 3) AS km FROM gen LEFT JOIN (SELECT * FROM r WHERE k = 1) r ON r.gen_id = gen.gen_id")
def fill_from_nearest(spark: SparkSession, sf: str) -> DataFrame:
    left, right = _sides(spark, sf)
    m = nearest(left, "gen_id", right, "sub_id", 15.0).join(view(spark, sf, "sub").select("sub_id", "operator"), "sub_id")
    return view(spark, sf, "gen").select("gen_id", "fuel").join(m, "gen_id", "left").select("gen_id", F.coalesce(S.blank_to_null(F.col("fuel")), "operator").alias("filled"), F.round("km", 3).alias("km"))


@query("haversine_pairs", sql_with("line", "sub") + f" SELECT line_id, {hav('f.lat', 'f.lon', 't.lat', 't.lon')} AS km FROM line JOIN sub f ON f.sub_id = from_sub JOIN sub t ON t.sub_id = to_sub")
def haversine_pairs(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.graph import end_distance

    buses = view(spark, sf, "sub").select(F.col("sub_id").alias("id"), "lat", "lon")
    lines = view(spark, sf, "line").select("line_id", F.col("from_sub").alias("a"), F.col("to_sub").alias("b"))
    return end_distance(buses, lines).select("line_id", F.round("km", 6).alias("km"))


PTS = ", p AS (SELECT region, sub_id, lat, lon, lag(lat) OVER w AS la, lag(lon) OVER w AS lo FROM sub WINDOW w AS (PARTITION BY region ORDER BY sub_id))"


def _chains(spark: SparkSession, sf: str) -> DataFrame:
    s = view(spark, sf, "sub")
    return s.groupBy("region").agg(F.sort_array(F.collect_list(F.struct("sub_id", "lat", "lon"))).alias("p"))


@query("polyline_length", sql_with("sub") + PTS + " SELECT region, round(coalesce(sum(" + hav("la", "lo", "lat", "lon").removeprefix("round(").removesuffix(", 6)") + "), 0), 4) AS km FROM p GROUP BY region")
def polyline_length(spark: SparkSession, sf: str) -> DataFrame:
    return _chains(spark, sf).select("region", F.round(geo.polyline_km(F.col("p")), 4).alias("km"))


@query("vertex_mean_centroid", sql_with("sub") + " SELECT region, round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon FROM sub GROUP BY region")
def vertex_mean_centroid(spark: SparkSession, sf: str) -> DataFrame:
    c = _chains(spark, sf).select("region", geo.centroid(F.col("p")).alias("c"))
    return c.select("region", F.round("c.lat", 6).alias("lat"), F.round("c.lon", 6).alias("lon"))


@query("vertex_thinning", sql_with("sub") + ", p AS (SELECT region, sub_id, row_number() OVER (PARTITION BY region ORDER BY sub_id) - 1 AS i, count(*) OVER (PARTITION BY region) AS n FROM sub) SELECT region, sub_id FROM p WHERE n <= 4 OR i % 3 = 0 OR i = n - 1")
def vertex_thinning(spark: SparkSession, sf: str) -> DataFrame:
    return _chains(spark, sf).select("region", F.explode(geo.thinned(F.col("p"))).alias("p")).select("region", "p.sub_id")


@query("rdp_simplify")
def rdp_simplify(spark: SparkSession, sf: str) -> DataFrame:
    coords = F.transform("p", lambda x: F.struct(x["lat"].alias("lat"), x["lon"].alias("lon")))
    return _chains(spark, sf).select("region", geo.simplified(coords, 0.5).alias("p")).select("region", F.posexplode("p").alias("i", "p")).select("region", "i", "p.lat", "p.lon")


@query("dms_parts", sql_with("sub") + ", p AS (SELECT sub_id, lat, floor(lat) AS d, floor((lat - floor(lat)) * 60) AS m FROM sub) SELECT sub_id, CAST(d AS INTEGER) AS d, CAST(m AS INTEGER) AS m, round((lat - d - m / 60e0) * 3600, 4) AS s, round(d + m / 60e0 + round((lat - d - m / 60e0) * 3600, 4) / 3600e0, 6) AS back FROM p")
def dms_parts(spark: SparkSession, sf: str) -> DataFrame:
    p = view(spark, sf, "sub").select("sub_id", S.decimal_to_dms(F.col("lat")).alias("x")).select("sub_id", "x.*")
    return p.withColumn("back", F.round(S.dms_to_decimal(F.col("d"), F.col("m"), F.col("s")), 6))


@query("per_unit_branches", sql_with("line") + ", z AS (SELECT line_id, kv * kv / 100e0 AS z, km * 0.05e0 AS r, km * 0.4e0 AS x FROM line), p AS (SELECT line_id, z, r, greatest(x / z, 0.005e0) AS x FROM z) SELECT line_id, round(greatest(r / z, x * 0.05e0), 8) AS r, round(x, 8) AS x FROM p")
def per_unit_branches(spark: SparkSession, sf: str) -> DataFrame:
    p = S.per_unit(F.col("km") * 0.05, F.col("km") * 0.4, F.col("kv"))
    return view(spark, sf, "line").select("line_id", p.alias("p")).select("line_id", F.round("p.r", 8).alias("r"), F.round("p.x", 8).alias("x"))


@query("electrical_scalars", sql_with("line") + " SELECT line_id, round((1e0 + km) * 1e-6 / (2 * pi() * 50) * 1e9, 6) AS nf, round(tan(acos(0.8e0 + km / 200e0)), 6) AS tan_phi, CASE WHEN kv >= 275 THEN 800e0 WHEN kv >= 154 THEN 400e0 WHEN kv >= 110 THEN 200e0 ELSE 100e0 END AS mva, least(greatest(km, 2e0), 20e0) AS clamped, CASE WHEN mva >= 100 THEN 'red' WHEN mva >= 80 THEN 'orange' WHEN mva >= 50 THEN 'yellow' ELSE 'green' END AS color, round(km * 24 * 5 * 80 / 1048576e0, 6) AS mb FROM line")
def electrical_scalars(spark: SparkSession, sf: str) -> DataFrame:
    x = view(spark, sf, "line")
    return x.select("line_id", F.round(S.capacitance_nf(1.0 + F.col("km"), 50.0), 6).alias("nf"), F.round(S.tan_phi(0.8 + F.col("km") / 200.0), 6).alias("tan_phi"), S.transformer_mva(F.col("kv")).alias("mva"), S.clamp(F.col("km"), 2.0, 20.0).alias("clamped"), S.loading_color(F.col("mva")).alias("color"), F.round(S.problem_mb(F.col("km"), F.lit(24)), 6).alias("mb"))


@query("escaped_text", "SELECT doc_id, replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS html, CASE WHEN regexp_matches(text, '[\",\\r\\n]') THEN '\"' || replace(text, '\"', '\"\"') || '\"' ELSE text END AS csv FROM documents")
def escaped_text(spark: SparkSession, sf: str) -> DataFrame:
    d = spark.read.parquet(f"{sf}/documents.parquet")
    return d.select("doc_id", S.html_escaped(F.col("text")).alias("html"), S.csv_escaped(F.col("text")).alias("csv"))
