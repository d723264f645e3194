"""Queries over the network: equi-joins, audits, aggregates, ordered operators, sets and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.scalars import is_synthetic
from ..operators import graph, relational as R
from .bridge import sql_with, view
from .registry import query


def _buses(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "sub").select(F.col("sub_id").alias("id"), "lat", "lon", "kv", "region")


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    """All links whose ends exist and differ."""
    ids = view(spark, sf, "sub").select("sub_id")
    e = view(spark, sf, "link").select("a", "b")
    return e.join(ids.withColumnRenamed("sub_id", "a"), "a", "left_semi").join(ids.withColumnRenamed("sub_id", "b"), "b", "left_semi").where("a <> b")


EDGES = ", e AS (SELECT a, b FROM link WHERE a <> b AND a IN (SELECT sub_id FROM sub) AND b IN (SELECT sub_id FROM sub))"
COMPONENTS = EDGES + ", r(id, o) AS (SELECT sub_id, sub_id FROM sub UNION SELECT r.id, u.b FROM r JOIN (SELECT a, b FROM e UNION SELECT b, a FROM e) u ON u.a = r.o), c AS (SELECT id, min(o) AS component FROM r GROUP BY id)"


def recursive(*names: str) -> str:
    return sql_with(*names).replace("WITH ", "WITH RECURSIVE ", 1)


@query("line_bus_join", sql_with("line", "sub") + " SELECT line_id, f.kv AS from_kv, t.kv AS to_kv, f.sub_id IS NULL OR t.sub_id IS NULL AS dropped FROM line LEFT JOIN sub f ON f.sub_id = from_sub LEFT JOIN sub t ON t.sub_id = to_sub")
def line_bus_join(spark: SparkSession, sf: str) -> DataFrame:
    s = view(spark, sf, "sub").select("sub_id", "kv")
    f, t = s.select(F.col("sub_id").alias("from_sub"), F.col("kv").alias("from_kv"), F.lit(True).alias("f")), s.select(F.col("sub_id").alias("to_sub"), F.col("kv").alias("to_kv"), F.lit(True).alias("t"))
    return view(spark, sf, "line").select("line_id", "from_sub", "to_sub").join(f, "from_sub", "left").join(t, "to_sub", "left").select("line_id", "from_kv", "to_kv", (F.col("f").isNull() | F.col("t").isNull()).alias("dropped"))


@query("generator_bus_warnings", sql_with("gen", "sub") + " SELECT gen_id, CASE WHEN gen.sub_id IS NULL THEN 'unconnected' WHEN sub.sub_id IS NULL THEN 'unknown' ELSE 'ok' END AS state FROM gen LEFT JOIN sub ON sub.sub_id = gen.sub_id")
def generator_bus_warnings(spark: SparkSession, sf: str) -> DataFrame:
    s = view(spark, sf, "sub").select("sub_id", F.lit(True).alias("known"))
    return view(spark, sf, "gen").select("gen_id", "sub_id").join(s, "sub_id", "left").select("gen_id", F.when(F.col("sub_id").isNull(), "unconnected").when(F.col("known").isNull(), "unknown").otherwise("ok").alias("state"))


@query("reference_warnings", sql_with("line", "sub") + " SELECT line_id, 'from' AS side, from_sub AS missing FROM line WHERE from_sub NOT IN (SELECT sub_id FROM sub) UNION ALL SELECT line_id, 'to', to_sub FROM line WHERE to_sub NOT IN (SELECT sub_id FROM sub)")
def reference_warnings(spark: SparkSession, sf: str) -> DataFrame:
    ids, lines = view(spark, sf, "sub").select("sub_id"), view(spark, sf, "line")
    side = lambda c, n: lines.select("line_id", F.lit(n).alias("side"), F.col(c).alias("missing")).join(ids, F.col("missing") == ids.sub_id, "left_anti")
    return side("from_sub", "from").union(side("to_sub", "to"))


@query("orphan_lines", sql_with("line", "sub") + " SELECT line_id FROM line WHERE from_sub NOT IN (SELECT sub_id FROM sub) OR to_sub NOT IN (SELECT sub_id FROM sub)")
def orphan_lines(spark: SparkSession, sf: str) -> DataFrame:
    return line_bus_join(spark, sf).where("dropped").select("line_id")


@query("isolated_buses", sql_with("link", "sub") + EDGES + " SELECT sub_id FROM sub WHERE sub_id NOT IN (SELECT a FROM e UNION SELECT b FROM e)")
def isolated_buses(spark: SparkSession, sf: str) -> DataFrame:
    e = _edges(spark, sf)
    ends = e.select(F.col("a").alias("sub_id")).union(e.select(F.col("b").alias("sub_id"))).distinct()
    return view(spark, sf, "sub").select("sub_id").join(ends, "sub_id", "left_anti")


@query("isolated_generators", sql_with("gen", "sub") + " SELECT gen_id FROM gen WHERE sub_id IS NULL OR sub_id NOT IN (SELECT sub_id FROM sub)")
def isolated_generators(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "gen").select("gen_id", "sub_id").join(view(spark, sf, "sub").select("sub_id"), "sub_id", "left_anti").select("gen_id")


@query("buses_without_load", sql_with("load", "sub") + " SELECT sub_id FROM sub WHERE sub_id NOT IN (SELECT sub_id FROM load WHERE mw > 400)")
def buses_without_load(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "sub").select("sub_id").join(view(spark, sf, "load").where("mw > 400").select("sub_id").distinct(), "sub_id", "left_anti")


@query("unique_name_join", sql_with("sub", "gen") + ", l AS (SELECT name, min(sub_id) AS sub_id FROM sub GROUP BY name HAVING count(*) = 1), g AS (SELECT concat('Supplier#', lpad(CAST(gen_id % 150 AS VARCHAR), 9, '0')) AS name, gen_id FROM gen), r AS (SELECT name, min(gen_id) AS gen_id FROM g GROUP BY name HAVING count(*) = 1) SELECT l.name, sub_id, gen_id FROM l JOIN r ON l.name = r.name UNION ALL SELECT name, -1, count(*) FROM sub GROUP BY name HAVING count(*) > 1")
def unique_name_join(spark: SparkSession, sf: str) -> DataFrame:
    s = view(spark, sf, "sub").select("name", "sub_id")
    g = view(spark, sf, "gen").select(F.concat(F.lit("Supplier#"), F.lpad((F.col("gen_id") % 150).cast("string"), 9, "0")).alias("name"), "gen_id")
    return R.unique_matches(s, g, "name").select("name", "sub_id", "gen_id").union(s.groupBy("name").agg(F.lit(-1).cast("long"), F.count("*").alias("n")).where("n > 1"))


@query("undirected_pair_lookup", sql_with("line") + ", p AS (SELECT least(from_sub, to_sub) AS a, greatest(from_sub, to_sub) AS b, min(line_id) AS first FROM line GROUP BY 1, 2) SELECT line_id, first, first <> line_id AS shared, (from_sub > to_sub) AS reversed FROM line JOIN p ON a = least(from_sub, to_sub) AND b = greatest(from_sub, to_sub)")
def undirected_pair_lookup(spark: SparkSession, sf: str) -> DataFrame:
    x = view(spark, sf, "line").select("line_id", "from_sub", "to_sub", F.least("from_sub", "to_sub").alias("a"), F.greatest("from_sub", "to_sub").alias("b"))
    return x.join(x.groupBy("a", "b").agg(F.min("line_id").alias("first")), ["a", "b"]).select("line_id", "first", (F.col("first") != F.col("line_id")).alias("shared"), (F.col("from_sub") > F.col("to_sub")).alias("reversed"))


@query("coordinate_hash_join", sql_with("sub") + " SELECT g.sub_id AS from_id, max(sub.sub_id) AS sub_id FROM sub g JOIN sub ON printf('%.4f,%.4f', g.lat, g.lon + CASE WHEN g.sub_id % 3 = 0 THEN 0.00003e0 ELSE 0.001e0 END) = printf('%.4f,%.4f', sub.lat, sub.lon) GROUP BY g.sub_id")
def coordinate_hash_join(spark: SparkSession, sf: str) -> DataFrame:
    """Equal positions to four decimals; of several the last one read, which is the one of the largest number, wins."""
    sub = view(spark, sf, "sub")
    near = F.col("lon") + F.expr("CASE WHEN sub_id % 3 = 0 THEN 0.00003e0 ELSE 0.001e0 END")
    k = sub.select(F.format_string("%.4f,%.4f", "lat", "lon").alias("k"), "sub_id")
    return sub.select(F.col("sub_id").alias("from_id"), F.format_string("%.4f,%.4f", F.col("lat"), near).alias("k")).join(k, "k").groupBy("from_id").agg(F.max("sub_id").alias("sub_id"))


@query("maintenance_interval_join", sql_with("gen") + ", w AS (SELECT gen_id, gen_id % 20 AS s, gen_id % 20 + up AS e FROM gen) SELECT gen_id, CAST(t AS INTEGER) AS t FROM w JOIN range(24) h(t) ON s <= t AND t < e")
def maintenance_interval_join(spark: SparkSession, sf: str) -> DataFrame:
    w = view(spark, sf, "gen").select("gen_id", (F.col("gen_id") % 20).cast("int").alias("s"), (F.col("gen_id") % 20 + F.col("up")).cast("int").alias("e"))
    return w.select("gen_id", F.explode(F.sequence("s", F.least(F.col("e"), F.lit(24)) - 1)).alias("t"))


@query("network_summary", sql_with("sub", "gen", "line") + " SELECT (SELECT count(*) FROM sub) AS substations, (SELECT count(*) FROM line) AS lines, (SELECT count(*) FROM gen) AS generators, (SELECT sum(mw) FROM gen) AS mw")
def network_summary(spark: SparkSession, sf: str) -> DataFrame:
    n = lambda v, k: view(spark, sf, v).agg(F.count("*").alias(k))
    # four rows of one number each meet here
    g = view(spark, sf, "gen").agg(F.count("*").alias("generators"), F.sum("mw").alias("mw"))
    return n("sub", "substations").crossJoin(n("line", "lines")).crossJoin(g)


@query("audit_rollup", sql_with("sub", "gen") + ", u AS (SELECT 'sub' AS layer, region, name = '' OR name LIKE 'sub\\_%' ESCAPE '\\' AS bad FROM sub UNION ALL SELECT 'gen', region, coalesce(fuel, '') = '' FROM gen) SELECT coalesce(layer, 'total') AS layer, coalesce(CAST(region AS VARCHAR), 'all') AS region, count(*) AS n, CAST(sum(CASE WHEN bad THEN 1 ELSE 0 END) AS BIGINT) AS bad FROM u GROUP BY ROLLUP (layer, region)")
def audit_rollup(spark: SparkSession, sf: str) -> DataFrame:
    s = view(spark, sf, "sub").select(F.lit("sub").alias("layer"), "region", is_synthetic(F.col("name")).alias("bad"))
    g = view(spark, sf, "gen").select(F.lit("gen"), "region", F.coalesce("fuel", F.lit("")) == "")
    r = s.union(g).rollup("layer", "region").agg(F.count("*").alias("n"), F.count_if("bad").alias("bad"))
    return r.select(F.coalesce("layer", F.lit("total")).alias("layer"), F.coalesce(F.col("region").cast("string"), F.lit("all")).alias("region"), "n", "bad")


@query("generation_by_fuel", sql_with("gen") + " SELECT coalesce(nullif(trim(fuel), ''), 'unknown') AS fuel, count(*) AS n, round(sum(mw), 2) AS mw FROM gen GROUP BY 1")
def generation_by_fuel(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "gen").groupBy(F.coalesce(F.nullif(F.trim("fuel"), F.lit("")), F.lit("unknown")).alias("fuel")).agg(F.count("*").alias("n"), F.round(F.sum("mw"), 2).alias("mw"))


@query("region_pivot", sql_with("sub", "gen", "line") + " SELECT region, CAST(sum(s) AS BIGINT) AS sub, CAST(sum(g) AS BIGINT) AS gen, CAST(sum(l) AS BIGINT) AS line FROM (SELECT region, 1 AS s, 0 AS g, 0 AS l FROM sub UNION ALL SELECT region, 0, 1, 0 FROM gen UNION ALL SELECT region, 0, 0, 1 FROM line) GROUP BY region")
def region_pivot(spark: SparkSession, sf: str) -> DataFrame:
    u = None
    for v in ("sub", "gen", "line"):
        part = view(spark, sf, v).select("region", F.lit(v).alias("layer"))
        u = part if u is None else u.union(part)
    return u.groupBy("region").pivot("layer", ["sub", "gen", "line"]).count().na.fill(0)


@query("weighted_load_allocation", sql_with("sub") + ", w AS (SELECT sub_id, region, greatest(kv, 0) AS w, sum(greatest(kv, 0)) OVER (PARTITION BY region) AS s, count(*) OVER (PARTITION BY region) AS n FROM sub) SELECT sub_id, round(1000e0 * CASE WHEN s > 0 THEN w / s ELSE 1e0 / n END, 6) AS p, round(1000e0 * CASE WHEN s > 0 THEN w / s ELSE 1e0 / n END * tan(acos(0.95e0)), 6) AS q FROM w")
def weighted_load_allocation(spark: SparkSession, sf: str) -> DataFrame:
    p = R.share(view(spark, sf, "sub"), F.lit(1000.0), F.col("kv"), ["region"], "p")
    return p.select("sub_id", F.round("p", 6).alias("p"), F.round(F.col("p") * F.tan(F.acos(F.lit(0.95))), 6).alias("q"))


@query("generation_scaling", sql_with("gen") + ", s AS (SELECT region, sum(mw) AS s FROM gen GROUP BY region) SELECT gen_id, round(mw * least(3000e0 / s, 1e0), 6) AS p FROM gen JOIN s ON s.region = gen.region")
def generation_scaling(spark: SparkSession, sf: str) -> DataFrame:
    g = view(spark, sf, "gen").select("gen_id", "region", "mw")
    return g.join(g.groupBy("region").agg(F.sum("mw").alias("s")), "region").select("gen_id", F.round(F.col("mw") * F.least(3000.0 / F.col("s"), F.lit(1.0)), 6).alias("p"))


@query("bus_voltage_inference", sql_with("sub", "line") + ", k AS (SELECT id, max(kv) AS kv FROM (SELECT from_sub AS id, kv FROM line UNION ALL SELECT to_sub, kv FROM line) WHERE kv > 0 GROUP BY id), v AS (SELECT sub_id, CASE WHEN sub.kv > 0 THEN sub.kv ELSE k.kv END AS kv FROM sub LEFT JOIN k ON k.id = sub.sub_id) SELECT sub_id, coalesce(kv, (SELECT median(kv) FROM v)) AS kv FROM v")
def bus_voltage_inference(spark: SparkSession, sf: str) -> DataFrame:
    ln = view(spark, sf, "line").where("kv > 0")
    k = ln.select(F.col("from_sub").alias("sub_id"), "kv").union(ln.select("to_sub", "kv")).groupBy("sub_id").agg(F.max("kv").alias("k"))
    v = view(spark, sf, "sub").select("sub_id", "kv").join(k, "sub_id", "left").select("sub_id", F.when(F.col("kv") > 0, F.col("kv")).otherwise(F.col("k")).alias("kv"))
    return v.crossJoin(F.broadcast(v.agg(F.median("kv").alias("m")))).select("sub_id", F.coalesce("kv", "m").alias("kv"))  # one row


@query("parallel_branch_merge", sql_with("line") + ", y AS (SELECT least(from_sub, to_sub) AS a, greatest(from_sub, to_sub) AS b, r / (r * r + x * x) AS g, x / (r * r + x * x) AS s, mva FROM (SELECT *, km * 0.05e0 AS r, km * 0.4e0 AS x FROM line) WHERE r * r + x * x > 1e-12), m AS (SELECT a, b, sum(g) AS g, sum(s) AS s, sum(mva) AS mva, count(*) AS circuits FROM y GROUP BY a, b) SELECT a, b, round(g / (g * g + s * s), 6) AS r, round(s / (g * g + s * s), 6) AS x, mva, circuits FROM m")
def parallel_branch_merge(spark: SparkSession, sf: str) -> DataFrame:
    x = view(spark, sf, "line").select(F.col("from_sub").alias("a"), F.col("to_sub").alias("b"), (F.col("km") * 0.05).alias("r"), (F.col("km") * 0.4).alias("x"), "mva")
    return R.parallel_merged(x).withColumns({"r": F.round("r", 6), "x": F.round("x", 6)})


@query("method_convergence_stats", sql_with("run") + " SELECT method, count(*) AS runs, CAST(sum(CASE WHEN ok THEN 1 ELSE 0 END) AS BIGINT) AS converged, round(100e0 * sum(CASE WHEN ok THEN 1 ELSE 0 END) / count(*), 4) AS rate, round(avg(CASE WHEN ok THEN iterations END), 4) AS iterations FROM run GROUP BY method")
def method_convergence_stats(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "run").groupBy("method").agg(F.count("*").alias("runs"), F.count_if("ok").alias("converged"), F.round(F.lit(100.0) * F.count_if("ok") / F.count("*"), 4).alias("rate"), F.round(F.avg(F.when(F.col("ok"), F.col("iterations"))), 4).alias("iterations"))


@query("interzone_flows", sql_with("line", "sub") + " SELECT f.region AS a, t.region AS b, count(*) AS lines, sum(mva) AS mva FROM line JOIN sub f ON f.sub_id = from_sub JOIN sub t ON t.sub_id = to_sub WHERE f.region <> t.region GROUP BY 1, 2")
def interzone_flows(spark: SparkSession, sf: str) -> DataFrame:
    s = view(spark, sf, "sub").select("sub_id", "region")
    x = view(spark, sf, "line").select("from_sub", "to_sub", "mva").join(s.select(F.col("sub_id").alias("from_sub"), F.col("region").alias("a")), "from_sub").join(s.select(F.col("sub_id").alias("to_sub"), F.col("region").alias("b")), "to_sub")
    return x.where("a <> b").groupBy("a", "b").agg(F.count("*").alias("lines"), F.sum("mva").alias("mva"))


@query("loads_on_buses", sql_with("load") + " SELECT sub_id, kind, count(*) AS n, round(sum(mw), 3) AS mw, round(max(mw), 6) AS peak FROM load GROUP BY sub_id, kind")
def loads_on_buses(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "load").groupBy("sub_id", "kind").agg(F.count("*").alias("n"), F.round(F.sum("mw"), 3).alias("mw"), F.round(F.max("mw"), 6).alias("peak"))


@query("counter_most_common", sql_with("load") + " SELECT kind, count(*) AS n, count(DISTINCT sub_id) AS buses FROM load GROUP BY kind")
def counter_most_common(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "load").groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("sub_id").alias("buses"))


@query("count_comparison", sql_with("sub", "gen") + ", s AS (SELECT region, count(*) AS n FROM sub WHERE kv > 100 GROUP BY region), g AS (SELECT region, count(*) AS n FROM gen WHERE mw > 49 GROUP BY region) SELECT coalesce(s.region, g.region) AS region, coalesce(s.n, 0) AS subs, coalesce(g.n, 0) AS gens, coalesce(s.n, 0) = coalesce(g.n, 0) AS same FROM s FULL OUTER JOIN g ON s.region = g.region")
def count_comparison(spark: SparkSession, sf: str) -> DataFrame:
    s = view(spark, sf, "sub").where("kv > 100").groupBy("region").agg(F.count("*").alias("subs"))
    g = view(spark, sf, "gen").where("mw > 49").groupBy("region").agg(F.count("*").alias("gens"))
    return s.join(g, "region", "full_outer").na.fill(0, ["subs", "gens"]).withColumn("same", F.col("subs") == F.col("gens"))


@query("line_list_multiplicity", sql_with("line") + " SELECT from_sub, region, count(*) AS n, min(line_id) AS first, arg_min(kv, line_id) AS kv FROM line GROUP BY from_sub, region")
def line_list_multiplicity(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "line").groupBy("from_sub", "region").agg(F.count("*").alias("n"), F.min("line_id").alias("first"), F.min_by("kv", "line_id").alias("kv"))


@query("dedup_suffix", sql_with("sub") + " SELECT sub_id, CASE WHEN count(*) OVER (PARTITION BY name) > 1 THEN name || '_' || CAST(row_number() OVER (PARTITION BY name ORDER BY sub_id) AS VARCHAR) ELSE name END AS unique_name FROM sub")
def dedup_suffix(spark: SparkSession, sf: str) -> DataFrame:
    return R.suffixed(view(spark, sf, "sub").select("sub_id", "name"), "name", "sub_id").select("sub_id", "unique_name")


@query("line_name_tiers", sql_with("line", "sub") + ", n AS (SELECT line_id, line.region, line.kv, nullif(f.name, '') AS a, nullif(t.name, '') AS b FROM line LEFT JOIN sub f ON f.sub_id = from_sub LEFT JOIN sub t ON t.sub_id = to_sub), k AS (SELECT *, CASE WHEN a <> b THEN 1 WHEN kv >= 187 THEN 2 ELSE 3 END AS tier FROM n) SELECT line_id, tier, CASE tier WHEN 1 THEN a || '-' || b || ' line' WHEN 2 THEN CAST(CAST(kv AS INTEGER) AS VARCHAR) || 'kV line' ELSE 'R' || CAST(region AS VARCHAR) || ' line ' || CAST(row_number() OVER (PARTITION BY region, tier ORDER BY line_id) AS VARCHAR) END AS name FROM k")
def line_name_tiers(spark: SparkSession, sf: str) -> DataFrame:
    s = view(spark, sf, "sub").select("sub_id", F.nullif(F.col("name"), F.lit("")).alias("name"))
    n = view(spark, sf, "line").join(s.select(F.col("sub_id").alias("from_sub"), F.col("name").alias("a")), "from_sub", "left").join(s.select(F.col("sub_id").alias("to_sub"), F.col("name").alias("b")), "to_sub", "left")
    k = n.withColumn("tier", F.when(F.col("a") != F.col("b"), 1).when(F.col("kv") >= 187, 2).otherwise(3))
    seq = F.row_number().over(Window.partitionBy("region", "tier").orderBy("line_id"))
    name = F.when(F.col("tier") == 1, F.concat("a", F.lit("-"), "b", F.lit(" line"))).when(F.col("tier") == 2, F.concat(F.col("kv").cast("int").cast("string"), F.lit("kV line"))).otherwise(F.concat(F.lit("R"), F.col("region").cast("string"), F.lit(" line "), seq.cast("string")))
    return k.select("line_id", "tier", name.alias("name"))


@query("load_duration", sql_with("load") + " SELECT sub_id, event_id, CAST(row_number() OVER w AS INTEGER) AS rank, round(percent_rank() OVER (PARTITION BY sub_id ORDER BY mw DESC), 6) AS share, round(max(mw) OVER (PARTITION BY sub_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), 6) AS peak_so_far FROM load WINDOW w AS (PARTITION BY sub_id ORDER BY mw DESC, event_id)")
def load_duration(spark: SparkSession, sf: str) -> DataFrame:
    by = Window.partitionBy("sub_id")
    return view(spark, sf, "load").select("sub_id", "event_id", F.row_number().over(by.orderBy(F.desc("mw"), "event_id")).alias("rank"), F.round(F.percent_rank().over(by.orderBy(F.desc("mw"))), 6).alias("share"), F.round(F.max("mw").over(by.orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)), 6).alias("peak_so_far"))


@query("annual_profile", sql_with("run") + " SELECT CAST(month(day) AS INTEGER) AS month, isodow(day) > 5 AS weekend, count(*) AS n, round(avg(mw), 6) AS mean, max(mw) AS peak, min(mw) AS valley, round(100e0 * avg(mw) / max(mw), 4) AS load_factor FROM run GROUP BY 1, 2")
def annual_profile(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "run").groupBy(F.month("day").alias("month"), F.dayofweek("day").isin(1, 7).alias("weekend")).agg(F.count("*").alias("n"), F.round(F.avg("mw"), 6).alias("mean"), F.max("mw").alias("peak"), F.min("mw").alias("valley"), F.round(100.0 * F.avg("mw") / F.max("mw"), 4).alias("load_factor"))


CURVE = "WITH h AS (SELECT range AS h FROM range(8760)), d AS (SELECT h, 0.73e0 + 0.18e0 * cos(2 * pi() * (h % 24 - 16) / 24e0) + 0.06e0 * exp(-0.5e0 * pow((h % 24 - 10) / 3e0, 2)) + 0.18e0 * exp(-0.5e0 * pow((h % 24 - 14) / 1.5e0, 2)) + 0.14e0 * exp(-0.5e0 * pow((h % 24 - 18) / 1.2e0, 2)) AS d, 0.9e0 + greatest(0.1e0 * cos(2 * pi() * (h // 24 % 365 + 1 - 30) / 365e0), 0.1e0 * cos(2 * pi() * (h // 24 % 365 + 1 - 210) / 365e0)) AS s, CASE WHEN (h // 24) % 7 >= 5 THEN 0.9e0 ELSE 1e0 END AS w FROM h)"


@query("load_curve_8760", CURVE + " SELECT CAST(h AS BIGINT) AS h, round(d / (SELECT max(d) FROM d), 6) AS daily, round(s / (SELECT max(s) FROM d), 6) AS seasonal, round(d * s * w / (SELECT max(d * s * w) FROM d), 6) AS multiplier FROM d")
def load_curve_8760(spark: SparkSession, sf: str) -> DataFrame:
    from ..functions.scalars import daily_shape, seasonal_shape, weekend_factor

    h = spark.range(8760).withColumnRenamed("id", "h")
    x = h.withColumns({"daily": daily_shape(F.col("h") % 24), "seasonal": seasonal_shape(F.floor(F.col("h") / 24) % 365 + 1)})
    x = x.withColumn("x", F.col("daily") * F.col("seasonal") * weekend_factor(F.col("h")))
    one = F.broadcast(x.agg(F.max("x").alias("m")))  # one row
    return x.crossJoin(one).select("h", F.round("daily", 6).alias("daily"), F.round("seasonal", 6).alias("seasonal"), F.round(F.col("x") / F.col("m"), 6).alias("multiplier"))


@query("topn_loading", sql_with("line") + " SELECT line_id, mva FROM line ORDER BY mva DESC, line_id LIMIT 20")
def topn_loading(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "line").select("line_id", "mva").orderBy(F.desc("mva"), "line_id").limit(20)


@query("slack_choice", sql_with("gen", "sub") + ", r AS (SELECT sub.region, sub.sub_id, row_number() OVER (PARTITION BY sub.region ORDER BY CASE WHEN sub.sub_id % 17 = 3 THEN 0 WHEN mw IS NOT NULL THEN 1 ELSE 2 END, CASE WHEN sub.sub_id % 17 = 3 THEN 0 ELSE -coalesce(mw, 0) END, sub.sub_id, gen_id) AS k FROM sub LEFT JOIN gen ON gen.sub_id = sub.sub_id) SELECT region, sub_id FROM r WHERE k = 1")
def slack_choice(spark: SparkSession, sf: str) -> DataFrame:
    """A bus marked as slack first, then the bus of the largest connected unit, then the first bus."""
    x = view(spark, sf, "sub").select("region", "sub_id").join(view(spark, sf, "gen").select("sub_id", "mw"), "sub_id", "left")
    marked = F.col("sub_id") % 17 == 3
    rank = F.struct(F.when(marked, 0).when(F.col("mw").isNotNull(), 1).otherwise(2), F.when(marked, 0.0).otherwise(-F.coalesce("mw", F.lit(0.0))), F.col("sub_id"))
    return x.groupBy("region").agg(F.min_by("sub_id", rank).alias("sub_id"))


@query("merge_regions_dedup", sql_with("sub", "gen") + ", u AS (SELECT sub_id AS id, 0 AS o, region FROM sub UNION ALL SELECT gen_id % 500, 1 + gen_id, region FROM gen) SELECT id, arg_min(region, o) AS region, count(*) AS copies FROM u GROUP BY id")
def merge_regions_dedup(spark: SparkSession, sf: str) -> DataFrame:
    u = view(spark, sf, "sub").select(F.col("sub_id").alias("id"), F.lit(0).cast("long").alias("o"), "region").union(view(spark, sf, "gen").select(F.col("gen_id") % 500, 1 + F.col("gen_id"), F.col("region")))
    return R.first_wins(u, ["id"], ["o"]).select("id", "region").join(u.groupBy("id").agg(F.count("*").alias("copies")), "id")


@query("offset_stack", sql_with("sub") + " SELECT sub_id, region, row_number() OVER (ORDER BY region, sub_id) - 1 AS bus FROM sub")
def offset_stack(spark: SparkSession, sf: str) -> DataFrame:
    return R.stacked(view(spark, sf, "sub").select("sub_id", "region"), "region", "sub_id").select("sub_id", "region", "bus")


@query("connected_components", recursive("link", "sub") + COMPONENTS + " SELECT id, component FROM c")
def connected_components(spark: SparkSession, sf: str) -> DataFrame:
    return graph.connected_components(_buses(spark, sf), _edges(spark, sf))


@query("largest_component", recursive("link", "sub") + COMPONENTS + ", z AS (SELECT component, count(*) AS n FROM c GROUP BY component ORDER BY n DESC, component LIMIT 1) SELECT id FROM c WHERE component = (SELECT component FROM z)")
def largest_component(spark: SparkSession, sf: str) -> DataFrame:
    return graph.main_component(connected_components(spark, sf)).select("id")


@query("reconnect_isolated", recursive("link", "sub") + COMPONENTS + ", z AS (SELECT component, count(*) AS n FROM c GROUP BY component ORDER BY n DESC, component LIMIT 1), m AS (SELECT id, component = (SELECT component FROM z) AS main FROM c), p AS (SELECT a.id AS from_id, b.id AS to_id, round(2 * 6371e0 * atan2(sqrt(h), sqrt(1 - h)), 6) AS km FROM (SELECT x.id, y.id AS bid, pow(sin((radians(t.lat) - radians(s.lat)) / 2), 2) + cos(radians(s.lat)) * cos(radians(t.lat)) * pow(sin(radians(t.lon - s.lon) / 2), 2) AS h FROM m x JOIN sub s ON s.sub_id = x.id JOIN m y ON NOT x.main AND y.main JOIN sub t ON t.sub_id = y.id) a JOIN m b ON b.id = a.bid), nn AS (SELECT *, row_number() OVER (PARTITION BY from_id ORDER BY km, to_id) AS k FROM p WHERE km <= 200) SELECT from_id, to_id, km FROM nn WHERE k = 1")
def reconnect_isolated(spark: SparkSession, sf: str) -> DataFrame:
    return graph.reconnect(_buses(spark, sf), connected_components(spark, sf), 200.0)


@query("component_bridging")
def component_bridging(spark: SparkSession, sf: str) -> DataFrame:
    return graph.bridge(_buses(spark, sf), _edges(spark, sf), 150.0)


@query("ybus_coo", sql_with("line") + ", y AS (SELECT from_sub AS a, to_sub AS b, r / (r * r + x * x) AS g, -x / (r * r + x * x) AS s FROM (SELECT *, km * 0.05e0 AS r, km * 0.4e0 AS x FROM line) WHERE r * r + x * x > 1e-12), z AS (SELECT a AS i, a AS j, g, s FROM y UNION ALL SELECT b, b, g, s FROM y UNION ALL SELECT a, b, -g, -s FROM y UNION ALL SELECT b, a, -g, -s FROM y) SELECT i, j, round(sum(g), 4) AS g, round(sum(s), 4) AS b FROM z GROUP BY i, j")
def ybus_coo(spark: SparkSession, sf: str) -> DataFrame:
    x = view(spark, sf, "line").select(F.col("from_sub").alias("a"), F.col("to_sub").alias("b"), (F.col("km") * 0.05).alias("r"), (F.col("km") * 0.4).alias("x"))
    return graph.ybus(x).withColumns({"g": F.round("g", 4), "b": F.round("b", 4)})


@query("attribute_upsert", sql_with("sub") + ", n AS (SELECT sub_id + 50 AS sub_id, CASE WHEN sub_id % 2 = 0 THEN 66e0 END AS kv, sub_id % 3 <> 0 AS has_kv FROM sub WHERE sub_id % 4 < 3) SELECT coalesce(sub.sub_id, n.sub_id) AS sub_id, CASE WHEN has_kv THEN n.kv ELSE sub.kv END AS kv, coalesce(sub.region, -1) AS region FROM sub FULL OUTER JOIN n ON n.sub_id = sub.sub_id")
def attribute_upsert(spark: SparkSession, sf: str) -> DataFrame:
    s = view(spark, sf, "sub").select("sub_id", "kv", "region")
    n = view(spark, sf, "sub").selectExpr("sub_id + 50 AS sub_id", "CASE WHEN sub_id % 2 = 0 THEN 66e0 END AS kv", "sub_id % 3 <> 0 AS has_kv", "sub_id % 4 AS q").where("q < 3")
    return R.upserted(s, n, "sub_id", {"kv": "has_kv"}).withColumn("region", F.coalesce("region", F.lit(-1)))


@query("attribute_delete", sql_with("sub", "gen") + " SELECT sub_id FROM sub WHERE sub_id NOT IN (SELECT gen_id % 40 FROM gen)")
def attribute_delete(spark: SparkSession, sf: str) -> DataFrame:
    return R.deleted(view(spark, sf, "sub").select("sub_id"), view(spark, sf, "gen").select((F.col("gen_id") % 40).alias("sub_id")), "sub_id")
