"""Queries that repair or synthesise parts of the network, and small reports."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import geo
from ..kernels.curves import cubic
from ..operators import commitment as C, graph, powerflow as P, relational as R
from .bridge import sql_with, view
from .commitment import _grid, uc_schedule
from .network import COMPONENTS, _buses, _edges, recursive
from .registry import query

MAIN = COMPONENTS + ", z AS (SELECT component, count(*) AS n FROM c GROUP BY component ORDER BY n DESC, component LIMIT 1), m AS (SELECT id FROM c WHERE component = (SELECT component FROM z))"


def main_ids(spark: SparkSession, sf: str) -> DataFrame:
    return graph.main_component(graph.connected_components(_buses(spark, sf), _edges(spark, sf))).select("id")


@query("deactivate_isolated", recursive("line", "link", "sub", "gen") + MAIN + " SELECT 'bus' AS kind, sub_id AS id, sub_id IN (SELECT id FROM m) AS in_service FROM sub UNION ALL SELECT 'line', line_id, from_sub IN (SELECT id FROM m) AND to_sub IN (SELECT id FROM m) FROM line UNION ALL SELECT 'gen', gen_id, coalesce(sub_id, -1) IN (SELECT id FROM m) FROM gen")
def deactivate_isolated(spark: SparkSession, sf: str) -> DataFrame:
    m = main_ids(spark, sf)
    flag = lambda df, key, kind, *on: _flagged(df, m, key, kind, on)
    return flag(view(spark, sf, "sub"), "sub_id", "bus", "sub_id").union(flag(view(spark, sf, "line"), "line_id", "line", "from_sub", "to_sub")).union(flag(view(spark, sf, "gen"), "gen_id", "gen", "sub_id"))


def _flagged(df: DataFrame, m: DataFrame, key: str, kind: str, on: tuple[str, ...]) -> DataFrame:
    ok = F.lit(True)
    df = df.select(F.col(key).alias("_id"), *[F.col(c).alias(f"_{c}") for c in on])
    for c in on:
        df = df.join(m.select(F.col("id").alias(f"_{c}"), F.lit(True).alias(f"_ok_{c}")), f"_{c}", "left")
        ok = ok & F.coalesce(f"_ok_{c}", F.lit(False))
    return df.select(F.lit(kind).alias("kind"), F.col("_id").alias("id"), ok.alias("in_service"))


@query("simplify_network", recursive("line", "link", "sub") + MAIN + " SELECT line_id, from_sub, to_sub FROM line WHERE from_sub IN (SELECT id FROM m) AND to_sub IN (SELECT id FROM m) AND from_sub <> to_sub AND km > 0")
def simplify_network(spark: SparkSession, sf: str) -> DataFrame:
    m = main_ids(spark, sf)
    x = view(spark, sf, "line").where("from_sub <> to_sub AND km > 0").select("line_id", "from_sub", "to_sub")
    return x.join(m.withColumnRenamed("id", "from_sub"), "from_sub", "left_semi").join(m.withColumnRenamed("id", "to_sub"), "to_sub", "left_semi").select("line_id", "from_sub", "to_sub")


@query("unsupplied_buses", recursive("link", "sub") + COMPONENTS + ", x AS (SELECT DISTINCT component FROM c WHERE id % 10 = 0) SELECT id FROM c WHERE component NOT IN (SELECT component FROM x)")
def unsupplied_buses(spark: SparkSession, sf: str) -> DataFrame:
    c = graph.connected_components(_buses(spark, sf), _edges(spark, sf))
    return c.join(c.where("id % 10 = 0").select("component").distinct(), "component", "left_anti").select("id")


JITTER = "(0.9e0 + CAST((sub_id * 7919) % 1000 AS DOUBLE) / 5e3)"


@query("load_synthesis", sql_with("sub") + f", w AS (SELECT sub_id, region, greatest(kv, 1) * {JITTER} AS w FROM sub) SELECT sub_id, round(500e0 * w / sum(w) OVER (PARTITION BY region), 6) AS p FROM w")
def load_synthesis(spark: SparkSession, sf: str) -> DataFrame:
    w = F.greatest("kv", F.lit(1.0)) * F.expr(JITTER)
    return R.share(view(spark, sf, "sub"), F.lit(500.0), w, ["region"], "p").select("sub_id", F.round("p", 6).alias("p"))


@query("generation_synthesis", sql_with("gen") + ", s AS (SELECT region, sum(mw) AS s FROM gen GROUP BY region) SELECT gen_id, round(least(greatest(mw * 2000e0 / s * (0.95e0 + CAST((gen_id * 31) % 1000 AS DOUBLE) / 1e4), 0), mw), 6) AS p FROM gen JOIN s ON s.region = gen.region")
def generation_synthesis(spark: SparkSession, sf: str) -> DataFrame:
    g = view(spark, sf, "gen").select("gen_id", "region", "mw")
    p = F.col("mw") * 2000.0 / F.col("s") * F.expr("0.95e0 + CAST((gen_id * 31) % 1000 AS DOUBLE) / 1e4")
    return g.join(g.groupBy("region").agg(F.sum("mw").alias("s")), "region").select("gen_id", F.round(F.least(F.greatest(p, F.lit(0.0)), F.col("mw")), 6).alias("p"))


@query("needs_enrichment", sql_with("gen", "sub") + " SELECT gen_id FROM gen LEFT JOIN sub ON sub.sub_id = gen.sub_id WHERE coalesce(fuel, '') = '' OR coalesce(sub.name, '') = '' OR coalesce(trim(sub.operator), '') = ''")
def needs_enrichment(spark: SparkSession, sf: str) -> DataFrame:
    s = view(spark, sf, "sub").select("sub_id", "name", F.trim("operator").alias("operator"))
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    return view(spark, sf, "gen").select("gen_id", "fuel", "sub_id").join(s, "sub_id", "left").where(blank(F.col("fuel")) | blank(F.col("name")) | blank(F.col("operator"))).select("gen_id")


@query("name_contains_join", sql_with("gen") + ", k AS (SELECT * FROM (VALUES ('dam', 1), ('park', 2), ('plant', 3)) k(word, code)) SELECT gen_id, max(code) AS code FROM gen JOIN k ON contains(lower(label), word) GROUP BY gen_id")
def name_contains_join(spark: SparkSession, sf: str) -> DataFrame:
    k = F.broadcast(spark.createDataFrame([("dam", 1), ("park", 2), ("plant", 3)], "word string, code int"))  # three rows
    return view(spark, sf, "gen").join(k, F.contains(F.lower("label"), F.col("word"))).groupBy("gen_id").agg(F.max("code").alias("code"))


@query("slim_geometry", sql_with("sub") + ", p AS (SELECT region, sub_id, round(lat, 4) AS lat, round(lon, 4) AS lon, row_number() OVER (PARTITION BY region ORDER BY sub_id) - 1 AS i, count(*) OVER (PARTITION BY region) AS n FROM sub) SELECT region, lat, lon FROM p WHERE n <= 4 OR i % 3 = 0 OR i = n - 1")
def slim_geometry(spark: SparkSession, sf: str) -> DataFrame:
    c = view(spark, sf, "sub").groupBy("region").agg(F.sort_array(F.collect_list(F.struct("sub_id", "lat", "lon"))).alias("p"))
    return c.select("region", F.explode(geo.rounded(geo.thinned(F.col("p")), 4)).alias("p")).select("region", "p.lat", "p.lon")


@query("storage_cycles", sql_with("run") + " SELECT unit, round(sum(CASE WHEN ok THEN mw ELSE 0e0 END), 6) AS charge, round(sum(CASE WHEN ok THEN 0e0 ELSE mw END) / 100e0, 6) AS cycles FROM run GROUP BY unit")
def storage_cycles(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "run").groupBy("unit").agg(F.round(F.sum(F.when(F.col("ok"), F.col("mw")).otherwise(0.0)), 6).alias("charge"), F.round(F.sum(F.when(F.col("ok"), 0.0).otherwise(F.col("mw"))) / 100.0, 6).alias("cycles"))


@query("transformer_lines", sql_with("line", "sub") + " SELECT line_id, CASE WHEN greatest(f.kv, t.kv) >= 275 THEN 800e0 WHEN greatest(f.kv, t.kv) >= 154 THEN 400e0 WHEN greatest(f.kv, t.kv) >= 110 THEN 200e0 ELSE 100e0 END AS mva FROM line JOIN sub f ON f.sub_id = from_sub JOIN sub t ON t.sub_id = to_sub WHERE least(f.kv, t.kv) > 0 AND greatest(f.kv, t.kv) / least(f.kv, t.kv) >= 1.5e0")
def transformer_lines(spark: SparkSession, sf: str) -> DataFrame:
    from ..functions.scalars import transformer_mva

    s = view(spark, sf, "sub").select("sub_id", "kv")
    x = view(spark, sf, "line").select("line_id", "from_sub", "to_sub").join(s.select(F.col("sub_id").alias("from_sub"), F.col("kv").alias("a")), "from_sub").join(s.select(F.col("sub_id").alias("to_sub"), F.col("kv").alias("b")), "to_sub")
    high, low = F.greatest("a", "b"), F.least("a", "b")
    return x.where(low > 0).where(high / low >= 1.5).select("line_id", transformer_mva(high).alias("mva"))


@query("duplicate_ids", sql_with("gen", "sub") + " SELECT id, count(*) AS n FROM (SELECT sub_id AS id FROM sub UNION ALL SELECT gen_id FROM gen) GROUP BY id HAVING count(*) > 1")
def duplicate_ids(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "sub").select(F.col("sub_id").alias("id")).union(view(spark, sf, "gen").select("gen_id")).groupBy("id").agg(F.count("*").alias("n")).where("n > 1")


@query("spline_30min")
def spline_30min(spark: SparkSession, sf: str) -> DataFrame:
    """Each substation's hourly mean load, wrapped around the day and interpolated to half hours."""
    hourly = view(spark, sf, "load").groupBy("kind", F.hour("ts").alias("h")).agg(F.avg("mw").alias("mw"))

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf.set_index("h").mw.reindex(range(24)).interpolate(limit_direction="both").to_numpy()
        v = cubic(np.arange(25.0), np.r_[y, y[0]], np.arange(48) / 2)
        return pd.DataFrame({"kind": pdf.kind.iloc[0], "slot": range(48), "mw": np.round(v, 6)})

    return hourly.groupBy("kind").applyInPandas(fill, "kind string, slot int, mw double")


@query("timestep_powerflow")
def timestep_powerflow(spark: SparkSession, sf: str) -> DataFrame:
    """Angles of the linear flow for every hour: one solve per region, scaled by the hour's factor."""
    from ..functions.scalars import daily_shape

    one = P.solve_dc(*_grid(spark, sf))
    hours = F.explode(F.sequence(F.lit(0), F.lit(23)))
    return one.withColumn("t", hours).select("region", "id", "t", F.round(F.col("va_deg") * daily_shape(F.col("t")), 6).alias("va_deg"))


@query("uc_summary")
def uc_summary(spark: SparkSession, sf: str) -> DataFrame:
    return C.merged_status(uc_schedule(spark, sf))


@query("angle_pruning")
def angle_pruning(spark: SparkSession, sf: str) -> DataFrame:
    """AC flow after dropping buses whose linear angle passes a limit: the widest limit that converges, per region."""
    # stored once: three attempts read them
    buses, branches = map(graph.shared_table, _grid(spark, sf))
    angles = graph.shared_table(P.solve_dc(buses, branches))
    out = None
    for rank, limit in enumerate((45.0, 30.0, 20.0)):
        keep = angles.where(F.abs("va_deg") <= limit).select(F.col("region").alias("kept_region"), F.col("id").alias("kept"))
        solved = P.solve(buses.join(keep, (F.col("region") == F.col("kept_region")) & (F.col("id") == F.col("kept")), "left_semi"), branches, ["newton"])
        one = solved.groupBy("region").agg(F.first("converged").alias("ok"), F.count("*").alias("buses")).select("region", F.lit(rank).alias("rank"), F.lit(limit).alias("limit"), "ok", "buses")
        out = one if out is None else out.union(one)
    return R.first_wins(out.where("ok"), ["region"], ["rank"]).select("region", "limit", "buses")
