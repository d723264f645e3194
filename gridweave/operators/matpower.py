"""Case tables in the MATPOWER layout: buses, generators with voltage support, branches per unit."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Type codes of buses.
PQ, PV, SLACK = 1, 2, 3
#: Smallest voltage (kV) and reactive limit (Mvar) of a synchronous condenser.
CONDENSERS = [(275.0, 500.0), (154.0, 200.0), (110.0, 100.0)]


def dispatch_factors(gens: DataFrame, peaks: DataFrame, load_factor: float, reserve: float) -> DataFrame:
    """region, factor: the share of capacity that meets load and reserve, at most 0.9; half without capacity."""
    cap = gens.groupBy("region").agg(F.sum("mw").alias("cap"))
    load = F.least(F.col("peak_mw") * load_factor, F.col("cap") * 0.8)
    return peaks.join(cap, "region", "left").select("region", F.when(F.col("cap") > 0, F.least(load * (1 + reserve) / F.col("cap"), F.lit(0.9))).otherwise(0.5).alias("factor"))


def bus_table(buses: DataFrame, gens: DataFrame, slacks: DataFrame) -> DataFrame:
    """bus, type, pd, qd, bs, base_kv of buses (bus, kv, pd, qd); a null load counts as none.

    Slack beats generator beats condenser (any bus from 110 kV without a unit); the rest are load buses.
    """
    has = gens.select("bus").distinct().withColumn("has_gen", F.lit(True))
    ref = slacks.select("bus").distinct().withColumn("is_slack", F.lit(True))
    kind = F.when(F.col("is_slack"), SLACK).when(F.col("has_gen") | (F.col("kv") >= CONDENSERS[-1][0]), PV).otherwise(PQ)
    pd = F.coalesce("pd", F.lit(0.0))
    joined = buses.join(has, "bus", "left").join(ref, "bus", "left")
    return joined.select("bus", kind.alias("type"), pd.alias("pd"), F.coalesce("qd", F.lit(0.0)).alias("qd"), F.when(pd > 0, pd * 0.35).otherwise(0.0).alias("bs"), F.col("kv").alias("base_kv"))


def gen_table(buses: DataFrame, gens: DataFrame, slacks: DataFrame, factors: DataFrame) -> DataFrame:
    """bus, kind, pg, qmax, qmin, pmax: units by their region's factor, slack sources, condensers."""
    units = gens.join(factors, "region").select("bus", F.lit("unit").alias("kind"), (F.col("mw") * F.col("factor")).alias("pg"), (F.col("mw") * 0.6).alias("qmax"), (F.col("mw") * -0.3).alias("qmin"), F.col("mw").alias("pmax"))
    wide = slacks.select("bus", F.lit("slack").alias("kind"), F.lit(0.0).alias("pg"), F.lit(9999.0).alias("qmax"), F.lit(-9999.0).alias("qmin"), F.lit(9999.0).alias("pmax"))
    limit = F.lit(None).cast("double")
    for kv, mvar in reversed(CONDENSERS):
        limit = F.when(F.col("kv") >= kv, mvar).otherwise(limit)
    taken = gens.select("bus").union(slacks.select("bus")).distinct()
    free = buses.join(taken, "bus", "left_anti").withColumn("q", limit).where("q IS NOT NULL")
    held = free.select("bus", F.lit("condenser").alias("kind"), F.lit(0.0).alias("pg"), F.col("q").alias("qmax"), (F.col("q") * -0.4).alias("qmin"), F.lit(0.0).alias("pmax"))
    return units.unionByName(wide).unionByName(held)
