"""Unit-commitment tables: checks of every rule as relational queries, dispatch, decomposition, solving."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..kernels.commitment import schedule


def in_time():
    return Window.partitionBy("unit").orderBy("t")


def edges(schedule: DataFrame) -> DataFrame:
    """Adds v (started) and w (stopped) to (unit, t, u); every unit is off before the first period."""
    was = F.lag("u", 1, 0).over(in_time())
    return schedule.withColumns({"v": ((F.col("u") == 1) & (was == 0)).cast("int"), "w": ((F.col("u") == 0) & (was == 1)).cast("int")})


def min_time_violations(schedule: DataFrame) -> DataFrame:
    """Runs of equal state (unit, start, periods, u) shorter than min_up or min_down; the last run may be cut by the horizon."""
    change = (F.col("u") != F.lag("u", 1, -1).over(in_time())).cast("int")
    run = F.sum("c").over(in_time())
    runs = schedule.withColumn("c", change).withColumn("run", run).groupBy("unit", "run", "u", "min_up", "min_down").agg(F.min("t").alias("start"), F.max("t").alias("stop"), F.count("*").alias("periods"))
    ends = schedule.groupBy("unit").agg(F.max("t").alias("last"), F.min("t").alias("first"))
    short = runs.join(ends, "unit").where("stop < last").where("(u = 1 AND periods < min_up) OR (u = 0 AND start > first AND periods < min_down)")
    return short.select("unit", "start", "periods", "u")


def capacity_violations(schedule: DataFrame) -> DataFrame:
    return schedule.where("p > mw * u + 1e-6 OR p < p_min * u - 1e-6").select("unit", "t", "p")


def ramp_violations(schedule: DataFrame) -> DataFrame:
    """Changes between periods beyond the ramps while the unit stays on; null ramps are no limit."""
    d = F.col("p") - F.lag("p").over(in_time())
    was = F.lag("u").over(in_time())
    x = schedule.withColumns({"d": d, "was": was}).where("u = 1 AND was = 1")
    return x.where("d > ramp_up + 1e-6 OR -d > ramp_down + 1e-6").select("unit", "t", F.round("d", 6).alias("d"))


def balance(schedule: DataFrame, demand: DataFrame, reserve: float) -> DataFrame:
    """t, p, online, demand, short, reserve_short for every period of (t, demand)."""
    s = schedule.groupBy("t").agg(F.sum("p").alias("p"), F.sum(F.col("mw") * F.col("u")).alias("online"))
    x = demand.join(s, "t", "left").na.fill(0.0, ["p", "online"])
    return x.select("t", "p", "online", "demand", (F.col("p") < F.col("demand") - 1e-6).alias("short"), (F.col("online") < F.col("demand") * (1 + reserve) - 1e-6).alias("reserve_short"))


def state_of_charge(storage: DataFrame) -> DataFrame:
    """Adds soc to (unit, t, charge, discharge, efficiency, initial): a running sum."""
    step = F.col("charge") * F.col("efficiency") - F.col("discharge") / F.col("efficiency")
    return storage.withColumn("soc", F.col("initial") + F.sum(step).over(in_time().rowsBetween(Window.unboundedPreceding, 0)))


def merit_order(units: DataFrame, demand: DataFrame) -> DataFrame:
    """region, t, unit, p: cheapest first within each region and period (exact without minimum output).

    The running capacity of a region is one window over its units; periods only compare with it.
    """
    before = F.coalesce(F.sum("mw").over(Window.partitionBy("region").orderBy("cost", "unit").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    stack = units.select("region", "unit", "mw", before.alias("below"))
    p = F.least(F.col("mw"), F.greatest(F.col("demand") - F.col("below"), F.lit(0.0)))
    return stack.join(demand, "region").withColumn("p", p).where("p > 0").select("region", "t", "unit", "p")


def nodal(generation: DataFrame, flows: DataFrame, demand: DataFrame) -> DataFrame:
    """region, t, surplus = generation + imports - exports - demand; a positive flow goes from -> to."""
    i = flows.select(F.col("to_region").alias("region"), "t", F.col("flow").alias("x"))
    o = flows.select(F.col("from_region").alias("region"), "t", (-F.col("flow")).alias("x"))
    g = generation.select("region", "t", F.col("p").alias("x"))
    all_in = g.union(i).union(o).union(demand.select("region", "t", (-F.col("demand")).alias("x")))
    return all_in.groupBy("region", "t").agg(F.sum("x").alias("surplus"))


def solve(units: DataFrame, demand: DataFrame, reserve: float = 0.05) -> DataFrame:
    """region, unit, t, u, p, status, cost, bound: one region a task.

    units: region, unit, mw, p_min, cost, fixed, startup, shutdown, min_up, min_down, off_from, off_to.
    """

    def run(key: tuple, g: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        names = ["region", "unit", "t", "u", "p", "status", "cost", "bound"]
        if not len(g) or not len(d):
            return pd.DataFrame([], columns=names)
        g, d = g.sort_values("unit"), d.sort_values("t")
        t = d.t.to_numpy()
        banned = (t[None, :] >= g.off_from.to_numpy()[:, None]) & (t[None, :] < g.off_to.to_numpy()[:, None])
        r = schedule(d.demand.to_numpy(float), reserve, g.to_dict("records"), banned)
        k, n = len(g), len(t)
        return pd.DataFrame({"region": key[0], "unit": np.repeat(g.unit.to_numpy(), n), "t": np.tile(t, k), "u": r["u"].ravel(), "p": r["p"].ravel(), "status": r["status"], "cost": r["cost"], "bound": r["bound"]})[names]

    return units.groupBy("region").cogroup(demand.groupBy("region")).applyInPandas(run, "region long, unit long, t long, u int, p double, status string, cost double, bound double")


def merged_status(results: DataFrame) -> DataFrame:
    """One row: Optimal if all are, Infeasible or Unbounded if any is, else the first other status; no cost without all parts' costs."""
    one = results.groupBy("region").agg(F.first("status").alias("status"), F.first("cost").alias("cost"), F.first("bound").alias("bound"))
    has = lambda s: F.bool_or(F.col("status") == s)
    first = F.min(F.when(F.col("status") != "Optimal", F.struct("region", "status")))["status"]
    status = F.when(F.bool_and(F.col("status") == "Optimal"), "Optimal").when(has("Infeasible"), "Infeasible").when(has("Unbounded"), "Unbounded").otherwise(first)
    cost = F.when(F.bool_and(F.col("cost").isNotNull() & ~F.isnan("cost")), F.sum("cost"))
    return one.agg(status.alias("status"), cost.alias("cost"), F.sum("bound").alias("bound"), F.count("*").alias("regions"))


def tier(cores: int, memory_gb: float) -> dict:
    """Effort by hardware: rounds of the relaxation and the gap aimed at."""
    if cores >= 4 and memory_gb >= 8:
        return {"tier": "high", "seconds": 600, "gap": 0.01, "rounds": 40}
    if cores >= 2 and memory_gb >= 4:
        return {"tier": "mid", "seconds": 300, "gap": 0.05, "rounds": 25}
    return {"tier": "low", "seconds": 120, "gap": 0.10, "rounds": 12}
