"""Power flow per region: tables in, tables out; one region (and method) a task."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..kernels import powerflow as K
from ..kernels.sparse import Matrix

BASE_MVA = 100.0


def case_of(buses: pd.DataFrame, branches: pd.DataFrame, z: float = 1.0) -> tuple[K.Case, np.ndarray]:
    """Buses (id, kind 1 pq 2 pv 3 slack, p, q in MW, vm) and branches (a, b, r, x in per unit)."""
    buses = buses.sort_values("id")
    ids = buses["id"].to_numpy()
    r, x = branches.r.to_numpy(float), branches.x.to_numpy(float)
    ends = [branches[c].to_numpy() for c in ("a", "b")]
    i, j = (np.maximum(np.searchsorted(ids, e, "right") - 1, 0) for e in ends)
    ok = (ends[0] != ends[1]) & (ids[i] == ends[0]) & (ids[j] == ends[1]) & ~(r * r + x * x <= 1e-12)
    i, j, g = i[ok], j[ok], 1 / (r[ok] + 1j * x[ok])
    y = Matrix((len(ids), len(ids)), np.c_[i, j, i, j].ravel(), np.c_[i, j, j, i].ravel(), np.c_[g, g, -g, -g].ravel())
    kind = buses["kind"].to_numpy()
    pick = lambda k: np.flatnonzero(kind == k)
    s = (buses.p.to_numpy() + 1j * buses.q.to_numpy()) * z / BASE_MVA
    return K.Case(y, s.astype(complex), buses.vm.to_numpy().astype(complex), pick(3), pick(2), pick(1)), ids


def solve(buses: DataFrame, branches: DataFrame, names: list[str] | None = None, tol: float = 1e-8, most: int = 20) -> DataFrame:
    """region, method, id, vm, va_deg, converged, iterations, reason: every method on every region."""
    wanted = names or [m.name for m in K.methods()]
    every = buses.select("region", F.explode(F.array(*map(F.lit, wanted))).alias("method"), "id", "kind", "p", "q", "vm")
    lines = branches.select("region", F.explode(F.array(*map(F.lit, wanted))).alias("method"), "a", "b", "r", "x")

    def run(key: tuple, b: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        names = ["region", "method", "id", "vm", "va_deg", "converged", "iterations", "reason"]
        if not len(b):
            return pd.DataFrame([], columns=names)
        c, ids = case_of(b, e)
        try:
            r = K.method(key[1]).solve(c, tol, most)
        except Exception as problem:  # a method's failure is a result, not the job's
            r = K.Result(c.v, False, 0, str(problem))
        return pd.DataFrame({"region": key[0], "method": key[1], "id": ids, "vm": np.abs(r.v), "va_deg": np.degrees(np.angle(r.v)), "converged": r.converged, "iterations": r.iterations, "reason": r.reason})[names]

    schema = "region long, method string, id long, vm double, va_deg double, converged boolean, iterations int, reason string"
    return every.groupBy("region", "method").cogroup(lines.groupBy("region", "method")).applyInPandas(run, schema)


def solve_dc(buses: DataFrame, branches: DataFrame) -> DataFrame:
    """region, id, va_deg of the linear flow."""

    def run(key: tuple, b: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        if not len(b):
            return pd.DataFrame([], columns=["region", "id", "va_deg"])
        c, ids = case_of(b, e)
        return pd.DataFrame({"region": key[0], "id": ids, "va_deg": np.degrees(K.dc(c.y, c.s.real, int(c.slack[0])))})

    return buses.groupBy("region").cogroup(branches.groupBy("region")).applyInPandas(run, "region long, id long, va_deg double")


def convergence_report(solved: DataFrame) -> DataFrame:
    """method, regions, converged, rate, iterations and the reasons of failure."""
    one = solved.groupBy("region", "method").agg(F.first("converged").alias("ok"), F.first("iterations").alias("n"), F.first("reason").alias("why"))
    return one.groupBy("method").agg(F.count("*").alias("regions"), F.count_if("ok").alias("converged"), F.round(100.0 * F.count_if("ok") / F.count("*"), 2).alias("rate"), F.round(F.avg(F.when(F.col("ok"), F.col("n"))), 2).alias("iterations"), F.sort_array(F.collect_set(F.when(~F.col("ok"), F.col("why")))).alias("reasons"))
