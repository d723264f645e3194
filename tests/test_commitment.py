import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridweave.kernels.commitment import best_schedules, fullest, schedule
from gridweave.operators import commitment as C
from gridweave.plans.commitment import uc_schedule

SF = "/root/testdata/sf0.001"


def units_of(ids):
    return [{"mw": float(1 + i * 7 % 50), "p_min": 0.1 * (1 + i * 7 % 50), "cost": float(1 + i * 37 % 101), "fixed": 5.0, "startup": 50.0, "shutdown": 10.0, "min_up": 1 + i % 6, "min_down": 2} for i in ids]


def bans(ids, n=24):
    t = np.arange(n)
    return np.array([(t >= i % 40) & (t < i % 40 + 2) for i in ids])


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_every_unit_of_every_region_is_scheduled(spark):
    parts = spark.read.parquet(f"{SF}/part.parquet").select("p_partkey", "p_size").unionByName(spark.range(10**6, 10**6 + 1000).select(F.col("id").alias("p_partkey"), F.lit(7).alias("p_size")))
    at = spark.conf.get("spark.checkpoint.dir") + "/uc"
    spark.read.parquet(f"{SF}/part.parquet").limit(1).drop("p_partkey", "p_size").crossJoin(parts).write.mode("overwrite").parquet(f"{at}/part.parquet")
    got = uc_schedule(spark, at).groupBy("unit").agg(F.count("*").alias("n")).collect()
    assert {r.unit for r in got} == {r.p_partkey for r in parts.collect()} and all(r.n == 24 for r in got)


def test_schedules_keep_every_rule():
    for first in range(10):
        ids = range(first, first + 10 * 60, 10)
        units, banned = units_of(ids), bans(ids)
        mw = np.array([x["mw"] for x in units])
        demand = mw.sum() * (0.35 + 0.01 * np.arange(24))
        r = schedule(demand, 0.05, units, banned)
        assert r["status"] in ("Optimal", "Feasible") and r["bound"] <= r["cost"] and (r["cost"] - r["bound"]) / r["cost"] < 0.1
        assert not (r["u"].astype(bool) & banned).any()
        assert ((r["u"] * mw[:, None]).sum(0) >= 1.05 * demand - 1e-6).all() and (r["p"].sum(0) >= demand - 1e-6).all()


def test_side_by_side_equals_trying_every_schedule():
    rng = np.random.default_rng(5)
    n = 8
    for _ in range(6):
        units = units_of(rng.integers(0, 1000, 4))
        for x in units:
            x["min_up"], x["min_down"] = int(rng.integers(1, 4)), int(rng.integers(1, 4))
        columns = {k: np.array([x[k] for x in units], float) for k in units[0]}
        price, reserve = rng.uniform(0, 110, n), rng.uniform(0, 3, n)
        u, p, value = best_schedules(price, reserve, columns, np.zeros((4, n), bool))
        for g, x in enumerate(units):
            best = np.inf
            for code in range(2**n):
                s = [code >> t & 1 for t in range(n)]
                cuts = [0, *(t for t in range(1, n) if s[t] != s[t - 1]), n]
                if any(b < n and (b - a < x["min_up"] if s[a] else a > 0 and b - a < x["min_down"]) for a, b in zip(cuts, cuts[1:], strict=False)):
                    continue
                out = np.where(price > x["cost"], x["mw"], x["p_min"])
                run = sum(((x["cost"] - price[t]) * out[t] + x["fixed"] - reserve[t] * x["mw"]) * s[t] for t in range(n))
                run += sum(x["startup"] for t in range(n) if s[t] and not (t and s[t - 1])) + sum(x["shutdown"] for t in range(1, n) if s[t - 1] and not s[t])
                best = min(best, run)
            assert value[g] == pytest.approx(best)


def test_a_short_run_before_a_ban_costs_only_that_run():
    units, banned = units_of([1]), np.zeros((1, 24), bool)
    units[0]["min_up"] = 4
    banned[0, 1:3] = True
    assert fullest(units, banned)[0].tolist() == [0, 0, 0] + [1] * 21


def test_summary_counts_regions(spark):
    rows = [(r, r * 100 + i, *units_of([i])[0].values(), 0, 0) for r in range(2) for i in range(60)]
    units = spark.createDataFrame(rows, "region long, unit long, mw double, p_min double, cost double, fixed double, startup double, shutdown double, min_up int, min_down int, off_from long, off_to long")
    demand = spark.createDataFrame([(r, t, 500.0) for r in range(2) for t in range(24)], "region long, t long, demand double")
    got = C.solve(units, demand)
    assert got.select("unit").distinct().count() == 120
    assert C.merged_status(got).first().regions == 2


def test_merged_status(spark):
    from gridweave.operators.commitment import merged_status

    def of(*rows):
        return merged_status(spark.createDataFrame(list(rows), "region long, status string, cost double, bound double")).first()

    assert (of((1, "Optimal", 2.0, 1.0), (2, "Optimal", 3.0, 2.0)).status, of((1, "Optimal", 2.0, 1.0), (2, "Optimal", 3.0, 2.0)).cost) == ("Optimal", 5.0)
    assert of((1, "Feasible", 2.0, 1.0), (2, "Unbounded", 3.0, 2.0), (3, "Infeasible", None, 1.0)).status == "Infeasible"
    some = of((2, "Not Solved", None, 2.0), (3, "Feasible", 2.0, 1.0), (1, "Optimal", 1.0, 1.0))
    assert some.status == "Not Solved" and some.cost is None and some.regions == 3
