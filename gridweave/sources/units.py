"""Units for commitment from XML documents of regions, with a configuration's defaults."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.parameters import defaulted
from .readers import xml_rows

#: Defaults of a configuration; fuel costs are by fuel.
DEFAULTS = {"startup_cost": 5000.0, "shutdown_cost": 2000.0, "min_up_time_h": 4, "min_down_time_h": 4, "ramp_up_mw_per_h": None, "ramp_down_mw_per_h": None, "labor_cost_per_h": 1000.0, "no_load_cost": 500.0, "disaster_risk_score": 0.0}
FUEL_COSTS = {"coal": 4500.0, "lng": 7000.0, "oil": 9000.0, "nuclear": 1500.0, "hydro": 0.0, "pumped_hydro": 2000.0, "geothermal": 0.0, "wind": 0.0, "solar": 0.0, "biomass": 3000.0, "mixed": 5000.0, "unknown": 5000.0}
#: Fixed value: the time that maintenance windows count their hours from.
EPOCH = "2000-01-01 00:00:00"

OWN = ["id", "name", "capacity_mw", "fuel_type", "status", "connected_substation", "startup_cost", "shutdown_cost", "min_up_time_h", "min_down_time_h", "fuel_cost_per_mwh", "labor_cost_per_h", "no_load_cost"]
UNIT = (
    "struct<" + ",".join(f"_{c}:string" for c in OWN) + ",Location:struct<_latitude:string,_longitude:string>,RampRates:struct<_ramp_up_mw_per_h:string,_ramp_down_mw_per_h:string>,"
    "MaintenancePlan:struct<Window:array<struct<_start:string,_end:string>>>,RebuildPlan:struct<_planned_date:string>,DisasterRisk:struct<_risk_score:string>>"
)


def unit_rows(spark: SparkSession, path: str, defaults: dict | None = None, fuel_costs: dict[str, float] | None = None) -> DataFrame:
    """One row a ``Generator`` of every ``Region``; attributes that are absent get the default.

    Numbers that do not parse raise.  Maintenance windows become hours; those without both ends, with
    times that do not parse or that end before they start go.  Regions without units give no rows.
    """
    base = DEFAULTS | (defaults or {})
    costs = FUEL_COSTS if fuel_costs is None else fuel_costs
    regions = xml_rows(spark, path, "Region", f"_id string, Generators struct<Generator:array<{UNIT}>>")
    g = regions.select(F.coalesce("_id", F.lit("")).alias("region"), F.explode("Generators.Generator").alias("g"))
    text = lambda c, missing="": F.coalesce(F.col(f"g._{c}"), F.lit(missing)).alias(c)
    real = lambda c, missing, at="g": F.coalesce(F.col(f"{at}._{c}").cast("double"), F.lit(missing).cast("double")).alias(c)
    whole = lambda c: F.coalesce(F.col(f"g._{c}").cast("double").cast("int"), F.lit(base[c]).cast("int"), F.lit(1)).alias(c)
    hour = lambda c: f"CAST(timestampdiff(SECOND, TIMESTAMP_NTZ'{EPOCH}', try_cast(w.{c} AS TIMESTAMP_NTZ)) / 3600 AS INT)"
    windows = f"coalesce(filter(transform(g.MaintenancePlan.Window, w -> struct({hour('_start')} AS start_h, {hour('_end')} AS end_h)), w -> w.start_h < w.end_h), array())"
    return g.select(
        "region", text("id"), text("name"), real("capacity_mw", 0.0), text("fuel_type", "unknown"), text("status", "active"), text("connected_substation"),
        real("latitude", 0.0, "g.Location"), real("longitude", 0.0, "g.Location"),
        *(real(c, base[c] or 0.0) for c in ("startup_cost", "shutdown_cost", "labor_cost_per_h", "no_load_cost")), whole("min_up_time_h"), whole("min_down_time_h"),
        defaulted(F.col("g._fuel_cost_per_mwh").cast("double"), F.coalesce(F.col("g._fuel_type"), F.lit("unknown")), costs).alias("fuel_cost_per_mwh"),
        *(real(c, base[c], "g.RampRates") for c in ("ramp_up_mw_per_h", "ramp_down_mw_per_h")), F.expr(windows).alias("maintenance"),
        F.when(F.col("g.RebuildPlan._planned_date") != "", F.col("g.RebuildPlan._planned_date")).alias("rebuild_planned_date"), real("risk_score", base["disaster_risk_score"] or 0.0, "g.DisasterRisk"),
    )
