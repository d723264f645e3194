"""Parameters that a configuration gives by class: of lines, of units, of hours."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.scalars import capacitance_nf

# Line classes in kV with r and x in ohm per km, b in siemens per km, the largest current in kA; in the order of the list, which decides ties.
LINE_CLASSES = [(500, 0.012, 0.290, 4.1e-6, 4.0), (275, 0.028, 0.325, 3.85e-6, 2.0), (154, 0.050, 0.380, 3.5e-6, 1.0), (66, 0.120, 0.400, 3.2e-6, 0.6), (220, 0.032, 0.335, 3.75e-6, 1.8), (187, 0.038, 0.350, 3.65e-6, 1.5), (132, 0.045, 0.370, 3.55e-6, 1.2), (110, 0.055, 0.385, 3.45e-6, 0.9), (77, 0.100, 0.395, 3.3e-6, 0.7)]

#: Example fractions by fuel: ramps up and down, least output (shares of the capacity), costs of a start and a stop a MW.
UNIT_FRACTIONS = {"coal": (0.02, 0.02, 0.30, 15.0, 5.0), "gas": (0.05, 0.05, 0.30, 10.0, 3.0), "oil": (0.06, 0.06, 0.25, 12.0, 4.0), "nuclear": (0.01, 0.01, 0.80, 60.0, 20.0), "solar": (1.0, 1.0, 0.0, 0.0, 0.0), "wind": (1.0, 1.0, 0.0, 0.0, 0.0)}


def with_line_parameters(lines: DataFrame, hz: float) -> DataFrame:
    """Adds class, exact, r, x, c (nF per km) and i of the class of ``kv``, or of the nearest one.

    The list is a literal of the plan: no join, no shuffle.
    """
    if hz not in (50.0, 60.0):
        raise ValueError("frequency must be 50 or 60 Hz")
    key = F.rint("kv").cast("int")
    rows = F.array(*(F.struct(F.abs(key - k).alias("d"), F.lit(o).alias("o"), F.lit(k).alias("class"), F.lit(r).alias("r"), F.lit(x).alias("x"), F.lit(b).alias("b"), F.lit(i).alias("i")) for o, (k, r, x, b, i) in enumerate(LINE_CLASSES)))
    best = lines.withColumn("_p", F.array_min(rows))
    kept = [F.col(c) for c in lines.columns]
    return best.select(*kept, F.col("_p.class"), (F.col("_p.d") == 0).alias("exact"), F.col("_p.r"), F.col("_p.x"), capacitance_nf(F.col("_p.b") * 1e6, hz).alias("c"), F.col("_p.i"))


def defaulted(own: Column, key: Column, defaults: dict[str, float]) -> Column:
    """The row's own value, else the key's default, else that of ``unknown``, else 0."""
    found = F.coalesce(*(F.when(key == k, F.lit(v)) for k, v in defaults.items()), F.lit(None).cast("double"))
    return F.coalesce(own, found, F.lit(defaults.get("unknown")).cast("double"), F.lit(0.0))


def with_unit_parameters(units: DataFrame, fractions: dict[str, tuple[float, ...]] = UNIT_FRACTIONS) -> DataFrame:
    """gen_id and ramps, least output and costs of units (gen_id, mw, fuel)."""
    part = lambda i, missing: F.coalesce(*(F.when(F.col("fuel") == k, F.lit(v[i])) for k, v in fractions.items()), F.lit(missing))
    mw = F.col("mw")
    return units.select("gen_id", F.round(mw * part(0, 0.05), 2).alias("ramp_up"), F.round(mw * part(1, 0.05), 2).alias("ramp_down"), F.round(mw * part(2, 0.3), 2).alias("p_min"), F.round(mw * part(3, 10.0), 0).alias("startup_cost"), F.round(mw * part(4, 3.0), 0).alias("shutdown_cost"))


def calendar_multipliers(spark: SparkSession, year: int, weekday: list[float], weekend: list[float], monthly: list[float], reference: float, least: float = 0.01) -> DataFrame:
    """h, month, hour, weekday, multiplier of 8760 hours from the first of January."""
    start = datetime.date(year, 1, 1).toordinal()
    day = F.date_add(F.lit(datetime.date(year, 1, 1)), F.floor(F.col("h") / 24).cast("int"))
    x = spark.range(8760).withColumnRenamed("id", "h").select("h", F.month(day).alias("month"), (F.col("h") % 24).cast("int").alias("hour"), ((F.floor(F.col("h") / 24) + (start - 1)) % 7 < 5).alias("weekday"))
    pick = lambda values, i: F.element_at(F.array(*map(F.lit, values)), i)
    factor = F.when(F.col("weekday"), pick(weekday, F.col("hour") + 1)).otherwise(pick(weekend, F.col("hour") + 1)) * pick(monthly, F.col("month")) / reference
    return x.withColumn("multiplier", F.round(F.greatest(factor, F.lit(least)), 6))


__all__ = ["LINE_CLASSES", "UNIT_FRACTIONS", "calendar_multipliers", "defaulted", "with_line_parameters", "with_unit_parameters"]
