"""Distance-bounded joins: pairs by an equi-join on grid cells, the best one by a search around each row."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import from_arrow_type
from pyspark.sql.types import StructType

from ..functions.geo import haversine, planar_km
from ..kernels.places import Places, floats

#: Kilometres of a degree of latitude at least.
DEGREE_KM = 111.0


def _cells(lat: Column, lon: Column, dlat: float, dlon: float) -> tuple[Column, Column]:
    return F.floor(lat / dlat).cast("int"), F.floor(lon / dlon).cast("int")


def within_km(left: DataFrame, right: DataFrame, km: float, metric: str = "haversine", max_abs_lat: float = 60.0) -> DataFrame:
    """Pairs of ``left`` (llat, llon, ...) and ``right`` (rlat, rlon, ...) within ``km``, with column ``km``.

    A cell is at least ``km`` on each side anywhere up to ``max_abs_lat``, so a row meets at most
    the nine cells around it: the left side is repeated nine times, the right side once.
    """
    dlat = km / DEGREE_KM * 1.001
    dlon = dlat if metric == "planar" else dlat / math.cos(math.radians(max_abs_lat))
    i, j = _cells(F.col("llat"), F.col("llon"), dlat, dlon)
    around = F.array(*(F.struct((i + a).alias("ci"), (j + b).alias("cj")) for a in (-1, 0, 1) for b in (-1, 0, 1)))
    spread = left.withColumn("_cell", F.explode(around)).withColumns({"_ci": F.col("_cell.ci"), "_cj": F.col("_cell.cj")}).drop("_cell")
    ri, rj = _cells(F.col("rlat"), F.col("rlon"), dlat, dlon)
    held = right.withColumns({"_ci": ri, "_cj": rj})
    d = (haversine if metric == "haversine" else planar_km)(F.col("llat"), F.col("llon"), F.col("rlat"), F.col("rlon"))
    return spread.join(held, ["_ci", "_cj"]).withColumn("km", F.round(d, 6)).where(F.col("km") <= km).drop("_ci", "_cj")


#: Places that a task holds at once, 24 bytes each; more are dealt out by latitude.
PLACES = 500_000
#: Rows of the other side that one group of a dealt search holds, about.
GROUP = 200_000


def places(right: DataFrame, value: str, order: Column | None = None) -> pa.Table | None:
    """value, rlat, rlon of all known places, sorted by ``order``; of equal places the first; None beyond PLACES."""
    order = F.col(value) if order is None else order
    one = right.where("rlat IS NOT NULL AND rlon IS NOT NULL").groupBy("rlat", "rlon").agg(F.min_by(value, order).alias(value), F.min(order).alias("_o"))
    held = one.where(F.col("_o").isNotNull()).limit(PLACES + 1).toArrow()
    return held.sort_by("_o").select([value, "rlat", "rlon"]) if held.num_rows <= PLACES else None


def _kernel(held: pa.Table, metric: str) -> Places:
    return Places(floats(held["rlat"]), floats(held["rlon"]), metric)


def attached(left: DataFrame, held: pa.Table, ends: list[tuple[str, str, str, str]], km: float, metric: str = "haversine", best: str = "nearest") -> DataFrame:
    """The rows of left with, for each end (latitude, longitude, name, name of km), the place's value and distance.

    Nothing is shuffled: every task searches the places, which ``places`` has bounded.  ``best``: nearest, or
    largest for the first place of their order within ``km`` (without a distance).
    """
    spark, value = left.sparkSession, held.column_names[0]
    kernel = _kernel(held, metric)
    radii = kernel.radii(km) if best == "nearest" else None
    shared = spark.sparkContext.broadcast((held[value].combine_chunks(), kernel, radii))
    kind = from_arrow_type(held.schema.field(0).type)
    schema = StructType(list(left.schema))
    for _, _, name, far in ends:
        schema = schema.add(name, kind)
        schema = schema.add(far, "double") if best == "nearest" else schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, kernel, radii = shared.value
        for batch in batches:
            columns = list(batch.columns)
            for lat, lon, _, _ in ends:
                p = floats(batch.column(lat)), floats(batch.column(lon))
                at, far = kernel.nearest(*p, km, radii) if best == "nearest" else (kernel.largest(*p, km), None)
                columns.append(values.take(pa.array(at, mask=at < 0)))
                columns += [pa.array(far, mask=at < 0)] if far is not None else []
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return left.mapInArrow(run, schema)


def dealt(left: DataFrame, key: str, right: DataFrame, value: str, km: float, metric: str, best: str, order: Column | None = None) -> DataFrame:
    """key, value, _o, km for each key and band of latitudes, by the same search where the places are too many for a task.

    Bands of about PLACES / 2 places; a row of left goes to each band that it reaches, and large bands' rows
    are spread over groups that each hold the band's places.
    """
    order = F.col(value) if order is None else order
    right = right.select("rlat", "rlon", F.col(value).alias("_v"), order.alias("_o")).where("rlat IS NOT NULL AND rlon IS NOT NULL AND _o IS NOT NULL").groupBy("rlat", "rlon").agg(F.min_by("_v", "_o").alias("_v"), F.min("_o").alias("_o"))
    n = math.ceil(2 * right.count() / PLACES)
    cuts = sorted(set(right.approxQuantile("rlat", [i / n for i in range(1, n)], 1 / (4 * n))))
    band = lambda lat: sum((F.when(lat >= c, 1).otherwise(0) for c in cuts), F.lit(0))
    reach = km / DEGREE_KM * 1.001
    rows = left.where("llat IS NOT NULL AND llon IS NOT NULL").select(F.col(key).alias("_k"), "llat", "llon", F.explode(F.sequence(band(F.col("llat") - reach), band(F.col("llat") + reach))).alias("_b"))
    sizes = {r["_b"]: math.ceil(r["n"] / GROUP) for r in rows.groupBy("_b").agg(F.count("*").alias("n")).collect()}  # a row for each band
    parts = F.create_map(*(F.lit(x) for b in range(len(cuts) + 1) for x in (b, sizes.get(b, 0))))[F.col("_b")]
    rows = rows.withColumn("_g", F.pmod(F.xxhash64("llat", "llon", "_k"), parts).cast("int"))
    spread = right.withColumn("_b", band(F.col("rlat"))).where(parts > 0).withColumn("_g", F.explode(F.sequence(F.lit(0), parts - 1)))
    kinds = {f.name: f.dataType for f in [*rows.schema, *right.schema]}
    schema = StructType().add("_k", kinds["_k"]).add("_v", kinds["_v"]).add("_o", kinds["_o"]).add("km", "double")

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        b = b.sort_by("_o")
        p, kernel = (floats(a["llat"]), floats(a["llon"])), _kernel(b, metric)
        at, far = kernel.nearest(*p, km) if best == "nearest" else (kernel.largest(*p, km), np.zeros(len(p[0])))
        ok = np.flatnonzero(at >= 0)
        b = b.take(at[ok])
        return pa.table({"_k": a["_k"].take(pa.array(ok)), "_v": b["_v"], "_o": b["_o"], "km": far[ok]})

    found = rows.groupBy("_b", "_g").cogroup(spread.groupBy("_b", "_g")).applyInArrow(run, schema)
    return found.withColumnsRenamed({"_k": key, "_v": value})


def nearest(left: DataFrame, key: str, right: DataFrame, order: str, km: float, metric: str = "haversine") -> DataFrame:
    """For each ``key`` of left the nearest row of right within ``km``; ties to the smallest ``order``.

    A search around each row by growing radii, so its cost goes with the rows of left, not with pairs.
    """
    held = places(right, order)
    if held is not None:
        found = attached(left.select(key, "llat", "llon"), held, [("llat", "llon", order, "km")], km, metric).where(F.col(order).isNotNull())
    else:
        found = dealt(left, key, right, order, km, metric, "nearest")
    best = F.min(F.struct("km", order)).alias("m")
    return found.groupBy(key).agg(best).select(key, F.col(f"m.{order}").alias(order), F.col("m.km").alias("km"))


def largest_within(left: DataFrame, key: str, right: DataFrame, value: str, km: float, metric: str = "haversine") -> DataFrame:
    """For each ``key`` of left the largest ``value``, a number, of right within ``km``."""
    right = right.where(F.col(value).isNotNull())
    held = places(right, value, -F.col(value))
    if held is not None:
        found = attached(left.select(key, "llat", "llon"), held, [("llat", "llon", value, "")], km, metric, "largest").where(F.col(value).isNotNull())
    else:
        found = dealt(left, key, right, value, km, metric, "largest", -F.col(value))
    return found.groupBy(key).agg(F.max(value).alias(value))
