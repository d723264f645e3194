"""Geometry on columns: distances, lengths, centroids, tiling; Douglas-Peucker as a Pandas function."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, functions as F

EARTH_KM = 6371.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def planar_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Distance in degree space times 111 km."""
    return F.sqrt(F.pow(lat1 - lat2, 2) + F.pow(lon1 - lon2, 2)) * 111.0


def polyline_km(coords: Column) -> Column:
    """Length of an array of (lat, lon) structs; 0 with fewer than two points."""
    pairs = F.zip_with(F.slice(coords, 1, F.greatest(F.size(coords) - 1, F.lit(0))), F.slice(coords, 2, F.greatest(F.size(coords) - 1, F.lit(0))), lambda a, b: haversine(a["lat"], a["lon"], b["lat"], b["lon"]))
    return F.when(F.size(coords) >= 2, F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)).otherwise(0.0)


def line_km(coords: Column, ends: Column) -> Column:
    """Polyline length, else the distance of the ends, else 1; two decimals."""
    along = polyline_km(coords)
    return F.round(F.when(along > 0, along).when(ends > 0, ends).otherwise(1.0), 2)


def centroid(coords: Column) -> Column:
    """Mean of all vertices, a repeated closing one included."""
    n = F.size(coords)
    mean = lambda f: F.aggregate(coords, F.lit(0.0), lambda s, p: s + p[f]) / n
    return F.when(n > 0, F.struct(mean("lat").alias("lat"), mean("lon").alias("lon")))


def thinned(coords: Column, stride: int = 3) -> Column:
    """Every ``stride``-th vertex and the last; up to four vertices stay."""
    n = F.size(coords)
    kept = F.filter(coords, lambda p, i: (i % stride == 0) | (i == n - 1))
    return F.when(n <= 4, coords).otherwise(kept)


def rounded(coords: Column, digits: int = 4) -> Column:
    return F.transform(coords, lambda p: F.struct(F.round(p["lat"], digits).alias("lat"), F.round(p["lon"], digits).alias("lon")))


def within(lat: Column, lon: Column, box: tuple[float, float, float, float]) -> Column:
    """Inside (lat_min, lat_max, lon_min, lon_max), borders included."""
    return lat.between(box[0], box[1]) & lon.between(box[2], box[3])


def tiles(lat_min: Column, lat_max: Column, lon_min: Column, lon_max: Column, rows: int, cols: int) -> Column:
    """Array of (row, col, lon_min, lat_min, lon_max, lat_max)."""
    h, w = (lat_max - lat_min) / rows, (lon_max - lon_min) / cols
    cell = lambda i, j: F.struct(i.alias("row"), j.alias("col"), (lon_min + w * j).alias("lon_min"), (lat_min + h * i).alias("lat_min"), (lon_min + w * (j + 1)).alias("lon_max"), (lat_min + h * (i + 1)).alias("lat_max"))
    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), lambda i: F.transform(F.sequence(F.lit(0), F.lit(cols - 1)), lambda j: cell(i, j))))


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Angle of the segment in degrees, in the plane of degrees."""
    return F.degrees(F.atan2(lat2 - lat1, lon2 - lon1))


def simplify(points: list[tuple[float, float]], tolerance: float) -> list[int]:
    """Places of the points that Douglas-Peucker keeps, without recursion."""
    keep, spans = {0, len(points) - 1} if points else set(), [(0, len(points) - 1)]
    while spans:
        a, b = spans.pop()
        if b - a < 2:
            continue
        (x0, y0), (x1, y1) = points[a], points[b]
        dx, dy = x1 - x0, y1 - y0
        norm = math.hypot(dx, dy)
        best, at = -1.0, a
        for i in range(a + 1, b):
            x, y = points[i]
            d = abs(dy * (x - x0) - dx * (y - y0)) / norm if norm else math.hypot(x - x0, y - y0)
            if d > best:
                best, at = d, i
        if best > tolerance:
            keep.add(at)
            spans += [(a, at), (at, b)]
    return sorted(keep)


def simplified(coords: Column, tolerance: float = 1e-4) -> Column:
    """Douglas-Peucker over arrays of (lat, lon); SQL has no way to say it."""

    @F.pandas_udf("array<struct<lat:double,lon:double>>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            out = []
            for line in part:
                points = [(p["lat"], p["lon"]) for p in line] if line is not None else []
                out.append([{"lat": points[i][0], "lon": points[i][1]} for i in simplify(points, tolerance)])
            yield pd.Series(out)

    return run(coords)
