"""Searches around points in numpy (and Arrow columns): places sorted by latitude band and longitude, for several radii."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

EARTH_KM, DEGREE_KM = 6371.0, 111.0
#: Pairs whose distances are computed at once.
PAIRS = 1 << 20


def distance(metric: str, lat1: np.ndarray, lon1: np.ndarray, lat2: np.ndarray, lon2: np.ndarray) -> np.ndarray:
    """Kilometres to six decimals, as the columns of functions.geo have them."""
    if metric == "planar":
        return np.round(np.sqrt((lat1 - lat2) ** 2 + (lon1 - lon2) ** 2) * 111.0, 6)
    p1, p2 = np.radians(lat1), np.radians(lat2)
    a = np.sin((p2 - p1) / 2) ** 2 + np.cos(p1) * np.cos(p2) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return np.round(2 * EARTH_KM * np.arctan2(np.sqrt(a), np.sqrt(np.maximum(1 - a, 0))), 6)


def floats(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A column of numbers; nulls are NaN."""
    return column.cast(pa.float64()).to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.cast(pa.float64()).to_numpy()


class Places:
    """Points in the order that breaks ties; nulls are NaN and are never met."""

    def __init__(self, lat: np.ndarray, lon: np.ndarray, metric: str = "haversine") -> None:
        self.lat, self.lon, self.metric = np.asarray(lat, float), np.asarray(lon, float), metric
        self.known = np.flatnonzero(np.isfinite(self.lat) & np.isfinite(self.lon))
        self._levels: dict[float, tuple] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_levels": {}}

    def _around(self, lon: np.ndarray) -> np.ndarray:
        return lon if self.metric == "planar" else np.mod(lon + 180.0, 360.0) - 180.0

    def _level(self, km: float) -> tuple:
        """Row numbers by band and longitude, their keys, the first band, a band's width in keys, the least longitude."""
        if km not in self._levels:
            lat, lon = self.lat[self.known], self._around(self.lon[self.known])
            high = km / DEGREE_KM * 1.001
            band, low = np.floor(lat / high), lon.min(initial=0.0)
            first, wide = band.min(initial=0.0), lon.max(initial=0.0) - low + 4.0
            key = (band - first) * wide + (lon - low)
            order = np.argsort(key, kind="stable")
            self._levels[km] = self.known[order], key[order], high, first, band.max(initial=first) - first, wide, low
        return self._levels[km]

    def crowd(self, km: float) -> float:
        """How many places share a square of ``km`` with a place, on average."""
        high = km / DEGREE_KM
        cells = np.stack([np.floor(self.lat[self.known] / high), np.floor(self.lon[self.known] / high)])
        n = np.unique(cells, axis=1, return_counts=True)[1].astype(float)
        return float((n * n).sum() / max(n.sum(), 1.0))

    def radii(self, km: float, crowd: float = 3.0) -> list[float]:
        """Halves of ``km`` down to a radius whose squares are all but empty, ascending."""
        out = [km]
        while self.crowd(out[-1]) > crowd and out[-1] > 0.02:
            out.append(out[-1] / 2)
        return out[::-1]

    def pairs(self, lat: np.ndarray, lon: np.ndarray, km: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(rows of the points, places, km) of all pairs within ``km``; a point's pairs come together, rows ascend."""
        rows = np.flatnonzero(np.isfinite(lat) & np.isfinite(lon))
        if not len(rows) or not len(self.known):
            return
        at, key, high, first, last, wide, low = self._level(km)
        lat, lon = lat[rows], lon[rows]
        x = self._around(lon)
        reach = np.full(len(rows), high)
        shifts = (0.0,)
        if self.metric != "planar":
            d, far = np.radians(high), np.radians(np.minimum(np.abs(lat) + high, 90.0))
            cos = np.cos(np.radians(lat))
            reach = np.where(far >= np.pi / 2 - 1e-9, 360.0, np.degrees(np.arcsin(np.minimum(np.sin(d) / np.maximum(np.abs(cos), 1e-12), 1.0))))
            shifts = (0.0, 360.0, -360.0) if ((x - reach < -180) | (x + reach > 180)).any() else shifts
        reach = reach * 1.001 + 1e-5
        starts, counts = [], []
        for step in (-1, 0, 1):
            band = np.floor(lat / high) + step - first
            for s in shifts:
                # beyond both ends by less than the gap between bands
                a, b = np.clip(x + s - reach - low, -1.0, wide - 2.0), np.clip(x + s + reach - low, -1.0, wide - 2.0)
                if s:  # what the unshifted range has met already is left out
                    a, b = (np.maximum(a, x + reach - low), b) if s > 0 else (a, np.minimum(b, x - reach - low))
                ok = (band >= 0) & (band <= last) & (b >= a)
                i = np.searchsorted(key, band * wide + a, "left")
                j = np.searchsorted(key, band * wide + b, "right")
                starts.append(i)
                counts.append(np.where(ok, np.maximum(j - i, 0), 0))
        start, count = np.stack(starts, 1), np.stack(counts, 1)
        total = np.cumsum(count.sum(1))
        begin = 0
        while begin < len(rows):
            end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + PAIRS, "right")))
            c, s = count[begin:end].ravel(), start[begin:end].ravel()
            n = int(c.sum())
            if n:
                who = np.repeat(np.repeat(np.arange(begin, end), count.shape[1]), c)
                where = at[np.repeat(s - np.cumsum(c) + c, c) + np.arange(n)]
                d = distance(self.metric, lat[who], lon[who], self.lat[where], self.lon[where])
                ok = d <= km
                yield rows[who[ok]], where[ok], d[ok]
            begin = end

    def nearest(self, lat: np.ndarray, lon: np.ndarray, km: float, radii: list[float] | None = None, allowed=None) -> tuple[np.ndarray, np.ndarray]:
        """For each point the nearest place within ``km`` (the first on ties; -1: none) and its distance.

        Radii grow; a point whose nearest place lies within the radius is done.  ``allowed`` (rows, places)
        says which pairs count.
        """
        best, far = np.full(len(lat), -1), np.full(len(lat), np.inf)
        left = np.flatnonzero(np.isfinite(lat) & np.isfinite(lon))
        for r in radii or self.radii(km):
            for rows, where, d in self.pairs(lat[left], lon[left], r):
                if allowed is not None:
                    ok = allowed(left[rows], where)
                    rows, where, d = rows[ok], where[ok], d[ok]
                if not len(rows):
                    continue
                begin = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
                least = np.repeat(np.minimum.reduceat(d, begin), np.diff(np.r_[begin, len(rows)]))
                ties = d == least
                rows, where, d = rows[ties], where[ties], d[ties]
                begin = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
                best[left[rows[begin]]], far[left[rows[begin]]] = np.minimum.reduceat(where, begin), d[begin]
            left = left[best[left] < 0]
            if not len(left):
                break
        return best, far

    def largest(self, lat: np.ndarray, lon: np.ndarray, km: float, block: int = 32) -> np.ndarray:
        """For each point the first place within ``km``; -1: none.

        Points of a square share their candidates and meet them in order, a block at a time, until one is near.
        """
        found = np.full(len(lat), -1)
        left = np.flatnonzero(np.isfinite(lat) & np.isfinite(lon))
        if not len(left) or not len(self.known):
            return found
        at, key, high, first, last, wide, low = self._level(km)
        square = np.stack([np.floor(lat[left] / high), np.floor(lon[left] / high)])
        by = np.lexsort(square)
        edges = np.flatnonzero(np.r_[True, (np.diff(square[:, by], axis=1) != 0).any(0), True])
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            rows = left[by[a:b]]
            # all places that any of these points can meet: around their middle, with the square's own size on top
            band = np.floor(lat[rows[0]] / high) - first
            near = [at[np.searchsorted(key, max(band - 1, 0) * wide - 1.0) : np.searchsorted(key, (min(band + 1, last) + 1) * wide - 1.5)]] if -1 <= band <= last + 1 else []
            if not near or not len(near[0]):
                continue
            ids = near[0]
            if self.metric == "planar":
                ids = ids[(self.lon[ids] >= lon[rows].min() - high * 1.001) & (self.lon[ids] <= lon[rows].max() + high * 1.001)]
            elif (top := np.abs(lat[rows]).max() + high) < 89.0:
                w = np.degrees(np.arcsin(min(np.sin(np.radians(high)) / np.cos(np.radians(top)), 1.0))) * 1.001
                middle = (lon[rows].min() + lon[rows].max()) / 2
                ids = ids[np.abs(self._around(self.lon[ids] - middle)) <= w + (lon[rows].max() - lon[rows].min()) / 2 + 1e-5]
            ids = np.sort(ids)
            for k in range(0, len(ids), block):
                some = ids[k : k + block]
                d = distance(self.metric, lat[rows, None], lon[rows, None], self.lat[some], self.lon[some]) <= km
                hit = d.any(1)
                found[rows[hit]] = some[d[hit].argmax(1)]
                rows = rows[~hit]
                if not len(rows):
                    break
        return found
