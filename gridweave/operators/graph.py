"""Graph operators on edge tables: components, isolation, reconnection, bridging, admittance matrix."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.geo import haversine
from ..kernels.places import Places, floats


def shared_path(spark: SparkSession) -> str:
    """A new name in the folder that all executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = os.path.join(tempfile.gettempdir(), "gridweave-shared")
    return f"{base.rstrip('/')}/graph-{uuid.uuid4().hex}"


def shared_table(df: DataFrame) -> DataFrame:
    """Write to the folder that all executors share and read back: cuts the lineage of loops."""
    spark, path = df.sparkSession, shared_path(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes (id), edges (a, b) -> id, component: the smallest id reachable.

    Labels hop to the smallest label among neighbours and then to their label's label, so long
    chains take a logarithmic number of rounds; each round is two shuffles on ids.
    """
    both = shared_table(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = shared_table(nodes.select("id").distinct().withColumn("c", F.col("id")))
    while True:
        seen = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("c").alias("m"))
        hop = labels.join(seen, labels.id == seen.a, "left").select("id", F.col("c").alias("was"), F.least("c", F.coalesce("m", "c")).alias("c"))
        top = hop.select(F.col("id").alias("r"), F.col("c").alias("rc"))
        now = shared_table(hop.join(top, F.col("c") == F.col("r"), "left").select("id", "was", F.least("c", F.coalesce("rc", "c")).alias("c")))
        changed = now.where("was <> c").limit(1).count()
        labels = now.select("id", "c")
        if not changed:
            return labels.select("id", F.col("c").alias("component"))


def component_sizes(components: DataFrame) -> DataFrame:
    return components.groupBy("component").agg(F.count("*").alias("n"))


def main_component(components: DataFrame) -> DataFrame:
    """The largest component's nodes; ties to the smallest id."""
    best = component_sizes(components).orderBy(F.desc("n"), "component").limit(1).select("component")
    return components.join(F.broadcast(best), "component", "left_semi")


def isolated(components: DataFrame) -> DataFrame:
    """Nodes outside the main component."""
    return components.join(main_component(components).select("id"), "id", "left_anti")


def reconnect(buses: DataFrame, components: DataFrame, km: float) -> DataFrame:
    """One new line for each isolated bus to the nearest bus of the main component within ``km``."""
    from .spatial import nearest

    main = main_component(components).select("id")
    right = buses.join(main, "id", "left_semi").select(F.col("id").alias("to_id"), F.col("lat").alias("rlat"), F.col("lon").alias("rlon"))
    left = buses.join(isolated(components).select("id"), "id", "left_semi").select(F.col("id").alias("from_id"), F.col("lat").alias("llat"), F.col("lon").alias("llon"))
    return nearest(left, "from_id", right, "to_id", km)


def bridge(buses: DataFrame, edges: DataFrame, km: float) -> DataFrame:
    """Lines (a, b, km) that join components through their nearest buses, in rounds.

    Every round each component takes its shortest link to another one within ``km`` and components
    merge along them (Boruvka), so at most a logarithmic number of rounds is needed.  Up to
    ``PLACES`` buses, links are searched around each bus of all components but the largest; beyond,
    all pairs within ``km`` are stored.
    """
    from .spatial import PLACES

    held = buses.select(F.col("id").alias("b"), F.col("lat").alias("rlat"), F.col("lon").alias("rlon")).where("b IS NOT NULL").limit(PLACES + 1).toArrow()
    return _bridge_pairs(buses, edges, km) if held.num_rows > PLACES else _bridge_search(buses, edges, km, held)


def _bridge_search(buses: DataFrame, edges: DataFrame, km: float, held: pa.Table) -> DataFrame:
    """The driver keeps a component number for each of at most PLACES buses and a link for each component."""
    spark = buses.sparkSession
    held = held.sort_by("b")
    ids = held["b"].to_numpy()
    label = dict(connected_components(buses.select("id"), edges.select("a", "b")).where("id IS NOT NULL").toPandas().itertuples(index=False))
    root = np.unique(np.array([label[i] for i in ids]), return_inverse=True)[1]
    kernel = Places(floats(held["rlat"]), floats(held["rlon"]))
    shared = spark.sparkContext.broadcast((kernel, kernel.radii(km)))
    parts = max(spark.sparkContext.defaultParallelism, len(ids) // 10_000)
    lines: list[tuple[int, int, float]] = []
    while len(ids):
        main = int(np.bincount(root).argmax())
        out = np.flatnonzero(root != main)
        if not len(out):
            break
        now = spark.sparkContext.broadcast((root, main))
        searching = spark.sparkContext.broadcast(out[np.argsort(root[out], kind="stable")])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            (kernel, radii), (root, main), rows_of = shared.value, now.value, searching.value
            for batch in batches:
                for part in batch.column(0).to_pylist():
                    rows = rows_of[part * len(rows_of) // parts : (part + 1) * len(rows_of) // parts]
                    found = [nearest_other(kernel, radii, km, root, rows, None), nearest_other(kernel, radii, km, root, rows, main)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], names=["x", "y", "km"])

        links = spark.range(0, parts, 1, parts).mapInArrow(run, "x long, y long, km double").toPandas()
        now.destroy()
        searching.destroy()
        links["lo"], links["hi"] = np.minimum(links.x, links.y), np.maximum(links.x, links.y)
        links = links.sort_values(["km", "lo", "hi"])
        sides = pd.concat([links.assign(c=root[links[e]]) for e in ("x", "y")]).sort_values(["km", "lo", "hi"], kind="stable")
        new = sides.drop_duplicates("c").drop_duplicates(["lo", "hi"])
        if not len(new):
            break
        lines += [(int(ids[lo]), int(ids[hi]), float(d)) for lo, hi, d in zip(new.lo, new.hi, new.km, strict=True)]
        root = merged(root, new.lo.to_numpy(), new.hi.to_numpy())
    return spark.createDataFrame(pd.DataFrame(lines, columns=["a", "b", "km"]), "a long, b long, km double")


def nearest_other(kernel: Places, radii: list[float], km: float, root: np.ndarray, rows: np.ndarray, main: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x, y, km) of the least link of each component among ``rows``: to any other one, or to ``main``.

    A component that has a link within a radius needs no larger one.
    """
    best: dict[int, tuple[float, int, int, int, int]] = {}
    left = rows
    for r in radii:
        for i, y, d in kernel.pairs(kernel.lat[left], kernel.lon[left], r):
            x = left[i]
            ok = root[y] == main if main is not None else root[y] != root[x]
            x, y, d = x[ok], y[ok], d[ok]
            if not len(x):
                continue
            c, lo, hi = root[x], np.minimum(x, y), np.maximum(x, y)
            by = np.lexsort((hi, lo, d, c))
            first = by[np.r_[True, c[by][1:] != c[by][:-1]]]
            for k in first:
                new = (float(d[k]), int(lo[k]), int(hi[k]), int(x[k]), int(y[k]))
                best[int(c[k])] = min(best.get(int(c[k]), new), new)
        left = left[~np.isin(root[left], np.fromiter(best, np.int64, len(best)))]
        if not len(left):
            break
    got = list(best.values())
    return np.array([g[3] for g in got], np.int64), np.array([g[4] for g in got], np.int64), np.array([g[0] for g in got], float)


def merged(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Component numbers after the links between buses a and b."""
    up = np.arange(root.max(initial=-1) + 1)
    for x, y in zip(root[a], root[b], strict=True):
        while up[x] != x:
            x = up[x] = up[up[x]]
        while up[y] != y:
            y = up[y] = up[up[y]]
        up[max(x, y)] = min(x, y)
    while (up != up[up]).any():
        up = up[up]
    return np.unique(up[root], return_inverse=True)[1]


def _bridge_pairs(buses: DataFrame, edges: DataFrame, km: float) -> DataFrame:
    from .spatial import within_km

    found, all_edges = None, edges.select("a", "b")
    left = buses.select(F.col("id").alias("a"), F.col("lat").alias("llat"), F.col("lon").alias("llon"))
    right = buses.select(F.col("id").alias("b"), F.col("lat").alias("rlat"), F.col("lon").alias("rlon"))
    near = shared_table(within_km(left, right, km).where("a < b").select("a", "b", "km"))
    while True:
        c = connected_components(buses.select("id"), all_edges)
        ends = near.join(c.select(F.col("id").alias("a"), F.col("component").alias("ca")), "a").join(c.select(F.col("id").alias("b"), F.col("component").alias("cb")), "b").where("ca <> cb")
        side = ends.select("ca", F.struct("km", "a", "b").alias("l")).union(ends.select(F.col("cb").alias("ca"), F.struct("km", "a", "b").alias("l")))
        new = shared_table(side.groupBy("ca").agg(F.min("l").alias("l")).select("l.a", "l.b", "l.km").distinct())
        if not new.head(1):
            return found if found is not None else new
        found = new if found is None else found.union(new)
        all_edges = all_edges.union(new.select("a", "b"))


def ybus(branches: DataFrame) -> DataFrame:
    """(i, j, g, b) of the admittance matrix of branches (a, b, r, x); impedances near zero are left out."""
    z2 = F.col("r") * F.col("r") + F.col("x") * F.col("x")
    y = branches.where(z2 > 1e-12).select("a", "b", (F.col("r") / z2).alias("g"), (-F.col("x") / z2).alias("s"))
    stamps = F.array(*(F.struct(i.alias("i"), j.alias("j"), (sign * F.col("g")).alias("g"), (sign * F.col("s")).alias("b")) for i, j, sign in ((F.col("a"), F.col("a"), 1), (F.col("b"), F.col("b"), 1), (F.col("a"), F.col("b"), -1), (F.col("b"), F.col("a"), -1))))
    return y.select(F.explode(stamps).alias("s")).select("s.*").groupBy("i", "j").agg(F.sum("g").alias("g"), F.sum("b").alias("b"))


def weak_diagonal(matrix: DataFrame, least: float = 1e-12) -> DataFrame:
    """Buses whose diagonal admittance is all but zero."""
    return matrix.where("i = j").where(F.sqrt(F.col("g") * F.col("g") + F.col("b") * F.col("b")) < least).select("i")


def end_distance(buses: DataFrame, lines: DataFrame) -> DataFrame:
    """line_id and the great-circle distance of its ends."""
    f = buses.select(F.col("id").alias("a"), F.col("lat").alias("la"), F.col("lon").alias("oa"))
    t = buses.select(F.col("id").alias("b"), F.col("lat").alias("lb"), F.col("lon").alias("ob"))
    return lines.join(f, "a").join(t, "b").select("line_id", haversine(F.col("la"), F.col("oa"), F.col("lb"), F.col("ob")).alias("km"))
