"""Connected components: up to ``FEW`` edges in one task, more by alternating large-star and small-star steps.

A star step is a query of several shuffles and a graph takes dozens of them, each of which costs
the driver plans, threads and task states, however few the edges are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import discard, shared_dir, stored

FEW = 500_000


def _roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of these edges that are not the smallest of their component, and that smallest one."""
    nodes, ends = np.unique(np.r_[u, v], return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    root = np.arange(len(nodes))
    while len(a):
        x, y = root[a], root[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        # the larger root hangs under the smallest that it meets; then all paths are shortened to their ends
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root != (root := root[root])).any():
            pass
    under = root < np.arange(len(nodes))
    return nodes[under], nodes[root[under]]


def _in_one_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    parts = [(p.u.to_numpy(np.int64), p.v.to_numpy(np.int64)) for p in batches]
    if parts:
        node, root = _roots(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        yield pd.DataFrame({"node": node, "root": root})


def _both(e: DataFrame) -> DataFrame:
    return e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _star(neighbours: DataFrame, large: bool) -> DataFrame:
    """Link each node's neighbours (the larger ones, or all of them with itself) to their smallest."""
    least = neighbours.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = neighbours.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(a, b) pairs of longs -> (node, root): the smallest node of each node's component.

    Nodes without edges to others are left out; null ends are ignored.
    """
    spark, at = edges.sparkSession, shared_dir(edges.sparkSession)
    clean = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a is not null and b is not null and a <> b").distinct()
    now, step, before = stored(clean, f"{at}/0"), 0, None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(mark) == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        if mark[0] <= FEW:
            out = stored(now.coalesce(1).mapInPandas(_in_one_task, "node long, root long"), f"{at}/roots")
            discard(spark, f"{at}/{step}")
            return out
        before = tuple(mark)
        step += 1
        wide = stored(_star(_both(now), True), f"{at}/{step}-large")
        now = stored(_star(wide.where("v < u"), False), f"{at}/{step}")
        discard(spark, f"{at}/{step}-large", f"{at}/{step - 1}")
