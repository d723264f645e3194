"""Relational operators of the grid model: sharing, merging, ordering and attribute updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def share(df: DataFrame, total: Column, weight: Column, by: list[str], out: str) -> DataFrame:
    """``total`` split by ``weight`` inside each group; equal parts where no weight is positive.

    The group's sums come from a partial aggregate joined back, so no group is gathered anywhere.
    """
    w = df.withColumn("_w", F.greatest(weight, F.lit(0.0)))
    sums = w.groupBy(*by).agg(F.sum("_w").alias("_sum"), F.count("*").alias("_n"))
    part = F.when(F.col("_sum") > 0, F.col("_w") / F.col("_sum")).otherwise(1.0 / F.col("_n"))
    return w.join(sums, by).withColumn(out, total * part).drop("_w", "_sum", "_n")


def parallel_merged(lines: DataFrame) -> DataFrame:
    """Lines (a, b, r, x, mva) between the same two ends as one: admittances and ratings add up."""
    z2 = F.col("r") * F.col("r") + F.col("x") * F.col("x")
    y = lines.where(z2 > 1e-12).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), (F.col("r") / z2).alias("g"), (F.col("x") / z2).alias("s"), "mva")
    m = y.groupBy("a", "b").agg(F.sum("g").alias("g"), F.sum("s").alias("s"), F.sum("mva").alias("mva"), F.count("*").alias("circuits"))
    n = F.col("g") * F.col("g") + F.col("s") * F.col("s")
    return m.select("a", "b", (F.col("g") / n).alias("r"), (F.col("s") / n).alias("x"), "mva", "circuits")


def first_wins(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row for each key: the first by ``order``; a partial aggregate, not a window."""
    rest = [c for c in df.columns if c not in key]
    best = df.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return best.select(*key, "_r.*").select(df.columns)


def unique_matches(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join on the keys that occur exactly once on both sides."""
    once = lambda df: df.join(df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n")).where("_n = 1").select(key), key, "left_semi")
    return once(left).join(once(right), key)


def suffixed(df: DataFrame, name: str, order: str) -> DataFrame:
    """Names that occur more than once get _1, _2, ... by ``order``."""
    w = Window.partitionBy(name)
    n = F.row_number().over(w.orderBy(order))
    return df.withColumn("unique_name", F.when(F.count("*").over(w) > 1, F.concat(F.col(name), F.lit("_"), n.cast("string"))).otherwise(F.col(name)))


def windows_over(n: int, size: int, overlap: int) -> list[tuple[int, int, int]]:
    """(window, start, stop) of overlapping windows over 0..n; the last one is cut and ends the list."""
    out, start, step = [], 0, size - overlap
    while True:
        out.append((len(out), start, min(start + size, n)))
        if start + size >= n:
            return out
        start += step


def upserted(table: DataFrame, changes: DataFrame, key: str, supplied: dict[str, str]) -> DataFrame:
    """Rows of ``table`` with ``changes`` applied; ``supplied``: column -> name of its flag in ``changes``.

    A flagged null overwrites; an unflagged column stays as it is; new keys are inserted.
    """
    unknown = set(supplied) - set(table.columns)
    if unknown:
        raise AttributeError(f"no such columns: {sorted(unknown)}")
    old, new = table.alias("o"), changes.alias("n")
    joined = old.join(new, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    pick = [F.coalesce(F.col(f"o.{key}"), F.col(f"n.{key}")).alias(key)]
    for c in table.columns:
        if c in supplied:
            pick.append(F.when(F.col(f"n.{supplied[c]}"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
        elif c != key:
            pick.append(F.col(f"o.{c}").alias(c))
    return joined.select(pick)


def deleted(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return table.join(keys.select(key).distinct(), key, "left_anti")


def stacked(parts: DataFrame, group: str, order: str) -> DataFrame:
    """Adds ``bus``: consecutive numbers over groups, each group's offset being the rows before it.

    Group sizes are few rows; numbers inside a group come from a window over that group.
    """
    sizes = parts.groupBy(group).agg(F.count("*").alias("_n"))
    before = Window.orderBy(group).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(group, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    local = F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1
    return parts.withColumn("_local", local).join(F.broadcast(offsets), group).withColumn("bus", F.col("_base") + F.col("_local")).drop("_base", "_local")
