"""The grid model over the driver's relational tables.

Each view is one SELECT that both engines read alike: integer arithmetic first, then one cast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: view -> (table, columns as (name, expression))
VIEWS: dict[str, tuple[str, list[tuple[str, str]]]] = {
    "sub": ("supplier", [
        ("sub_id", "s_suppkey"),
        ("name", "CASE WHEN s_suppkey % 7 = 0 THEN '' WHEN s_suppkey % 11 = 0 THEN concat('sub_', CAST(s_suppkey AS STRING)) WHEN s_suppkey % 5 = 0 THEN 'Central' ELSE s_name END"),
        ("region", "s_nationkey % 10"),
        ("lat", "33e0 + CAST((s_suppkey * 7919) % 4001 AS DOUBLE) / 1e3"),
        ("lon", "130e0 + CAST((s_suppkey * 10473) % 4003 AS DOUBLE) / 1e3"),
        ("voltage", "CASE s_suppkey % 8 WHEN 0 THEN '500000' WHEN 1 THEN '275000;66000' WHEN 2 THEN '77000,6600' WHEN 3 THEN 'yes' WHEN 4 THEN NULL WHEN 5 THEN '' WHEN 6 THEN '66000' ELSE '154000' END"),
        ("kv", "CASE s_suppkey % 6 WHEN 0 THEN 500e0 WHEN 1 THEN 275e0 WHEN 2 THEN 154e0 WHEN 3 THEN 66e0 WHEN 4 THEN 0e0 ELSE 187e0 END"),
        ("operator", "CASE s_suppkey % 4 WHEN 0 THEN 'East Power Grid Division' WHEN 1 THEN 'West Electric' WHEN 2 THEN ' ' ELSE 'Hydro Board' END"),
        ("balance", "s_acctbal"),
    ]),
    "gen": ("part", [
        ("gen_id", "p_partkey"), ("name", "p_name"), ("region", "p_partkey % 10"),
        ("lat", "33e0 + CAST((p_partkey * 6151) % 4007 AS DOUBLE) / 1e3"), ("lon", "130e0 + CAST((p_partkey * 3571) % 4013 AS DOUBLE) / 1e3"),
        ("mw", "CAST(p_size AS DOUBLE)"),
        ("capacity", "CASE p_partkey % 6 WHEN 0 THEN concat(CAST(p_size AS STRING), ' MW') WHEN 1 THEN concat(CAST(p_size * 100 AS STRING), ' kW') WHEN 2 THEN CAST(p_size * 1000 AS STRING) WHEN 3 THEN CAST(p_size AS STRING) WHEN 4 THEN concat(CAST(p_size AS STRING), '.5GW') ELSE 'unknown' END"),
        ("fuel", "CASE p_partkey % 9 WHEN 0 THEN 'gas' WHEN 1 THEN 'Coal' WHEN 2 THEN 'oil;gas' WHEN 3 THEN 'solar' WHEN 4 THEN 'wind' WHEN 5 THEN '' WHEN 6 THEN NULL WHEN 7 THEN 'tidal' ELSE 'nuclear' END"),
        ("label", "concat(CASE p_partkey % 5 WHEN 0 THEN 'Solar Park ' WHEN 1 THEN 'Wind Farm ' WHEN 2 THEN 'Big Dam ' WHEN 3 THEN 'Thermal Plant ' ELSE 'Site ' END, CAST(p_partkey AS STRING))"),
        ("sub_id", "CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE (p_partkey * 31) % 107 END"), ("cost", "CAST(1 + (p_partkey * 37) % 101 AS DOUBLE)"),
        ("up", "1 + p_partkey % 6"),
    ]),
    "line": ("orders", [
        ("line_id", "o_orderkey"), ("from_sub", "(o_orderkey * 7919) % 103"), ("to_sub", "(o_custkey * 4729 + o_orderkey) % 103"),
        ("kv", "CASE o_orderkey % 5 WHEN 0 THEN 500e0 WHEN 1 THEN 275e0 WHEN 2 THEN 154e0 WHEN 3 THEN 66e0 ELSE 187e0 END"),
        ("km", "CAST(o_orderkey % 97 AS DOUBLE) / 4e0"), ("mva", "CAST(o_custkey % 400 AS DOUBLE)"), ("status", "o_orderstatus"), ("region", "o_orderkey % 10"),
    ]),
    "link": ("supplier", [
        ("link_id", "s_suppkey"), ("a", "s_suppkey"),
        ("b", "CASE s_nationkey % 4 WHEN 0 THEN s_suppkey + 1 WHEN 1 THEN s_suppkey + 7 WHEN 2 THEN s_suppkey - s_suppkey % 5 ELSE s_suppkey END"),
    ]),
    "way": ("orders", [
        ("way_id", "o_orderkey"), ("region", "o_orderkey % 10"), ("name", "CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE concat('Way ', CAST(o_orderkey % 500 AS STRING)) END"),
        ("lat1", "33e0 + CAST((o_orderkey * 7919) % 4001 AS DOUBLE) / 1e3"), ("lon1", "130e0 + CAST((o_orderkey * 10473) % 4003 AS DOUBLE) / 1e3"),
        ("lat2", "33e0 + CAST((o_custkey * 6151) % 4007 AS DOUBLE) / 1e3"), ("lon2", "130e0 + CAST((o_orderkey * 10473 + o_custkey) % 4003 AS DOUBLE) / 1e3"),
        ("kv", "CASE o_orderkey % 7 WHEN 0 THEN 500e0 WHEN 1 THEN 275e0 WHEN 2 THEN 154e0 WHEN 3 THEN 66e0 WHEN 4 THEN 187e0 WHEN 5 THEN 100e0 ELSE 33e0 END"),
    ]),
    "load": ("events", [
        ("event_id", "event_id"), ("ts", "ts"), ("sub_id", "user_id % 100"), ("kind", "event_type"), ("mw", "value"),
    ]),
    "run": ("lineitem", [
        ("unit", "l_partkey"), ("t", "(l_orderkey * 8 + l_linenumber)"), ("method", "l_returnflag"), ("ok", "l_linestatus = 'F'"), ("iterations", "l_quantity"), ("from_sub", "l_suppkey"), ("to_sub", "l_partkey % 100"), ("day", "l_shipdate"), ("flow", "l_discount * l_quantity"), ("mw", "l_quantity"),
    ]),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, columns = VIEWS[name]
    return spark.read.parquet(f"{sf_dir}/{source}.parquet").selectExpr(*(f"{e} AS `{n}`" for n, e in columns))


def sql_with(*names: str) -> str:
    """The WITH clause that defines the views for the other engine."""
    parts = []
    for n in names:
        source, columns = VIEWS[n]
        listed = ", ".join(f"{e} AS {c}" for c, e in columns)
        parts.append(f"{n} AS (SELECT {listed} FROM {source})")
    return "WITH " + ", ".join(parts)
