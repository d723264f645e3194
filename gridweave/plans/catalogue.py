"""Names of the engine's queries, each with its Spark plan and its SQL counterpart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.scalars import voltage_max
from ..operators.spatial import nearest
from . import attributes, commitment, exchange, model, network, repair, telemetry  # noqa: F401  register their queries
from .bridge import sql_with, view
from .attributes import NEAR, PLANAR, num
from .registry import QUERIES, SQL, Query, query

FLAGSHIP_SQL = (
    sql_with("gen", "sub")
    + f", v AS (SELECT sub_id, max(v) AS v FROM (SELECT sub_id, {num('p')} AS v FROM (SELECT sub_id, regexp_replace(trim(unnest(string_split_regex(regexp_replace(lower(trim(voltage)), '^dc', ''), '[;,]'))), '^dc', '') AS p FROM sub WHERE voltage IS NOT NULL)) WHERE v > 0 GROUP BY sub_id), n AS ("
    + NEAR.format(d=PLANAR, m=50).removeprefix(", ").replace("p AS", "WITH p AS", 1)
    + ") SELECT gen.region, CASE WHEN v >= 1000 THEN round(v / 1000, 1) ELSE round(v / 1000, 3) END AS kv, count(*) AS generators, round(sum(mw), 3) AS mw FROM gen JOIN n ON n.gen_id = gen.gen_id LEFT JOIN v ON v.sub_id = n.sub_id GROUP BY 1, 2"
)


@query("capacity_by_region_voltage", FLAGSHIP_SQL)
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generating capacity by region and by the voltage of the nearest substation within 50 km."""
    gen, sub = view(spark, sf_dir, "gen"), view(spark, sf_dir, "sub")
    left = gen.select("gen_id", F.col("lat").alias("llat"), F.col("lon").alias("llon"))
    right = sub.select("sub_id", F.col("lat").alias("rlat"), F.col("lon").alias("rlon"))
    near = nearest(left, "gen_id", right, "sub_id", 50.0, "planar").select("gen_id", "sub_id")
    kv = sub.select("sub_id", voltage_max(F.col("voltage")).alias("kv"))
    joined = gen.select("gen_id", "region", "mw").join(near, "gen_id").join(kv, "sub_id")
    return joined.groupBy("region", "kv").agg(F.count("*").alias("generators"), F.round(F.sum("mw"), 3).alias("mw"))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
