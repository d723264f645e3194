"""Queries over measurements in time; the same windows run as streams in ``gridweave.streaming``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..streaming.telemetry import sessions, tumbling
from .bridge import sql_with, view
from .registry import query


@query("telemetry_tumbling", sql_with("load") + " SELECT kind, time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n, round(sum(mw), 3) AS mw, round(max(mw), 6) AS peak FROM load GROUP BY 1, 2")
def telemetry_tumbling(spark: SparkSession, sf: str) -> DataFrame:
    return tumbling(view(spark, sf, "load"), "1 hour").withColumns({"mw": F.round("mw", 3), "peak": F.round("peak", 6)})


@query("telemetry_sessions", sql_with("load") + ", g AS (SELECT sub_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM load WINDOW w AS (PARTITION BY sub_id ORDER BY ts)), s AS (SELECT sub_id, ts, sum(new) OVER (PARTITION BY sub_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT sub_id, min(ts) AS start, count(*) AS n FROM s GROUP BY sub_id, k")
def telemetry_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return sessions(view(spark, sf, "load"), "30 minutes")
