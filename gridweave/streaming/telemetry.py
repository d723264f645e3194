"""Windows over measurements (sub_id, kind, ts, mw); each runs on a batch or, with a watermark, on a stream.

The engine's model has no streams of its own; these extend it to live telemetry.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def late(df: DataFrame, delay: str | None) -> DataFrame:
    return df.withWatermark("ts", delay) if delay else df


def tumbling(df: DataFrame, size: str, delay: str | None = None, slide: str | None = None) -> DataFrame:
    """kind, start, n, mw, peak of each window; ``slide`` makes windows overlap."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    x = late(df, delay).groupBy("kind", w.alias("w")).agg(F.count("*").alias("n"), F.sum("mw").alias("mw"), F.max("mw").alias("peak"))
    return x.select("kind", F.col("w.start").alias("start"), "n", "mw", "peak")


def sessions(df: DataFrame, gap: str, delay: str | None = None) -> DataFrame:
    """sub_id, start, n of each run of measurements without a pause of ``gap``."""
    x = late(df, delay).groupBy("sub_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return x.select("sub_id", F.col("w.start").alias("start"), "n")


def alarms(df: DataFrame, limit: float) -> DataFrame:
    """Changes of state above or below ``limit`` per substation, with state kept across batches (streams only)."""

    def watch(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        high = state.get[0] if state.exists else False
        out = []
        rows = pd.concat(list(frames)).sort_values("ts")
        for ts, mw in zip(rows.ts, rows.mw, strict=True):
            if (mw > limit) != high:
                high = not high
                out.append((key[0], ts, high))
        state.update((high,))
        yield pd.DataFrame(out, columns=["sub_id", "ts", "high"])

    return df.groupBy("sub_id").applyInPandasWithState(watch, "sub_id long, ts timestamp, high boolean", "high boolean", "append", GroupStateTimeout.NoTimeout)
