"""Time-windowed aggregates that run alike on static and on streaming DataFrames.

Unordered windows over a whole stream have no end, so the streaming form of a keyed aggregate is a tumbling
window with a watermark; projections, filters and scalar expressions need no streaming form.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling_aggregate(df: DataFrame, time: str, width: str, keys: list[str], value: str, delay: str | None = None) -> DataFrame:
    """SUM and COUNT of ``value`` for each key and window; rows later than ``delay`` are dropped from a stream."""
    if df.isStreaming and delay is None:
        raise ValueError("a stream needs a delay, or its state never ends")
    rows = df.withWatermark(time, delay) if delay and df.isStreaming else df
    return (
        rows.groupBy(F.window(time, width).alias("w"), *keys)
        .agg(F.coalesce(F.sum(value), F.lit(0)).alias("total"), F.count(value).alias("n"))
        .select(F.col("w.start").alias("window_start"), *keys, "total", "n")
    )
