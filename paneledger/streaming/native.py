"""Spark's own watermark, for comparison. An approximation only: the watermark
moves once per micro-batch and lacks the inclusive-boundary correction, late rows
are dropped without a receipt, and a window emits one value, never a revision."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paneledger.config import Config


def native_tumbling(stream: DataFrame, config: Config) -> DataFrame:
    """Counts per window of a stream ``(log_id, t)``, in append mode."""
    bound = config.watermark.bound_ms + config.allowed_lateness_ms
    offset = config.offset_ms % config.window_ms
    timed = stream.selectExpr("log_id", "timestamp_millis(t) AS ts").withWatermark("ts", f"{bound} milliseconds")
    window = F.window("ts", f"{config.window_ms} milliseconds", startTime=f"{offset} milliseconds")
    return timed.groupBy("log_id", window).agg(F.count(F.lit(1)).alias("count")).selectExpr(
        "log_id", "unix_millis(window.start) AS win_start", "unix_millis(window.end) AS win_end", "count")
