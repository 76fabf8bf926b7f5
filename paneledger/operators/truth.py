"""What the log says when all of it has arrived: counts, lateness, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame

from paneledger.functions.windows import window_end, window_start
from paneledger.operators.arrival import EVENT_LATENESS
from paneledger.operators.judge import aggregates
from paneledger.operators.panes import per_log
from paneledger.operators.scan import ordered_scan, running_sum

# Fixed quantiles of a lateness profile.
PROFILE_QUANTILES = {"p50": "0.5D", "p90": "0.9D", "p99": "0.99D", "p999": "0.999D"}


def batch_windows(log: DataFrame, window_ms: int, offset_ms: int = 0) -> DataFrame:
    """Events per window, whatever their order: the truth a run is held against."""
    return (
        log.selectExpr("log_id", f"{window_start('t', window_ms, offset_ms)} AS win_start")
        .groupBy("log_id", "win_start").agg(*aggregates(count="count(1)"))
        .selectExpr("log_id", "win_start", f"{window_end('win_start', window_ms)} AS win_end", "count")
    )


def lateness_profile(indexed: DataFrame, blocks: int | None = None) -> DataFrame:
    """Out-of-order share and exact nearest-rank lateness quantiles per log.

    Quantile p of n values is the one at rank min(n - 1, floor(p n)), found from
    the running count over the distinct lateness values.
    """
    counted = indexed.selectExpr("log_id", f"{EVENT_LATENESS} AS late_ms").groupBy("log_id", "late_ms").agg(
        *aggregates(n="count(1)"))
    ranked = ordered_scan(counted, ["log_id"], ["late_ms"], {"rank_end": running_sum("rank_end", "n")}, blocks, derived=True).rows
    totals = ranked.groupBy("log_id").agg(*aggregates(total="sum(n)"))
    quantiles = {
        name: f"max(late_ms) FILTER (WHERE rank_end - n <= least(total - 1, floor({p} * total)) "
              f"AND least(total - 1, floor({p} * total)) < rank_end)"
        for name, p in PROFILE_QUANTILES.items()
    }
    late = "coalesce(sum(n) FILTER (WHERE late_ms > 0), 0L)"
    return per_log(ranked, totals).groupBy("log_id").agg(*aggregates(
        events="sum(n)", out_of_order=late, out_of_order_pct=f"{late} * 100D / sum(n)", **quantiles,
        max_lateness="max(late_ms)",
    ))


def stream_stats(log: DataFrame) -> DataFrame:
    """Events, event-time span, and how many events share one event time."""
    return log.groupBy("log_id").agg(*aggregates(
        events="count(1)", span_ms="max(t) - min(t)", distinct_event_times="count(DISTINCT t)",
        events_per_distinct_time="round(count(1) / count(DISTINCT t), 2)",
    ))
