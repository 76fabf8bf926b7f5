"""Judging events, and the per-window tally of the judgements."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from paneledger.config import Config
from paneledger.functions.windows import window_end, window_start
from paneledger.names import LATE_IN_BOUND, ON_TIME, TOO_LATE
from paneledger.operators.arrival import EVENT_LATENESS


def event_class(allowed_lateness_ms: int) -> str:
    """An event is judged by its window's end against the watermark before it."""
    return (
        f"CASE WHEN w_before >= win_end + {allowed_lateness_ms}L THEN '{TOO_LATE}' "
        f"WHEN w_before >= win_end THEN '{LATE_IN_BOUND}' ELSE '{ON_TIME}' END"
    )


def judge(watermarked: DataFrame, config: Config) -> DataFrame:
    """Adds ``win_start, win_end, lateness_ms, cls`` to watermarked rows."""
    start = window_start("t", config.window_ms, config.offset_ms)
    return (
        watermarked.selectExpr("*", f"{start} AS win_start", f"{EVENT_LATENESS} AS lateness_ms")
        .selectExpr("*", f"{window_end('win_start', config.window_ms)} AS win_end")
        .selectExpr("*", f"{event_class(config.allowed_lateness_ms)} AS cls")
    )


def aggregates(**named: str) -> list[F.Column]:
    return [F.expr(sql).alias(name) for name, sql in named.items()]


def tally(judged: DataFrame) -> DataFrame:
    """One row per (log, window) with any event, from one pass over the events.

    Every aggregate combines before the shuffle, so a window holding a third of
    the log costs one row per task. The watermark before a log's events never
    falls, so the minimum over late events is the value at the first of them.
    """
    kept, late = f"FILTER (WHERE cls <> '{TOO_LATE}')", f"FILTER (WHERE cls = '{LATE_IN_BOUND}')"
    return judged.groupBy("log_id", "win_start", "win_end").agg(*aggregates(
        events="count(1)",
        on_time=f"count_if(cls = '{ON_TIME}')",
        late_in_bound=f"count_if(cls = '{LATE_IN_BOUND}')",
        too_late=f"count_if(cls = '{TOO_LATE}')",
        first_index=f"min(i) {kept}",
        last_index=f"max(i) {kept}",
        first_late_index=f"min(i) {late}",
        first_late_before=f"min(w_before) {late}",
        first_late_after=f"min(w_after) {late}",
        w_max="max(w_after)",
        min_t="min(t)",
        max_t="max(t)",
        max_lateness_ms="max(lateness_ms)",
        overshoots="count_if(w_after > max_seen)",
        max_overshoot_ms="coalesce(max(w_after - max_seen) FILTER (WHERE w_after > max_seen), 0L)",
        regressions="count_if(raw < w_after)",
        max_regression_ms="coalesce(max(w_after - raw) FILTER (WHERE raw < w_after), 0L)",
    ))


def log_health(tallied: DataFrame) -> DataFrame:
    """Per log: how far the watermark got, and how the strategy behaved."""
    return tallied.groupBy("log_id").agg(*aggregates(
        events="sum(events)",
        w_last="max(w_max)",
        watermark_overshoots="sum(overshoots)",
        max_overshoot_ms="max(max_overshoot_ms)",
        watermark_regressions="sum(regressions)",
        max_regression_ms="max(max_regression_ms)",
        max_lateness_ms="max(max_lateness_ms)",
        min_event_time="min(min_t)",
        max_event_time="max(max_t)",
    ))


def receipts(judged: DataFrame, config: Config) -> DataFrame:
    """The side output: every refused event with the reason, once."""
    refused = f"'{TOO_LATE}', '{LATE_IN_BOUND}'" if config.late_policy == "side-output" else f"'{TOO_LATE}'"
    beyond = (
        "concat('beyond allowed lateness: watermark ', w_before, ' >= windowEnd ', win_end, "
        f"' + allowedLateness {config.allowed_lateness_ms}')"
    )
    return judged.where(f"cls IN ({refused})").selectExpr(
        "log_id", "i AS index", "t", "win_start", "win_end",
        f"CASE WHEN cls = '{TOO_LATE}' THEN {beyond} "
        "ELSE 'late but within allowed lateness; policy is side-output' END AS reason",
        "w_before - win_end AS lateness_ms",
    )


def trace(judged: DataFrame) -> DataFrame:
    """The emitted watermark, on change only."""
    return judged.where("NOT (w_after <=> w_before)").selectExpr("log_id", "i AS index", "w_after AS watermark")


def observed(judged: DataFrame) -> tuple[DataFrame, Observation]:
    """``judged``, and its counters and the watermark's health over all logs as metrics
    of whatever job reads it whole: they cost no pass of their own. Every event is on
    time, late or refused, so the first is the sum of the next three."""
    metrics = Observation()
    return judged.observe(metrics, *aggregates(
        total="count(1)",
        on_time=f"count_if(cls = '{ON_TIME}')",
        late_in_bound=f"count_if(cls = '{LATE_IN_BOUND}')",
        too_late=f"count_if(cls = '{TOO_LATE}')",
        watermark_overshoots="count_if(w_after > max_seen)",
        watermark_regressions="count_if(raw < w_after)",
        w_last="max(w_after)",
        max_lateness_ms="max(lateness_ms)",
    )), metrics
