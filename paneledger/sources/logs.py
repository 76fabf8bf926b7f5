"""Event logs from tables, and the catalogue of named logs.

A log is a DataFrame ``(log_id, t, *order, ...)``: independent logs side by side,
event times in epoch milliseconds, and columns that put the arrivals of a log in
a total order. Nothing is sorted here; the arrival index does that.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from paneledger.functions.times import epoch_ms


def arrival_log(df: DataFrame, t: str, tie: str, p: str | None = None, log_id: str = "'log'", k: str | None = None) -> DataFrame:
    """A log whose arrival order is a second timestamp ``p``, ties broken by
    ``tie`` (or ``tie`` alone where no processing time was recorded). All SQL."""
    columns = [f"{log_id} AS log_id", f"{t} AS t", f"{p or 'CAST(NULL AS BIGINT)'} AS p", f"{tie} AS seq"]
    return df.selectExpr(*columns, *([f"{k} AS k"] if k else []))


@dataclass(frozen=True)
class NamedLog:
    """A log that can be loaded by name."""

    name: str
    title: str
    event_time: str
    processing_time: str
    window_ms: int
    order: tuple[str, ...]
    load: Callable[[SparkSession, str], DataFrame]


def _delayed(key: str, t: str, per_step: str, steps: int) -> str:
    """A derived processing time: one fifth of the rows come late, by key."""
    return f"{t} + CASE WHEN ({key} * 7919) % 100 < 80 THEN 0L ELSE {per_step.format(d=f'(({key} * 104729) % {steps})')} END"


def _events(spark: SparkSession, folder: str, log_id: str, delayed: bool) -> DataFrame:
    t = epoch_ms("ts", ntz=True)
    p = _delayed("event_id", t, "{d} * {d} * 83L", 720) if delayed else None
    return arrival_log(spark.read.parquet(f"{folder}/events.parquet"), t, "event_id", p, log_id, "event_type")


def _orders(spark: SparkSession, folder: str) -> DataFrame:
    t = epoch_ms("o_orderdate", ntz=True)
    p = _delayed("o_orderkey", t, "{d} * 86400000L", 5)
    return arrival_log(spark.read.parquet(f"{folder}/orders.parquet"), t, "o_orderkey", p, "'orders'", "o_orderpriority")


NAMED_LOGS = {
    log.name: log
    for log in [
        NamedLog("events", "site events, one fifth of them delayed", "ts, to the millisecond",
                 "ts plus a delay derived from event_id", 3_600_000, ("p", "seq"), lambda spark, folder: _events(spark, folder, "'events'", True)),
        NamedLog("events_in_order", "site events in order of event_id", "ts, to the millisecond",
                 "not recorded; arrival order is event_id", 3_600_000, ("seq",), lambda spark, folder: _events(spark, folder, "'events_in_order'", False)),
        NamedLog("events_by_user", "site events, one log per user", "ts, to the millisecond",
                 "ts plus a delay derived from event_id", 3_600_000, ("p", "seq"), lambda spark, folder: _events(spark, folder, "CAST(user_id AS STRING)", True)),
        NamedLog("orders", "orders, one fifth of them delayed by days", "o_orderdate, to the day",
                 "o_orderdate plus a delay derived from o_orderkey", 86_400_000, ("p", "seq"), _orders),
    ]
}


def named_log(name: str) -> NamedLog:
    if name not in NAMED_LOGS:
        raise ValueError(f"unknown log {name!r}; known: {', '.join(NAMED_LOGS)}")
    return NAMED_LOGS[name]
