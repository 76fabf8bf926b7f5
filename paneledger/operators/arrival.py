"""The arrival index: an event log with positions and running maxima."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from paneledger.operators.scan import first_of_group, ordered_scan, running_index, running_max, running_max_before


NO_LOG, NO_TIME, NO_PLACE = "no log", "no event time", "no place in the arrival order"


@dataclass(frozen=True)
class ArrivalIndex:
    """Rows ``(log_id, blk, i, t, max_before, max_seen, first_t, ...)``.

    ``i`` is the 0-based arrival position in the log, ``max_seen`` the highest
    event time up to and including the row, ``max_before`` the same without the
    row (NULL for the first), ``first_t`` the event time of the first arrival.
    ``events`` has the input columns only, ``rejects`` the rows that are in neither,
    with a ``reason``; ``total`` counts the rows. Independent of any configuration: build
    once, run many.
    """

    rows: DataFrame
    events: DataFrame
    rejects: DataFrame
    total: int


def reject_reason(order: list[str]) -> str:
    """SQL of why a row cannot be an event, NULL if it can."""
    missing = " OR ".join(f"{c} IS NULL" for c in order)
    return f"CASE WHEN log_id IS NULL THEN '{NO_LOG}' WHEN t IS NULL THEN '{NO_TIME}' WHEN {missing} THEN '{NO_PLACE}' END"


def index_log(
    log: DataFrame, order: list[str] = ["seq"], keep_columns: list[str] = [], blocks: int | None = None,  # noqa: B006
    on_bad: str = "quarantine",
) -> ArrivalIndex:
    """Index a log of ``(log_id, t, *order)``.

    Rows without a log, a time or a place go to ``rejects``; with ``on_bad='fail'``
    they raise, and so does an order that is not total (several rows of a log at one
    place), without which a run would not be repeatable.
    """
    if on_bad not in ("fail", "quarantine"):
        raise ValueError(f"unknown on_bad {on_bad!r}; known: fail, quarantine")
    columns = dict.fromkeys(["log_id", "t", *order, *keep_columns])
    checked = log.selectExpr(*columns, f"{reject_reason(order)} AS reason")
    rejects, log = checked.where("reason IS NOT NULL"), checked.where("reason IS NULL").drop("reason")
    if on_bad == "fail":
        if (bad := rejects.first()) is not None:
            raise ValueError(f"log {bad.log_id!r}: {bad.reason}")
        if (bad := repeated_positions(log, order).first()) is not None:
            raise ValueError(f"log {bad.log_id!r}: {bad['count']} rows at {[bad[c] for c in order]}")
    running = {
        "i": running_index("i"),
        "max_seen": running_max("max_seen", "t"),
        "max_before": running_max_before("max_seen", "t"),
        "first_t": first_of_group("first_t", "t"),
    }
    scanned = ordered_scan(log.select(*columns), ["log_id"], order, running, blocks)
    kept = [c for c in columns if c != "log_id"]
    return ArrivalIndex(
        scanned.rows.select("log_id", "blk", "i", "max_before", "max_seen", "first_t", *kept),
        scanned.events.select("log_id", *kept),
        rejects, scanned.total,
    )


def repeated_positions(log: DataFrame, order: list[str] = ["seq"]) -> DataFrame:  # noqa: B006
    """Positions that several rows of a log claim; an order with any is not total,
    and a run over it would not be repeatable."""
    return log.groupBy("log_id", *order).count().where("count > 1")


def first_rows(index: ArrivalIndex, n: int) -> DataFrame:
    """The first ``n`` arrivals of every log, contiguous, not a sample."""
    return index.rows.where(f"i < {n}")


# How far an event is behind the highest event time seen so far.
EVENT_LATENESS = "greatest(0L, coalesce(max_before, t) - t)"
