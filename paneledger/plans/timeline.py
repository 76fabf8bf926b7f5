"""What happened at each arrival: a mark per event, and every pane it caused."""

from __future__ import annotations

from pyspark.sql import DataFrame

from paneledger.functions.text import human_ms
from paneledger.names import LATE_IN_BOUND, TOO_LATE
from paneledger.operators import panes
from paneledger.plans.run import Run

COLUMNS = ["log_id", "index", "t", "watermark", "mark", "win_start", "pane_seq", "count", "note"]


def _pane_note(word: str, retracts: str) -> str:
    return (
        f"concat('{word} [', win_start, ',', win_end, ') = ', count, "
        f"CASE WHEN {retracts} IS NULL THEN '' ELSE concat(' (was ', {retracts}, ')') END)"
    )


def timeline(run: Run) -> DataFrame:
    """One row per arrival, with its own pane if it caused one, and one row per
    window that the arrival closed. Marks: ``!`` went to the side output, ``*``
    revised a pane, ``o`` any other arrival, ``|`` the watermark closed a window.
    ``watermark`` is the one after the event.

    The event that closes a window is known from the crossing, so nothing is
    joined back to the events, however many windows one event closes.
    """
    policy = run.config.late_policy
    refused = f"cls = '{TOO_LATE}'" + (f" OR cls = '{LATE_IN_BOUND}'" if policy == "side-output" else "")
    mark = f"CASE WHEN {refused} THEN '!' ELSE 'o' END"
    plain = run.judged.where(f"cls <> '{LATE_IN_BOUND}'") if policy == "update" else run.judged
    rows = plain.selectExpr(
        "log_id", "i AS index", "t", "w_after AS watermark", f"{mark} AS mark", "win_start",
        "CAST(NULL AS BIGINT) AS pane_seq", "CAST(NULL AS BIGINT) AS count",
        f"CASE WHEN {refused} THEN concat('refused, ', {human_ms('(w_before - win_end)')}, ' after the close') ELSE '' END AS note",
    )
    if policy == "update":
        rows = rows.unionByName(panes.late_panes(run.judged, run.counts).selectExpr(
            "log_id", "at_index AS index", "t", "w_after AS watermark",
            "CASE WHEN kind = 'revision' THEN '*' ELSE 'o' END AS mark", "win_start", "seq AS pane_seq", "count",
            f"CASE WHEN kind = 'revision' THEN {_pane_note('revised', 'retracts')} ELSE {_pane_note('closed', 'retracts')} END AS note",
        ))
    closes = run.firing_panes.selectExpr(
        "log_id", "at_index AS index", "trigger.t AS t", "watermark",
        "'|' AS mark",
        "win_start", "seq AS pane_seq", "count", f"{_pane_note('closed', 'retracts')} AS note",
    )
    return rows.unionByName(closes).select(*COLUMNS)
