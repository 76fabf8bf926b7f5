"""Window states and panes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paneledger.config import Config
from paneledger.names import END_OF_STREAM, LATE_IN_BOUND, ON_TIME
from paneledger.operators.crossing import FIRE, RELEASE
from paneledger.operators.judge import aggregates
from paneledger.operators.scan import BEFORE, ordered_scan, running_index

PANE_COLUMNS = [
    "log_id", "win_start", "win_end", "seq", "kind", "count", "retracts", "watermark", "at_index", "own_pane", "opened_index",
]
HAS_STATE = "on_time + late_in_bound > 0"
OPENED_LATE = "(on_time = 0 AND late_in_bound > 0)"


# Columns of ``window_counts`` that are not part of a window's state.
NOT_STATE = ["first_late_index", "first_late_before", "first_late_after", "events", "w_last", "log_events", "kept"]


def per_log(rows: DataFrame, logs: DataFrame, few: bool = False) -> DataFrame:
    """Join the columns of ``logs``, one row each, to rows. A plain left join, so the
    engine picks at run time: few logs are sent to the rows; else both are shuffled,
    and the rows of a log that holds too many are split over as many tasks as needed.
    A caller who has counted ``few`` logs has them sent at once: the engine would shuffle
    the rows before it sees that, and a table that is held keeps what they fell into."""
    return rows.join(F.broadcast(logs) if few else logs, "log_id", "left")


def with_ends(tallied: DataFrame, health: DataFrame) -> DataFrame:
    """Every window with any event, and of its log the events ``log_events`` and how far
    the watermark got, ``w_last``."""
    return per_log(tallied, health.selectExpr("log_id", "w_last", "events AS log_events"))


def window_counts(known: DataFrame, config: Config) -> DataFrame:
    """``with_ends`` and what the run made of the events of each window, the panes and
    the emitted value. ``kept`` says whether the run had state for it, that is, any event
    was not too late. Needs no crossing; other columns are carried as they are."""
    update = config.late_policy == "update"
    reached = "true" if config.termination == "flush" else "coalesce(w_last >= win_end, false)"
    revisions = "late_in_bound" if update else "0L"
    unopened = revisions if update else "1L"
    panes = f"CASE WHEN on_time > 0 THEN CASE WHEN {reached} THEN 1L + {revisions} ELSE 0L END WHEN late_in_bound > 0 THEN {unopened} ELSE 0L END"
    return known.selectExpr("*", f"on_time + {revisions} AS count", f"{panes} AS panes").selectExpr(
        "log_id", "win_start", "win_end", "count", "CASE WHEN panes > 0 THEN count END AS emitted", "panes",
        "panes > 0 AS fired", f"{OPENED_LATE} AND {str(update).lower()} AS opened_after_close",
        "on_time", "late_in_bound", "too_late", "first_index", "last_index",
        "first_late_index", "first_late_before", "first_late_after", "events", "w_last", "log_events", f"{HAS_STATE} AS kept",
        *[c for c in (FIRE, RELEASE) if c in known.columns],
    )


def window_state(crossed: DataFrame, config: Config) -> DataFrame:
    """The kept windows of ``window_counts`` with their crossings: when each window fired
    and was released."""
    at_end = f"{END_OF_STREAM}L" if config.termination == "flush" else "CAST(NULL AS BIGINT)"
    late_open = "first_late_before" if config.late_policy == "update" else "first_late_after"
    return crossed.selectExpr(
        *[c for c in crossed.columns if c not in [*NOT_STATE, FIRE, RELEASE]],
        f"CASE WHEN {OPENED_LATE} THEN {late_open} WHEN fired THEN coalesce(fire.watermark, {at_end}) END AS fired_at_watermark",
        f"coalesce(release.watermark, {at_end}) AS collected_at_watermark",
    ).selectExpr("*", "collected_at_watermark IS NOT NULL AS collected")


def firing_panes(rows: DataFrame, config: Config) -> DataFrame:
    """The pane of each window that the watermark (or the flush) closed, with the
    event that did it in ``trigger``, from the kept windows and their crossings."""
    fire = "fire"
    if config.termination == "flush":
        fire = (
            f"coalesce(fire, named_struct('index', log_events, 'watermark', {END_OF_STREAM}L, "
            "'t', CAST(NULL AS BIGINT)))"
        )
    own = "on_time > 0" if config.late_policy == "update" else "true"
    return (
        rows.selectExpr("*", f"CASE WHEN on_time > 0 THEN {fire} END AS trigger")
        .where(f"{own} AND (trigger IS NOT NULL OR on_time = 0)")
        .selectExpr(
            "log_id", "win_start", "win_end", "1L AS seq", "'initial' AS kind", "on_time AS count",
            "CAST(NULL AS BIGINT) AS retracts",
            "CASE WHEN on_time > 0 THEN trigger.watermark ELSE first_late_after END AS watermark",
            "CASE WHEN on_time > 0 THEN trigger.index ELSE first_late_index END AS at_index",
            "false AS own_pane", "first_index AS opened_index", "trigger",
        )
    )


def late_positions(judged: DataFrame, counts: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """Late events with their ordinal ``nth`` among the late events of their window, and
    of the window, from ``counts``, the on-time count and the index that opened it.

    Ordinals are counted inside (window, block), which bounds the group even when
    one window holds a third of the log, and shifted by the counts of the blocks
    before; only late events are read. A streaming run, whose ``counts`` include what
    its live windows ``prior`` had counted, goes on from there.
    """
    keys = ["log_id", "win_start", "blk"]
    late = judged.where(f"cls = '{LATE_IN_BOUND}'")
    before = f"coalesce(sum(n_late) OVER (PARTITION BY log_id, win_start ORDER BY blk {BEFORE}), 0L)"
    parts = late.groupBy(*keys).agg(*aggregates(n_late="count(1)")).selectExpr(*keys, f"{before} AS late_before")
    parts = parts.join(counts.selectExpr("log_id", "win_start", "on_time", "first_index AS opened_index"), ["log_id", "win_start"])
    if prior is not None:
        known = prior.selectExpr("log_id", "win_start", "late_in_bound AS p_late")
        parts = parts.join(known, ["log_id", "win_start"], "left").selectExpr(
            *keys, "on_time", "opened_index", "late_before + coalesce(p_late, 0L) AS late_before")
    return (
        late.selectExpr("*", "row_number() OVER (PARTITION BY log_id, win_start, blk ORDER BY i) AS in_part")
        .join(parts, keys).selectExpr("*", "in_part + late_before AS nth").drop("in_part", "late_before")
    )


def late_panes(judged: DataFrame, counts: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """Under ``update``, the pane of every late event: a revision, or the first
    pane of a window that had no event before the watermark passed it."""
    first = "on_time = 0 AND nth = 1"
    return late_positions(judged, counts, prior).selectExpr(
        "log_id", "win_start", "win_end",
        "CASE WHEN on_time > 0 THEN nth + 1 ELSE nth END AS seq",
        f"CASE WHEN {first} THEN 'initial' ELSE 'revision' END AS kind",
        "on_time + nth AS count",
        f"CASE WHEN {first} THEN NULL ELSE on_time + nth - 1 END AS retracts",
        "w_before AS watermark", "i AS at_index", "true AS own_pane", "opened_index",
        "t", "w_after",
    )


# Emission order: by index; at one index the event's own pane, then the windows
# it closed in the order they were opened.
PANE_ORDER = ["log_id", "at_index", "own_pane DESC", "opened_index"]


def emission_order(panes: DataFrame, blocks: int | None = None) -> DataFrame:
    """``panes`` with ``pos``, their place in the order in which their log emitted them.
    One event may close any number of windows: the panes at one index are cut like any
    other stretch of the log, by the windows' opening."""
    ordered = panes.selectExpr("*", "IF(own_pane, 0, 1) AS turn")
    return ordered_scan(ordered, ["log_id"], ["at_index", "turn", "opened_index"], {"pos": running_index("pos")}, blocks, derived=True).rows.drop("turn", "blk")
