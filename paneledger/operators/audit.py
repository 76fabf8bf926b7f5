"""The audit: what panes, receipts and watermarks can be shown to be worth.

Every function takes plain tables, so the tables of any streaming job can be
audited, not only those of ``plans.run``; ``audit_panes`` starts from what a job
emits:

- windows   ``(log_id, win_start, win_end, emitted, panes, fired, on_time,
  late_in_bound, opened_after_close, collected_at_watermark?)``
- truth     ``(log_id, win_start, win_end, count)``, see ``truth.batch_windows``
- receipts  ``(log_id, win_start, lateness_ms, ...)``, one row per refused event
- panes     ``(log_id, win_start, seq, kind, count, retracts, ...)``
- health    one row per log, see ``judge.log_health``

An *outcome* is about a window; a *finding* accuses the engine.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame

from paneledger.config import Config
from paneledger.functions.text import watermark_text
from paneledger.functions.windows import window_end, window_start
from paneledger.names import END_OF_STREAM, LATE_IN_BOUND, ON_TIME
from paneledger.operators.judge import aggregates, event_class
from paneledger.operators.panes import per_log
from paneledger.operators.scan import last_known, last_known_before, ordered_scan, running_max
from paneledger.operators.truth import batch_windows

KEYS = ["log_id", "win_start"]
ACCUSING = "coalesce(reason IN ('no-pane-after-close', 'unexplained-shortfall'), false)"


def _text(*parts: str) -> str:
    """Concatenate SQL parts; a NULL reads ``null``."""
    return f"concat({', '.join(p if p.startswith(chr(39)) else f'coalesce(CAST({p} AS STRING), {chr(39)}null{chr(39)})' for p in parts)})"


def _finding(rows: DataFrame, code: str, detail: str, window: str = "CAST(NULL AS BIGINT)") -> DataFrame:
    return rows.selectExpr("log_id", f"'{code}' AS code", "'defect' AS severity", f"{window} AS win_start", f"{detail} AS detail")


def follow(log: DataFrame, trace: DataFrame, releases: DataFrame | None = None) -> DataFrame:
    """A job's tables merged in arrival order, in one scan: the indexed ``log`` (log_id,
    i, t), the steps of its watermark in ``trace`` (log_id, index, watermark; on change is
    enough) and, if it tells, when it gave up the state of a window in ``releases``
    (log_id, win_start, index). At one index the event comes first, then the steps, then
    the releases.

    Every row knows the highest event time so far ``max_seen``, the index of the last
    event ``last_i``, and the watermark before it ``w_before`` and with it ``w_now``.
    """
    merged = log.selectExpr("log_id", "i AS at", "0 AS kind", "t", "CAST(NULL AS BIGINT) AS watermark", "CAST(NULL AS BIGINT) AS win_start").unionByName(
        trace.selectExpr("log_id", "index AS at", "1 AS kind", "CAST(NULL AS BIGINT) AS t", "watermark", "CAST(NULL AS BIGINT) AS win_start"))
    if releases is not None:
        merged = merged.unionByName(releases.selectExpr(
            "log_id", "index AS at", "2 AS kind", "CAST(NULL AS BIGINT) AS t", "CAST(NULL AS BIGINT) AS watermark", "win_start"))
    running = {
        "max_seen": running_max("max_seen", "t"),
        "last_i": running_max("last_i", "IF(kind = 0, at, NULL)"),
        "w_now": last_known("w_now", "watermark"),
        "w_before": last_known_before("w_now", "watermark"),
    }
    # A row that is repeated, or steps at one index, must not share a place in the order.
    order = ["at", "kind", "watermark", "win_start"]
    return ordered_scan(merged, ["log_id"], order, running, derived=True).rows


def health_from_trace(followed: DataFrame) -> DataFrame:
    """How a job's watermark behaved, per log: the columns of ``judge.log_health`` that
    the audit needs.

    An event counts as overshot if the watermark stands above the highest event time
    once it has been taken in: as it stood before the event, put right by every step
    that the event caused. A step that falls counts as a regression. The flush, which
    comes after all events, is neither.
    """
    def over(watermark: str) -> str:
        return f"({watermark} < {END_OF_STREAM} AND {watermark} > max_seen)"

    own_step = "kind = 1 AND at = last_i"
    return followed.groupBy("log_id").agg(*aggregates(
        events="count_if(kind = 0)",
        w_last="max(watermark)",
        watermark_overshoots=f"count_if(kind = 0 AND {over('w_before')}) + count_if({own_step} AND {over('watermark')})"
                             f" - count_if({own_step} AND {over('w_before')})",
        max_overshoot_ms=f"greatest(0L, max(w_before - max_seen) FILTER (WHERE kind = 0 AND {over('w_before')}),"
                         f" max(watermark - max_seen) FILTER (WHERE {own_step} AND {over('watermark')}))",
        watermark_regressions="count_if(kind = 1 AND watermark < w_before)",
        max_regression_ms="coalesce(max(w_before - watermark) FILTER (WHERE kind = 1 AND watermark < w_before), 0L)",
    ))


def windows_from_panes(
    panes: DataFrame, log: DataFrame, trace: DataFrame, config: Config, followed: DataFrame | None = None,
) -> DataFrame:
    """The windows of any streaming job, from what it emitted: ``panes`` (log_id,
    win_start, win_end, seq, count), the indexed ``log`` and the ``trace`` of its
    watermark, see ``follow``.

    What a window emitted is its last pane. How its events were to be judged follows
    from the watermark before each of them. A window that the job released has the
    watermark of that moment in ``collected_at_watermark``.
    """
    followed = follow(log, trace) if followed is None else followed
    start = window_start("t", config.window_ms, config.offset_ms)
    judged = followed.where("kind = 0").selectExpr("log_id", "w_before", f"{start} AS win_start").selectExpr(
        "*", f"{window_end('win_start', config.window_ms)} AS win_end").selectExpr("*", f"{event_class(config.allowed_lateness_ms)} AS cls")
    owed = judged.groupBy(*KEYS, "win_end").agg(*aggregates(
        on_time=f"count_if(cls = '{ON_TIME}')", late_in_bound=f"count_if(cls = '{LATE_IN_BOUND}')"))
    emitted = panes.groupBy(*KEYS).agg(*aggregates(pane_end="max(win_end)", emitted="max_by(count, seq)", panes="count(1)"))
    released = followed.where("kind = 2").groupBy(*KEYS).agg(*aggregates(collected_at_watermark="min_by(w_now, at)"))
    update = str(config.late_policy == "update").lower()
    return owed.join(emitted, KEYS, "full_outer").join(released, KEYS, "left").selectExpr(
        *KEYS, f"coalesce(win_end, pane_end, {window_end('win_start', config.window_ms)}) AS win_end", "emitted", "coalesce(panes, 0L) AS panes",
        "coalesce(panes, 0L) > 0 AS fired",
        "coalesce(on_time, 0L) AS on_time", "coalesce(late_in_bound, 0L) AS late_in_bound",
        f"coalesce(on_time = 0 AND late_in_bound > 0, false) AND {update} AS opened_after_close", "collected_at_watermark")


def audit_panes(panes: DataFrame, log: DataFrame, receipts: DataFrame, trace: DataFrame, config: Config) -> DataFrame:
    """The verdict on a job's windows, from its own tables only."""
    return audit_job(panes, log, receipts, trace, config).verdict


@dataclass(frozen=True)
class Audit:
    """What a job's own tables show: an outcome per window, and all that accuses it."""

    verdict: DataFrame
    findings: DataFrame
    health: DataFrame
    windows: DataFrame


def audit_job(
    panes: DataFrame, log: DataFrame, receipts: DataFrame, trace: DataFrame, config: Config, releases: DataFrame | None = None,
) -> Audit:
    """All eight checks on a job that this library did not run, from what it leaves
    behind; ``log`` is indexed. Its tables are merged once, and everything is read from that."""
    followed = follow(log, trace, releases)
    health = health_from_trace(followed)
    windows = windows_from_panes(panes, log, trace, config, followed)
    truth = batch_windows(log, config.window_ms, config.offset_ms)
    verdict = verdict_windows(windows, truth, receipts, health, config)
    findings = reduce(DataFrame.unionByName, [
        overshoot_findings(health), regression_findings(health, config), premature_close_findings(windows, config),
        pane_count_findings(windows, config), pane_chain_findings(panes), silent_drop_findings(verdict), window_findings(verdict)])
    return Audit(verdict, findings, health, windows)


def receipt_counts(receipts: DataFrame, config: Config) -> DataFrame:
    """Receipts per window, split by whether the event was within the bound."""
    in_bound = f"lateness_ms < {config.allowed_lateness_ms}"
    return receipts.groupBy(*KEYS).agg(*aggregates(
        too_late_receipts=f"count_if(NOT ({in_bound}))", in_bound_receipts=f"count_if({in_bound})"))


def verdict_windows(
    windows: DataFrame, truth: DataFrame, receipts: DataFrame, health: DataFrame, config: Config,
) -> DataFrame:
    """One outcome per window, over every window that either side knows.

    A refused event counts once: too-late receipts, plus in-bound discards (the
    receipts of ``side-output``, the late count of ``drop``).
    """
    engine = windows.selectExpr(*KEYS, "win_end AS engine_end", "emitted", "panes", "on_time", "late_in_bound")
    joined = (
        truth.selectExpr(*KEYS, "win_end", "count AS expected")
        .join(engine, KEYS, "full_outer")
        .join(receipt_counts(receipts, config), KEYS, "left")
    )
    return _outcomes(per_log(joined, health.select("log_id", "w_last")), config)


def verdict_of_run(counted: DataFrame, config: Config) -> DataFrame:
    """The same for a run of this library, from ``panes.window_counts``: its tally is a
    batch count over all events, and of those it refused, so nothing is read again."""
    return _outcomes(counted.selectExpr(
        *KEYS, "win_end", "win_end AS engine_end", "events AS expected", "IF(kept, emitted, NULL) AS emitted", "panes", "on_time", "late_in_bound",
        "too_late AS too_late_receipts", "late_in_bound AS in_bound_receipts", "w_last"), config)


def _outcomes(windows: DataFrame, config: Config) -> DataFrame:
    """Outcomes from one row per window: what was expected, emitted and receipted, and
    the watermark its log ended with."""
    discarded = {"update": "0L", "drop": "late_in_bound", "side-output": "in_bound_receipts"}[config.late_policy]
    w_final = f"{END_OF_STREAM}L" if config.termination == "flush" else "w_last"
    rows = windows.selectExpr(
        *KEYS, "coalesce(win_end, engine_end) AS win_end", "coalesce(expected, 0L) AS expected", "emitted",
        "coalesce(panes, 0L) AS panes", f"coalesce({discarded}, 0L) AS discarded", f"coalesce({_tallied(config)}, 0L) AS tallied",
        "coalesce(too_late_receipts, 0L) AS too_late_receipts", f"{w_final} AS w_final",
    ).selectExpr(
        "*", "too_late_receipts + discarded AS receipted", "expected - coalesce(emitted, 0L) AS short",
        "w_final IS NULL OR w_final < win_end AS unreached",
    )
    rows = rows.selectExpr("*", """CASE
        WHEN panes = 0 AND unreached THEN 'watermark-never-reached'
        WHEN panes = 0 AND receipted >= expected AND expected > 0 THEN 'lateness-bound-exceeded'
        WHEN panes = 0 THEN 'no-pane-after-close'
        WHEN emitted <=> expected THEN NULL
        WHEN short = receipted AND receipted > 0 AND discarded > 0 THEN 'policy-discard'
        WHEN short = receipted AND receipted > 0 THEN 'lateness-bound-exceeded'
        ELSE 'unexplained-shortfall' END AS reason""")
    return rows.selectExpr(
        *KEYS, "win_end",
        "CASE WHEN reason IS NOT NULL THEN 'unverifiable' WHEN panes > 1 THEN 'revised' ELSE 'complete' END AS outcome",
        "reason", "expected", "emitted", "panes", "receipted",
        "greatest(0L, expected - tallied - too_late_receipts) AS lost", f"{_detail()} AS detail",
    )


def _tallied(config: Config) -> str:
    """Events that a window counted or discarded on the record. Under
    ``side-output`` an in-bound late event is owed a receipt, so that counts."""
    late = "in_bound_receipts" if config.late_policy == "side-output" else "late_in_bound"
    return f"coalesce(on_time, 0L) + coalesce({late}, 0L)"


def _detail() -> str:
    """The sentence behind an outcome."""
    return f"""CASE
        WHEN reason = 'watermark-never-reached' THEN concat('the watermark ended at ', {watermark_text('w_final')},
            CASE WHEN w_final IS NULL THEN '' ELSE concat(', ', win_end - w_final, ' ms before the end of the window') END)
        WHEN panes = 0 AND reason = 'lateness-bound-exceeded' THEN
            {_text("'the watermark passed before any of the '", 'expected', "' event(s) came; '", 'receipted', "' receipted'")}
        WHEN panes = 0 THEN {_text("'closed without a pane; '", 'expected - receipted', "' event(s) unaccounted for'")}
        WHEN reason = 'unexplained-shortfall' THEN
            {_text("'emitted '", 'emitted', "' of '", 'expected', "', only '", 'receipted', "' receipted'")}
        WHEN reason IS NOT NULL THEN
            {_text("'emitted '", 'emitted', "' of '", 'expected', "'; the missing '", 'short', "' are receipted ('",
                   'too_late_receipts', "' too late, '", 'discarded', "' discarded by policy)'")}
        WHEN panes > 1 THEN {_text('panes', "' panes; the last one agrees with the batch count'")}
        ELSE 'one pane; it agrees with the batch count' END"""


def window_findings(verdict: DataFrame) -> DataFrame:
    """``no-pane-after-close`` and ``unexplained-shortfall``: the reasons that accuse."""
    return verdict.where(ACCUSING).selectExpr("log_id", "reason AS code", "'defect' AS severity", "win_start", "detail")


def overshoot_findings(health: DataFrame) -> DataFrame:
    """The watermark stood above every event time seen so far."""
    return _finding(health.where("watermark_overshoots > 0"), "watermark-overshoot", _text(
        "watermark_overshoots", "' event(s) with the watermark above the highest event time, by up to '",
        "max_overshoot_ms", "' ms'"))


def regression_findings(health: DataFrame, config: Config | None = None) -> DataFrame:
    """The raw watermark fell although the strategy, that of ``config`` or else of all
    given logs, promises that it cannot."""
    promised = str(config is None or config.watermark.monotonic).lower()
    fell = health.where(f"watermark_regressions > 0 AND {promised}")
    return _finding(fell, "watermark-regression", _text(
        "watermark_regressions", "' fall(s) of a raw watermark that cannot fall, by up to '", "max_regression_ms", "' ms'"))


def unaccounted_events(windows: DataFrame, truth: DataFrame, receipts: DataFrame, config: Config) -> DataFrame:
    """Per window: events that were neither tallied nor receipted."""
    lost = f"count - ({_tallied(config)}) - coalesce(too_late_receipts, 0L)"
    return (
        truth.select(*KEYS, "count").join(windows.select(*KEYS, "on_time", "late_in_bound"), KEYS, "left")
        .join(receipt_counts(receipts, config), KEYS, "left")
        .selectExpr(*KEYS, f"{lost} AS lost").where("lost > 0")
    )


def silent_drop_findings(unaccounted: DataFrame) -> DataFrame:
    """From ``unaccounted_events``, or from a verdict, which has ``lost`` as well."""
    lost = unaccounted.where("lost > 0").groupBy("log_id").agg(*aggregates(lost="sum(lost)"))
    return _finding(lost, "silent-drop", _text("lost", "' event(s) neither counted nor receipted'"))


def missing_events(indexed: DataFrame, accounted: DataFrame) -> DataFrame:
    """The very events of an indexed log that no ``(log_id, i)`` row accounts for."""
    return indexed.join(accounted.select("log_id", "i"), ["log_id", "i"], "left_anti")


def premature_close_findings(windows: DataFrame, config: Config) -> DataFrame:
    """State was released before the watermark had passed end + allowed lateness."""
    owed = f"win_end + {config.allowed_lateness_ms}L"
    return _finding(windows.where(f"collected_at_watermark < {owed}"), "premature-close", _text(
        "'released at watermark '", "collected_at_watermark", "', '", f"{owed} - collected_at_watermark", "' ms too early'"),
        "win_start")


def pane_chain_findings(panes: DataFrame) -> DataFrame:
    """A revision must retract exactly what the pane before it emitted.

    Each pane is sent to its own number with what it retracts, and to the next
    number with what it emitted: one pass, grouped by (window, number), so a window
    with very many panes is spread over all tasks. A pane that retracts nothing and need
    not is not looked at under its own number.
    """
    own = "named_struct('seq', seq, 'revision', kind = 'revision', 'retracts', retracts, 'was', CAST(NULL AS BIGINT))"
    following = "named_struct('seq', seq + 1, 'revision', false, 'retracts', CAST(NULL AS BIGINT), 'was', count)"
    sent = f"IF(coalesce(kind = 'revision', false) OR retracts IS NOT NULL, array({own}, {following}), array({following}))"
    linked = panes.selectExpr(*KEYS, f"inline({sent})").groupBy(*KEYS, "seq").agg(*aggregates(
        revisions="count_if(revision)", stated="count(retracts)",
        retracts="max(retracts)", least="min(retracts)", was="max(was)", least_was="min(was)"))
    broken = "stated < revisions OR was IS NULL OR retracts <> was OR least <> least_was"
    return _finding(linked.where(f"revisions > 0 AND ({broken})"), "pane-chain-broken", _text(
        "'pane '", "seq", "' retracts '", "retracts", "' but the pane before emitted '", "was"), "win_start")


def pane_count_findings(windows: DataFrame, config: Config) -> DataFrame:
    """Under ``update`` a fired window owes one pane for its close and one per
    in-bound late event; for a window opened after its close these coincide."""
    owed = "late_in_bound + CASE WHEN opened_after_close THEN 0 ELSE 1 END"
    off = windows.where(f"fired AND panes <> {owed} AND {str(config.late_policy == 'update').lower()}")
    return _finding(off, "pane-count-mismatch", _text("panes", "' pane(s) where '", owed, "' were owed'"), "win_start")


def verdict_summary(verdict: DataFrame, run_findings: DataFrame) -> DataFrame:
    """Per log: outcome counts, windows, findings, and whether the log is clean.
    ``run_findings`` are those that the verdict does not imply; ``all_receipted``
    counts the windows without a pane whose events are all receipted."""
    summary = verdict.groupBy("log_id").agg(*aggregates(
        **{name: f"count_if(outcome = '{name}')" for name in ("complete", "revised", "unverifiable")},
        total="count(1)", accused=f"count_if({ACCUSING}) + CAST(max(lost) > 0 AS BIGINT)",
        all_receipted="count_if(panes = 0 AND reason = 'lateness-bound-exceeded')"))
    found = run_findings.groupBy("log_id").agg(*aggregates(n="count(1)"))
    return summary.join(found, "log_id", "left").selectExpr("*", "accused + coalesce(n, 0L) AS findings").selectExpr(
        "log_id", "complete", "revised", "unverifiable", "total", "findings", "findings = 0 AS clean", "all_receipted")


def reason_counts(verdict: DataFrame) -> DataFrame:
    return verdict.where("reason IS NOT NULL").groupBy("log_id", "reason").agg(*aggregates(windows="count(1)"))


def finding_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("log_id", "code").agg(*aggregates(findings="count(1)"))
