"""Outcomes of hand-computed logs, and altered tables that must be accused."""

from __future__ import annotations

import pytest

from paneledger import Config, WatermarkSpec, run_log
from paneledger.operators import audit
from paneledger.sinks.reports import verdict_text
from made import demo

BASE = Config(4_000, 0, 4_000, "update", "idle", WatermarkSpec("bounded", bound_ms=0))
ONE_LATE = [*range(0, 8_000, 1_000), 500]


def config(**changes) -> Config:
    return Config(**{**BASE.__dict__, **changes})


def outcomes(run):
    return {r.win_start: (r.outcome, r.reason) for r in run.verdict.collect()}


@pytest.mark.parametrize("times, changes, window, expected", [
    ([0, 1000, 8000, 9000], {"termination": "flush"}, 0, ("complete", None)),
    ([0, 1000, 5000, 6000, 2000], {"termination": "flush"}, 0, ("revised", None)),
    ([0, 1000], {}, 0, ("unverifiable", "watermark-never-reached")),
    ([0, 1000, 40000, 41000, 2000], {"termination": "flush"}, 0, ("unverifiable", "lateness-bound-exceeded")),
    ([40000, 41000, 42000, 1000, 2000], {"termination": "flush"}, 0, ("unverifiable", "lateness-bound-exceeded")),
    (ONE_LATE, {"late_policy": "drop"}, 0, ("unverifiable", "policy-discard")),
    (ONE_LATE, {"late_policy": "side-output"}, 0, ("unverifiable", "policy-discard")),
])
def test_outcomes(make_log, times, changes, window, expected):
    run = run_log(make_log(times), config(**changes))
    assert outcomes(run)[window] == expected
    assert run.findings.count() == 0


def test_demo_tells_its_story(spark):
    run = demo(spark)
    panes = run.panes.orderBy("at_index").collect()
    assert [(p.at_index, p.win_start, p.seq, p.kind, p["count"], p.retracts, p.watermark) for p in panes] == [
        (6, 0, 1, "initial", 4, None, 5999), (9, 0, 2, "revision", 5, 4, 7999),
        (12, 5000, 1, "initial", 5, None, 10999), (16, 10000, 1, "initial", 5, None, 15999)]
    assert [(r["index"], r.win_start, r.lateness_ms) for r in run.side_output.collect()] == [(18, 5000, 6999)]
    assert verdict_text(run, "demo") == [
        "1 complete   1 revised   2 unverifiable   (4 windows of 5.0s)",
        "  unverifiable because lateness-bound-exceeded: 1",
        "  unverifiable because watermark-never-reached: 1",
        "  no findings",
    ]
    details = {r.win_start: r.detail for r in run.verdict.collect()}
    assert details[15000] == "the watermark ended at 16999, 3001 ms before the end of the window"
    assert details[0] == "2 panes; the last one agrees with the batch count"


def test_falling_adaptive_watermark_is_no_finding(make_log):
    times = [*range(0, 10_000, 100), *range(9_900 - 100_000, 9_900 - 100_000 - 600, -10)]
    run = run_log(make_log(times), Config(5_000, 0, 4_000, "update", "flush", WatermarkSpec(
        "percentile", percentile=0.5, sample_size=16)))
    assert run.health.first().watermark_regressions > 0
    assert run.findings.count() == 0


def codes(df):
    return sorted((r.code, r.win_start) for r in df.collect())


def test_altered_tables_are_accused(make_log):
    run = run_log(make_log([*ONE_LATE, 30_000, 31_000, 1_000]), BASE)
    assert codes(run.findings) == []

    early = run.windows.withColumn("collected_at_watermark", run.windows["win_end"] - 1)
    assert codes(audit.premature_close_findings(early, BASE)) == [("premature-close", 0), ("premature-close", 4000), ("premature-close", 28000)]

    broken = run.panes.selectExpr("log_id", "win_start", "seq", "kind", "count", "retracts + 1 AS retracts")
    assert codes(audit.pane_chain_findings(broken)) == [("pane-chain-broken", 0)]
    headless = run.panes.where("kind = 'revision'")
    assert codes(audit.pane_chain_findings(headless)) == [("pane-chain-broken", 0)]

    short = run.counts.selectExpr("log_id", "win_start", "panes - 1 AS panes", "fired", "late_in_bound", "opened_after_close")
    assert ("pane-count-mismatch", 0) in codes(audit.pane_count_findings(short, BASE))

    no_receipts = run.side_output.where("false")
    lost = audit.unaccounted_events(run.counts, run.truth, no_receipts, BASE)
    assert [(r.win_start, r.lost) for r in lost.collect()] == [(0, 1)]
    assert codes(audit.silent_drop_findings(lost)) == [("silent-drop", None)]
    verdict = audit.verdict_windows(run.counts, run.truth, no_receipts, run.health, BASE)
    assert codes(audit.window_findings(verdict)) == [("unexplained-shortfall", 0)]

    silent = run.counts.withColumn("panes", run.counts["panes"] * 0).selectExpr("*").drop("emitted").selectExpr(
        "*", "CAST(NULL AS BIGINT) AS emitted")
    verdict = audit.verdict_windows(silent, run.truth, run.side_output, run.health, BASE)
    assert ("no-pane-after-close", 0) in codes(audit.window_findings(verdict))

    fell = run.health.selectExpr("log_id", "3L AS watermark_regressions", "7L AS max_regression_ms")
    assert codes(audit.regression_findings(fell, BASE)) == [("watermark-regression", None)]
    adaptive = config(watermark=WatermarkSpec("percentile"))
    assert codes(audit.regression_findings(fell, adaptive)) == []


def test_revised_windows_hidden_as_complete_change_nothing_else(make_log):
    """An altered verdict that calls revised windows complete is an exact relabel."""
    run = run_log(make_log(ONE_LATE), BASE)
    hidden = run.verdict.selectExpr("log_id", "win_start", "panes", "reason", "lost", "CASE WHEN outcome = 'revised' THEN 'complete' ELSE outcome END AS outcome")
    honest, lying = run.summary.first(), audit.verdict_summary(hidden, run.run_findings).first()
    assert honest.revised == 1 and lying.revised == 0
    assert lying.complete == honest.complete + honest.revised and lying.unverifiable == honest.unverifiable


def test_empty_log(make_log):
    run = run_log(make_log({}), BASE)
    assert run.panes.count() == run.verdict.count() == run.trace.count() == run.lateness.count() == 0
