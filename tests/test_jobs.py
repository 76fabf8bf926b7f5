"""Jobs that this library did not run, comparisons that name rows, and the emission order."""

from __future__ import annotations

import shutil
import subprocess
import sys
import time
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from paneledger import Config, Run, WatermarkSpec, index_log
from paneledger.operators.audit import audit_job, follow, health_from_trace
from paneledger.operators.scan import split_points, with_blocks
from paneledger.operators.watermarks import SlidingBound
from paneledger.plans import compare
from paneledger.sources.ndjson import read_ndjson
from paneledger.workspace import new_path, release

CONFIG = Config(100, 0, 50, "update", "idle", WatermarkSpec("bounded", bound_ms=0))
TIMES = [0, 10, 120, 30, 250, 260, 140, 400, 90, 900]


@pytest.fixture
def run(make_log):
    return Run(index_log(make_log(TIMES)), CONFIG)


def released(run):
    return run.crossed.selectExpr("log_id", "win_start", "release.index AS index").where("index IS NOT NULL")


def test_an_honest_job_has_no_findings(run):
    found = audit_job(run.panes, run.index.rows, run.side_output, run.trace, CONFIG, released(run))
    assert found.findings.collect() == []
    own, seen = run.health.first(), found.health.first()
    assert all(own[c] == seen[c] for c in seen.asDict())
    assert {r.win_start: r.collected_at_watermark for r in found.windows.collect()} == {
        r.win_start: r.collected_at_watermark for r in run.windows.collect()} | {
            r.win_start: None for r in run.verdict.collect() if r.panes == 0}


def test_a_sparse_trace_that_leaps_and_falls(spark, run):
    """Steps (index, watermark): above the highest time from event 2 to event 4, then lower."""
    trace = spark.createDataFrame([("log", 0, -1), ("log", 2, 300), ("log", 5, 200), ("log", 7, 399)], "log_id string, index long, watermark long")
    health = health_from_trace(follow(run.index.rows, trace)).first()
    # Events 2 and 3 stand under 300 with 120 seen, event 4 with 250.
    assert (health.watermark_overshoots, health.max_overshoot_ms) == (3, 180)
    assert (health.watermark_regressions, health.max_regression_ms, health.w_last, health.events) == (1, 100, 399, 10)
    codes = {r.code for r in audit_job(run.panes, run.index.rows, run.side_output, trace, CONFIG).findings.collect()}
    assert {"watermark-overshoot", "watermark-regression"} <= codes


def test_flush_and_strays_are_no_overshoot(spark, run):
    trace = spark.createDataFrame([("log", 9, 899), ("log", 10, 2**63 - 1)], "log_id string, index long, watermark long")
    health = health_from_trace(follow(run.index.rows, trace)).first()
    assert (health.watermark_overshoots, health.max_overshoot_ms, health.watermark_regressions) == (0, 0, 0)


def test_state_given_up_too_early(run):
    early = run.crossed.selectExpr("log_id", "win_start", "fire.index AS index").where("index IS NOT NULL")
    found = audit_job(run.panes, run.index.rows, run.side_output, run.trace, CONFIG, early).findings.collect()
    at = {r.i: r.w_after for r in run.judged.collect()}
    owed = {r.win_start: r.win_start + 150 for r in early.collect() if at[r["index"]] < r.win_start + 150}
    assert owed and {(r.code, r.win_start) for r in found} == {("premature-close", start) for start in owed}


def test_changed_rows_are_named(spark):
    left = spark.createDataFrame([(1, "a", None), (2, None, 5), (2, None, 5), (3, "c", 7)], "x long, y string, z long")
    right = spark.createDataFrame([(3, "c", 7), (2, None, 5), (1, None, 1), (1, "a", None)], "x long, y string, z long")
    assert sorted(map(tuple, compare.changed_rows(left, right).collect())) == [(1, None, 1, 0, 1), (2, None, 5, 1, 0)]
    assert compare.same_rows(left, right).first().asDict() == {"left_rows": 4, "right_rows": 4, "only_left": 1, "only_right": 1}
    assert compare.changed_rows(left, left.limit(9)).collect() == []
    shifted = left.selectExpr("z AS x", "y", "x AS z")  # nulls in other columns are other rows
    assert compare.same_rows(left, shifted).first().only_left == 4


def test_equal_tables_are_read_once(spark):
    """What made the rows of a table is not run again to find that no row differs."""
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    table = spark.range(500).mapInArrow(counted, "id long")
    assert tuple(compare.same_rows(table, spark.range(500)).first()) == (500, 500, 0, 0)
    assert made.value == 500


def test_emission_order(run):
    order = [(r.at_index, not r.own_pane, r.opened_index) for r in run.emitted.orderBy("pos").collect()]
    assert order == sorted(order) and len(order) == run.panes.count()
    assert [r.pos for r in run.emitted.orderBy("pos").collect()] == list(range(len(order)))


def test_one_event_closes_many_windows(make_log):
    """The panes at one index are cut into blocks like all others."""
    run = Run(index_log(make_log([*range(0, 50_000, 100), 10_000_000])), CONFIG, blocks=9)
    rows = run.emitted.orderBy("pos").collect()
    assert [r.win_start for r in rows[:500]] == list(range(0, 50_000, 100)) and [r.pos for r in rows] == list(range(len(rows)))


def test_metrics_of_the_write(spark, run):
    metrics = run.write_judged(new_path(spark, "judged"))
    counters = run.counters.first()
    assert all(metrics[c] == counters[c] for c in ("total", "on_time", "late_in_bound", "too_late"))
    assert metrics["total"] == metrics["on_time"] + metrics["late_in_bound"] + metrics["too_late"] == len(TIMES)


def test_fractional_times(spark, tmp_path):
    (tmp_path / "log").write_text('{"t": 1.5, "p": 2.4999}\n{"t": -1.5}\n{"t": 3}\n')
    read = lambda **options: [(r.t, r.p) for r in read_ndjson(spark, str(tmp_path / "log"), **options).events.orderBy("seq").collect()]
    assert read(fraction="round") == [(2, 2), (-1, None), (3, None)]
    assert read(fraction="floor") == [(1, 2), (-2, None), (3, None)]
    assert read(fraction="round", unit_ms=1_000) == [(1500, 2500), (-1500, None), (3000, None)]
    with pytest.raises(ValueError, match="whole number"):
        read()
    with pytest.raises(ValueError, match="fraction"):
        read(fraction="ceil")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.integers(0, 40)), max_size=90), st.integers(1, 12), st.sampled_from([0.0, 0.5, 0.8, 0.99, 1.0]), st.integers(1, 30))
def test_sliding_bound_against_sorting(late, size, percentile, step):
    spec = WatermarkSpec("percentile", percentile=percentile, sample_size=size, floor_ms=2)
    bound, found = SlidingBound(spec), []
    for at in range(0, len(late), step):
        part = late[at:at + step]
        found += bound.bounds(np.array([x or 0 for x in part], np.int64), np.array([x is not None for x in part])).tolist()
    recent, expected = [], []
    for x in late:
        recent = (recent + [x])[-size:] if x is not None else recent
        expected.append(max(2, sorted(recent)[min(len(recent) - 1, int(percentile * len(recent)))]) if recent else 2)
    assert found == expected


def test_twenty_thousand_blocks_plan_quickly(spark):
    frame = spark.range(400_000).selectExpr("'x' AS g", "id * 7 AS n")
    total, points = split_points(frame, ["g", "n"], 20_000)
    assert total == 400_000 and len(points) > 10_000
    start = time.perf_counter()
    placed = with_blocks(frame, ["g", "n"], points)
    placed._jdf.queryExecution().executedPlan()
    assert time.perf_counter() - start < 5
    blocks = placed.groupBy("blk").agg({"n": "min"}).orderBy("blk").collect()
    assert len(blocks) == len(points) + 1 and [r[1] for r in blocks] == sorted(r[1] for r in blocks)


def test_profiles_repeat_in_one_session(spark):
    logs = compare.index_named(spark, "/root/testdata/sf0.001", ["events", "orders"])
    seen = [sorted(map(tuple, compare.profile_matrix(logs).collect())) for _ in range(3)]
    assert seen[0] == seen[1] == seen[2] and len(seen[0]) == 6
    release()


def test_the_rest_stands_without_the_training_data_folders(tmp_path):
    """The driver deletes these folders and the pipeline; the entry must still import."""
    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "*.json"))
    script = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 50 and set(o) <= set(q) and 'pipeline' not in q"
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path / "repo", capture_output=True, text=True, timeout=120, env={"PATH": "/usr/bin:/bin"})
    assert done.returncode == 0, done.stderr
