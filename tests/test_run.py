"""Whole runs against the one-event-at-a-time model, on many logs at once."""

from __future__ import annotations

import random
from dataclasses import replace

import pytest

from model import run_model
from paneledger import Config, Run, WatermarkSpec, index_log
from paneledger.operators.arrival import repeated_positions
from paneledger.operators.audit import finding_counts
from paneledger.plans import compare, run as plan


def random_logs(seed: int) -> dict[str, list[int]]:
    rng = random.Random(seed)
    logs = {}
    for name in range(14):
        n = rng.choice([1, 2, 5, 30, 90, 240])
        step, reach = rng.choice([3, 40, 400]), rng.choice([0, 5, 60])
        t, rows = rng.choice([0, -3000]), []
        for i in range(n):
            t += rng.choice([0, 1, step, step, step * rng.choice([1, 1, 1, 20])])
            rows.append((i + (rng.randint(0, reach) if rng.random() < 0.3 else 0), i, t))
        logs[f"log{name}"] = [t for _, _, t in sorted(rows)]
    # One event far in the future closes every later window at once.
    logs["jump"] = [0, 10, 2_000_000, *range(20, 9000, 37)]
    # A third of all rows are late events of one window.
    logs["hot"] = [0, 10, 20, 180, *[5 + i % 60 for i in range(300)], 190, 420, *range(430, 2_000, 50)]
    return logs


LOGS = random_logs(11)
SPECS = [
    WatermarkSpec("bounded", bound_ms=70), WatermarkSpec("bounded-naive", bound_ms=0),
    WatermarkSpec("percentile", percentile=0.8, sample_size=6, floor_ms=3), WatermarkSpec("punctuated", every_n=4),
    WatermarkSpec("processing-time", ms_per_event=90),
]
CASES = [
    Config(100, 0, 130, "update", "idle", SPECS[0]),
    Config(100, 37, 200, "update", "flush", SPECS[0]),
    Config(50, -20, 0, "drop", "idle", SPECS[0]),
    Config(250, 0, 500, "side-output", "flush", SPECS[1]),
    Config(100, 0, 300, "update", "idle", SPECS[2]),
    Config(70, 5, 150, "side-output", "idle", SPECS[2]),
    Config(100, 0, 450, "update", "flush", SPECS[3]),
    Config(90, 11, 400, "drop", "idle", SPECS[3]),
    Config(100, 0, 220, "update", "idle", SPECS[4]),
    Config(100, 0, 220, "drop", "flush", SPECS[4]),
]


@pytest.fixture(scope="module")
def index(spark):
    rows = [(name, seq, t) for name, times in LOGS.items() for seq, t in enumerate(times)]
    log = spark.createDataFrame(rows, "log_id string, seq bigint, t bigint").repartition(3)
    return index_log(log, ["seq"], blocks=7)


def by_log(df, *columns):
    return sorted((tuple(row) for row in df.select("log_id", *columns).collect()), key=repr)


def of_model(models, table, *columns):
    return sorted(((name, *[row[c] for c in columns]) for name, m in models.items() for row in m[table]), key=repr)


@pytest.mark.parametrize("config", CASES, ids=lambda c: f"{c.watermark.name}-{c.late_policy}-{c.termination}")
def test_run_matches_model(index, config):
    run = Run(index, config, blocks=5, block_size=9)
    models = {name: run_model(times, config) for name, times in LOGS.items()}
    pane = ["win_start", "seq", "kind", "count", "retracts", "watermark", "at_index"]
    assert by_log(run.panes, *pane) == of_model(models, "panes", *pane)
    receipt = ["index", "t", "win_start", "lateness_ms"]
    assert by_log(run.side_output, *receipt) == of_model(models, "side", *receipt)
    assert by_log(run.trace, "index", "watermark") == of_model(models, "trace", "index", "watermark")
    assert by_log(run.windows, "win_start", "count", "emitted", "panes", "on_time", "late_in_bound",
                  "opened_after_close", "fired_at_watermark", "collected_at_watermark") == sorted((
        (name, w["start"], w["count"], w["emitted"], w["panes"], w["on_time"], w["late"], w["opened_late"],
         w["fired_at"], w["collected_at"])
        for name, m in models.items() for w in m["windows"].values()), key=repr)
    assert by_log(run.verdict, "win_start", "outcome", "reason") == sorted(
        ((name, s, *v) for name, m in models.items() for s, v in m["verdict"].items()), key=repr)
    health = list(models["jump"]["health"])
    assert by_log(run.health, *health) == sorted(
        ((name, *[m["health"][c] for c in health]) for name, m in models.items()), key=repr)
    codes = {row.code for row in run.findings.collect()}
    assert codes == ({"watermark-overshoot"} if config.watermark.name == "processing-time" else set())
    counters = {row.log_id: row for row in run.counters.collect()}
    for name, times in LOGS.items():
        row = counters[name]
        assert row.on_time + row.late_in_bound + row.too_late + row.discarded_without_receipt == row.total == len(times)


def test_repeated_positions_are_found(make_log):
    log = make_log([1, 2, 3])
    assert repeated_positions(log).count() == 0
    assert [r.seq for r in repeated_positions(log.union(log.where("seq = 1"))).collect()] == [1]


def test_finding_counts(index):
    config = Config(100, 0, 220, "update", "idle", SPECS[4])
    counted = finding_counts(Run(index, config).findings).where("log_id = 'hot'").collect()
    assert [(r.code, r.findings) for r in counted] == [("watermark-overshoot", 1)]


@pytest.mark.parametrize("config", [CASES[0], CASES[4], CASES[7]], ids=lambda c: f"{c.watermark.name}-{c.late_policy}")
def test_another_termination_of_a_run(index, config):
    """A run that shares its events and crossings with one ended otherwise is as one of its own."""
    idle = Run(index, config)
    own, shared = Run(index, replace(config, termination="flush")), idle.ended("flush")
    for table in ("panes", "windows", "verdict", "trace", "outcome_counts"):
        columns = getattr(own, table).columns
        assert by_log(getattr(shared, table), *columns) == by_log(getattr(own, table), *columns)
    assert by_log(idle.verdict, "win_start", "reason") == by_log(Run(index, config).verdict, "win_start", "reason")


def test_control_sweep_judges_once(index, monkeypatch):
    kept, remember = [], plan.remember
    monkeypatch.setattr(plan, "remember", lambda df: kept.append(df) or remember(df))
    swept = compare.control_sweep(index, CASES[0])
    assert len(kept) == 3  # the tally, with the ends of the logs, with the crossings: for both terminations
    assert swept.first().logs == len(LOGS)
