"""Blocks, their carry, and rows that cannot be events."""

from __future__ import annotations

import datetime
import decimal
import os
import random

import pytest

from paneledger import Config, CustomWatermark, Run, WatermarkSpec, index_log
from paneledger.operators import scan
from paneledger.operators.audit import audit_panes
from paneledger.operators.scan import ordered_scan, running_index, running_sum, split_points, with_blocks
from paneledger.sources.feeds import archive_log
from paneledger.sources.ndjson import file_order
from paneledger.streaming.fold import FoldTables, _key
from paneledger.workspace import keep, new_path, release, scope


def test_block_numbers_follow_the_keys(spark):
    rng = random.Random(1)
    values = [None, -5, 0, 3, 7, 99, 12345678901]
    rows = [(rng.choice([None, "a", "b'c", "d\\e", "z"]), rng.choice(values), datetime.datetime(2024, 1, 1 + rng.randrange(9), 3, 4, 5, 678)) for _ in range(500)]
    frame = spark.createDataFrame(rows, "g string, n long, at timestamp_ntz")
    total, points = split_points(frame, ["g", "n", "at"], 9)
    assert total == 500 and 2 < len(points) < 9
    got = with_blocks(frame, ["g", "n", "at"], points).collect()
    order = sorted(got, key=lambda r: (r.g is not None, r.g or "", r.n is not None, r.n or 0, r.at))
    blocks = [row.blk for row in order]
    assert blocks == sorted(blocks) and set(blocks) == set(range(len(points) + 1))


def test_carry_is_bounded_by_blocks(spark, monkeypatch):
    """Ten thousand logs in step: each cut is inside one log at most."""
    carried = []
    plain = scan.block_carry
    monkeypatch.setattr(scan, "block_carry", lambda *args: carried.append(plain(*args)) or carried[-1])
    log = spark.range(50_000).selectExpr("CAST(id % 10000 AS STRING) AS g", "id DIV 10000 AS seq")
    rows = ordered_scan(log, ["g"], ["seq"], {"i": running_index("i"), "s": running_sum("s", "seq")}, blocks=40).rows
    assert rows.where("i <> seq OR s <> seq * (seq + 1) / 2").isEmpty()
    assert 0 < carried[0].count() <= 80


def test_one_shuffle_before_the_window(spark):
    log = spark.range(30_000).selectExpr("'x' AS g", "id AS seq")
    rows = ordered_scan(log, ["g"], ["seq"], {"i": running_index("i")}).events
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert rows.agg({"blk": "max"}).first()[0] > 0 and "RepartitionByExpression" not in plan
    release()


def test_rows_that_cannot_be_events(spark):
    rows = [("a", 0, 10), ("a", 1, None), (None, 2, 20), ("a", None, 30), ("a", 3, 500), ("b", 4, 7)]
    log = spark.createDataFrame(rows, "log_id string, seq long, t long")
    index = index_log(log)
    assert sorted((r.log_id, r.seq, r.t) for r in index.rows.collect()) == [("a", 0, 10), ("a", 3, 500), ("b", 4, 7)]
    assert {r.reason for r in index.rejects.collect()} == {"no log", "no event time", "no place in the arrival order"}
    run = Run(index, Config(100, 0, 50, "update", "flush", WatermarkSpec("bounded", bound_ms=10)))
    assert run.findings.isEmpty() and run.verdict.count() == 3
    for bad in (log, spark.createDataFrame([("a", 0, 1), ("a", 0, 2)], log.schema)):
        with pytest.raises(ValueError, match="log"):
            index_log(bad, on_bad="fail")
    with pytest.raises(ValueError, match="quarantine"):
        index_log(log, on_bad="skip")


def test_audit_of_foreign_panes(make_log):
    """Panes that were lost or miscounted are found without the run's own counts."""
    run = Run(index_log(make_log([0, 10, 120, 130, 250, 260, 90, 900])), Config(100, 0, 400, "update", "flush", WatermarkSpec("bounded", bound_ms=0)))
    seen = lambda panes: {r.win_start: r.reason for r in audit_panes(panes, run.index.rows, run.side_output, run.trace, run.config).collect()}
    assert seen(run.panes) == {r.win_start: r.reason for r in run.verdict.collect()} and set(seen(run.panes).values()) == {None}
    assert seen(run.panes.where("win_start <> 100"))[100] == "no-pane-after-close"
    assert seen(run.panes.where("win_start <> 0 OR seq < 2"))[0] == "unexplained-shortfall"


def test_archive_hours_and_broken_lines(spark, tmp_path):
    line = '{{"created_at": "2026-01-15T{:02d}:00:00Z", "type": "{}"}}\n'
    for hour in (3, 10, 0):
        (tmp_path / f"2026-01-15-{hour}.json").write_text(line.format(hour, f"a{hour}") + line.format(hour, f"b{hour}"))
    got = archive_log(spark, str(tmp_path)).orderBy("seq").collect()
    assert [r.k for r in got] == ["a0", "b0", "a3", "b3", "a10", "b10"]
    (tmp_path / "2026-01-15-4.json").write_text(line.format(4, "x") + "{broken\n")
    with pytest.raises(ValueError, match=r"2026-01-15-4.json:2: no readable"):
        archive_log(spark, str(tmp_path))


def test_file_names_sort_by_number(spark):
    names = ["p/part-00002-a", "p/part-10001-a", "p/part-100000-a", "p/q9", "p/q010", "p/q011x"]
    frame = spark.createDataFrame([(name,) for name in reversed(names)], "name string")
    assert [r.name for r in frame.orderBy(*[frame.selectExpr("name").columns[0]]).selectExpr("name", f"{file_order('name')} AS o").orderBy("o").collect()] == names


def test_order_keys_sort_like_numbers(spark):
    values = [-(10**30), -12, -1, 0, 5, 10**19, 10**30]
    frame = spark.createDataFrame([(decimal.Decimal(v),) for v in values], "n decimal(38, 0)")
    assert [int(r.n) for r in frame.selectExpr("n", f"{_key(['n'])} AS k").orderBy("k").collect()] == values


def test_a_long_stream_keeps_nothing(spark, make_log):
    config = Config(100, 0, 50, "update", "idle", WatermarkSpec("percentile", percentile=0.9, sample_size=4))
    tables = FoldTables(spark, new_path(spark, "fold"), config, ("seq",), whole_every=2)
    cached, folders = [], []
    for batch in range(4):
        rows = [("log", 10 * batch + k, 90 * (10 * batch + k) % 700 + 40 * batch) for k in range(10)]
        tables.fold(spark.createDataFrame(rows + [(None, 1, 1)], make_log([0]).schema), batch)
        cached.append(len(spark.sparkContext._jsc.getPersistentRDDs()))
        folders.append(len(os.listdir(tables.path.removeprefix("file:") + "/state_logs")))
        assert [r.log_id for r in spark.read.parquet(tables.folder("quarantine", batch)).collect()] == [None]
    assert cached[1] == cached[3] and folders[1] == folders[3]


def test_a_scope_frees_its_own(spark):
    outer = keep(spark.range(3).toDF("x"), "outer")
    with pytest.raises(RuntimeError), scope():
        inner = keep(spark.range(3).toDF("x"), "inner")
        path = inner.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
        assert os.path.exists(path)
        raise RuntimeError
    assert not os.path.exists(path) and outer.count() == 3


def test_a_strategy_of_ones_own(make_log):
    """Half way between the first and the highest event time."""
    half = CustomWatermark("half-way", lambda rows: rows.selectExpr("*", "first_t + (max_seen - first_t) DIV 2 AS raw"), True, "half way")
    wild = CustomWatermark("last-time", lambda rows: rows.selectExpr("*", "t AS raw"), True)
    times = [0, 200, 90, 500, 320, 1000, 40]
    run = Run(index_log(make_log(times)), Config(100, 0, 0, watermark=half))
    got = [(r.i, r.w_before, r.w_after) for r in run.judged.orderBy("i").collect()]
    marks = [max(times[:k + 1]) // 2 for k in range(len(times))]
    assert got == [(k, marks[k - 1] if k else None, marks[k]) for k in range(len(times))]
    assert run.findings.isEmpty() and half.describe() == "half way"
    fallen = Run(index_log(make_log(times)), Config(100, 0, 0, watermark=wild)).findings.collect()
    assert [r.code for r in fallen] == ["watermark-regression"]
    with pytest.raises(ValueError):
        CustomWatermark("bounded", lambda rows: rows)
