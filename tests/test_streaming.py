"""However a log is cut into micro-batches, the tables are those of one run."""

from __future__ import annotations

import pytest

from paneledger import Config, WatermarkSpec, run_log
from paneledger.streaming import fold
from paneledger.streaming.fold import FoldResult, FoldTables, replay_in_batches
from paneledger.streaming.keyed import panes_by_log, replay_by_log
from paneledger.streaming.native import native_tumbling
from paneledger.workspace import new_path
from test_run import random_logs

LOGS = {name: times for name, times in random_logs(5).items() if len(times) > 20 or name == "jump"}
CASES = [
    Config(100, 0, 130, "update", "flush", WatermarkSpec("bounded", bound_ms=70)),
    Config(90, 11, 400, "drop", "idle", WatermarkSpec("punctuated", every_n=7)),
    Config(70, 5, 150, "side-output", "flush", WatermarkSpec("percentile", percentile=0.8, sample_size=6)),
    Config(100, 0, 220, "update", "idle", WatermarkSpec("processing-time", ms_per_event=90)),
]


def rows(df, *columns):
    return sorted(map(tuple, df.select("log_id", *columns).collect()), key=repr)


@pytest.mark.parametrize("config", CASES, ids=lambda c: f"{c.watermark.name}-{c.late_policy}")
def test_micro_batches_equal_one_run(make_log, config):
    log = make_log(LOGS)
    whole = run_log(log, config)
    folded = replay_in_batches(log, ["seq"], config, batches=3, whole_every=2)
    pane = ["win_start", "win_end", "seq", "kind", "count", "retracts", "watermark", "at_index", "own_pane", "opened_index"]
    assert rows(folded.panes, *pane) == rows(whole.panes, *pane)
    assert rows(folded.side_output, "index", "t", "win_start", "reason", "lateness_ms") == rows(
        whole.side_output, "index", "t", "win_start", "reason", "lateness_ms")
    assert rows(folded.trace, "index", "watermark") == rows(whole.trace, "index", "watermark")
    assert rows(folded.verdict(log), "win_start", "outcome", "reason") == rows(whole.verdict, "win_start", "outcome", "reason")
    live = folded.live.count()
    assert 0 < live < whole.counts.count()


def test_rows_behind_their_log_are_quarantined_and_retries_are_idempotent(spark, make_log):
    config = Config(100, 0, 50, "update", "idle", WatermarkSpec("bounded", bound_ms=10))
    tables = FoldTables(spark, new_path(spark, "fold"), config, ("seq",))
    first = make_log([0, 50, 130, 260])
    tables.fold(first, 0)
    second = spark.createDataFrame([("log", 2, 140), ("log", 4, 400), ("log", 5, 290)], first.schema)
    tables.fold(second, 1)
    once = rows(FoldResult(tables, 1).panes, "win_start", "count", "at_index")
    tables.fold(second, 1)
    assert rows(FoldResult(tables, 1).panes, "win_start", "count", "at_index") == once
    strays = spark.read.parquet(tables.folder("quarantine", 1))
    assert [(r.seq, r.t) for r in strays.collect()] == [(2, 140)]
    whole = run_log(make_log([0, 50, 130, 260, 400, 290]), config)
    assert once == rows(whole.panes, "win_start", "count", "at_index")


def test_rows_of_one_log_stay_in_their_tasks(spark, monkeypatch):
    tasks, remember = [], fold.remember

    def watched(df):
        held = remember(df)
        if "stray" in held.columns:
            tasks.append(held.selectExpr("spark_partition_id() AS n").distinct().count())
        return held

    monkeypatch.setattr(fold, "remember", watched)
    config = Config(100, 0, 50, "update", "idle", WatermarkSpec("bounded", bound_ms=10))
    tables = FoldTables(spark, new_path(spark, "fold"), config, ("p", "seq"))
    for batch in range(2):
        rows_ = spark.range(2_000 * batch, 2_000 * batch + 2_000, 1, 4).selectExpr("'log' AS log_id", "id DIV 7 - 9 AS p", "id AS seq", "id AS t")
        tables.fold(rows_.unionByName(rows_.where(f"seq = {2_000 * batch + 5}").selectExpr("log_id", "p - 400 AS p", "seq", "t")), batch)
    assert min(tasks) > 3
    # The first of the added rows opens its log, the second lies behind it.
    assert [spark.read.parquet(tables.folder("quarantine", n)).count() for n in range(2)] == [0, 1]


def test_state_follows_the_batch(spark, make_log):
    """Three hundred logs, of which a batch touches one: it writes that log and the windows
    it changed; a whole state comes in turn, and the result is that of one run."""
    config = Config(100, 0, 50, "update", "idle", WatermarkSpec("bounded", bound_ms=10))
    tables = FoldTables(spark, new_path(spark, "fold"), config, ("seq",), whole_every=3)
    logs = {f"log{k}": [0, 50, 130, 260] for k in range(300)}
    tables.fold(make_log(logs), 0)
    schema = make_log([0]).schema
    for batch, t in ((1, 290), (2, 300), (3, 420), (4, 430)):
        tables.fold(spark.createDataFrame([("log7", 3 + batch, t)], schema), batch)
    rows_of = lambda table, batch: spark.read.parquet(tables.folder(f"state_{table}", batch)).count()
    assert rows_of("logs", 4) == 1 and rows_of("windows", 4) <= 2
    assert rows_of("logs", 3) == 300
    result = FoldResult(tables, 4)
    whole = run_log(make_log({**logs, "log7": [0, 50, 130, 260, 290, 300, 420, 430]}), config)
    assert rows(result.panes, "win_start", "seq", "count", "at_index") == rows(whole.panes, "win_start", "seq", "count", "at_index")
    assert result.logs.count() == 300
    assert rows(result.windows.where("log_id = 'log7'"), "win_start", "emitted") == rows(whole.counts.where("log_id = 'log7'"), "win_start", "emitted")


def test_native_tumbling_runs(spark, make_log):
    path, config = new_path(spark, "native"), Config(100, 0, 0, watermark=WatermarkSpec("bounded", bound_ms=10))
    log = make_log([0, 50, 130, 260])
    log.write.parquet(path)
    query = (native_tumbling(spark.readStream.schema(log.schema).parquet(path), config).writeStream.outputMode("append")
             .format("memory").queryName("native").trigger(availableNow=True).start())
    query.awaitTermination()
    assert rows(spark.table("native"), "win_start", "count") == [("log", 0, 2), ("log", 100, 1)]


def test_a_replay_reads_each_part_by_itself(spark):
    index = spark.range(0, 101, 1, 3).selectExpr("'log' AS log_id", "id AS t", "id AS i")
    parts = fold.in_parts(index, 4)
    for n in range(4):
        part = parts.where(f"part_n = {n}").selectExpr("t", "input_file_name() AS file").collect()
        assert sorted(r.t for r in part) == list(range(101 * n // 4, 101 * (n + 1) // 4))
        assert all(f"/part_n={n}/" in r.file for r in part)


@pytest.mark.parametrize("batches", [1, 4])
def test_keyed_state_equals_one_run(make_log, batches):
    log, config = make_log(LOGS), Config(100, 17, 130, "update", "idle", WatermarkSpec("bounded", bound_ms=70))
    pane = ["win_start", "win_end", "seq", "kind", "count", "retracts", "watermark", "at_index", "own_pane", "opened_index"]
    assert rows(replay_by_log(log, ["seq"], config, batches), *pane) == rows(run_log(log, config).panes, *pane)
    with pytest.raises(ValueError, match="fold"):
        panes_by_log(log, ["seq"], Config(100, 0, 0, "drop", "idle", WatermarkSpec("bounded", bound_ms=1)))
