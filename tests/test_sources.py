from __future__ import annotations

import gzip
import json

import pytest

from paneledger import Config, WatermarkSpec, run_log
from paneledger.plans.commands import check_ndjson
from paneledger.plans.compare import same_rows
from paneledger.sinks.reports import lateness_lines, report_json, run_fingerprint, stale, write_ndjson, write_run
from paneledger.sources.feeds import archive_log, change_log, earthquake_log
from paneledger.sources.logs import named_log
from paneledger.sources.ndjson import NO_TIME, NOT_JSON, numbered_lines, read_ndjson
from made import control, ordered_logs, run_seeded, seeded_logs


def test_ndjson_reports_bad_lines_by_number(spark, tmp_path):
    path = tmp_path / "log.ndjson"
    lines = ['{"t": 5, "p": 7, "k": "a"}', "", "not json", '{"t": "5"}', '{"k": "no t"}', '{"t": 1.5}', "[1]",
             '  {"t": -3, "p": "x", "k": 4}  ', '{"t": 1e400}', '{"t": 9.0, "p": null}', "null"]
    path.write_text("\n".join(lines) + "\n")
    parsed = read_ndjson(spark, str(path), on_bad="quarantine")
    events = [(r.seq, r.t, r.p, r.k) for r in parsed.events.orderBy("seq").collect()]
    assert events == [(1, 5, 7, "a"), (8, -3, None, ""), (10, 9, None, "")]
    bad = {r.line: r.reason for r in parsed.bad_lines.collect()}
    assert bad == {3: NOT_JSON, 4: NO_TIME, 5: NO_TIME, 6: NO_TIME, 7: NO_TIME, 9: NO_TIME, 11: NO_TIME}
    with pytest.raises(ValueError, match=r"log.ndjson:3: not valid JSON"):
        read_ndjson(spark, str(path))


def test_ndjson_preflight(spark, tmp_path):
    with pytest.raises(ValueError, match="cannot read"):
        read_ndjson(spark, str(tmp_path / "missing"))
    (tmp_path / "blank").write_text("\n  \n")
    with pytest.raises(ValueError, match="no events found"):
        read_ndjson(spark, str(tmp_path / "blank"))


def test_line_numbers_survive_file_splits(spark, tmp_path):
    path = tmp_path / "long.txt"
    path.write_text("".join(f"{i} {'x' * (i % 50)}\n" for i in range(1, 4001)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        lines = numbered_lines(spark, str(path), blocks=5)
        assert lines.where("line <> CAST(split(value, ' ')[0] AS BIGINT)").count() == 0
        assert lines.count() == 4000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_check_ndjson_and_round_trip(spark, tmp_path):
    source = tmp_path / "in.ndjson"
    source.write_text("".join(f'{{"t": {t}, "p": null, "k": "e"}}\n' for t in [*range(0, 50_000, 1000), 2000]))
    run = check_ndjson(spark, str(source))
    summary = run.summary.first()
    assert (run.counters.first().total, summary.findings, summary.clean) == (51, 0, True)
    log = read_ndjson(spark, str(source)).events
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "7")
    write_ndjson(log, str(tmp_path / "out"), ["seq"])
    spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    assert len(list((tmp_path / "out").glob("part*"))) > 5
    again = read_ndjson(spark, str(tmp_path / "out"), one_log=True).events
    diff = same_rows(log.select("seq", "t", "p", "k"), again.select("seq", "t", "p", "k")).first()
    assert (diff.left_rows, diff.only_left, diff.only_right) == (51, 0, 0)


def test_feeds(spark, tmp_path):
    archive = tmp_path / "hour.json.gz"
    with gzip.open(archive, "wt") as out:
        for second in (3, 1, 2):
            out.write(json.dumps({"created_at": f"2026-01-15T03:00:0{second}Z", "type": "PushEvent"}) + "\n")
    rows = [(r.seq, r.t % 60_000, r.p, r.k) for r in archive_log(spark, str(archive), first=2).orderBy("seq").collect()]
    assert rows == [(0, 3000, None, "PushEvent"), (1, 1000, None, "PushEvent")]

    quakes = tmp_path / "month.geojson"
    quakes.write_text(json.dumps({"features": [
        {"properties": {"time": 50, "updated": 90, "net": "us"}}, {"properties": {"time": 10, "updated": 70, "net": "ci"}},
        {"properties": {"time": 5, "updated": 90, "net": "ak"}}, {"properties": {"time": None, "updated": 1, "net": "x"}}]}))
    rows = [(r.seq, r.t, r.p, r.k) for r in earthquake_log(spark, str(quakes)).orderBy("seq").collect()]
    assert rows == [(0, 10, 70, "ci"), (1, 5, 90, "ak"), (2, 50, 90, "us")]

    changes = tmp_path / "capture.txt"
    data = [{"timestamp": 100, "meta": {"dt": "1970-01-01T00:01:41.5Z"}, "server_name": "en"},
            {"timestamp": 99, "meta": {"dt": "1970-01-01T00:01:42Z"}}, {"timestamp": 98, "meta": {}}]
    changes.write_text("event: message\n" + "".join(f"data: {json.dumps(d)}\n" for d in data) + "data: {oops\n")
    rows = [(r.seq, r.t, r.p, r.k) for r in change_log(spark, str(changes)).orderBy("seq").collect()]
    assert rows == [(0, 100_000, 101_500, "en"), (1, 99_000, 102_000, "unknown")]


def test_seeded_logs_are_pure_and_late(spark):
    spec = dict(step_ms=1000, late_prob=0.2, max_delay_slots=20, burst_at=120, burst_count=80, burst_span_ms=4000)
    log = seeded_logs(spark, range(1, 4), 300, **spec)
    again = seeded_logs(spark, range(1, 4), 300, **spec).repartition(5)
    diff = same_rows(log, again).first()
    assert (diff.left_rows, diff.only_left, diff.only_right) == (900, 0, 0)
    late = log.selectExpr("avg(CAST(arrival > seq AS INT)) AS late", "max(arrival - seq) AS most").first()
    assert 0.1 < late.late < 0.3 and 1 < late.most <= 21
    burst = log.where("seq BETWEEN 120 AND 199").groupBy("log_id").agg({"t": "max", "seq": "count"}).count()
    assert burst == 3
    spans = log.where("seq BETWEEN 120 AND 199").groupBy("log_id").agg({"t": "max"}).join(
        log.where("seq = 120").selectExpr("log_id", "t AS t0"), "log_id").selectExpr("`max(t)` - t0 AS span").collect()
    assert {r.span for r in spans} == {79 * 50}


def test_sweep_detects_the_planted_strategy_and_spares_the_control(spark):
    config = Config(10_000, 0, 5_000, "update", "idle", WatermarkSpec("processing-time", ms_per_event=1_000))
    spec = dict(late_prob=0.2, max_delay_slots=20, burst_at=120, burst_count=80, burst_span_ms=4000)
    planted = run_seeded(spark, range(1, 41), 300, config, **spec)
    honest = run_seeded(spark, range(1, 41), 300, **spec)
    assert planted.findings.where("code = 'watermark-overshoot'").select("log_id").distinct().count() == 40
    assert honest.findings.count() == 0


def test_negative_control(spark):
    assert ordered_logs(spark, range(1, 3), 50, step_ms=700).where("arrival <> seq").count() == 0
    row = control(spark, range(1, 31), 120).first()
    assert (row.logs, row.revised, row.unverifiable, row.findings) == (30, 0, 0, 0)
    assert (row.idle_findings, row.idle_tail_only) == (0, 30)


def test_reports(spark, make_log, tmp_path):
    config = Config(4_000, 0, 4_000, "update", "flush", WatermarkSpec("bounded", bound_ms=0))
    run = run_log(make_log([*range(0, 8_000, 1_000), 500]), config)
    write_run(run, str(tmp_path / "run"))
    trace = [json.loads(line) for part in sorted((tmp_path / "run/trace").glob("part*")) for line in part.read_text().splitlines()]
    assert trace[-1] == {"log_id": "log", "index": 9, "watermark": "+inf"}
    other = run_log(make_log([*range(0, 8_000, 1_000), 500]), config)
    prints = lambda r: sorted(map(tuple, run_fingerprint(r).collect()))
    assert prints(run) == prints(other) != prints(run_log(make_log([*range(0, 8_000, 1_000), 400]), config))
    assert json.loads(report_json(run.counters).first().report)["total"] == 9
    assert lateness_lines(run.lateness).first().lateness == "1/9 out of order (11.11%), p50 0ms, p99 6.5s, max 6.5s"
    run.counts.write.parquet(str(tmp_path / "profile"))
    assert stale(run.counts, str(tmp_path / "profile")).first().only_left == 0


def test_named_logs():
    with pytest.raises(ValueError, match="known: events, events_in_order, events_by_user, orders"):
        named_log("nope")
