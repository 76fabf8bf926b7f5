
from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import expr

import oracle_queries
from paneledger import Config, Run, WatermarkSpec, index_log
from paneledger.functions import human_ms, parse_window_key, window_key
from paneledger.operators import audit
from paneledger.operators.arrival import EVENT_LATENESS, first_rows
from paneledger.operators.truth import batch_windows, stream_stats
from paneledger.plans import compare
from paneledger.plans.timeline import timeline
from paneledger.sinks.reports import run_fingerprint, write_ndjson
from paneledger.sources.feeds import archive_log, change_log
from paneledger.sources.logs import named_log
from paneledger.sources.ndjson import read_ndjson
from paneledger.streaming.fold import replay_in_batches
from paneledger.streaming.keyed import replay_by_log
from paneledger.workspace import new_path

HOUR = 3_600_000
BEFORE_1970 = 4_000_000_000_000
BOUNDED = WatermarkSpec("bounded", bound_ms=600_000)
PERCENTILE = WatermarkSpec("percentile", percentile=0.99, sample_size=512)
PUNCTUATED = WatermarkSpec("punctuated", every_n=64)

PANE = ["log_id", "win_start", "win_end", "seq", "kind", "count", "retracts", "watermark", "at_index"]
VERDICT = ["log_id", "win_start", "win_end", "outcome", "reason", "expected", "emitted", "panes", "receipted"]
MATRIX_LOGS = ["events", "events_in_order", "orders"]


def _index(spark: SparkSession, sf_dir: str, name: str = "events", keep: tuple[str, ...] = ()):
    log = named_log(name)
    return index_log(log.load(spark, sf_dir), list(log.order), list(keep))


def _config(spec: WatermarkSpec = BOUNDED, policy: str = "update", termination: str = "idle") -> Config:
    return Config(HOUR, 0, 2 * HOUR, policy, termination, spec)


def _run(spark: SparkSession, sf_dir: str, spec: WatermarkSpec = BOUNDED, policy: str = "update",
         termination: str = "idle", name: str = "events") -> Run:
    return Run(_index(spark, sf_dir, name), _config(spec, policy, termination))


def _users_in_order(spark: SparkSession, sf_dir: str):
    return index_log(named_log("events_by_user").load(spark, sf_dir), ["seq"])


def _watermark(spec: WatermarkSpec) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _run(spark, sf_dir, spec).judged.select("log_id", "i", "raw", "w_before", "w_after")


def _verdict(**options) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _run(spark, sf_dir, **options).verdict.select(*VERDICT)


def _panes(**options) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _run(spark, sf_dir, **options).panes.select(*PANE)


def tumbling_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch_windows(named_log("events").load(spark, sf_dir), HOUR).selectExpr(
        "log_id", "win_start", "win_end", f"{window_key('win_start', 'win_end')} AS window_key", "count")


def window_key_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = tumbling_count(spark, sf_dir).select("window_key")
    return keys.selectExpr("window_key", f"{parse_window_key('window_key')} AS w").selectExpr("window_key", "w.win_start", "w.win_end")


def ndjson_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events log written as NDJSON in arrival order, and read back by line."""
    log, path = named_log("events"), new_path(spark, "ndjson")
    write_ndjson(log.load(spark, sf_dir), path, list(log.order))
    return read_ndjson(spark, path, one_log=True).events.select("seq", "t", "p", "k")


def lateness_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_run(spark, sf_dir).lateness)


def _rounded(profile: DataFrame) -> DataFrame:
    return profile.selectExpr(*[
        "round(out_of_order_pct, 4) AS out_of_order_pct" if c == "out_of_order_pct" else c for c in profile.columns])


def window_fire(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir).crossed.selectExpr(
        "log_id", "win_start", "fire.index AS fire_index", "fire.watermark AS fire_watermark",
        "release.index AS release_index", "release.watermark AS release_watermark")


def profile_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.profile_matrix(compare.index_named(spark, sf_dir, MATRIX_LOGS))


def pane_chain_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panes of a job that retracts one too many at every fifth index."""
    altered = _run(spark, sf_dir).panes.selectExpr(
        "log_id", "win_start", "seq", "kind", "count",
        "CASE WHEN kind = 'revision' AND at_index % 5 = 0 THEN retracts + 1 ELSE retracts END AS retracts")
    return audit.pane_chain_findings(altered)


def audit_premature_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of a job that releases state as soon as a window ends."""
    run = _run(spark, sf_dir)
    altered = run.windows.where("collected").withColumn("collected_at_watermark", run.windows["win_end"])
    return audit.premature_close_findings(altered, run.config)


def audit_pane_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of a job that skips a revision wherever there were several."""
    run = _run(spark, sf_dir)
    altered = run.counts.selectExpr(
        "log_id", "win_start", "CASE WHEN late_in_bound > 1 THEN panes - 1 ELSE panes END AS panes",
        "fired", "late_in_bound", "opened_after_close")
    return audit.pane_count_findings(altered, run.config)


def audit_silent_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipts of a job that forgets a third of them."""
    run = _run(spark, sf_dir)
    kept = run.side_output.where("index % 3 <> 0")
    return audit.silent_drop_findings(audit.unaccounted_events(run.counts, run.truth, kept, run.config))


def missing_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events that such a job lost."""
    run = _run(spark, sf_dir)
    accounted = run.judged.where("cls <> 'too_late'").select("log_id", "i").unionByName(
        run.side_output.where("index % 3 <> 0").selectExpr("log_id", "index AS i"))
    return audit.missing_events(run.index.rows, accounted).select("log_id", "i", "t")


def _audited(run: Run, panes):
    return audit.audit_panes(panes, run.index.rows, run.side_output, run.trace, run.config)


def verdict_from_panes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict from what the run emitted, not from its own counts."""
    run = _run(spark, sf_dir)
    return _audited(run, run.panes).select(*VERDICT)


def findings_from_panes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the audit says of a job that loses every fifth window's panes and counts
    one event too few in the window after it."""
    run = _run(spark, sf_dir)
    altered = run.panes.where(f"win_start % {5 * HOUR} <> 0").withColumn("count", expr(f"count - CAST(win_start % {5 * HOUR} = {HOUR} AS BIGINT)"))
    return audit.window_findings(_audited(run, altered))


def foreign_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the tables of a job show whose watermark leaps three hours ahead at some events
    and falls back, and which gives up every fifth window as soon as it closes."""
    run = _run(spark, sf_dir)
    trace = run.trace.selectExpr("log_id", "index", f"watermark + IF(index % 50 = 7, {3 * HOUR}, 0) AS watermark")
    releases = run.crossed.selectExpr(
        "log_id", "win_start", f"IF(win_start % {5 * HOUR} = 0, fire.index, release.index) AS index").where("index IS NOT NULL")
    found = audit.audit_job(run.panes, run.index.rows, run.side_output, trace, run.config, releases).findings
    return found.where("code IN ('watermark-overshoot', 'watermark-regression', 'premature-close')")


def _opened_late(spark: SparkSession, sf_dir: str, policy: str) -> Run:
    """Windows of a minute, off the grid and before 1970: most have one event, and many
    get it only after they should have closed."""
    log = named_log("events").load(spark, sf_dir).selectExpr("log_id", f"t - {BEFORE_1970} AS t", "p", "seq")
    return Run(index_log(log, ["p", "seq"]), Config(60_000, 17_000, 2 * HOUR, policy, "idle", BOUNDED))


def replay_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same log indexed and run twice: rows of both, and rows only in one."""
    first, second = _run(spark, sf_dir), _run(spark, sf_dir)
    tables = [(name, getattr(first, name), getattr(second, name)) for name in ("panes", "side_output", "trace", "verdict")]
    return reduce(DataFrame.unionByName, [
        compare.same_rows(a, b).selectExpr(f"'{name}' AS table_name", "*") for name, a, b in tables])


def changed_panes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panes in which a run differs from a job that counts one event too many at
    every 97th index, named by both sides' hash trees."""
    panes = _run(spark, sf_dir).panes.select(*PANE)
    altered = panes.withColumn("count", expr("count + IF(at_index % 97 = 5, 1L, 0L)"))
    return compare.changed_rows(panes, altered)


def observed_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the write of the judged events tells of the run, as its metrics."""
    metrics = _run(spark, sf_dir, PERCENTILE).write_judged(new_path(spark, "judged"))
    return spark.createDataFrame([metrics], ", ".join(f"{name} bigint" for name in metrics))


def fingerprints_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of every table of a run, and whether a second run has the same fingerprint."""
    first, second = run_fingerprint(_run(spark, sf_dir)), run_fingerprint(_run(spark, sf_dir))
    return first.join(second.withColumnsRenamed({"rows": "rows_2", "fingerprint": "fingerprint_2"}), "table_name").selectExpr(
        "table_name", "rows", "rows = rows_2 AND fingerprint = fingerprint_2 AS equal")


def _with_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events log where some rows lack their time, log or place."""
    return named_log("events").load(spark, sf_dir).selectExpr(
        "IF(seq % 89 = 0, NULL, log_id) AS log_id", "IF(seq % 97 = 0, NULL, t) AS t", "IF(seq % 101 = 0, NULL, p) AS p", "seq", "seq AS event")


def rejected_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_log(_with_holes(spark, sf_dir), ["p", "seq"], ["event"]).rejects.select("event", "reason")


def verdict_with_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of that log, audited."""
    return Run(index_log(_with_holes(spark, sf_dir), ["p", "seq"]), _config()).summary


def ndjson_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events log with its times in seconds and fractions of them, read back to the millisecond."""
    log, path = named_log("events"), new_path(spark, "ndjson")
    write_ndjson(log.load(spark, sf_dir).selectExpr("log_id", "t / 1000 AS t", "p / 1000 AS p", "seq", "k"), path, list(log.order))
    return read_ndjson(spark, path, one_log=True, unit_ms=1_000, fraction="round").events.select("seq", "t", "p", "k")


def _written_in_order(rows: DataFrame, path: str, *folders: str) -> str:
    """Lines ``value`` in order of ``event_id``, in files that sort like them. A write into
    folders sorts by them, in place of any order but one that begins with the folders, and
    of these none may be null."""
    filled = rows.withColumns({folder: expr(f"coalesce({folder}, '')") for folder in folders})
    ordered = filled.repartitionByRange("event_id").sortWithinPartitions(*folders, "event_id").select("value", *folders)
    (ordered.write.partitionBy(*folders) if folders else ordered.write).text(path)
    return path


def feed_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as an hourly archive, one folder for every 50,000, read back in order."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(
        "event_id", "concat('2026-01-15-', event_id DIV 50000) AS hour",
        "to_json(named_struct('created_at', date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSS'Z'\"), 'type', event_type)) AS value")
    return archive_log(spark, _written_in_order(rows, new_path(spark, "archive"), "hour")).select("seq", "t", "k")


def feed_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a captured stream of server-sent events, with broken lines and other
    fields between them, read back in order."""
    log = named_log("events").load(spark, sf_dir)
    dt = "date_format(timestamp_millis(p), \"yyyy-MM-dd'T'HH:mm:ss.SSS'Z'\")"
    data = f"concat('data: ', to_json(named_struct('timestamp', t DIV 1000, 'meta', named_struct('dt', {dt}), 'server_name', k)))"
    rows = log.selectExpr("seq AS event_id", f"CASE seq % 50 WHEN 7 THEN 'data: {{broken' WHEN 8 THEN 'event: message' ELSE {data} END AS value")
    return change_log(spark, _written_in_order(rows, new_path(spark, "changes"))).select("seq", "t", "p", "k")


def _streamed(spark: SparkSession, sf_dir: str, spec: WatermarkSpec = BOUNDED, policy: str = "update", termination: str = "idle"):
    log = named_log("events")
    return replay_in_batches(log.load(spark, sf_dir), list(log.order), _config(spec, policy, termination), batches=4)


def _streamed_panes(**options) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _streamed(spark, sf_dir, **options).panes.select(*PANE)


# The training-data operators and their pipeline may be absent.
try:
    import corpus_pipeline
    from paneledger.llm import registry
except ImportError:
    registry = corpus_pipeline = None


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = dict(_log_queries())
    if registry is not None:
        found |= registry.queries() | {"pipeline": corpus_pipeline.run}
    return found


def _log_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "tumbling_count": tumbling_count,
        "window_key_roundtrip": window_key_roundtrip,
        "arrival_order": lambda s, d: _index(s, d).rows.select("log_id", "i", "t", "p", "seq"),
        "log_head": lambda s, d: first_rows(_index(s, d, keep=("k",)), 5_000).select("log_id", "i", "t", "k"),
        "ndjson_scan": ndjson_scan,
        "running_max": lambda s, d: _index(s, d).rows.select("log_id", "i", "max_seen"),
        "event_lateness": lambda s, d: _index(s, d).rows.selectExpr("log_id", "i", f"{EVENT_LATENESS} AS lateness_ms"),
        "human_duration": lambda s, d: _index(s, d).rows.selectExpr("log_id", "i", f"{human_ms(EVENT_LATENESS)} AS lateness"),
        "lateness_profile": lateness_profile,
        "stream_stats": lambda s, d: stream_stats(named_log("events").load(s, d)),
        "stream_catalog": lambda s, d: _rounded(compare.profile_streams(s, d)),
        "wm_bounded": _watermark(BOUNDED),
        "wm_bounded_naive": _watermark(WatermarkSpec("bounded-naive", bound_ms=600_000)),
        "wm_percentile": _watermark(PERCENTILE),
        "wm_punctuated": _watermark(PUNCTUATED),
        "wm_processing_time": _watermark(WatermarkSpec("processing-time", ms_per_event=HOUR)),
        "watermark_trace": lambda s, d: _run(s, d, termination="flush").trace,
        "watermark_health": lambda s, d: _run(s, d, PERCENTILE).health,
        "event_class": lambda s, d: _run(s, d).judged.select("log_id", "i", "t", "win_start", "cls"),
        "run_counters": lambda s, d: _run(s, d).counters,
        "run_counters_drop": lambda s, d: _run(s, d, policy="drop").counters,
        "window_state": lambda s, d: _run(s, d).windows,
        "window_fire": window_fire,
        "panes": _panes(),
        "panes_drop": _panes(policy="drop"),
        "panes_flush": _panes(termination="flush"),
        "side_output": lambda s, d: _run(s, d, policy="side-output").side_output,
        "timeline": lambda s, d: timeline(_run(s, d)),
        "verdict_windows": _verdict(),
        "verdict_summary": lambda s, d: _run(s, d).summary,
        "verdict_reasons": lambda s, d: _run(s, d).reasons,
        "verdict_drop": _verdict(policy="drop"),
        "verdict_side_output": _verdict(policy="side-output"),
        "verdict_flush": _verdict(termination="flush"),
        "verdict_percentile": _verdict(spec=PERCENTILE),
        "verdict_by_log": lambda s, d: _run(s, d, name="events_by_user").summary,
        "profile_matrix": profile_matrix,
        "retired_conditions": lambda s, d: compare.retired_conditions(profile_matrix(s, d)),
        "boundary_experiment": lambda s, d: compare.boundary_experiment(compare.index_named(s, d, ["events", "orders"])),
        "control_ordered": lambda s, d: _run(s, d, termination="flush", name="events_in_order").summary,
        "control_sweep": lambda s, d: compare.control_sweep(_users_in_order(s, d), _config()),
        "audit_overshoot": lambda s, d: audit.overshoot_findings(
            _run(s, d, WatermarkSpec("processing-time", ms_per_event=HOUR)).health),
        "pane_chain_audit": pane_chain_audit,
        "audit_premature_close": audit_premature_close,
        "audit_pane_count": audit_pane_count,
        "audit_silent_drop": audit_silent_drop,
        "missing_events": missing_events,
        "run_fingerprint": fingerprints_equal,
        "verdict_from_panes": verdict_from_panes,
        "findings_from_panes": findings_from_panes,
        "rejected_events": rejected_events,
        "verdict_with_rejects": verdict_with_rejects,
        "feed_archive": feed_archive,
        "feed_changes": feed_changes,
        "ndjson_seconds": ndjson_seconds,
        "replay_equal": replay_equal,
        "foreign_findings": foreign_findings,
        "pane_stream": lambda s, d: _run(s, d).emitted.select("pos", *PANE),
        "pane_stream_flush": lambda s, d: _run(s, d, termination="flush").emitted.select("pos", *PANE),
        "changed_panes": changed_panes,
        "observed_counters": observed_counters,
        "window_state_opened_late": lambda s, d: _opened_late(s, d, "update").windows,
        "panes_opened_late": lambda s, d: _opened_late(s, d, "update").panes.select(*PANE),
        "panes_drop_opened_late": lambda s, d: _opened_late(s, d, "drop").panes.select(*PANE),
        "streaming_panes": _streamed_panes(),
        "streaming_by_log": lambda s, d: replay_by_log(
            named_log("events_by_user").load(s, d), ["p", "seq"], _config(), batches=3).select(*PANE),
        "streaming_percentile": _streamed_panes(spec=PERCENTILE),
        "streaming_punctuated": _streamed_panes(spec=PUNCTUATED),
        "streaming_drop": _streamed_panes(policy="drop"),
        "streaming_flush": _streamed_panes(termination="flush"),
        "streaming_receipts": lambda s, d: _streamed(s, d, policy="side-output").side_output,
        "streaming_side_output": lambda s, d: _streamed(s, d).side_output,
    }


def oracle_sql() -> dict[str, str]:
    found = dict(oracle_queries.statements())
    if registry is not None:
        found |= registry.oracle_sql()
        found |= {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    return found


def entry(spark: SparkSession) -> DataFrame:
    """The flagship: what every window of the events log is worth."""
    return queries()["verdict_windows"](spark, "/root/testdata/sf0.001")
