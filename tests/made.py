"""Logs made by rule: the demo log, and seeded out-of-order logs of any length."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from paneledger.config import Config, WatermarkSpec, require_fraction, require_int
from paneledger.operators.arrival import index_log
from paneledger.operators.scan import ordered_scan, running_sum
from paneledger.plans.commands import CHECK_CONFIG
from paneledger.plans.compare import control_sweep
from paneledger.plans.run import Run, run_log

# Fixed event times of the demo, in arrival order: one event inside the allowed
# lateness (3000) and one beyond it (the second 6000).
DEMO_TIMES = [
    0, 1000, 2000, 4000, 5000, 6000, 7000, 8000, 9000, 3000,
    10000, 11000, 12000, 13000, 14000, 15000, 17000, 18000, 6000,
]
DEMO_CONFIG = Config(5_000, 0, 6_000, "update", "idle", WatermarkSpec("bounded", bound_ms=1_000))


def demo_log(spark: SparkSession) -> DataFrame:
    rows = [("demo", i, t, i * 1_000, "demo") for i, t in enumerate(DEMO_TIMES)]
    return spark.createDataFrame(rows, "log_id string, seq bigint, t bigint, p bigint, k string")


def seeded_logs(
    spark: SparkSession, seeds: range, events: int, *, start_ms: int = 0, step_ms: int = 1_000, regular: bool = False,
    late_prob: float = 0.15, max_delay_slots: int = 8, keys: int = 1,
    burst_at: int = -1, burst_count: int = 0, burst_span_ms: int = 0,
) -> DataFrame:
    """One out-of-order log per seed, ``(log_id, arrival, seq, t, key)``; arrivals
    are ordered by (arrival, seq).

    Event times advance by exponential gaps of mean ``step_ms`` (or a regular grid),
    except in a burst; a fraction ``late_prob`` arrives up to about
    ``max_delay_slots`` positions late. Every draw is a hash of (seed, event,
    purpose), so a log is a pure function of its seed however Spark splits it.
    """
    require_int("events", events, 1)
    require_fraction("late_prob", late_prob)
    draw = lambda purpose: f"((xxhash64(seed, id, '{purpose}') & 1048575) + 0.5D) / 1048576D"
    burst_step = max(1, round(burst_span_ms / burst_count)) if burst_count else 0
    in_burst = f"id > {burst_at} AND id < {burst_at + burst_count}" if burst_at >= 0 else "false"
    gap = f"{step_ms}L" if regular else f"greatest(1L, CAST(round(-ln(1 - {draw('gap')}) * {step_ms}) AS BIGINT))"
    delay = f"1 + least({max_delay_slots}L, CAST(round(-ln(1 - {draw('delay')}) / 3 * {max_delay_slots}) AS BIGINT))"
    ids = spark.range(len(seeds) * events).selectExpr(
        f"{seeds.start} + {seeds.step} * (id DIV {events}) AS seed", f"id % {events} AS id")
    drawn = ids.selectExpr(
        "CAST(seed AS STRING) AS log_id", "id AS seq",
        f"CASE WHEN id = 0 THEN 0L WHEN {in_burst} THEN {burst_step}L ELSE {gap} END AS gap",
        f"id + CASE WHEN {draw('late')} < {late_prob} THEN {delay} ELSE 0L END AS arrival",
        f"concat('k', id % {keys}) AS key")
    timed = ordered_scan(drawn, ["log_id"], ["seq"], {"total": running_sum("total", "gap")}).rows
    return timed.selectExpr("log_id", "arrival", "seq", f"{start_ms}L + total AS t", "key")


def ordered_logs(spark: SparkSession, seeds: range, events: int, **spec: int) -> DataFrame:
    """Seeded logs with exactly zero lateness."""
    return seeded_logs(spark, seeds, events, late_prob=0, max_delay_slots=0, **spec)


def demo(spark: SparkSession) -> Run:
    return run_log(demo_log(spark), DEMO_CONFIG)


def run_seeded(spark: SparkSession, seeds: range, events: int, config: Config = CHECK_CONFIG, **spec: float) -> Run:
    """Run seeded out-of-order logs, all seeds in one job."""
    return run_log(seeded_logs(spark, seeds, events, **spec), config, ["arrival", "seq"])


def control(spark: SparkSession, seeds: range, events: int, step_ms: int = 700, config: Config = CHECK_CONFIG) -> DataFrame:
    """The negative control over seeded ordered logs."""
    return control_sweep(index_log(ordered_logs(spark, seeds, events, step_ms=step_ms), ["seq"]), config)
