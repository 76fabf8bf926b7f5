"""The jobs a user starts by name."""

from __future__ import annotations

from pyspark.sql import SparkSession

from paneledger.config import Config, WatermarkSpec
from paneledger.plans.run import Run, run_log
from paneledger.sources.logs import named_log
from paneledger.sources.ndjson import read_ndjson

CHECK_CONFIG = Config(10_000, 0, 5_000, "update", "idle", WatermarkSpec("bounded", bound_ms=2_000))


def run_named(spark: SparkSession, folder: str, name: str, config: Config | None = None) -> Run:
    """Run a named log; window and allowed lateness default to its own window size."""
    log = named_log(name)
    config = config or Config(log.window_ms, 0, log.window_ms, "update", "idle", WatermarkSpec("bounded", bound_ms=2_000))
    return run_log(log.load(spark, folder), config, list(log.order))


def check_ndjson(spark: SparkSession, path: str, config: Config = CHECK_CONFIG) -> Run:
    """Audit an event log in NDJSON; a bad line fails with its number."""
    return run_log(read_ndjson(spark, path).events, config)
