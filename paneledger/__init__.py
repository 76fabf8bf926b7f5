"""Event-time windowing over out-of-order logs, and an audit of its results."""

from paneledger.config import Config, CustomWatermark, WatermarkSpec
from paneledger.operators.arrival import ArrivalIndex, index_log
from paneledger.plans.run import Run, run_log

__all__ = ["ArrivalIndex", "Config", "CustomWatermark", "Run", "WatermarkSpec", "index_log", "run_log"]
