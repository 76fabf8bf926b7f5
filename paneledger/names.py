"""Fixed values that results and messages are made of."""

from __future__ import annotations

LATE_POLICIES = ["drop", "update", "side-output"]
TERMINATIONS = ["idle", "flush"]
STRATEGY_NAMES = ["bounded", "bounded-naive", "percentile", "punctuated", "processing-time"]

ON_TIME = "on_time"
LATE_IN_BOUND = "late_in_bound"
TOO_LATE = "too_late"

OUTCOMES = ["complete", "revised", "unverifiable"]
UNVERIFIABLE_REASONS = [
    "watermark-never-reached",
    "lateness-bound-exceeded",
    "policy-discard",
    "unexplained-shortfall",
    "no-pane-after-close",
]
FINDING_CODES = [
    "watermark-overshoot",
    "watermark-regression",
    "silent-drop",
    "premature-close",
    "pane-count-mismatch",
    "pane-chain-broken",
    "unexplained-shortfall",
    "no-pane-after-close",
]

# The watermark after an end-of-stream flush. A watermark that has not advanced
# yet is NULL. Neither takes part in arithmetic.
END_OF_STREAM = 9223372036854775807
