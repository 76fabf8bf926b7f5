"""Run configuration. Everything is checked here, before any Spark job starts."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame

from paneledger.names import LATE_POLICIES, STRATEGY_NAMES, TERMINATIONS


def require_int(name: str, value: Any, minimum: int | None = None) -> int:
    if isinstance(value, bool) or not isinstance(value, int):
        raise ValueError(f"{name} must be an integer, got {value!r}")
    if minimum is not None and value < minimum:
        wanted = {0: "zero or more", 1: "a positive integer"}.get(minimum, f"at least {minimum}")
        raise ValueError(f"{name} must be {wanted}, got {value}")
    return value


def require_fraction(name: str, value: Any) -> float:
    if isinstance(value, bool) or not isinstance(value, (int, float)) or not 0 <= value <= 1:
        raise ValueError(f"{name} must be a number between 0 and 1, got {value!r}")
    return float(value)


def require_choice(name: str, value: Any, allowed: list[str]) -> str:
    if value not in allowed:
        raise ValueError(f"unknown {name} {value!r}; known: {', '.join(allowed)}")
    return value


@dataclass(frozen=True)
class WatermarkSpec:
    """Which watermark strategy to use, and its parameters.

    Only the parameters of the named strategy are read: ``bound_ms`` (bounded,
    bounded-naive), ``percentile``/``sample_size``/``floor_ms`` (percentile),
    ``every_n`` (punctuated), ``ms_per_event``/``origin_ms`` (processing-time).
    """

    name: str = "bounded"
    bound_ms: int = 0
    percentile: float = 0.99
    sample_size: int = 512
    floor_ms: int = 0
    every_n: int = 64
    ms_per_event: int = 1
    origin_ms: int | None = None

    def __post_init__(self) -> None:
        require_choice("watermark strategy", self.name, STRATEGY_NAMES)
        require_int("bound_ms", self.bound_ms, 0)
        require_fraction("percentile", self.percentile)
        require_int("sample_size", self.sample_size, 1)
        require_int("floor_ms", self.floor_ms, 0)
        require_int("every_n", self.every_n, 1)
        require_int("ms_per_event", self.ms_per_event, 0)
        if self.origin_ms is not None:
            require_int("origin_ms", self.origin_ms)

    @property
    def monotonic(self) -> bool:
        """Whether the strategy promises a raw watermark that never falls."""
        return self.name in ("bounded", "bounded-naive", "processing-time")

    def describe(self) -> str:
        return {
            "bounded": f"highest event time - {self.bound_ms} ms - 1",
            "bounded-naive": f"highest event time - {self.bound_ms} ms",
            "percentile": (
                f"highest event time - p{round(self.percentile * 100)} of the last "
                f"{self.sample_size} lateness values (at least {self.floor_ms} ms) - 1"
            ),
            "punctuated": f"lowest event time of each {self.every_n} events - 1",
            "processing-time": f"origin + {self.ms_per_event} ms per arrived event, event times unread",
        }[self.name]


@dataclass(frozen=True)
class CustomWatermark:
    """A strategy of the user's own.

    ``raw`` takes the indexed rows (log_id, i, t, max_seen, max_before, first_t, ...)
    and returns them with ``raw``, what the strategy says after the event; the engine
    makes the emitted watermark of it, its running maximum. ``monotonic`` promises
    that it never falls, which the audit holds it to.
    """

    name: str
    raw: Callable[[DataFrame], DataFrame]
    monotonic: bool = False
    text: str = ""

    def __post_init__(self) -> None:
        if self.name in STRATEGY_NAMES or not callable(self.raw):
            raise ValueError(f"a watermark of one's own needs a new name and a function, got {self.name!r}, {self.raw!r}")

    def describe(self) -> str:
        return self.text or self.name


@dataclass(frozen=True)
class Config:
    window_ms: int = 60_000
    offset_ms: int = 0
    allowed_lateness_ms: int = 0
    late_policy: str = "update"
    termination: str = "idle"
    watermark: WatermarkSpec | CustomWatermark = field(default_factory=WatermarkSpec)

    def __post_init__(self) -> None:
        require_int("window_ms", self.window_ms, 1)
        require_int("offset_ms", self.offset_ms)
        require_int("allowed_lateness_ms", self.allowed_lateness_ms, 0)
        require_choice("late policy", self.late_policy, LATE_POLICIES)
        require_choice("termination", self.termination, TERMINATIONS)
        if not isinstance(self.watermark, (WatermarkSpec, CustomWatermark)):
            raise ValueError(f"watermark must be a WatermarkSpec, got {self.watermark!r}")

    @classmethod
    def lenient(cls, raw: dict[str, Any], default: Config | None = None) -> Config:
        """A configuration from untrusted settings: a value that cannot be used
        falls back to the default, a number out of range is clamped."""
        base = default or cls(window_ms=5_000, allowed_lateness_ms=6_000, watermark=WatermarkSpec(bound_ms=1_000))

        def number(key: str, fallback: int, low: int) -> int:
            try:
                value = float(raw.get(key, fallback))
            except (TypeError, ValueError):
                return fallback
            return max(low, math.floor(value + 0.5)) if math.isfinite(value) else fallback

        def choice(key: str, fallback: str, allowed: list[str]) -> str:
            return raw[key] if raw.get(key) in allowed else fallback

        bound = number("bound", base.watermark.bound_ms, 0)
        return cls(
            window_ms=number("window", base.window_ms, 1),
            offset_ms=base.offset_ms,
            allowed_lateness_ms=number("lateness", base.allowed_lateness_ms, 0),
            late_policy=choice("policy", base.late_policy, LATE_POLICIES),
            termination=choice("termination", base.termination, TERMINATIONS),
            watermark=WatermarkSpec(
                choice("watermark", base.watermark.name, STRATEGY_NAMES),
                bound_ms=bound, floor_ms=bound, ms_per_event=1_000,
            ),
        )
