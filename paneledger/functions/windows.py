"""Tumbling windows over epoch milliseconds: half-open, floored, offset-able.

All functions return SQL expressions, for ``selectExpr`` and ``F.expr``.
"""

from __future__ import annotations

from paneledger.config import require_int

# Fixed pattern of a window key: start and end may both be negative.
WINDOW_KEY_PATTERN = r"^(-?\\d+)-(-?\\d+)$"


def window_start(t: str, window_ms: int, offset_ms: int = 0) -> str:
    """Start of the window holding ``t``. Exact on BIGINT, floors below zero."""
    require_int("window_ms", window_ms, 1)
    require_int("offset_ms", offset_ms)
    return f"({t}) - pmod(({t}) - ({offset_ms}L), {window_ms}L)"


def window_end(start: str, window_ms: int) -> str:
    return f"({start}) + {window_ms}L"


def window_key(start: str, end: str) -> str:
    return f"concat_ws('-', {start}, {end})"


def parse_window_key(key: str) -> str:
    """``struct<win_start, win_end>`` of a window key; a malformed key fails the query."""
    part = f"CAST(regexp_extract({key}, '{WINDOW_KEY_PATTERN}', {{}}) AS BIGINT)"
    return (
        f"CASE WHEN {key} RLIKE '{WINDOW_KEY_PATTERN}' "
        f"THEN named_struct('win_start', {part.format(1)}, 'win_end', {part.format(2)}) "
        f"ELSE raise_error(concat('not a window key: ', coalesce({key}, 'null'))) END"
    )
