"""Time adapters, as SQL: everything inside the library is epoch milliseconds (BIGINT)."""

from __future__ import annotations


def epoch_ms(column: str, ntz: bool = False) -> str:
    """Epoch milliseconds of a TIMESTAMP, or of a TIMESTAMP_NTZ read as UTC
    (whatever the session time zone is)."""
    if ntz:
        return f"timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {column})"
    return f"unix_millis({column})"


def iso_ms(column: str) -> str:
    """Epoch milliseconds of an ISO-8601 text, NULL when it is not one."""
    return f"unix_millis(try_to_timestamp({column}))"


def seconds_ms(column: str) -> str:
    return f"CAST({column} * 1000 AS BIGINT)"
