"""Human-readable renderings, as SQL expressions."""

from __future__ import annotations

from paneledger.names import END_OF_STREAM

# Fixed multiplier that splits a double into two halves of at most 26 bits.
DOUBLE_SPLIT = "134217729D"


def _one_decimal(size: str, per: int) -> str:
    """``size / per`` to one decimal, rounded as the nearest double of the quotient
    demands: an exact half goes up only where that double is not below it."""
    tenths, twice_rest, quotient = f"(({size}) * 10 DIV {per})", f"(({size}) * 10 % {per} * 2)", f"(({size}) / {per}D)"
    high = f"({quotient} * {DOUBLE_SPLIT} - ({quotient} * {DOUBLE_SPLIT} - {quotient}))"
    not_below = f"({high} * 20D - ({tenths} * 2 + 1)) + ({quotient} - {high}) * 20D >= 0"
    up = f"CAST({twice_rest} > {per} OR ({twice_rest} = {per} AND {not_below}) AS BIGINT)"
    return f"concat_ws('.', ({tenths} + {up}) DIV 10, ({tenths} + {up}) % 10)"


def human_ms(ms: str) -> str:
    """A duration with one decimal in the largest unit that fits; the sign stays."""
    size = f"abs({ms})"
    in_unit = lambda per, suffix: f"concat(CASE WHEN {ms} < 0 THEN '-' ELSE '' END, {_one_decimal(size, per)}, '{suffix}')"
    return (
        f"CASE WHEN {size} < 1000 THEN concat({ms}, 'ms') WHEN {size} < 60000 THEN {in_unit(1_000, 's')} "
        f"WHEN {size} < 3600000 THEN {in_unit(60_000, 'm')} WHEN {size} < 86400000 THEN {in_unit(3_600_000, 'h')} "
        f"ELSE {in_unit(86_400_000, 'd')} END"
    )


def watermark_text(w: str) -> str:
    return (
        f"CASE WHEN {w} IS NULL THEN '-inf (never advanced)' "
        f"WHEN {w} = {END_OF_STREAM}L THEN '+inf (end of stream)' ELSE CAST({w} AS STRING) END"
    )


def lateness_text() -> str:
    """One line about a row of a lateness profile."""
    return (
        "concat(format_string('%d/%d out of order (%.2f%%), p50 ', out_of_order, events, out_of_order_pct), "
        f"{human_ms('p50')}, ', p99 ', {human_ms('p99')}, ', max ', {human_ms('max_lateness')})"
    )
